"""Keyed joins and set operations.

Panels are joined on (grid_id, date) after both sides are collapsed to one row
per key, so the join's exchange reuses the aggregation's hash partitioning.
Nothing is force-broadcast here except lookup tables whose size is fixed by
construction; everything else is left to the size-checked automatic broadcast /
AQE.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def left_join_suffixed(base: DataFrame, right: DataFrame, keys=("grid_id", "date"), suffix="_gee") -> DataFrame:
    """base LEFT JOIN right on keys; right columns that clash with base get ``suffix``."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c in base.columns and c not in keys}
    r = right.withColumnsRenamed(clash) if clash else right
    return base.join(r, list(keys), "left")


def semi(df: DataFrame, keys_df: DataFrame, key="grid_id") -> DataFrame:
    return df.join(keys_df.select(key), key, "left_semi")


def anti(df: DataFrame, keys_df: DataFrame, key="grid_id") -> DataFrame:
    return df.join(keys_df.select(key), key, "left_anti")


def group_stat(df: DataFrame, value: str, keys=("grid_id",), stat="avg", name: str | None = None) -> DataFrame:
    """``groupby.transform``: the group statistic on every row (window over the key)."""
    fn = getattr(F, stat)
    return df.withColumn(name or f"{value}_{stat}", fn(value).over(Window.partitionBy(*keys)))


def common_keys(frames: list[DataFrame], keys=("grid_id", "date")) -> DataFrame:
    out = frames[0].select(*keys)
    for f in frames[1:]:
        out = out.intersect(f.select(*keys))
    return out


def distinct_first(df: DataFrame, key="grid_id", order="date", cols=("longitude", "latitude")) -> DataFrame:
    """One row per key with the first (by ``order``) values."""
    return df.groupBy(key).agg(*[F.min_by(c, F.col(order)).alias(c) for c in cols])


def global_rank(keys_df: DataFrame, key: str, out: str = "rank", partitions: int | None = None) -> DataFrame:
    """0-based rank of each distinct ``key`` in sort order, without a single-partition
    window: range-partition the keys, count rows per range (one row per partition),
    prefix-sum those counts, and number rows inside each range."""
    spark = keys_df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (keys_df.select(key).distinct().repartitionByRange(n_parts, key)
                     .withColumn("__pid", F.spark_partition_id()))
    ranged = cut_lineage(ranged)  # files pin the range assignment, also when an executor is lost
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    # one row per range partition: the prefix sum, and the broadcast, are n_parts rows (fixed above)
    offsets = counts.select("__pid", F.coalesce(
        F.sum("__c").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("__off"))
    local = F.row_number().over(Window.partitionBy("__pid").orderBy(key)) - 1
    return (ranged.join(F.broadcast(offsets), "__pid")
                  .select(key, (F.col("__off") + local).alias(out)))
