"""Exact quantiles without an unbounded single-task state.

Spark's exact ``percentile`` merges a map of every distinct value of a group in one final task,
which does not survive 100 TB of distinct doubles.  Here all ranks of all groups are found together
by distributed selection: every pass counts values in equal-width buckets of each rank's range
(partial aggregates, at most ``buckets`` rows a rank) and narrows the range to the [min, max] of the
bucket that holds the rank, until it is a single value.  A hot value resolves at once.  Results equal
linear-interpolated ``percentile`` / ``quantile_cont``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKETS = 1024


def grouped_quantiles(long: DataFrame, keys: list[str], probs: list[float], value: str = "value", buckets: int = BUCKETS) -> DataFrame:
    """``keys`` and ``q`` (array, one entry per probability) of every group with a non-null value."""
    x = long.select(*keys, F.col(value).cast("double").alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))

    def same(suffix):  # groups whose key is NULL are groups like others
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"__{suffix}_{k}"))
        return cond

    def renamed(df, suffix, *cols):
        return df.select(*[F.col(k).alias(f"__{suffix}_{k}") for k in keys], *cols)

    st = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("__n") - 1)).alias("h")) for i, q in enumerate(probs)])
    targets = cut_lineage(st.select(*keys, "__lo", "__hi", F.inline(wanted)))
    ranks = targets.select(*keys, "__lo", "__hi", F.explode(F.array_distinct(F.array(
        F.floor("h").cast("long"), F.ceil("h").cast("long")))).alias("__k")).distinct().withColumn("__below", F.lit(0).cast("long"))
    ranks = cut_lineage(ranks)
    while not ranks.where("__lo < __hi").isEmpty():
        open_ = renamed(ranks.where("__lo < __hi"), "o", "__k", "__lo", "__hi", "__below")
        inside = x.join(open_, same("o"))
        inside = inside.where((F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi")))
        width = (F.col("__hi") - F.col("__lo")) / buckets
        # a range too narrow to divide has two values left
        b = F.when(width > 0, F.least(F.floor((F.col("__x") - F.col("__lo")) / width), F.lit(buckets - 1))).otherwise(
            (F.col("__x") > F.col("__lo")).cast("long"))
        c = inside.groupBy(*keys, "__k", "__below", b.alias("__b")).agg(
            F.count(F.lit(1)).alias("__c"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        before = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys, "__k").orderBy("__b").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        c = c.withColumn("__below", F.col("__below") + before)
        found = c.where((F.col("__k") >= F.col("__below")) & (F.col("__k") < F.col("__below") + F.col("__c")))
        ranks = cut_lineage(ranks.where("__lo = __hi").select(*keys, "__k", "__lo", "__hi", "__below").unionByName(
            found.select(*keys, "__k", "__lo", "__hi", "__below")))
    r = renamed(ranks, "r", F.col("__k"), F.col("__lo").alias("__v"))
    j = targets.join(r, ((F.col("__k") == F.floor("h")) | (F.col("__k") == F.ceil("h"))) & same("r")).groupBy(*keys, "i", "h").agg(F.min("__v").alias("v0"), F.max("__v").alias("v1"))
    j = j.withColumn("v", F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("h") - F.floor("h")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
    return j.groupBy(*keys).agg(ordered.alias("q"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], buckets: int = BUCKETS) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of every column over all its non-null rows; all columns and ranks share each pass."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    rows = grouped_quantiles(long, ["column"], probs, buckets=buckets).collect()  # one row per column
    found = {r["column"]: list(r["q"]) for r in rows}
    return {c: found.get(c, [None] * len(probs)) for c in cols}


def exact_quantile(df: DataFrame, col: str, probs: list[float], buckets: int = BUCKETS) -> list[float | None]:
    return exact_quantiles(df, [col], probs, buckets)[col]
