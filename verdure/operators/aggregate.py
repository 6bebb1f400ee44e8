"""Grouped aggregations and reshapes (partial + final hash aggregates)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip
from ..session import cut_lineage
from .quantiles import grouped_quantiles

NUMERIC = {"double", "float", "int", "bigint", "smallint", "tinyint"}


def collapse_mean(df: DataFrame, keys=("grid_id", "date")) -> DataFrame:
    """Mean of every numeric column per key (one row per cell-month)."""
    num = [c for c, t in df.dtypes if t in NUMERIC and c not in keys]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in num])


def collapse_mixed(df: DataFrame, keys=("grid_id", "date"), order_col="source_file") -> DataFrame:
    """Mean for numeric columns, deterministic first (min_by ``order_col``) for the rest."""
    num = [c for c, t in df.dtypes if t in NUMERIC and c not in keys]
    other = [c for c, t in df.dtypes if t not in NUMERIC and c not in keys]
    aggs = [F.avg(c).alias(c) for c in num]
    aggs += [F.min_by(c, F.col(order_col)).alias(c) if c != order_col else F.min(c).alias(c) for c in other]
    return df.groupBy(*keys).agg(*aggs)


def region_month(df: DataFrame, cols: list[str], date_col="date") -> DataFrame:
    """Mean over all cells per date (the single-key series); partial aggregation
    means the one hot key per month is combined map-side."""
    return df.groupBy(date_col).agg(*[F.avg(c).alias(c) for c in cols])


def raster_pivot(df: DataFrame, value: str, lon_values: list[int], date_col="date") -> DataFrame:
    """lat x lon mean matrix per month; the lon set is bounded and passed explicitly."""
    piv = df.groupBy(date_col, "lat").pivot("lon", lon_values).agg(F.avg(value))
    return piv.select(date_col, "lat", *[F.col(str(v)).alias(f"lon_{v}") for v in lon_values])


def raster_long(df: DataFrame, channels: list[str], date_col="date") -> DataFrame:
    return df.select(date_col, "lat", "lon", *channels).unpivot([date_col, "lat", "lon"], channels, "channel", "value")


def raster_stretch(long_df: DataFrame, lo_q=0.02, hi_q=0.98, date_col="date") -> DataFrame:
    """Per (month, channel): NULL -> median, then (x - p2) / max(p98 - p2, 1e-6) clipped to [0, 1], percentiles of
    the filled values.  Quantiles by distributed selection: no task holds a whole month."""
    keys = [date_col, "channel"]
    med = grouped_quantiles(long_df, keys, [0.5]).select(*keys, F.col("q")[0].alias("__m"))
    x = long_df.join(med, keys, "left").withColumn("value", F.coalesce("value", "__m")).drop("__m")
    x = cut_lineage(x)
    q = grouped_quantiles(x, keys, [lo_q, hi_q]).select(*keys, F.col("q")[0].alias("__l"), F.col("q")[1].alias("__h"))
    x = x.join(q, keys, "left")
    return x.withColumn("value", clip((F.col("value") - F.col("__l")) / F.greatest(
        F.col("__h") - F.col("__l"), F.lit(1e-6)), 0.0, 1.0)).drop("__l", "__h")


def distinct_counts(df: DataFrame, key="grid_id", date_col="date") -> DataFrame:
    per = df.groupBy(key).agg(F.countDistinct(date_col).alias("__d"))
    med = per.agg(F.percentile("__d", 0.5).alias("median_dates_per_cell"))
    tot = df.agg(F.countDistinct(key).alias("n_cells"), F.countDistinct(date_col).alias("n_dates"))
    return tot.withColumn("median_dates_per_cell", med.scalar())
