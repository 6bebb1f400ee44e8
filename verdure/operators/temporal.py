"""Per-key temporal features.

Every expression shares one ``Window.partitionBy(keys).orderBy(date)`` spec, so
a whole feature block plans to a single shuffle by key and one Window node.
Windows are positional (rows), like the reference; a cell's rows are bounded by
its number of months, so no partition grows with the data volume.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.wavelet import full_series_sql
from ..functions.wavelet import approx_sql


def order_window(keys, order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def lag_exprs(cols, lags, keys=("grid_id",), calendar: bool = False) -> dict[str, Column]:
    """Value ``k`` rows before, or with ``calendar`` the value of the month exactly ``k`` months before (NULL where that
    month is missing): a range frame over the month number, no month spine."""
    if calendar:
        w = Window.partitionBy(*keys).orderBy(F.year("date") * 12 + F.month("date"))
        return {f"{c}_lag_{k}": F.max(c).over(w.rangeBetween(-k, -k)) for c in cols for k in lags}
    w = order_window(keys)
    return {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in lags}


def roll_mean_past_exprs(cols, windows, keys=("grid_id",)) -> dict[str, Column]:
    """Mean of the previous k rows, current row excluded, min 1 row."""
    w = order_window(keys)
    return {f"{c}_roll_{k}": F.avg(c).over(w.rowsBetween(-k, -1)) for c in cols for k in windows}


def roll_mean_incl_exprs(cols, k=3, keys=("grid_id",), suffix="roll") -> dict[str, Column]:
    w = order_window(keys)
    return {f"{c}_{suffix}_{k}": F.avg(c).over(w.rowsBetween(-(k - 1), 0)) for c in cols}


def roll_std_past_exprs(cols, windows, keys=("grid_id",)) -> dict[str, Column]:
    """Sample std of the previous k rows, min 2 rows (stddev_samp of 1 row is NULL)."""
    w = order_window(keys)
    return {f"{c}_std_{k}": F.stddev_samp(c).over(w.rowsBetween(-k, -1)) for c in cols for k in windows}


def roll_sum_exprs(cols, windows, keys=("grid_id",)) -> dict[str, Column]:
    w = order_window(keys)
    return {f"{c}_sum_{k}": F.sum(c).over(w.rowsBetween(-(k - 1), 0)) for c in cols for k in windows}


def lead_exprs(col, horizons, keys=("grid_id",), prefix="target_vhi_h") -> dict[str, Column]:
    w = order_window(keys)
    return {f"{prefix}{h}": F.lead(col, h).over(w) for h in horizons}


def add_wavelet_causal(df: DataFrame, cols, keys=("grid_id",), window: int = K.WAVELET_WINDOW) -> DataFrame:
    """``<c>_wavelet_approx/detail``: db4 low band of the last <= 12 values of the
    one-step-shifted series (first row back-filled), evaluated at its newest
    sample.  Two Window nodes over the same partitioning, zero extra shuffles."""
    w = order_window(keys)
    # a back-fill only applies before the first non-null value, where it equals the
    # first non-null of the whole key: one aggregate per key instead of a
    # shrinking following-frame per row
    whole_ahead = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shifted = {}
    for c in cols:
        prev = F.lag(c, 1).over(w)
        shifted[f"__s_{c}"] = prev
    df = df.withColumns(shifted)
    filled = {}
    for c in cols:
        s = f"__s_{c}"
        filled[s] = F.coalesce(F.last(s, ignorenulls=True).over(upto),
                               F.first(s, ignorenulls=True).over(whole_ahead))
    df = df.withColumns(filled)
    # history lags as plain columns (one Window node), then the projection is a
    # cheap codegen'd expression over those columns
    lags = {"__n": F.least(F.row_number().over(w), F.lit(window))}
    for c in cols:
        for k in range(1, window):
            lags[f"__h{k}_{c}"] = F.lag(f"__s_{c}", k).over(w)
    df = df.withColumns(lags)
    out = {}
    for c in cols:
        hist = [f"__s_{c}"] + [f"__h{k}_{c}" for k in range(1, window)]
        approx = F.expr(approx_sql(hist, "__n", double_suffix="D"))
        out[f"{c}_wavelet_approx"] = approx
        out[f"{c}_wavelet_detail"] = F.col(f"__s_{c}") - approx
    df = df.withColumns(out)
    return df.drop("__n", *[f"__s_{c}" for c in cols], *[f"__h{k}_{c}" for c in cols for k in range(1, window)])


def ffill_bfill(df: DataFrame, cols, keys=("grid_id",)) -> DataFrame:
    """Forward then backward fill per key (ordered by date).  The back-fill only
    reaches rows before the first non-null, so it is the key's first non-null
    value (whole-key frame, computed once per key)."""
    w = order_window(keys)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(upto),
                                         F.first(c, ignorenulls=True).over(ahead)) for c in cols})


def interpolate(df: DataFrame, cols, keys=("grid_id",), order: str = "date") -> DataFrame:
    """Linear interpolation on row position per key; edges take the nearest value
    (pandas ``interpolate(limit_direction='both')`` applied per key)."""
    w = order_window(keys)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # "next non-null" as a running frame in descending date order: one extra sort
    # inside the same partitioning instead of re-aggregating a following frame per row
    ahead = (Window.partitionBy(*keys).orderBy(F.col(order).desc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("__pos", F.row_number().over(w))
    new = {}
    for c in cols:
        pv = F.struct(F.col("__pos").alias("p"), F.col(c).alias("v"))
        tagged = F.when(F.col(c).isNotNull(), pv)
        new[f"__prev_{c}"] = F.last(tagged, ignorenulls=True).over(upto)
        new[f"__next_{c}"] = F.last(tagged, ignorenulls=True).over(ahead)
    df = df.withColumns(new)
    out = {}
    for c in cols:
        p, nx = F.col(f"__prev_{c}"), F.col(f"__next_{c}")
        frac = (F.col("__pos") - p["p"]) / (nx["p"] - p["p"])
        out[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                  .when(p.isNull(), nx["v"])
                  .when(nx.isNull(), p["v"])
                  .otherwise(p["v"] + (nx["v"] - p["v"]) * frac))
    df = df.withColumns(out)
    return df.drop("__pos", *[f"__prev_{c}" for c in cols], *[f"__next_{c}" for c in cols])


def target_variants(df: DataFrame, keys=("grid_id",)) -> DataFrame:
    """vhi_smoothed_past = mean of the 3 previous VHI; residual = lag1 - smoothed;
    anomaly = lag1 - mean(lag1 over the calendar month) (NULL -> 0).
    The calendar-month mean is a grouped aggregate joined back (12 rows)."""
    w = order_window(keys)
    df = df.withColumns({
        "vhi_lag_1": F.lag("vhi", 1).over(w),
        "vhi_smoothed_past": F.avg("vhi").over(w.rowsBetween(-3, -1)),
    })
    month_mean = df.groupBy(F.month("date").alias("__m")).agg(F.avg("vhi_lag_1").alias("__mm"))
    df = df.join(F.broadcast(month_mean), F.month("date") == F.col("__m"), "left")
    return (df.withColumns({
        "vhi_residual_past": F.coalesce(F.col("vhi_lag_1") - F.col("vhi_smoothed_past"), F.lit(0.0)),
        "vhi_anomaly_past": F.coalesce(F.col("vhi_lag_1") - F.col("__mm"), F.lit(0.0)),
    }).drop("__m", "__mm"))


def latest_per_key(df: DataFrame, keys=("grid_id",), order="date") -> DataFrame:
    """Newest row per key (``tail(1)``): ``max_by`` aggregate, partial-agg friendly."""
    others = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("__r"))
    return agg.select(*keys, "__r.*")


def downsample_even(df: DataFrame, n_out: int = 120, keys=("grid_id",), order="date") -> DataFrame:
    """Up to ``n_out`` evenly spaced rows per key (linspace positions, rounded down)."""
    w = order_window(keys, order)
    cnt = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    df = df.withColumns({"__pos": F.row_number().over(w) - 1, "__n": cnt})
    # position i is kept when it equals floor(j*(n-1)/(n_out-1)) for some j; with n <= n_out keep all
    j = F.ceil(F.col("__pos") * (n_out - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    hit = F.floor(j * (F.col("__n") - 1) / (n_out - 1)) == F.col("__pos")
    keep = (F.col("__n") <= n_out) | hit
    return df.where(keep).drop("__pos", "__n")


def wavelet_full(df: DataFrame, cols, keys=("grid_id",), order="date") -> DataFrame:
    """Non-causal db4 approx/detail over each key's whole series (level 1, or 2 from 28 samples), as array expressions:
    a key's series (bounded by its months) is collected, sorted, transformed and taken apart again.
    Output: keys, date, <c>_wavelet_approx, <c>_wavelet_detail.  NULL counts as NaN."""
    cols = list(cols)
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(cols)]
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), *values))).alias("s"))
    smooth = series.select(*keys, "s", *[F.expr(full_series_sql(f"s.x{i}")).alias(f"a{i}") for i in range(len(cols))])
    rows = smooth.select(*keys, F.inline(F.arrays_zip("s", *[f"a{i}" for i in range(len(cols))])))
    out = [F.col("s.t").alias(order)]
    for i, c in enumerate(cols):
        out += [F.col(f"a{i}").alias(f"{c}_wavelet_approx"), (F.col(f"s.x{i}") - F.col(f"a{i}")).alias(f"{c}_wavelet_detail")]
    return rows.select(*keys, *out)
