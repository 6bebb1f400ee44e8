"""Drought indices: VCI / TCI / VHI, SPI / SPEI z-scores, rainfall anomaly, risk.

Per-key statistics are window aggregates over ``partitionBy(keys)`` so they
reuse the shuffle the temporal features need; per (key, calendar month)
statistics are satisfied by the same hash partitioning (a subset of keys), so
they add a sort, not an exchange.  Exact percentiles per key are bounded by the
number of months a cell has.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip
from .temporal import order_window


def whole_key(keys, order: str = "date"):
    """Whole-partition frame, ordered by date: same values as an unordered window,
    but it shares the (key, date) sort with the temporal windows (one sort, not two)."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def scaled_index(x: str, keys=("grid_id",), invert=False, scale: float = 1.0, fit_until: str | None = None) -> Column:
    """(x - q05) / max(q95 - q05, 1e-6), clipped to [0, 1] (times ``scale``);
    ``invert`` gives scale - value.  ``fit_until``: quantiles of the months up to that date only, so that later
    (test) months do not shape the index."""
    w = whole_key(keys)
    fitted = F.col(x) if fit_until is None else F.when(F.col("date") <= F.lit(fit_until).cast("date"), F.col(x))
    q = F.percentile(fitted, F.array(F.lit(0.05), F.lit(0.95))).over(w)
    lo, hi = q[0], q[1]
    v = clip((F.col(x) - lo) / F.greatest(hi - lo, F.lit(1e-6)) * scale, 0.0, scale)
    return (F.lit(scale) - v) if invert else v


def add_vci_tci_vhi(df: DataFrame, keys=("grid_id",), ndvi="ndvi", lst="lst", clip_vhi=True,
                    scale: float = 1.0, fit_until: str | None = None) -> DataFrame:
    df = df.withColumns({"vci": scaled_index(ndvi, keys, scale=scale, fit_until=fit_until),
                         "tci": scaled_index(lst, keys, invert=True, scale=scale, fit_until=fit_until)})
    vhi = 0.5 * F.col("vci") + 0.5 * F.col("tci")
    return df.withColumn("vhi", clip(vhi, 0.0, scale) if clip_vhi else vhi)


def zscore(x, keys=("grid_id",)) -> Column:
    """Clipped z-score over the key; 0 when the std is 0 or undefined."""
    w = whole_key(keys)
    xc = F.col(x) if isinstance(x, str) else x
    sd = F.stddev_samp(xc).over(w)
    mu = F.avg(xc).over(w)
    return F.when(sd.isNull() | (sd == 0), F.lit(0.0)).otherwise(clip((xc - mu) / sd, -3.0, 3.0))


def add_spi_spei(df: DataFrame, keys=("grid_id",), variant: str = "et") -> DataFrame:
    """spi = z(rain); spei = z(rain - 20*ET) (``variant='temp'``: rain - 2*max(temp, 0))."""
    if variant == "et":
        wb = F.col("rainfall") - F.col("evapotranspiration") * 20
    else:
        wb = F.col("rainfall") - clip("temperature", lo=0.0) * 2
    return df.withColumns({"spi": zscore("rainfall", keys), "spei": zscore(wb, keys)})


def zscore_by_key_month(x: Column, keys=("grid_id",), month_col="month") -> Column:
    """z-score within (key, calendar month); NULL/Inf/undefined -> 0; clip +-3."""
    w = Window.partitionBy(*keys, month_col)
    sd = F.stddev_samp(x).over(w)
    mu = F.avg(x).over(w)
    z = F.when(sd.isNull() | (sd == 0) | x.isNull(), F.lit(0.0)).otherwise((x - mu) / sd)
    return clip(z, -3.0, 3.0)


def add_climate_indices(df: DataFrame, rain="rainfall", et: str | None = "evapotranspiration",
                        keys=("grid_id",), windows=(1, 3, 6, 12)) -> DataFrame:
    """rainfall_anomaly = rain - mean(rain | key, calendar month);
    spi_k = z(rolling k-month rain sum | key, month); spei_k on rain_k - ET_k."""
    if "month" not in df.columns:
        df = df.withColumn("month", F.month("date"))
    w = order_window(keys)
    sums = {}
    for k in windows:
        sums[f"__r{k}"] = F.sum(rain).over(w.rowsBetween(-(k - 1), 0))
        if et and et in df.columns:
            sums[f"__e{k}"] = F.sum(et).over(w.rowsBetween(-(k - 1), 0))
    df = df.withColumns(sums)
    out = {"rainfall_anomaly": F.col(rain) - F.avg(rain).over(Window.partitionBy(*keys, "month"))}
    for k in windows:
        r = F.col(f"__r{k}")
        out[f"spi_{k}"] = zscore_by_key_month(r, keys)
        wb = r - F.col(f"__e{k}") if f"__e{k}" in df.columns else r
        out[f"spei_{k}"] = zscore_by_key_month(wb, keys)
    df = df.withColumns(out)
    return df.drop(*[c for c in df.columns if c.startswith("__r") or c.startswith("__e")])


def risk_target(ndvi="ndvi", rain="rainfall", lst="lst", soil="soil_moisture") -> Column:
    """100*(.35*clip(.75-ndvi) + .25*clip(1-rain/220) + .2*clip((lst-28)/18) + .2*clip(1-soil)), clip 0-100."""
    c = F.col
    r = (0.35 * clip(0.75 - c(ndvi), 0.0, 1.0) + 0.25 * clip(1 - c(rain) / 220, 0.0, 1.0)
         + 0.2 * clip((c(lst) - 28) / 18, 0.0, 1.0) + 0.2 * clip(1 - c(soil), 0.0, 1.0))
    return clip(r * 100, 0.0, 100.0)


def risk_fallback(ndvi="ndvi", rain="rainfall", lst="lst", soil="soil_moisture_proxy") -> Column:
    """35*max(0,.75-ndvi) + 25*max(0,1-rain/220) + 20*max(0,(lst-28)/18) + 20*(1-soil), clip 0-100."""
    c = F.col
    s = (35 * clip(0.75 - c(ndvi), lo=0.0) + 25 * clip(1 - c(rain) / 220, lo=0.0)
         + 20 * clip((c(lst) - 28) / 18, lo=0.0) + 20 * (1 - c(soil)))
    return clip(s, 0.0, 100.0)


def severity_score_col(vhi) -> Column:
    """clip(1 - VHI_h, 0, 1)."""
    v = F.col(vhi) if isinstance(vhi, str) else vhi
    return clip(1.0 - v, 0.0, 1.0)


def choose_source(df: DataFrame, local: str, remote: str) -> str:
    """Use ``remote`` when its non-null count exceeds half of ``local``'s (one-row aggregate)."""
    if remote not in df.columns:
        return local
    row = df.agg(F.count(remote).alias("r"), F.count(local).alias("l")).first()
    return remote if row["r"] > row["l"] * 0.5 else local
