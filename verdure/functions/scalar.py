"""Column-level helpers.  All are built-in Spark expressions (codegen friendly)."""
from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo=None, hi=None) -> Column:
    """Null-preserving clip.  ``greatest``/``least`` skip NULL, so they are not used."""
    c = col(c)
    out = c
    if lo is not None and hi is not None:
        return F.when(c < lo, F.lit(lo)).when(c > hi, F.lit(hi)).otherwise(c)
    if lo is not None:
        out = F.when(c < lo, F.lit(lo)).otherwise(c)
    if hi is not None:
        out = F.when(c > hi, F.lit(hi)).otherwise(c)
    return out


def r6(c) -> Column:
    """Round to 6 decimals the same way in Spark and DuckDB: scale, round half away
    from zero, unscale; ``+ 0.0`` folds a negative zero into zero."""
    return F.round(col(c) * 1e6) / 1e6 + F.lit(0.0)


def sentinel_to_null(c, sentinels=K.SENTINELS) -> Column:
    c = col(c)
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    for s in sentinels:
        bad = bad | (c == F.lit(s))
    return F.when(bad, F.lit(None).cast("double")).otherwise(c)


def severity_class_vhi(c) -> Column:
    """VHI 0-1 -> class 4 (extreme) .. 0 (none)."""
    c = col(c)
    t = K.VHI_THRESHOLDS
    return (F.when(c < t[0], 4).when(c < t[1], 3).when(c < t[2], 2).when(c < t[3], 1)
            .otherwise(0).cast("int"))


def _label_ladder(c, thresholds, ascending: bool) -> Column:
    labels = K.SEVERITY_LABELS
    c = col(c)
    if ascending:  # low value = bad (VHI)
        e = F.when(c < thresholds[0], labels[0])
        for th, lab in zip(thresholds[1:], labels[1:4]):
            e = e.when(c < th, lab)
    else:  # high value = bad (risk)
        e = F.when(c >= thresholds[0], labels[0])
        for th, lab in zip(thresholds[1:], labels[1:4]):
            e = e.when(c >= th, lab)
    return e.otherwise(labels[4])


def severity_label_vhi(c) -> Column:
    return _label_ladder(c, K.VHI_THRESHOLDS, ascending=True)


def severity_label_vhi100(c) -> Column:
    return _label_ladder(c, K.VHI100_THRESHOLDS, ascending=True)


def severity_label_risk(c) -> Column:
    return _label_ladder(c, K.RISK_THRESHOLDS, ascending=False)


def md5_bucket(*keys, seed: str = "") -> Column:
    """Deterministic pseudo-random integer in [0, 2^32) from md5 of seed||keys.
    The same value is produced in DuckDB by ('0x'||substr(md5(k),1,8))::BIGINT."""
    parts = [F.lit(seed)] + [col(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("bigint")


def season_of(m) -> Column:
    return F.floor((col(m) % 12) / 3).cast("int")


def normalized_difference(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(
        F.try_divide(a - b, a + b))
