"""Composed frames shared by queries, the flagship and the bench."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import constants as K
from ..operators import conform as C
from ..operators import indices as I
from ..operators import temporal as T
from ..sources import fixtures as FX


def indexed_panel(spark, d) -> DataFrame:
    """panel + proxy signals + VCI/TCI/VHI + SPI/SPEI + calendar."""
    p = C.proxy_fill(FX.spread(FX.panel(spark, d), d))
    p = I.add_vci_tci_vhi(p)
    p = I.add_spi_spei(p)
    return C.calendar(p)


def feature_panel(spark, d, signals=("ndvi", "lst", "rainfall", "vhi"), wavelet=True) -> DataFrame:
    """indexed panel + lags, past rolling mean/std, causal wavelet, h-step targets.
    All window expressions share partitionBy(grid_id).orderBy(date)."""
    p = indexed_panel(spark, d)
    sig = list(signals)
    exprs = {}
    exprs.update(T.lag_exprs(sig, K.LAGS))
    exprs.update(T.roll_mean_past_exprs(sig, K.ROLLING_WINDOWS))
    exprs.update(T.roll_std_past_exprs(sig, K.ROLLING_WINDOWS))
    exprs.update(T.lead_exprs("vhi", K.HORIZONS))
    p = p.withColumns(exprs)
    if wavelet:
        p = T.add_wavelet_causal(p, sig)
    return p
