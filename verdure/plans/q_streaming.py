"""Registered query: streaming severity counters (extension), checked against
the batch answer."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.history import with_severity
from ..sources import fixtures as FX
from ..sources.readers import scratch_path
from ..streaming import history_stream as HS
from . import sqlfrag as S
from .registry import register


@register("stream_history_counters", S.with_(hist=S.HISTORY) + f"""
SELECT CAST(date_trunc('day', created_at) AS VARCHAR) AS window_start, {S.sev_label_risk('risk_score')} AS severity,
  count(*) AS n FROM hist GROUP BY 1, 2""")
def stream_history_counters(spark, d):
    hist = with_severity(FX.history(spark, d))
    src = HS.land_daily_files(hist, scratch_path(spark, "hist-stream"))
    sink = scratch_path(spark, "hist-counts")
    HS.run_counts(HS.severity_counts_stream(spark, src), sink, scratch_path(spark, "hist-ckpt"))
    out = HS.read_counts(spark, sink)
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "severity", "n")
