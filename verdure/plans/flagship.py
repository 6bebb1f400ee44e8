"""Flagship: features -> next-month target -> protocol splits -> persistence and
wavelet-smoothed forecasts -> metrics per (protocol, model)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import md5_bucket
from ..operators import datasets as DS
from ..operators import metrics as M
from ..session import cut_lineage
from .frames import feature_panel


def forecast_predictions(spark, d):
    """Rows (protocol, model, grid_id, date, y_true, y_pred): chronological test
    split and spatial holdout, tagged in one pass (no union of two recomputations)."""
    f = (feature_panel(spark, d, signals=("vhi",), wavelet=True)
         .where(F.col("target_vhi_h1").isNotNull())
         .select("grid_id", "date", "vhi", "vhi_wavelet_approx", "target_vhi_h1"))
    cut = DS.date_quantile_cut(f, 0.8)
    chrono_test = F.unix_date("date") > cut
    spatial_test = md5_bucket("grid_id", seed="41") < F.lit(0.2 * DS.TWO32)
    tags = f.withColumns({
        "__a": F.when(chrono_test, F.lit("A_strict_chronological_future_forecasting")),
        "__d": F.when(spatial_test, F.lit("D_spatial_holdout"))})
    protocols = F.filter(F.array("__a", "__d"), lambda x: x.isNotNull())
    models = F.array(
        F.struct(F.lit("persistence").alias("model"), F.col("vhi").alias("y_pred")),
        F.struct(F.lit("wavelet_smooth").alias("model"),
                 F.coalesce(F.col("vhi_wavelet_approx"), F.col("vhi")).alias("y_pred")),
    )
    rows = tags.select("grid_id", "date", "vhi", "vhi_wavelet_approx", "target_vhi_h1",
                    F.explode(protocols).alias("protocol"))
    return rows.select("protocol", "grid_id", "date", F.col("target_vhi_h1").alias("y_true"), F.inline(models))


def flagship(spark, d):
    preds = cut_lineage(forecast_predictions(spark, d))  # three metric passes read these rows
    reg = M.regression_metrics(preds)
    f1 = M.severity_f1(M.severity_confusion(preds))
    return reg.join(f1, ["protocol", "model"])
