"""Forecast metrics as grouped aggregates.

Each metric is a sum/avg per group (protocol, model, fold ...), so Spark runs
them as partial + final hash aggregates: a group holding a third of all rows is
still combined map-side.  The only two-pass metric, Willmott, needs the group
mean: a one-row-per-group table is joined back.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import clip, severity_class_vhi


def _g(group):
    return list(group) if group else []


def regression_metrics(df: DataFrame, group=("protocol", "model"), y="y_true", p="y_pred",
                       clip_pred: tuple | None = (0.0, 1.0), tol: float = 0.10, willmott: bool = True) -> DataFrame:
    """n, r2, rmse, mae, explained_variance, three MAPE variants (fractions), sMAPE,
    NSE, Willmott d, Pearson r, share within ``tol``.  One grouped aggregate; only Willmott needs the group means
    first (``willmott=False`` leaves it out, with its extra pass)."""
    g = _g(group)
    yp = clip(p, *clip_pred) if clip_pred else F.col(p)
    base = df.select(*g, F.col(y).alias("__y"), yp.alias("__p")).where(F.col("__y").isNotNull() & F.col("__p").isNotNull())
    if not willmott:
        joined = base.withColumn("__ym", F.lit(0.0))
    elif g:
        # one row per group; how it is joined is left to its size
        joined = base.join(base.groupBy(*g).agg(F.avg("__y").alias("__ym")), g, "inner")
    else:
        joined = base.withColumn("__ym", base.agg(F.avg("__y")).scalar())
    yv, pv, ym = F.col("__y"), F.col("__p"), F.col("__ym")
    err = pv - yv
    agg = joined.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(err * err).alias("__sse"),
        (F.var_pop(yv) * F.count(F.lit(1))).alias("__sst"),
        F.avg(F.abs(err)).alias("mae"),
        F.var_pop(yv - pv).alias("__var_res"),
        F.var_pop(yv).alias("__var_y"),
        F.avg(F.abs(clip(yv, 0.01, 1.0) - clip(pv, 0.01, 1.0)) / F.abs(clip(yv, 0.01, 1.0))).alias("mape"),
        F.avg(F.abs(err) / F.greatest(F.abs(yv), F.lit(1e-3))).alias("mape_floor"),
        F.avg(F.abs(err) / clip(F.abs(yv), 1.0, 100.0)).alias("mape_pct_scale"),
        F.avg(2 * F.abs(err) / F.greatest(F.abs(yv) + F.abs(pv), F.lit(0.01))).alias("smape"),
        F.sum(F.pow(F.abs(pv - ym) + F.abs(yv - ym), 2)).alias("__wd"),
        F.corr(yv, pv).alias("__corr"),
        F.stddev_pop(yv).alias("__sdy"),
        F.stddev_pop(pv).alias("__sdp"),
        F.avg((F.abs(err) <= tol).cast("double")).alias("within_tol"),
    )
    sse, sst = F.col("__sse"), F.col("__sst")
    out = agg.select(
        *g, "n",
        F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - sse / sst).alias("r2"),
        F.sqrt(sse / F.col("n")).alias("rmse"),
        "mae",
        F.when(F.col("__var_y") == 0, F.when(F.col("__var_res") == 0, 1.0).otherwise(0.0))
         .otherwise(1 - F.col("__var_res") / F.col("__var_y")).alias("explained_variance"),
        "mape", "mape_floor", "mape_pct_scale", "smape",
        (1 - sse / F.greatest(sst, F.lit(1e-12))).alias("nse"),
        (1 - sse / F.greatest(F.col("__wd"), F.lit(1e-12))).alias("willmott_index"),
        F.when((F.col("n") > 1) & (F.col("__sdy") > 0) & (F.col("__sdp") > 0), F.col("__corr"))
         .otherwise(0.0).alias("pearson_correlation"),
        "within_tol",
    )
    return out if willmott else out.drop("willmott_index")


def with_severity_classes(df: DataFrame, y="y_true", p="y_pred", clip_pred=(0.0, 1.0)) -> DataFrame:
    pv = clip(p, *clip_pred) if clip_pred else F.col(p)
    return df.withColumns({"true_class": severity_class_vhi(y), "pred_class": severity_class_vhi(pv)})


def severity_confusion(df: DataFrame, group=("protocol", "model"), y="y_true", p="y_pred",
                       clip_pred=(0.0, 1.0)) -> DataFrame:
    """5-class confusion counts (true_class, pred_class, n) per group."""
    g = _g(group)
    c = with_severity_classes(df.where(F.col(y).isNotNull() & F.col(p).isNotNull()), y, p, clip_pred)
    return c.groupBy(*g, "true_class", "pred_class").agg(F.count(F.lit(1)).alias("n"))


def severity_f1(confusion: DataFrame, group=("protocol", "model")) -> DataFrame:
    """accuracy, macro F1 and support-weighted F1 from confusion counts; classes =
    union of true and predicted classes; zero_division -> 0."""
    g = _g(group)
    tp = confusion.where(F.col("true_class") == F.col("pred_class")).select(
        *g, F.col("true_class").alias("cls"), F.col("n").alias("tp"))
    sup = confusion.groupBy(*g, F.col("true_class").alias("cls")).agg(F.sum("n").alias("support"))
    prd = confusion.groupBy(*g, F.col("pred_class").alias("cls")).agg(F.sum("n").alias("predicted"))
    per = (sup.join(prd, g + ["cls"], "full").join(tp, g + ["cls"], "left")
              .na.fill(0, ["tp", "support", "predicted"]))
    denom = F.col("support") + F.col("predicted")
    per = per.withColumn("f1", F.when(denom == 0, 0.0).otherwise(2 * F.col("tp") / denom))
    return per.groupBy(*g).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def compare_literature(metrics: DataFrame) -> DataFrame:
    L = K.LITERATURE
    return metrics.withColumns({
        "beats_r2": F.col("r2") > L["r2"],
        "beats_rmse": F.col("rmse") < L["rmse"],
        "beats_mae": F.col("mae") < L["mae"],
    })


def select_champion(metrics: DataFrame, within: str | None = "protocol") -> DataFrame:
    """Best row by (rmse, mae, -r2) — per ``within`` group (fixes the cross-protocol pick)."""
    from pyspark.sql import Window
    order = [F.col("rmse").asc(), F.col("mae").asc(), F.col("r2").desc(), F.col("model").asc()]
    if within:
        w = Window.partitionBy(within).orderBy(*order)
        return metrics.withColumn("__rk", F.row_number().over(w)).where("__rk = 1").drop("__rk")
    return metrics.orderBy(*order).limit(1)


def blend_weighted(a: Column, b: Column, w: float) -> Column:
    return clip(F.lit(w) * a + F.lit(1 - w) * b, 0.0, 1.0)


def claim_text(metrics: DataFrame) -> DataFrame:
    """``claim``: which literature metrics are beaten, and under what protocol (same-month estimation is said not to
    be forecasting); ``note``: what the protocol evaluates, NULL for one that is not known."""
    notes = F.create_map(*[x for k, v in K.PROTOCOL_NOTES.items() for x in (F.lit(k), F.lit(v))])
    fm = compare_literature(metrics)
    beaten = F.concat_ws(", ", F.when(F.col("beats_r2"), "r2"), F.when(F.col("beats_rmse"), "rmse"),
                         F.when(F.col("beats_mae"), "mae"))
    where = F.when(F.col("protocol") == K.SAME_MONTH_PROTOCOL, F.lit(" only under same-month estimation, not future forecasting."))
    claim = (F.when(beaten == "", F.lit("No literature metric beaten."))
             .otherwise(F.concat(F.lit("Beats literature on "), beaten, F.coalesce(where, F.concat(F.lit(" under "), "protocol", F.lit("."))))))
    return fm.withColumns({"claim": claim, "note": F.try_element_at(notes, F.col("protocol"))})


def average_folds(fold_metrics: DataFrame, group=("protocol", "model"), metrics=None) -> DataFrame:
    metrics = metrics or [c for c, t in fold_metrics.dtypes if t == "double"]
    return fold_metrics.groupBy(*group).agg(F.count(F.lit(1)).alias("folds"),
                                            *[F.avg(m).alias(m) for m in metrics])


def tidy(metrics: DataFrame, id_cols=("protocol", "model")) -> DataFrame:
    """Wide metrics -> (protocol, model, metric, value)."""
    vals = [c for c, t in metrics.dtypes if c not in id_cols and t in ("double", "bigint", "int")]
    return metrics.select(*id_cols, *[F.col(v).cast("double").alias(v) for v in vals]).unpivot(
        list(id_cols), vals, "metric", "value")
