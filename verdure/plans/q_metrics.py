"""Registered queries: forecast metrics over baseline predictions.

Predictions: y_true = next-month VHI per cell; models ``persistence`` (current
VHI) and ``smooth3`` (mean of the last 3 VHI incl. current); protocol = train /
test side of the chronological cut over the prediction rows.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import datasets as DS
from ..operators import metrics as M
from ..operators.temporal import order_window
from ..sources import readers as R
from . import sqlfrag as S
from .q_indices import VHI_SQL_CTE, vhi_panel
from .registry import register, rounded

W = "OVER (PARTITION BY grid_id ORDER BY date)"
DAYS = "date_diff('day', DATE '1970-01-01', date)"


def predictions(spark, d):
    w = order_window(["grid_id"])
    v = vhi_panel(spark, d).select(
        "grid_id", "date", F.lead("vhi", 1).over(w).alias("y_true"), "vhi",
        F.avg("vhi").over(w.rowsBetween(-2, 0)).alias("smooth3"))
    v = v.where(F.col("y_true").isNotNull())
    cut = DS.date_quantile_cut(v, 0.8)
    v = v.withColumn("protocol", F.when(F.unix_date("date") <= cut, "chrono_train").otherwise("chrono_test"))
    models = F.array(F.struct(F.lit("persistence").alias("model"), F.col("vhi").alias("y_pred")),
                     F.struct(F.lit("smooth3").alias("model"), F.col("smooth3").alias("y_pred")))
    return v.select("protocol", "grid_id", "date", "y_true", F.inline(models))


PRED_CTE = VHI_SQL_CTE + f""", pv AS (
  SELECT grid_id, date, lead(vhi, 1) {W} AS y_true, vhi,
    avg(vhi) OVER (PARTITION BY grid_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smooth3 FROM vhi),
pv2 AS (SELECT * FROM pv WHERE y_true IS NOT NULL),
pv3 AS (SELECT *, CASE WHEN {DAYS} <= (SELECT quantile_cont({DAYS}, 0.8) FROM pv2) THEN 'chrono_train' ELSE 'chrono_test' END AS protocol FROM pv2),
preds0 AS (SELECT protocol, grid_id, date, y_true, 'persistence' AS model, vhi AS y_pred FROM pv3 UNION ALL
           SELECT protocol, grid_id, date, y_true, 'smooth3' AS model, smooth3 AS y_pred FROM pv3),
preds AS (SELECT protocol, model, grid_id, date, y_true, {S.clip('y_pred', 0.0, 1.0)} AS y_pred FROM preds0),
gm AS (SELECT protocol, model, avg(y_true) AS ym FROM preds GROUP BY 1, 2),
agg AS (SELECT p.protocol, p.model, count(*) AS n, sum((y_pred - y_true) * (y_pred - y_true)) AS sse,
    var_pop(y_true) * count(*) AS sst, avg(abs(y_pred - y_true)) AS mae,
    var_pop(y_true - y_pred) AS var_res, var_pop(y_true) AS var_y,
    avg(abs({S.clip('y_true', 0.01, 1.0)} - {S.clip('y_pred', 0.01, 1.0)}) / abs({S.clip('y_true', 0.01, 1.0)})) AS mape,
    avg(abs(y_pred - y_true) / greatest(abs(y_true), 1e-3)) AS mape_floor,
    avg(abs(y_pred - y_true) / {S.clip('abs(y_true)', 1.0, 100.0)}) AS mape_pct_scale,
    avg(2 * abs(y_pred - y_true) / greatest(abs(y_true) + abs(y_pred), 0.01)) AS smape,
    sum(pow(abs(y_pred - ym) + abs(y_true - ym), 2)) AS wd, corr(y_true, y_pred) AS r,
    stddev_pop(y_true) AS sdy, stddev_pop(y_pred) AS sdp,
    avg(CASE WHEN abs(y_pred - y_true) <= 0.1 THEN 1.0 ELSE 0.0 END) AS within_tol
  FROM preds p JOIN gm ON p.protocol = gm.protocol AND p.model = gm.model GROUP BY 1, 2),
met AS (SELECT protocol, model, n,
    CASE WHEN sst = 0 THEN (CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - sse / sst END AS r2,
    sqrt(sse / n) AS rmse, mae,
    CASE WHEN var_y = 0 THEN (CASE WHEN var_res = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - var_res / var_y END AS explained_variance,
    mape, mape_floor, mape_pct_scale, smape, 1 - sse / greatest(sst, 1e-12) AS nse,
    1 - sse / greatest(wd, 1e-12) AS willmott_index,
    CASE WHEN n > 1 AND sdy > 0 AND sdp > 0 THEN r ELSE 0.0 END AS pearson_correlation, within_tol FROM agg)
"""


def _metrics(spark, d, willmott=False):
    return M.regression_metrics(predictions(spark, d), willmott=willmott)


def _sel(cols):
    return ", ".join(f"{S.r6(c)} AS {c}" for c in cols)


@register("met_regression", PRED_CTE + f"SELECT protocol, model, n, {_sel(['r2', 'rmse', 'mae', 'explained_variance'])} FROM met")
def met_regression(spark, d):
    return rounded(_metrics(spark, d).select("protocol", "model", "n", "r2", "rmse", "mae", "explained_variance"))


@register("met_mape_variants", PRED_CTE + f"SELECT protocol, model, {_sel(['mape', 'mape_floor', 'mape_pct_scale'])} FROM met")
def met_mape_variants(spark, d):
    return rounded(_metrics(spark, d).select("protocol", "model", "mape", "mape_floor", "mape_pct_scale"))


@register("met_smape_nse_willmott", PRED_CTE + f"SELECT protocol, model, {_sel(['smape', 'nse', 'willmott_index', 'pearson_correlation'])} FROM met")
def met_smape_nse_willmott(spark, d):
    return rounded(_metrics(spark, d, willmott=True).select("protocol", "model", "smape", "nse", "willmott_index", "pearson_correlation"))


@register("met_within_tol", PRED_CTE + f"SELECT protocol, model, {_sel(['within_tol'])} FROM met")
def met_within_tol(spark, d):
    return rounded(_metrics(spark, d).select("protocol", "model", "within_tol"))


CONF_SQL = PRED_CTE + f""", conf AS (SELECT protocol, model, {S.sev_class('y_true')} AS true_class, {S.sev_class('y_pred')} AS pred_class,
  count(*) AS n FROM preds GROUP BY 1, 2, 3, 4)
"""


@register("met_severity_confusion", CONF_SQL + "SELECT * FROM conf")
def met_severity_confusion(spark, d):
    return M.severity_confusion(predictions(spark, d))


@register("met_severity_f1", CONF_SQL + f""", tp AS (SELECT protocol, model, true_class AS cls, n AS tp FROM conf WHERE true_class = pred_class),
sup AS (SELECT protocol, model, true_class AS cls, sum(n) AS support FROM conf GROUP BY 1, 2, 3),
prd AS (SELECT protocol, model, pred_class AS cls, sum(n) AS predicted FROM conf GROUP BY 1, 2, 3),
per AS (SELECT coalesce(s.protocol, p.protocol) AS protocol, coalesce(s.model, p.model) AS model, coalesce(s.cls, p.cls) AS cls,
  coalesce(s.support, 0) AS support, coalesce(p.predicted, 0) AS predicted
  FROM sup s FULL JOIN prd p ON s.protocol = p.protocol AND s.model = p.model AND s.cls = p.cls),
per2 AS (SELECT per.*, coalesce(tp.tp, 0) AS tp FROM per LEFT JOIN tp ON per.protocol = tp.protocol AND per.model = tp.model AND per.cls = tp.cls),
per3 AS (SELECT *, CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1 FROM per2)
SELECT protocol, model, {S.r6('sum(tp) / sum(support)')} AS accuracy, {S.r6('avg(f1)')} AS f1_macro,
  {S.r6('sum(f1 * support) / sum(support)')} AS f1_weighted FROM per3 GROUP BY 1, 2""")
def met_severity_f1(spark, d):
    return rounded(M.severity_f1(M.severity_confusion(predictions(spark, d))))


L = K.LITERATURE
BEATS = f"r2 > {L['r2']} AS beats_r2, rmse < {L['rmse']} AS beats_rmse, mae < {L['mae']} AS beats_mae"


@register("met_compare_baseline", PRED_CTE + f"SELECT protocol, model, {BEATS} FROM met")
def met_compare_baseline(spark, d):
    return M.compare_literature(_metrics(spark, d)).select("protocol", "model", "beats_r2", "beats_rmse", "beats_mae")


@register("met_select_champion", PRED_CTE + f"""
SELECT protocol, model, {_sel(['rmse', 'mae', 'r2'])} FROM (
  SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY rmse, mae, r2 DESC, model) AS rk FROM met) WHERE rk = 1""")
def met_select_champion(spark, d):
    return rounded(M.select_champion(_metrics(spark, d)).select("protocol", "model", "rmse", "mae", "r2"))


@register("met_blend", PRED_CTE + f"""
SELECT protocol, grid_id, CAST(date AS VARCHAR) AS date, {S.r6('avg(y_pred)')} AS y_pred_mean,
  {S.r6(S.clip("0.6 * max(CASE WHEN model = 'persistence' THEN y_pred END) + 0.4 * max(CASE WHEN model = 'smooth3' THEN y_pred END)", 0.0, 1.0))} AS y_pred_weighted
FROM preds GROUP BY protocol, grid_id, date""")
def met_blend(spark, d):
    p = predictions(spark, d).withColumn("y_pred", F.when(F.col("y_pred") < 0, 0.0).when(F.col("y_pred") > 1, 1.0)
                                         .otherwise(F.col("y_pred")))
    out = p.groupBy("protocol", "grid_id", "date").agg(
        F.avg("y_pred").alias("y_pred_mean"),
        M.blend_weighted(F.max(F.when(F.col("model") == "persistence", F.col("y_pred"))),
                         F.max(F.when(F.col("model") == "smooth3", F.col("y_pred"))), 0.6).alias("y_pred_weighted"))
    return rounded(out)


REPORT_METRICS = ["r2", "rmse", "mae", "nse", "within_tol"]


@register("met_report_union", CONF_SQL.replace("WITH ", "WITH ", 1) + f""", f1 AS (
  SELECT protocol, model, sum(CASE WHEN true_class = pred_class THEN n ELSE 0 END) / sum(n) AS accuracy FROM conf GROUP BY 1, 2),
tidy AS ({' UNION ALL '.join(f"SELECT 'regression' AS report, protocol, model, '{m}' AS metric, {m} AS value FROM met" for m in REPORT_METRICS)}
  UNION ALL SELECT 'severity', protocol, model, 'accuracy', accuracy FROM f1)
SELECT report, protocol, model, metric, {S.r6('value')} AS value FROM tidy""")
def met_report_union(spark, d):
    """Reports written as JSON and read again; the third one is absent and adds nothing."""
    preds = predictions(spark, d)
    reg = M.tidy(M.regression_metrics(preds, willmott=False).select("protocol", "model", *REPORT_METRICS))
    sev = M.tidy(M.severity_f1(M.severity_confusion(preds)).select("protocol", "model", "accuracy"))
    top = R.scratch_path(spark, "reports")
    paths = {"regression": R.write_report(reg, f"{top}/regression"), "severity": R.write_report(sev, f"{top}/severity"),
             "holdout": f"{top}/holdout"}
    return rounded(R.read_reports(spark, paths, "protocol STRING, model STRING, metric STRING, value DOUBLE"))


def _claim_sql():
    beaten = ("concat_ws(', ', CASE WHEN beats_r2 THEN 'r2' END, CASE WHEN beats_rmse THEN 'rmse' END, "
              "CASE WHEN beats_mae THEN 'mae' END)")
    return PRED_CTE + f""", names(p, note) AS (VALUES
  ('A_strict_chronological_future_forecasting', 'This is strict future forecasting with no target-month VHI leakage.'),
  ('B_paper_comparable_random_split', 'This is paper-comparable random split evaluation, not chronological deployment forecasting.'),
  ('C_same_month_estimation', 'This is same-month VHI estimation/reconstruction, not future forecasting.'),
  ('D_spatial_holdout', 'This is unseen grid-cell spatial holdout evaluation.'),
  ('E_rolling_origin_validation', 'This is rolling-origin future validation averaged across folds.'),
  ('training_rows', NULL)),
b AS (SELECT p AS protocol, protocol || '/' || model AS model, note, r2 > {L['r2']} AS beats_r2, rmse < {L['rmse']} AS beats_rmse, mae < {L['mae']} AS beats_mae FROM met, names),
c AS (SELECT protocol, model, note, {beaten} AS beaten FROM b)
SELECT protocol, model, note, CASE WHEN beaten = '' THEN 'No literature metric beaten.'
  WHEN protocol LIKE 'C_%' THEN 'Beats literature on ' || beaten || ' only under same-month estimation, not future forecasting.'
  ELSE 'Beats literature on ' || beaten || ' under ' || protocol || '.' END AS claim FROM c"""


@register("met_claim", _claim_sql())
def met_claim(spark, d):
    # every metric row is claimed under each protocol name, and one that is no protocol
    names = F.array(*map(F.lit, [*K.PROTOCOL_NOTES, "training_rows"]))
    m = _metrics(spark, d).withColumn("model", F.concat_ws("/", "protocol", "model")).withColumn("protocol", F.explode(names))
    return M.claim_text(m).select("protocol", "model", "note", "claim")


@register("met_average_folds", VHI_SQL_CTE + f""", pv AS (SELECT grid_id, date, lead(vhi, 1) {W} AS y_true, vhi AS y_pred FROM vhi),
di AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM vhi)),
f AS (SELECT * FROM (VALUES (1, CAST(0.55 AS DOUBLE)), (2, CAST(0.65 AS DOUBLE)), (3, CAST(0.75 AS DOUBLE))) t(fold, frac)),
tg AS (SELECT date, fold FROM di, f WHERE idx > floor(n * frac) AND idx <= floor(n * frac) + 12),
fm AS (SELECT fold, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse, avg(abs(y_pred - y_true)) AS mae
  FROM pv JOIN tg ON pv.date = tg.date WHERE y_true IS NOT NULL GROUP BY fold)
SELECT 'E_rolling_origin_validation' AS protocol, 'persistence' AS model, count(*) AS folds,
  {S.r6('avg(rmse)')} AS rmse, {S.r6('avg(mae)')} AS mae FROM fm""")
def met_average_folds(spark, d):
    w = order_window(["grid_id"])
    v = vhi_panel(spark, d).select("grid_id", "date", F.lead("vhi", 1).over(w).alias("y_true"), F.col("vhi").alias("y_pred"))
    f = DS.rolling_origin_folds(v).where((F.col("role") == "test") & F.col("y_true").isNotNull())
    err = F.col("y_pred") - F.col("y_true")
    per_fold = f.groupBy("fold").agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"))
    out = M.average_folds(per_fold.withColumns({"protocol": F.lit("E_rolling_origin_validation"),
                                                "model": F.lit("persistence")}), metrics=["rmse", "mae"])
    return rounded(out)
