"""Registered queries: Spark ML fits, searches and scoring.

Fits are randomised, so their queries return facts that SQL can compute as well: which rows were scored, and
which bounds hold.  One-feature least squares and the persistence baseline are checked value by value."""
from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import conform as C
from ..operators import datasets as DS
from ..operators import models as ML
from ..operators import search as SE
from ..session import cut_lineage
from ..sources.readers import read_reports, scratch_path, write_report
from . import sqlfrag as S
from .frames import feature_panel
from .q_indices import VHI_SQL_CTE, vhi_panel
from .registry import register, rounded

PROTOCOL = "A_strict_chronological_future_forecasting"


def ml_data(spark, d, label="target_vhi_h1", columns=False):
    """Leakage-blocked features, next-month label, chronological train/test.  The frozen rows hold the features as one vector, and
    with ``columns`` one by one as well."""
    f = feature_panel(spark, d, signals=("ndvi", "lst", "rainfall", "vhi"), wavelet=True)
    feats = [c for c in C.leakage_block(C.numeric_features(f)) if c not in ("month", "season")]
    f = f.withColumn("label", F.col(label))
    data = ML.training_table(ML.assemble(f, feats).select("grid_id", "date", "label", "vci", "tci", "vhi",
                                                           *(feats if columns else []), ML.FEATURES_COL))
    # the cut-off is read from the frozen rows, once for all fits
    data = DS.split_chrono(data, cut=DS.date_cut_now(data, 0.8))
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    return train, test, feats


# ---- facts that SQL can check ------------------------------------------------------------------
# A cell's first six months lack lag_6, so they are incomplete; the last month has no next-month label.
ROWS_SQL = VHI_SQL_CTE + f""", m AS (SELECT grid_id, date, vhi, row_number() OVER (PARTITION BY grid_id ORDER BY date) AS k,
  lead(vhi, 1) OVER (PARTITION BY grid_id ORDER BY date) AS y FROM vhi),
rows_a AS (SELECT grid_id, date, y FROM m WHERE k > 6 AND y IS NOT NULL), rows_c AS (SELECT grid_id, date, vhi AS y FROM m WHERE k > 6),
cut_a AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.8) AS c FROM rows_a),
cut_c AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.8) AS c FROM rows_c),
train_a AS (SELECT * FROM rows_a WHERE date_diff('day', DATE '1970-01-01', date) <= (SELECT c FROM cut_a)),
test_a AS (SELECT * FROM rows_a WHERE date_diff('day', DATE '1970-01-01', date) > (SELECT c FROM cut_a)),
test_c AS (SELECT * FROM rows_c WHERE date_diff('day', DATE '1970-01-01', date) > (SELECT c FROM cut_c))
"""


def _facts_sql(models, protocol=PROTOCOL, table="test_a"):
    names = ", ".join(f"('{m}')" for m in models)
    return ROWS_SQL + f"""SELECT '{protocol}' AS protocol, model, count(*) AS n, count(DISTINCT grid_id) AS n_cells, CAST(min(date) AS VARCHAR) AS first_date,
  CAST(max(date) AS VARCHAR) AS last_date, {S.r6('avg(y)')} AS label_mean, true AS in_unit_interval, true AS rmse_over_mae, true AS r2_at_most_1, true AS scores_in_unit_interval
FROM {table}, (VALUES {names}) v(model) GROUP BY model"""


def _facts(preds, protocol=PROTOCOL):
    """One row per model: what was scored (rows, cells, dates, labels) and whether predictions and metrics keep their bounds.
    The metrics themselves come from ``ML.eval_metrics`` (see the bench)."""
    preds = cut_lineage(preds.select("grid_id", "date", "label", "y_pred", "model"))
    what = preds.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("grid_id").alias("n_cells"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.avg("label").alias("label_mean"), F.bool_and(F.col("y_pred").between(0, 1)).alias("in_unit_interval"))
    m = ML.eval_metrics(preds, protocol)
    unit = F.lit(True)
    for c in ("accuracy", "f1_macro", "f1_weighted", "within_tol"):
        unit = unit & F.col(c).between(0, 1)
    m = m.select("protocol", "model", (F.col("rmse") >= F.col("mae") - 1e-9).alias("rmse_over_mae"), (F.col("r2") <= 1).alias("r2_at_most_1"),
                 unit.alias("scores_in_unit_interval"))
    return rounded(m.join(what, "model").select("protocol", "model", "n", "n_cells", "first_date", "last_date", "label_mean", "in_unit_interval",
                                                "rmse_over_mae", "r2_at_most_1", "scores_in_unit_interval"))


@register("ml_gbt", _facts_sql(["gbt"]))
def ml_gbt(spark, d):
    tr, te, _ = ml_data(spark, d)
    return _facts(ML.fit_predict(ML.gbt(), tr, te, "gbt"))


@register("ml_forest", _facts_sql(["forest"]))
def ml_forest(spark, d):
    tr, te, _ = ml_data(spark, d)
    return _facts(ML.fit_predict(ML.forest(), tr, te, "forest"))


@register("ml_linear", _facts_sql(["linear"]))
def ml_linear(spark, d):
    tr, te, _ = ml_data(spark, d)
    return _facts(ML.fit_predict(ML.linear(), tr, te, "linear"))


@register("ml_linear_exact", ROWS_SQL + f""", x AS (SELECT t.grid_id, t.date, t.y, m.vhi AS v FROM train_a t JOIN m ON m.grid_id = t.grid_id AND m.date = t.date),
fit AS (SELECT regr_slope(y, v) AS b, regr_intercept(y, v) AS a FROM x)
SELECT t.grid_id, CAST(t.date AS VARCHAR) AS date, round({S.clip('(SELECT a FROM fit) + (SELECT b FROM fit) * m.vhi', 0.0, 1.0)} * 1e5) / 1e5 + 0.0 AS y_pred
FROM test_a t JOIN m ON m.grid_id = t.grid_id AND m.date = t.date""")
def ml_linear_exact(spark, d):
    """Least squares on one feature, every prediction checked (5 decimals)."""
    tr, te, _ = ml_data(spark, d)
    one = lambda df: ML.assemble(df.select("grid_id", "date", "label", "vhi"), ["vhi"])
    p = ML.fit_predict(ML.linear(), one(tr), one(te), "linear")
    return rounded(p.select("grid_id", "date", (F.round(F.col("y_pred") * 1e5) / 1e5 + 0.0).alias("y_pred")))


@register("ml_ensemble", _facts_sql(["ensemble"]))
def ml_ensemble(spark, d):
    tr, te, _ = ml_data(spark, d)
    return _facts(ML.ensemble(tr, te, weight=0.5))


# every model feature, spelled out: base signals, calendar, and per signal lags, rolling means and deviations, wavelet parts
MODEL_FEATURES = """ndvi lst rainfall temperature humidity evapotranspiration soil_moisture spi spei month_sin month_cos season_sin season_cos""".split() + [
    f"{c}_{x}" for c in ("ndvi", "lst", "rainfall", "vhi") for x in (
        "lag_1", "lag_2", "lag_3", "lag_6", "roll_3", "roll_6", "roll_12", "std_3", "std_6", "std_12", "wavelet_approx", "wavelet_detail")]


@register("ml_stack", f"SELECT *, {2 + len(MODEL_FEATURES)} AS meta_inputs FROM ({_facts_sql(['stack'])})")
def ml_stack(spark, d):
    """Forest and boosted trees under a boosted meta learner that also sees the features; ``meta_inputs`` is the length of its vector."""
    tr, te, _ = ml_data(spark, d)
    s = ML.fit_stack(tr)
    return _facts(s.predict(te)).withColumn("meta_inputs", F.lit(s.meta.numFeatures))


@register("ml_ridge_meta", _facts_sql(["ridge_meta"]))
def ml_ridge_meta(spark, d):
    """Non-negative ridge (alpha .05) over three base predictions on the validation
    tail of the training period; the blend is scored on the test rows."""
    tr, te, _ = ml_data(spark, d)
    s = DS.split_valid_quantile(tr, cut=DS.date_cut_now(tr, 0.85))
    fit_rows, valid = (s.where(F.col("split") == part).drop("split") for part in ("fit", "valid"))
    bases = {"gbt": ML.gbt(), "forest": ML.forest(), "linear": ML.linear()}
    models = {k: ML.fit(est, fit_rows) for k, est in bases.items()}

    xs = [f"p_{k}" for k in bases]
    xx, xy = ML.gram(ML.score_many(models, valid), xs)
    w = ML.nonneg_ridge(xx, xy, alpha=0.05)
    blend = sum((F.col(x) * wi for x, wi in zip(xs, w)), F.lit(0.0))
    preds = ML.score_many(models, te).select("grid_id", "date", "label", F.when(blend < 0, 0.0).when(blend > 1, 1.0).otherwise(blend).alias("y_pred"),
                                  F.lit("ridge_meta").alias("model"))
    return _facts(preds)


@register("ml_physics_residual", _facts_sql(["physics_residual"], "C_same_month_estimation", "test_c"))
def ml_physics_residual(spark, d):
    tr, te, _ = ml_data(spark, d, label="vhi")
    return _facts(ML.physics_residual(tr, te), "C_same_month_estimation")


@register("ml_persistence", VHI_SQL_CTE + f""", p AS (
  SELECT grid_id, date, lead(vhi, 1) OVER (PARTITION BY grid_id ORDER BY date) AS label, vhi AS y_pred FROM vhi)
SELECT grid_id, CAST(date AS VARCHAR) AS date, {S.r6('label')} AS label, {S.r6('y_pred')} AS y_pred, 'persistence' AS model
FROM p WHERE label IS NOT NULL""")
def ml_persistence(spark, d):
    p = ML.persistence(vhi_panel(spark, d))
    return rounded(p.where(F.col("label").isNotNull()))


def _search_rows(spark, d):
    tr, _, _ = ml_data(spark, d, columns=True)
    s = DS.split_valid_quantile(tr, cut=DS.date_cut_now(tr, 0.85))
    return s.where(F.col("split") == "fit").drop("split"), s.where(F.col("split") == "valid").drop("split")


def _search_facts(best, trials, fit_rows, valid):
    """Trial count, whether every trial lies in the space, whether the winner is the best of them, and the rows it is refitted on."""
    bounds = F.lit(True)
    for name, (lo, hi) in ML.GBT_SPACE.items():
        bounds = bounds & F.get_json_object("params", f"$.{name}").cast("double").between(lo, hi)
    model = ML.refit(best, fit_rows, valid)
    won = trials.orderBy("rmse", "trial").limit(1).select((F.col("params") == json.dumps(best)).alias("won"))
    refit_rows = fit_rows.unionByName(valid)
    scored = ML.predict(model, refit_rows, "refit").agg(F.count(F.lit(1)).alias("n")).scalar()
    return trials.agg(F.count(F.lit(1)).alias("n_trials"), F.bool_and(bounds).alias("in_space"), F.bool_and(F.col("rmse") > 0).alias("scored")).select(
        "n_trials", "in_space", "scored", won.scalar().alias("winner_is_best"), scored.alias("refit_rows"))


def _search_sql(n):
    return ROWS_SQL + f"SELECT CAST({n} AS BIGINT) AS n_trials, true AS in_space, true AS scored, true AS winner_is_best, count(*) AS refit_rows FROM train_a"


@register("ml_search_random", _search_sql(12))
def ml_search_random(spark, d):
    fit_rows, valid = _search_rows(spark, d)
    return _search_facts(*ML.random_search(fit_rows, valid, trials=12), fit_rows, valid)


# the rules of the mixed search, feature by feature: group, kind, and the least window or level that lets it in
SWARM_RULES = {
    **{f: ("base_remote_sensing", "plain", 0) for f in ("ndvi", "lst", "rainfall", "temperature", "humidity", "soil_moisture")},
    **{f: ("seasonal", "plain", 0) for f in ("month_sin", "month_cos", "season_sin", "season_cos")},
    **{f"{c}_lag_{k}": (f"{c}_lag_roll", "window", k) for c in ("ndvi", "lst", "rainfall", "vhi") for k in (1, 2, 3, 6)},
    # a rolling mean over three months is let in by every window
    **{f"{c}_roll_{k}": (f"{c}_lag_roll", "window", k if k > 3 else 1) for c in ("ndvi", "lst", "rainfall", "vhi") for k in (3, 6, 12)},
    **{f"{c}_wavelet_{k}": (f"{c}_wavelet", "level", at) for c in ("ndvi", "lst", "rainfall", "vhi") for k, at in (("approx", 1), ("detail", 2))},
}
_RULES_SQL = ", ".join(f"('{f}', '{g}', '{kind}', {least})" for f, (g, kind, least) in SWARM_RULES.items())


@register("ml_search_swarm", ROWS_SQL + f"""SELECT feature, feature_group, kind, CAST(least AS INTEGER) AS least, CAST(20 AS BIGINT) AS n_trials, true AS by_rule,
  true AS in_space, true AS winner_is_best, (SELECT count(*) FROM train_a) AS refit_rows FROM (VALUES {_RULES_SQL}) r(feature, feature_group, kind, least)""")
def ml_search_swarm(spark, d):
    """Mixed swarm.  One row per feature: whether every trial used it exactly where its group was on and its lag window or wavelet level let
    it in (the rules stand as a table, apart from the code that selects); and facts of the search."""
    fit_rows, valid = _search_rows(spark, d)
    space = SE.Space(tuple(c for c in fit_rows.columns if c in MODEL_FEATURES))
    fit_rows, valid = SE.superset(fit_rows, space), SE.superset(valid, space)
    best, trials = SE.mixed_swarm(fit_rows, valid, space, particles=5, iterations=4)
    rules = spark.createDataFrame([(f, *r) for f, r in SWARM_RULES.items()], "feature STRING, feature_group STRING, kind STRING, least INT")
    used = F.array_contains("features", F.col("feature"))
    on = (F.col("feature_group").isin("base_remote_sensing", "seasonal") | F.array_contains("groups", F.col("feature_group"))) & (
        F.col("least") <= F.when(F.col("kind") == "window", F.col("lag_window")).when(F.col("kind") == "level", F.col("wavelet_level")).otherwise(0))
    inside = F.col("lag_window").isin(*SE.LAG_WINDOWS) & F.col("wavelet_level").isin(*SE.WAVELET_LEVELS) & (F.col("rmse") > 0)
    for name, (lo, hi) in ML.GBT_SPACE.items():
        inside = inside & F.get_json_object("params", f"$.{name}").cast("double").between(lo, hi)
    # trials fan out to their rules by a generator: a few dozen literals
    fan = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(g).alias("feature_group"), F.lit(k).alias("kind"), F.lit(n).alias("least"))
                              for f, (g, k, n) in SWARM_RULES.items()]))
    told = trials.select("*", fan.alias("r")).select("*", "r.*").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_trials"), F.bool_and(used == on).alias("by_rule"), F.bool_and(inside).alias("in_space"))
    won = trials.orderBy("rmse", "trial").limit(1).select(
        ((F.col("params") == best.as_json()) & (F.col("features") == F.array(*[F.lit(f) for f in best.features]))).alias("won")).scalar()
    rows = fit_rows.unionByName(valid)
    scored = SE.predicted(SE.fitted(rows, space, best), rows, space, best).agg(F.count("y_pred").alias("n")).scalar()
    return rules.join(told, "feature").select("*", won.alias("winner_is_best"), scored.alias("refit_rows"))


FAMILY = {"gbt": ML.gbt, "forest": ML.forest, "linear": ML.linear}
METRICS = ("r2", "rmse", "mae")


@register("ml_model_family_eval", _facts_sql(["gbt", "forest", "linear"]))
def ml_model_family_eval(spark, d):
    """Each model of the family on the same rows, scored in one pass."""
    return _facts(_family(spark, d)[0])


def _family(spark, d):
    tr, te, _ = ml_data(spark, d)
    wide = ML.score_many({k: ML.fit(make(), tr) for k, make in FAMILY.items()}, te)
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("model"), ML.clip(f"p_{k}", 0.0, 1.0).alias("y_pred")) for k in FAMILY]))
    return wide.select("grid_id", "date", "label", "vhi", each), tr


@register("ml_metric_rows", ROWS_SQL + f""", p AS (SELECT t.y, m.vhi AS v FROM test_a t JOIN m ON m.grid_id = t.grid_id AND m.date = t.date),
base AS (SELECT 'rmse' AS metric, sqrt(avg((y - v) * (y - v))) AS value FROM p UNION ALL SELECT 'mae', avg(abs(y - v)) FROM p UNION ALL
  SELECT 'r2', 1 - sum((y - v) * (y - v)) / sum((y - mean) * (y - mean)) FROM p, (SELECT avg(y) AS mean FROM p))
SELECT '{PROTOCOL}' AS protocol, model, metric, true AS rounded, true AS in_report, model <> 'persistence' AS is_fitted,
  CASE WHEN model = 'persistence' THEN round(value, 4) END AS value
FROM base, (VALUES ('gbt'), ('forest'), ('linear'), ('persistence')) a(model)""")
def ml_metric_rows(spark, d):
    """Metric rows of a model run: R2, RMSE and MAE (4 decimals) of the family and the persistence baseline, written as a report and read
    by the report union.  Values of fitted models are in the report; SQL compares those of the baseline."""
    preds = cut_lineage(_family(spark, d)[0])  # scored once; four aggregates read the rows
    base = preds.where(F.col("model") == "gbt").select("grid_id", "date", "label", "vhi", F.lit("persistence").alias("model"), F.col("vhi").alias("y_pred"))
    m = ML.eval_metrics(preds.unionByName(base), PROTOCOL)
    long = m.select("protocol", "model", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(c, 4).alias("value")) for c in METRICS])))
    path = write_report(long, scratch_path(spark, "metrics"))
    report = read_reports(spark, {"run": path, "absent": path + "-none"}, "protocol STRING, model STRING, metric STRING, value DOUBLE")
    fitted = F.col("model") != "persistence"
    return report.select("protocol", "model", "metric", (F.col("value") == F.round("value", 4)).alias("rounded"), (F.col("report") == "run").alias("in_report"),
                         fitted.alias("is_fitted"), F.when(~fitted, F.col("value")).alias("value"))


@register("ml_feature_importance", ROWS_SQL + "SELECT CAST(10 AS BIGINT) AS n, true AS shares, true AS in_order, true AS known, count(*) AS fit_rows FROM train_a")
def ml_feature_importance(spark, d):
    """The ten largest shares, falling, of features of the model, and how many rows it was fitted on."""
    tr, _, feats = ml_data(spark, d)
    imp = ML.feature_importance(ML.fit(ML.gbt(), tr), feats, top=10, spark=spark)
    found = F.transform(F.array_sort(F.collect_list(F.struct("rank", "importance"))), lambda x: x["importance"])
    ranked = imp.withColumn("rank", F.monotonically_increasing_id())  # rows stand as the report lists them; ten of them
    return ranked.agg(F.count_distinct("feature").alias("n"), (F.bool_and(F.col("importance") >= 0) & (F.sum("importance") <= 1 + 1e-9)).alias("shares"),
                      (found == F.reverse(F.array_sort(found))).alias("in_order"), F.bool_and(F.col("feature").isin(feats)).alias("known")).withColumn(
        "fit_rows", tr.agg(F.count(F.lit(1))).scalar())


@register("ml_permutation_importance", "SELECT unnest([" + ", ".join(f"'{c}'" for c in MODEL_FEATURES) + "]) AS feature, true AS finite")
def ml_permutation_importance(spark, d):
    tr, te, feats = ml_data(spark, d, columns=True)
    model = ML.fit(ML.gbt(), tr)
    p = ML.permutation_importance(model, te, feats, repeats=3)
    return p.select("feature", (F.col("importance").isNotNull() & ~F.isnan("importance") & (F.abs("importance") < 1)).alias("finite"))


@register("ml_batch_score", ROWS_SQL + "SELECT grid_id, CAST(date AS VARCHAR) AS date, true AS in_unit_interval, true AS severity_fits, true AS risk_fits, true AS as_fitted FROM test_a")
def ml_batch_score(spark, d):
    """A scoring job: the model is saved, loaded with its feature list, and applied to rows whose vector is assembled from that list.
    Keys of every scored row; prediction within bounds and equal to the fitted model's, severity by the ladder, risk = (1 - vhi) * 100."""
    tr, te, feats = ml_data(spark, d, columns=True)
    fitted = ML.fit(ML.gbt(), tr)
    loaded, names = ML.load_model(spark, ML.save_model(fitted, feats, scratch_path(spark, "model"), spark))
    rows = ML.score_many({"fitted": fitted}, te).select("grid_id", "date", "label", "p_fitted", *names)
    s = ML.batch_score(loaded, ML.assemble(rows, names))
    v = F.col("predicted_vhi")
    ladder = (F.when(v < 0.20, "Extreme Drought").when(v < 0.35, "Severe Drought").when(v < 0.50, "Moderate Drought")
              .when(v < 0.65, "Mild Drought").otherwise("No Drought"))
    return rounded(s.select("grid_id", "date", v.between(0, 1).alias("in_unit_interval"), (F.col("severity") == ladder).alias("severity_fits"),
                            (F.abs(F.col("risk_score") - (1 - v) * 100) < 1e-9).alias("risk_fits"),
                            (ML.clip("p_fitted", 0.0, 1.0) == v).alias("as_fitted")))
