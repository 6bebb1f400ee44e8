"""Registered queries: scoring rules, forecasts, advisories, history analytics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import history as H
from ..operators import indices as I
from ..operators import models as ML
from ..operators import scoring as SC
from ..operators.temporal import latest_per_key, order_window
from ..sources import fixtures as FX
from . import sqlfrag as S
from .q_indices import VHI100_CTE, VHI_SQL_CTE, vhi_panel
from .registry import register, rounded

STATES = list(K.STATE_CROPS) + ["Sindh"]


def _dbl(x):
    return f"CAST({x} AS DOUBLE)"


REQ = f"""SELECT district || '-' || strftime(date, '%Y%m') AS id,
  ([{', '.join(repr(s) for s in STATES)}])[n_nationkey % {len(STATES)} + 1] AS state, district, date,
  {_dbl(6)} + n_nationkey AS latitude, {_dbl(68)} + n_nationkey AS longitude, ndvi, lst, rainfall, lst - 2.0 AS temperature,
  {S.clip('65 - lst + rainfall / 8', 15.0, 95.0)} AS humidity, {S.clip('2.5 + lst / 30', 0.2, 8.0)} AS wind_speed,
  {S.clip('0.12 + rainfall / 300 + ndvi / 3', 0.02, 0.95)} AS soil_moisture_proxy
FROM district JOIN nation ON district = n_name"""
RISK_FB = S.clip(f"35 * {S.clip('0.75 - ndvi', lo=0.0)} + 25 * {S.clip('1 - rainfall / 220', lo=0.0)}"
                 f" + 20 * {S.clip('(lst - 28) / 18', lo=0.0)} + 20 * (1 - soil_moisture_proxy)", 0.0, 100.0)
SCORED = f"""SELECT *, {S.sev_label_risk('risk')} AS severity, {S.bround('risk / 100', 4)} AS probability,
  {S.bround('risk', 2)} AS risk_score FROM (SELECT *, {RISK_FB} AS risk FROM req)"""
REQ_CTE = S.with_(district=S.DISTRICT, req=REQ, scored=SCORED)


def _scored(spark, d):
    return SC.score_fallback(FX.score_requests(spark, d))


PAYLOAD_SIGNALS = ("ndvi", "rainfall", "lst", "vhi")


@register("sc_payload_features", REQ_CTE + f""", sparse AS (SELECT id, CASE WHEN n % 3 = 0 THEN 0.35 ELSE ndvi END AS ndvi, CASE WHEN n % 4 = 0 THEN 36.0 ELSE lst END AS lst,
  rainfall, 24.0 AS solar_radiation FROM (SELECT *, CAST(latitude - 6 AS INTEGER) AS n FROM req)),
v AS (SELECT *, {S.clip('ndvi', 0.0, 1.0)} AS vci, {S.clip('1 - (lst - 20) / 35', 0.0, 1.0)} AS tci FROM sparse),
w AS (SELECT *, 0.5 * vci + 0.5 * tci AS vhi FROM v)
SELECT id, {S.r6('vci')} AS vci, {S.r6('tci')} AS tci, solar_radiation,
  {', '.join(f"{S.r6(c)} AS {c}_lag_1, {S.r6(c)} AS {c}_roll_3, {S.r6(c)} AS {c}_wavelet_low" for c in PAYLOAD_SIGNALS)} FROM w""")
def sc_payload_features(spark, d):
    """Payloads that lack some values (and a whole column): defaults, then indices, then model features."""
    n = (F.col("latitude") - 6).cast("int")
    r = FX.score_requests(spark, d)
    r = r.withColumns({"ndvi": F.when(n % 3 != 0, F.col("ndvi")), "lst": F.when(n % 4 != 0, F.col("lst"))})
    r = SC.payload_features(SC.payload_indices(SC.payload_defaults(r)), PAYLOAD_SIGNALS)
    return rounded(r.select("id", "vci", "tci", "solar_radiation", *[f"{c}_{s}" for c in PAYLOAD_SIGNALS for s in ("lag_1", "roll_3", "wavelet_low")]))


@register("sc_synthetic_history", REQ_CTE + f"""
SELECT id, CAST(k AS INTEGER) AS months_back, CAST(CAST(date - to_months(CAST(k AS INTEGER)) AS DATE) AS VARCHAR) AS date,
  {S.r6('ndvi + (k - 4) * 0.005')} AS ndvi, {S.r6('lst - (k - 4) * 0.15')} AS lst,
  {S.r6(S.clip('rainfall + (4 - k) * 1.2', lo=0.0))} AS rainfall FROM req, range(0, 9) r(k)""")
def sc_synthetic_history(spark, d):
    r = SC.synthetic_history(FX.score_requests(spark, d).select("id", "date", "ndvi", "lst", "rainfall"))
    return rounded(r.select("id", F.col("months_back").cast("int").alias("months_back"), "date", "ndvi", "lst", "rainfall"))


@register("sc_recursive_forecast", VHI100_CTE + f""", latest AS (SELECT grid_id, max(date) AS date, arg_max(vhi, date) AS vhi FROM vhi GROUP BY grid_id),
st AS (SELECT grid_id, date, vhi, CAST(s AS INTEGER) AS step FROM latest, range(1, 13) r(s)),
fc AS (SELECT *, {S.clip(f'vhi - step * (step + 1) * {_dbl(1.25)}', 0.0, 100.0)} AS v FROM st)
SELECT grid_id, step, strftime(date + to_months(step), '%Y-%m') AS forecast_month, {S.bround('v', 2)} AS forecast_vhi,
  {S.sev_label100('v')} AS severity,
  {S.bround(f'greatest({_dbl(0.55)}, {_dbl(0.92)} - step * {_dbl(0.07)})', 2)} AS confidence FROM fc""")
def sc_recursive_forecast(spark, d):
    v = I.add_vci_tci_vhi(FX.panel(spark, d), scale=100.0).select("grid_id", "date", "vhi")
    return SC.recursive_forecast(latest_per_key(v), 12)


@register("sc_model_forecast", VHI_SQL_CTE.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY date DESC) AS k FROM vhi),
h AS (SELECT grid_id, max(date) AS date, max(CASE WHEN k = 1 THEN vhi END) AS a, max(CASE WHEN k = 2 THEN vhi END) AS b, max(CASE WHEN k = 3 THEN vhi END) AS c
  FROM r GROUP BY grid_id HAVING count(*) >= 3),
f AS (SELECT grid_id, date, 0 AS step, a, b, c FROM h UNION ALL
  SELECT grid_id, date, step + 1, {S.clip('0.05::DOUBLE + 0.55::DOUBLE * a + 0.35::DOUBLE * ((0.0::DOUBLE + c + b + a) / 3)', 0.0, 1.0)}, a, b FROM f WHERE step < 12)
SELECT grid_id, CAST(step AS INTEGER) AS step, strftime(date + to_months(step), '%Y-%m') AS forecast_month, {S.r6('a')} AS forecast FROM f WHERE step > 0""")
def sc_model_forecast(spark, d):
    """Twelve chained steps of a linear model of lag and rolling state, from the last three observations of a cell."""
    v = vhi_panel(spark, d).select("grid_id", "date", "vhi")
    h = v.groupBy("grid_id").agg(F.max("date").alias("date"), F.transform(F.array_sort(F.collect_list(F.struct("date", "vhi"))), lambda x: x["vhi"]).alias("all"))
    h = h.where(F.size("all") >= 3).select("grid_id", "date", F.slice("all", -3, 3).alias("history"))
    return rounded(SC.model_forecast(h, lambda lag, roll: 0.05 + 0.55 * lag + 0.35 * roll, 12))


CHAIN_FIT = """x AS (SELECT vhi AS x1, (coalesce(lag(vhi, 2) OVER w, 0) + lag(vhi, 1) OVER w + vhi) / 3 AS x2, lead(vhi, 1) OVER w AS y, row_number() OVER w AS k
  FROM vhi WINDOW w AS (PARTITION BY grid_id ORDER BY date)),
c AS (SELECT var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS v12, covar_pop(x1, y) AS y1, covar_pop(x2, y) AS y2, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS m
  FROM x WHERE k >= 3 AND y IS NOT NULL),
b AS (SELECT *, (y1 * v2 - y2 * v12) / (v1 * v2 - v12 * v12) AS b1, (y2 * v1 - y1 * v12) / (v1 * v2 - v12 * v12) AS b2 FROM c),
coef AS (SELECT b1, b2, m - b1 * m1 - b2 * m2 AS b0 FROM b),"""


@register("sc_model_forecast_fitted", VHI_SQL_CTE.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
{CHAIN_FIT}
r AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY date DESC) AS k FROM vhi),
h AS (SELECT grid_id, max(date) AS date, max(CASE WHEN k = 1 THEN vhi END) AS a, max(CASE WHEN k = 2 THEN vhi END) AS b, max(CASE WHEN k = 3 THEN vhi END) AS c
  FROM r GROUP BY grid_id HAVING count(*) >= 3),
f AS (SELECT grid_id, date, 0 AS step, a, b, c FROM h UNION ALL
  SELECT grid_id, date, step + 1, {S.clip('b0 + b1 * a + b2 * ((0.0::DOUBLE + c + b + a) / 3)', 0.0, 1.0)}, a, b FROM f, coef WHERE step < 12)
SELECT grid_id, CAST(step AS INTEGER) AS step, strftime(date + to_months(step), '%Y-%m') AS forecast_month, round(a * 1e5) / 1e5 + 0.0 AS forecast FROM f WHERE step > 0""")
def sc_model_forecast_fitted(spark, d):
    """Twelve chained steps of a linear model fitted on the panel: next month's VHI from this month's and the mean of the last three.
    Every step is checked by value (5 decimals)."""
    w = order_window(["grid_id"])
    v = vhi_panel(spark, d).select("grid_id", "date", "vhi")
    rows = v.select("vhi", F.avg("vhi").over(w.rowsBetween(-2, 0)).alias("roll_3"), F.lead("vhi", 1).over(w).alias("label"), F.row_number().over(w).alias("k"))
    rows = ML.assemble(rows.where("k >= 3 AND label IS NOT NULL"), ["vhi", "roll_3"])
    intercept, (lag, roll) = ML.linear_terms(ML.fit(ML.linear(), ML.training_table(rows.select("label", ML.FEATURES_COL))))
    h = v.groupBy("grid_id").agg(F.max("date").alias("date"), F.transform(F.array_sort(F.collect_list(F.struct("date", "vhi"))), lambda x: x["vhi"]).alias("all"))
    h = h.where(F.size("all") >= 3).select("grid_id", "date", F.slice("all", -3, 3).alias("history"))
    out = SC.model_forecast(h, lambda x, mean: F.lit(intercept) + F.lit(lag) * x + F.lit(roll) * mean, 12)
    return out.withColumn("forecast", F.round(F.col("forecast") * 1e5) / 1e5 + 0.0)


@register("sc_probability", REQ_CTE + "SELECT id, severity, probability, risk_score FROM scored")
def sc_probability(spark, d):
    return _scored(spark, d).select("id", "severity", "probability", "risk_score")


def _case_map(col, mapping):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


@register("sc_recommendation", REQ_CTE + f"SELECT id, severity, {_case_map('severity', K.RECOMMENDATIONS)} AS recommendation FROM scored")
def sc_recommendation(spark, d):
    s = _scored(spark, d)
    return s.select("id", "severity", SC.recommendation(F.col("severity")).alias("recommendation"))


def _crops_sql():
    st = "CASE " + " ".join(f"WHEN state = '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in K.STATE_CROPS.items()) \
        + " ELSE []::VARCHAR[] END"
    base = "CASE " + " ".join(f"WHEN severity = '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in K.SEVERITY_CROPS.items()) + " END"
    return REQ_CTE + f""", l AS (SELECT id, state, severity, list_concat({st}, {base}) AS lst FROM scored),
u AS (SELECT id, state, severity, unnest(lst) AS crop, unnest(generate_series(1, len(lst))) AS pos FROM l),
f AS (SELECT id, state, severity, crop, min(pos) AS pos FROM u GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rk FROM f)
SELECT id, state, severity, string_agg(crop, ', ' ORDER BY pos) AS crops FROM r WHERE rk <= {K.MAX_CROPS} GROUP BY 1, 2, 3"""


@register("sc_crops", _crops_sql())
def sc_crops(spark, d):
    s = _scored(spark, d)
    return s.select("id", "state", "severity", F.array_join(SC.crops(F.col("severity"), F.col("state")), ", ").alias("crops"))


def _suit_sql():
    hardy = (f"(lower(severity) IN ({', '.join(repr(x) for x in K.HARDY_SEVERITIES)}) OR rainfall < {K.HARDY_RAIN_BELOW} "
             f"OR temperature > {K.HARDY_TEMP_ABOVE})")
    rows = " UNION ALL ".join(f"SELECT '{c}' AS crop, {h} AS hs, {o} AS os, '{w}' AS water_requirement"
                              for c, h, o, w, _ in K.CROP_SUITABILITY)
    return REQ_CTE + f""", t AS ({rows})
SELECT id, crop, {hardy} AS drought_hardy, CASE WHEN {hardy} THEN hs ELSE os END AS suitability_score, water_requirement
FROM scored, t"""


@register("sc_crop_suitability", _suit_sql())
def sc_crop_suitability(spark, d):
    s = SC.crop_suitability(_scored(spark, d))
    return s.select("id", "crop", "drought_hardy", "suitability_score", "water_requirement")


@register("sc_advisory", REQ_CTE + f"""
SELECT id, risk_score, CASE WHEN risk_score >= {K.HIGH_RISK} THEN '{K.ADVICE_HIGH}' ELSE '{K.ADVICE_LOW}' END AS irrigation_advice,
  CASE WHEN risk_score >= {K.HIGH_RISK} THEN '{'; '.join(K.WARNINGS_HIGH)}' ELSE '{'; '.join(K.WARNINGS_LOW)}' END AS risk_warnings
FROM scored""")
def sc_advisory(spark, d):
    a = SC.advisory(_scored(spark, d))
    return a.select("id", "risk_score", "irrigation_advice", F.array_join("risk_warnings", "; ").alias("risk_warnings"))


@register("ml_magnitude_importance", REQ_CTE + f""", long AS (
  {' UNION ALL '.join(f"SELECT id, '{c}' AS feature, abs({c}) AS mag FROM req" for c in SC.PAYLOAD_BASE)}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mag DESC, feature) AS rk FROM long)
SELECT id, feature, CAST(rk AS INTEGER) AS rk, {S.bround('mag / greatest(sum(mag) OVER (PARTITION BY id), 1e-6)', 4)} AS importance
FROM r WHERE rk <= 8""")
def ml_magnitude_importance(spark, d):
    r = FX.score_requests(spark, d)
    return SC.magnitude_importance(r, SC.PAYLOAD_BASE, id_cols=("id",))


# ---- prediction history / logs ---------------------------------------------------------------
HIST_CTE = S.with_(hist=S.HISTORY, logs=S.LOGS, users=S.USERS)
SEV = S.sev_label_risk("risk_score")


@register("hist_latest_n", HIST_CTE + "SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, risk_score FROM hist ORDER BY hist.created_at DESC, id DESC LIMIT 10")
def hist_latest_n(spark, d):
    return rounded(H.latest_n(FX.history(spark, d), 10).select("id", "created_at", "risk_score"))


@register("hist_counters", HIST_CTE + f"SELECT count(*) AS total, CAST(count_if(risk_score >= {K.HIGH_RISK}) AS BIGINT) AS high_risk FROM hist")
def hist_counters(spark, d):
    return H.counters(FX.history(spark, d))


@register("hist_severity_counts", HIST_CTE + f"SELECT {SEV} AS severity, count(*) AS n FROM hist GROUP BY 1")
def hist_severity_counts(spark, d):
    return H.severity_counts(FX.history(spark, d))


@register("hist_dashboard", HIST_CTE + f"""
SELECT count(*) AS total, CAST(count_if(risk_score >= {K.HIGH_RISK}) AS BIGINT) AS high_risk, {S.r6('avg(risk_score)')} AS avg_risk,
  arg_max({SEV}, (created_at, id)) AS latest_severity FROM hist""")
def hist_dashboard(spark, d):
    return rounded(H.dashboard(FX.history(spark, d)))


@register("hist_risk_trend", HIST_CTE + "SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, risk_score FROM hist ORDER BY hist.created_at DESC, id DESC LIMIT 20")
def hist_risk_trend(spark, d):
    return rounded(H.risk_trend(FX.history(spark, d)))


@register("hist_admin_analytics", HIST_CTE + """
SELECT count(*) AS total_users, CAST(count_if(is_active) AS BIGINT) AS active_users, (SELECT count(*) FROM hist) AS forecast_usage,
  l.id AS log_id, event, message, strftime(l.created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM users, (SELECT * FROM logs ORDER BY created_at DESC, id DESC LIMIT 20) l GROUP BY ALL""")
def hist_admin_analytics(spark, d):
    return rounded(H.admin_report(FX.users(spark, d), FX.history(spark, d), FX.logs(spark, d)))


@register("hist_last_login", HIST_CTE + """, lg AS (
  SELECT split_part(message, ': ', 2) AS email, max(created_at) AS last_login
  FROM logs WHERE event = 'user_login' AND contains(message, '@') GROUP BY 1)
SELECT u.id, u.email, strftime(lg.last_login, '%Y-%m-%d %H:%M:%S.%f') AS last_login FROM users u LEFT JOIN lg ON u.email = lg.email""")
def hist_last_login(spark, d):
    return rounded(H.last_login(FX.users(spark, d), FX.logs(spark, d)))


@register("hist_user_search", HIST_CTE + "SELECT id, email, role FROM users WHERE contains(lower(concat_ws(' ', email, role)), 'admin')")
def hist_user_search(spark, d):
    return H.user_search(FX.users(spark, d), "Admin").select("id", "email", "role")


@register("hist_recent_logs", HIST_CTE + "SELECT id, event, message, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM logs ORDER BY logs.created_at DESC, id DESC LIMIT 50")
def hist_recent_logs(spark, d):
    return rounded(H.latest_n(FX.logs(spark, d), 50))


@register("prj_severity_risk", HIST_CTE + f"SELECT id, {SEV} AS severity FROM hist")
def prj_severity_risk(spark, d):
    return H.with_severity(FX.history(spark, d)).select("id", "severity")
