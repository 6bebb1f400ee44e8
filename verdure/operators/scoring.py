"""Batch scoring rules: payload features, fallback risk, severity, advice, crops,
recursive forecasts.  Lookups are literal maps inside the expression (no join,
nothing to broadcast); everything is a projection or a bounded generator."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import clip, severity_label_risk, severity_label_vhi100
from .indices import risk_fallback

PAYLOAD_BASE = ["ndvi", "lst", "rainfall", "temperature", "humidity", "wind_speed", "soil_moisture_proxy"]


def _map_lit(d: dict) -> Column:
    parts = []
    for k, v in d.items():
        parts.append(F.lit(k))
        parts.append(F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v))
    return F.create_map(*parts)


def payload_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Absent inputs take the documented defaults: missing columns are added,
    NULLs in present ones are filled."""
    defaults = defaults or K.FORECAST_DEFAULTS
    present = set(df.columns)
    return df.withColumns({c: (F.coalesce(F.col(c), F.lit(v)) if c in present else F.lit(v))
                           for c, v in defaults.items()})


def payload_indices(df: DataFrame) -> DataFrame:
    """VCI, TCI, VHI of a payload where it has none: vci = ndvi and tci = 1 - (lst - 20) / 35, each in [0, 1], vhi their mean."""
    present = set(df.columns)

    def given(c, e):
        return F.coalesce(F.col(c), e) if c in present else e

    df = df.withColumns({"vci": given("vci", clip("ndvi", 0.0, 1.0)), "tci": given("tci", clip(1 - (F.col("lst") - 20) / 35, 0.0, 1.0))})
    return df.withColumn("vhi", given("vhi", 0.5 * F.col("vci") + 0.5 * F.col("tci")))


def payload_features(df: DataFrame, signals=("ndvi", "rainfall", "lst")) -> DataFrame:
    """Model features for a payload without history: lag / roll / wavelet = current value."""
    out = {}
    for c in signals:
        out[f"{c}_lag_1"] = F.col(c)
        out[f"{c}_roll_3"] = F.col(c)
        out[f"{c}_wavelet_low"] = F.col(c)
    return df.withColumns(out)


def synthetic_history(df: DataFrame, date_col="date") -> DataFrame:
    """9 monthly rows ending at the request month: k = 8..0 months back,
    ndvi + (k-4)*.005, lst - (k-4)*.15, rain = max(0, rain + (4-k)*1.2)."""
    k = F.col("months_back")
    x = df.withColumn("months_back", F.explode(F.sequence(F.lit(8), F.lit(0), F.lit(-1))))
    return x.withColumns({
        date_col: F.add_months(F.col(date_col), -k),
        "ndvi": F.col("ndvi") + (k - 4) * 0.005,
        "lst": F.col("lst") - (k - 4) * 0.15,
        "rainfall": clip(F.col("rainfall") + (4 - k) * 1.2, lo=0.0),
    })


def recursive_forecast(latest: DataFrame, horizon: int, vhi_col="vhi", date_col="date") -> DataFrame:
    """No-model fallback: v_s = clip(v_{s-1} - 2.5*s, 0, 100) compounding, i.e.
    max(v0 - 1.25*s*(s+1), 0) for v0 in [0, 100]; confidence = max(.55, .92 - .07*s)."""
    s = F.col("step")
    x = latest.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    v = clip(F.col(vhi_col) - s * (s + 1) * 1.25, 0.0, 100.0)
    return x.select(
        *[c for c in latest.columns if c not in (vhi_col, date_col)], "step",
        F.date_format(F.add_months(F.col(date_col), s), "yyyy-MM").alias("forecast_month"),
        F.bround(v, 2).alias("forecast_vhi"),
        severity_label_vhi100(v).alias("severity"),
        F.bround(F.greatest(F.lit(0.55), 0.92 - s * 0.07), 2).alias("confidence"))


def model_forecast(latest: DataFrame, predict, horizon: int, history_col="history", date_col="date") -> DataFrame:
    """Chained forecast: each step predicts from the state of the steps before it.

    ``history_col``: the last observed values, oldest first (at least one).  ``predict(lag_1, roll_3)`` is a column expression
    (a fitted linear model, say) of the last value and the mean of the last three; its result, in [0, 1], joins the
    history for the next step.  One projection: the chain runs inside the row."""
    def roll(h):
        last = F.slice(h, F.greatest(F.lit(1), F.size(h) - 2), 3)
        return F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last)

    def step(h, _):
        v = predict(F.element_at(h, -1), roll(h))
        return F.concat(h, F.array(clip(v, 0.0, 1.0)))

    chain = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col(history_col), step)
    x = latest.withColumn("__c", F.slice(chain, F.size(history_col) + 1, horizon))
    x = x.select(*[c for c in latest.columns if c != history_col], F.posexplode("__c").alias("__p", "forecast"))
    return x.select(*[c for c in latest.columns if c not in (history_col, date_col)], (F.col("__p") + 1).alias("step"),
                    F.date_format(F.add_months(F.col(date_col), F.col("__p") + 1), "yyyy-MM").alias("forecast_month"), "forecast")


def score_fallback(df: DataFrame) -> DataFrame:
    """risk (formula), severity (risk ladder), probability = risk/100 to 4 places,
    risk rounded to 2 places (half-even, like Python ``round``)."""
    risk = risk_fallback()
    x = df.withColumn("__risk", risk)
    return x.withColumns({
        "severity": severity_label_risk("__risk"),
        "probability": F.bround(F.col("__risk") / 100, 4),
        "risk_score": F.bround(F.col("__risk"), 2),
    }).drop("__risk")


def recommendation(severity: Column) -> Column:
    return _map_lit(K.RECOMMENDATIONS)[severity]


def crops(severity: Column, state: Column) -> Column:
    """State-specific crops then the severity list, order-preserving distinct, first 6."""
    st = F.coalesce(_map_lit(K.STATE_CROPS)[state], F.array().cast("array<string>"))
    base = _map_lit(K.SEVERITY_CROPS)[severity]
    return F.slice(F.array_distinct(F.concat(st, base)), 1, K.MAX_CROPS)


def crop_suitability(df: DataFrame, severity="severity", rainfall="rainfall", temperature="temperature") -> DataFrame:
    """One row per (request, crop) with the hardy / other score."""
    hardy = (F.lower(F.col(severity)).isin(*K.HARDY_SEVERITIES) | (F.col(rainfall) < K.HARDY_RAIN_BELOW)
             | (F.col(temperature) > K.HARDY_TEMP_ABOVE))
    table = F.array(*[F.struct(F.lit(c).alias("crop"), F.lit(h).alias("hardy_score"), F.lit(o).alias("other_score"),
                               F.lit(w).alias("water_requirement"), F.lit(r).alias("reason"))
                      for c, h, o, w, r in K.CROP_SUITABILITY])
    x = df.withColumn("drought_hardy", hardy).withColumn("__c", F.explode(table))
    return x.withColumns({
        "crop": F.col("__c.crop"),
        "suitability_score": F.when(F.col("drought_hardy"), F.col("__c.hardy_score")).otherwise(F.col("__c.other_score")),
        "water_requirement": F.col("__c.water_requirement"),
    }).drop("__c")


def advisory(df: DataFrame, risk="risk_score") -> DataFrame:
    high = F.col(risk) >= K.HIGH_RISK
    return df.withColumns({
        "irrigation_advice": F.when(high, K.ADVICE_HIGH).otherwise(K.ADVICE_LOW),
        "risk_warnings": F.when(high, F.array(*[F.lit(w) for w in K.WARNINGS_HIGH]))
                          .otherwise(F.array(*[F.lit(w) for w in K.WARNINGS_LOW])),
        "mitigation_tips": F.array(*[F.lit(t) for t in K.MITIGATION_TIPS]),
    })


def magnitude_importance(df: DataFrame, features: list[str], id_cols=("grid_id",), top: int = 8) -> DataFrame:
    """Fallback explanation: top ``top`` features by |value| per row, normalised to
    shares (total floored at 1e-6), rounded to 4 places."""
    from pyspark.sql import Window
    long = df.select(*id_cols, *features).unpivot(list(id_cols), features, "feature", "value")
    long = long.withColumn("mag", F.abs("value"))
    w = Window.partitionBy(*id_cols).orderBy(F.desc("mag"), F.asc("feature"))
    top_rows = long.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top)
    tot = F.greatest(F.sum("mag").over(Window.partitionBy(*id_cols)), F.lit(1e-6))
    return top_rows.select(*id_cols, "feature", "rk", F.bround(F.col("mag") / tot, 4).alias("importance"))
