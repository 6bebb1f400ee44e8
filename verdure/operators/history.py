"""Prediction-history and log analytics (dashboard aggregates).

Top-N reports use ``orderBy(...).limit(n)``, which Spark plans as a
TakeOrderedAndProject: each task keeps its own top n, the driver merges n per
task — bounded by n, not by the table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import severity_label_risk


def with_severity(hist: DataFrame, risk="risk_score") -> DataFrame:
    return hist.withColumn("severity", severity_label_risk(risk))


def latest_n(df: DataFrame, n: int, ts="created_at", tie="id") -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def counters(hist: DataFrame, risk="risk_score") -> DataFrame:
    return hist.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(risk) >= K.HIGH_RISK).alias("high_risk"))


def severity_counts(hist: DataFrame) -> DataFrame:
    return with_severity(hist).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def dashboard(hist: DataFrame, risk="risk_score", ts="created_at", tie="id") -> DataFrame:
    """total, high-risk count, average risk, severity of the newest prediction (one pass)."""
    h = with_severity(hist, risk)
    return h.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(F.col(risk) >= K.HIGH_RISK).alias("high_risk"),
                 F.avg(risk).alias("avg_risk"),
                 F.max_by("severity", F.struct(F.col(ts), F.col(tie))).alias("latest_severity"))


def risk_trend(hist: DataFrame, n: int = 20, risk="risk_score", ts="created_at", tie="id") -> DataFrame:
    """The newest n risk points, oldest first."""
    return latest_n(hist, n, ts, tie).select(tie, ts, risk).orderBy(ts, tie)


def admin_analytics(users: DataFrame, hist: DataFrame) -> DataFrame:
    u = users.agg(F.count(F.lit(1)).alias("total_users"), F.count_if(F.col("is_active")).alias("active_users"))
    return u.withColumn("forecast_usage", hist.agg(F.count(F.lit(1))).scalar())


def admin_report(users: DataFrame, hist: DataFrame, logs: DataFrame, n_logs: int = 20) -> DataFrame:
    """The counters of ``admin_analytics`` beside each of the newest ``n_logs`` log rows (one row of counters, logs
    NULL, when there are none)."""
    counters = admin_analytics(users, hist)
    newest = latest_n(logs, n_logs).agg(F.collect_list(F.struct("id", "event", "message", "created_at"))).scalar()
    return counters.withColumn("__l", F.explode_outer(newest)).select(
        "total_users", "active_users", "forecast_usage", F.col("__l.id").alias("log_id"), F.col("__l.event").alias("event"),
        F.col("__l.message").alias("message"), F.col("__l.created_at").alias("created_at"))


EMAIL = r"([^\s:]+@[^\s]+)"


def last_login(users: DataFrame, logs: DataFrame, login_event: str = "user_login") -> DataFrame:
    """Latest login per user.  The email is parsed out of the message so the join is an equi-join (no substring
    nested loop); messages without one match nobody."""
    lg = (logs.where(F.col("event") == login_event)
              .withColumn("__email", F.regexp_extract("message", EMAIL, 1)).where("__email <> ''")
              .groupBy("__email").agg(F.max("created_at").alias("last_login")))
    return users.join(lg, F.col("email") == F.col("__email"), "left").select("id", "email", "last_login")


def user_search(users: DataFrame, term: str) -> DataFrame:
    return users.where(F.lower(F.concat_ws(" ", "email", "role")).contains(term.lower()))
