"""Registered queries: operators of the inventory written as SQL text over the temporary views."""
from __future__ import annotations

from .registry import ORACLES, register, rounded
from .views import register_views


def _sql(spark, d, views, text):
    register_views(spark, d, views)
    return rounded(spark.sql(text))


def register_sql(key: str, of: str, views: tuple[str, ...], text: str) -> None:
    """``key``: the SQL ``text`` over the views; its rows are those of the operator ``of``."""
    register(key, ORACLES[of])(lambda spark, d: _sql(spark, d, views, text))


SIGNALS, LAGS = ("ndvi", "lst", "rainfall"), (1, 2, 3, 6)

register_sql("sql_idx_vhi", "idx_vhi", ("panel_indices",), "SELECT grid_id, date, vhi FROM panel_indices")

register_sql("sql_agg_region_month", "agg_region_month", ("panel",),
             f"SELECT date, {', '.join(f'avg({c}) AS {c}' for c in SIGNALS)} FROM panel GROUP BY date")

register_sql("sql_win_lag", "win_lag", ("panel_features",),
             f"SELECT grid_id, date, {', '.join(f'{c}_lag_{k}' for c in ('ndvi', 'rainfall', 'vhi') for k in LAGS)} FROM panel_features")

register_sql("sql_hist_severity_counts", "hist_severity_counts", ("history",), """
SELECT CASE WHEN risk_score >= 75 THEN 'Extreme Drought' WHEN risk_score >= 55 THEN 'Severe Drought' WHEN risk_score >= 35 THEN 'Moderate Drought'
  WHEN risk_score >= 20 THEN 'Mild Drought' ELSE 'No Drought' END AS severity, count(*) AS n FROM history GROUP BY 1""")
