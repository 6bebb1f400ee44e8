"""Temporary views for SQL over the panel, its indices and its features."""
from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import fixtures as FX
from .frames import feature_panel, indexed_panel

#: View -> the frame behind it.
VIEWS = {
    "panel": FX.panel,
    "panel_indices": indexed_panel,
    "panel_features": feature_panel,
    "district_panel": FX.district_panel,
    "history": FX.history,
    "users": FX.users,
    "logs": FX.logs,
}


def register_views(spark: SparkSession, sf_dir: str, names=tuple(VIEWS)) -> tuple[str, ...]:
    """Register ``names`` as temporary views of the session.  A view is a plan: nothing is computed or kept, and a query over it is
    optimised as a whole (columns and filters reach the scans)."""
    for name in names:
        VIEWS[name](spark, sf_dir).createOrReplaceTempView(name)
    return names
