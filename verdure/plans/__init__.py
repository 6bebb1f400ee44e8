"""Registered queries (one per operator key) and their DuckDB oracles."""
from . import registry


def load_all():
    """Import every query module so its ``@register`` calls run."""
    from . import q_indices  # noqa: F401
    for mod in ("q_sources", "q_quality", "q_aggregate", "q_temporal", "q_datasets", "q_scoring", "q_metrics",
                "q_models", "q_streaming", "q_views"):
        try:
            __import__(f"{__name__}.{mod}")
        except ModuleNotFoundError as e:
            if mod not in str(e):
                raise
    return registry.QUERIES, registry.ORACLES
