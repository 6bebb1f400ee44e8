"""Physical-plan properties the operators are designed for."""
import pytest

import __spark_entry__ as E
from verdure.plans import load_all
from verdure.plans.frames import feature_panel

QUERIES = load_all()[0]
ML_KEYS = {k for k in QUERIES if k.startswith("ml_") and k not in ("ml_persistence", "ml_magnitude_importance")}
IO_KEYS = {"stream_history_counters"}


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_panel_single_shuffle_by_cell(spark, sf):
    p = plan_text(feature_panel(spark, sf))
    # one exchange for the collapse (grid_id, date) and one by grid_id for all windows
    assert p.count("hashpartitioning(grid_id") >= 1
    assert p.count("Exchange") <= 3, p


@pytest.mark.parametrize("key", sorted(set(QUERIES) - ML_KEYS - IO_KEYS))
def test_no_python_udf_no_cartesian(spark, sf, key):
    p = plan_text(QUERIES[key](spark, sf))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{key}: {bad}"


def test_scoring_of_fitted_models_is_join_free(spark, sf):
    """Predictions of several models stand side by side without a join on the keys."""
    from verdure.operators import models as ML
    from verdure.plans.q_models import ml_data

    tr, te, feats = ml_data(spark, sf)
    assert not set(feats) - {"vhi", "vci", "tci"} & set(te.columns)
    quick = {"gbt": ML.fit(ML.gbt({"maxIter": 2}), tr), "forest": ML.fit(ML.forest({"numTrees": 2}), tr), "linear": ML.fit(ML.linear(), tr)}
    p = plan_text(ML.score_many(quick, te))
    assert "Join" not in p


def test_file_queries_read_no_text(spark, sf):
    for key in ("src_grid_csv_union", "src_file_window", "dq_export_inspect"):
        p = plan_text(QUERIES[key](spark, sf))
        assert "Scan text" not in p and "Scan csv" in p, key


def test_pruned_scan_reads_two_columns(spark, sf):
    df = QUERIES["src_pruned_scan"](spark, sf)
    p = plan_text(df)
    import re
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert set(schema.split(",")) == {"l_suppkey:bigint", "l_quantity:double"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"protocol", "model", "r2", "rmse", "mae", "f1_weighted"} <= set(df.columns)
