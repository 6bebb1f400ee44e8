"""Operators checked against plain numpy/pandas brute force on small fixtures."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdure.functions import constants as K
from verdure.functions.wavelet import approx_weights
from verdure.operators import datasets as DS
from verdure.operators import metrics as M
from verdure.operators import models as ML
from verdure.operators import scoring as SC
from verdure.operators import temporal as T


def _dwt_lowband_last(x):
    """Level-1 periodised db4 low band of x (numpy, explicit analysis + synthesis)."""
    taps = np.asarray(K.DB4_DEC_LO)
    n = len(x)
    xe = np.append(x, x[-1]) if n % 2 else np.asarray(x, float)
    size = len(xe)
    rec = np.zeros(size)
    for phase in range(4, 4 + size, 2):
        idx = [(phase - j) % size for j in range(len(taps))]
        a = sum(taps[j] * xe[idx[j]] for j in range(len(taps)))
        for j in range(len(taps)):
            rec[idx[j]] += taps[j] * a
    return rec[n - 1]


def test_wavelet_weights_sum_to_one_and_idempotent():
    for n in range(4, 13):
        w = np.asarray(approx_weights(n))
        assert abs(w.sum() - 1) < 1e-12
    assert np.allclose(approx_weights(4), [0.006712, 0.057539, 0.493288, 0.442461], atol=1e-6)


def test_causal_wavelet_matches_numpy(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in ("a", "b"):
        vals = rng.normal(size=20)
        for i, v in enumerate(vals):
            rows.append((g, pd.Timestamp("2020-01-01") + pd.DateOffset(months=i), float(v)))
    pdf = pd.DataFrame(rows, columns=["grid_id", "date", "x"])
    df = spark.createDataFrame(pdf).withColumn("date", F.to_date("date"))
    got = T.add_wavelet_causal(df, ["x"]).orderBy("grid_id", "date").toPandas()
    exp_a, exp_d = [], []
    for g, grp in pdf.groupby("grid_id"):
        s = grp["x"].shift(1).ffill().bfill().to_numpy()
        for pos in range(len(s)):
            h = s[max(0, pos - 11): pos + 1]
            if len(h) < 4 or np.std(h) == 0:
                a = h[-1]
            else:
                a = _dwt_lowband_last(h)
            exp_a.append(a)
            exp_d.append(h[-1] - a)
    assert np.allclose(got["x_wavelet_approx"], exp_a, atol=1e-12)
    assert np.allclose(got["x_wavelet_detail"], exp_d, atol=1e-12)


def test_interpolate_matches_pandas(spark):
    pdf = pd.DataFrame({"grid_id": ["a"] * 8, "date": pd.date_range("2020-01-01", periods=8, freq="MS"),
                        "x": [None, 1.0, None, None, 4.0, None, 6.0, None]})
    df = spark.createDataFrame(pdf).withColumn("date", F.to_date("date"))
    got = T.interpolate(df, ["x"]).orderBy("date").toPandas()["x"].to_numpy()
    want = pdf["x"].interpolate(limit_direction="both").to_numpy()
    assert np.allclose(got, want)


def test_regression_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.uniform(0, 1, 200)
    p = np.clip(y + rng.normal(0, 0.1, 200), 0, 1)
    df = spark.createDataFrame(pd.DataFrame({"protocol": "x", "model": "m", "y_true": y, "y_pred": p}))
    m = M.regression_metrics(df).first()
    sse = ((p - y) ** 2).sum()
    sst = ((y - y.mean()) ** 2).sum()
    assert math.isclose(m["r2"], 1 - sse / sst, rel_tol=1e-9)
    assert math.isclose(m["rmse"], math.sqrt(sse / len(y)), rel_tol=1e-9)
    assert math.isclose(m["mae"], np.abs(p - y).mean(), rel_tol=1e-9)
    wd = ((np.abs(p - y.mean()) + np.abs(y - y.mean())) ** 2).sum()
    assert math.isclose(m["willmott_index"], 1 - sse / wd, rel_tol=1e-9)
    assert math.isclose(m["pearson_correlation"], np.corrcoef(y, p)[0, 1], rel_tol=1e-9)


def _cls(v):
    return 4 if v < .2 else 3 if v < .35 else 2 if v < .5 else 1 if v < .65 else 0


def test_f1_macro_weighted_match_manual(spark):
    rng = np.random.default_rng(3)
    y = rng.uniform(0, 1, 300)
    p = rng.uniform(0, 1, 300)
    df = spark.createDataFrame(pd.DataFrame({"protocol": "x", "model": "m", "y_true": y, "y_pred": p}))
    r = M.severity_f1(M.severity_confusion(df)).first()
    tc, pc = [_cls(v) for v in y], [_cls(v) for v in p]
    classes = sorted(set(tc) | set(pc))
    f1s, sup = [], []
    for c in classes:
        tp = sum(1 for a, b in zip(tc, pc) if a == b == c)
        fp = sum(1 for a, b in zip(tc, pc) if b == c and a != c)
        fn = sum(1 for a, b in zip(tc, pc) if a == c and b != c)
        f1s.append(0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn))
        sup.append(sum(1 for a in tc if a == c))
    assert math.isclose(r["f1_macro"], np.mean(f1s), rel_tol=1e-9)
    assert math.isclose(r["f1_weighted"], np.dot(f1s, sup) / sum(sup), rel_tol=1e-9)
    assert math.isclose(r["accuracy"], np.mean([a == b for a, b in zip(tc, pc)]), rel_tol=1e-9)


def test_recursive_forecast_matches_loop(spark):
    df = spark.createDataFrame([("g", pd.Timestamp("2021-05-01").date(), 60.0), ("h", pd.Timestamp("2021-05-01").date(), 3.0)],
                               "grid_id string, date date, vhi double")
    got = SC.recursive_forecast(df, 6).orderBy("grid_id", "step").toPandas()
    for g, v0 in (("g", 60.0), ("h", 3.0)):
        v = v0
        for s in range(1, 7):
            v = min(100.0, max(0.0, v - 2.5 * s))
            row = got[(got.grid_id == g) & (got.step == s)].iloc[0]
            assert row["forecast_vhi"] == round(v, 2)
            assert row["confidence"] == round(max(0.55, 0.92 - s * 0.07), 2)


def test_crops_order_preserving_distinct(spark):
    df = spark.createDataFrame([("Maharashtra", K.MODERATE), ("Nowhere", K.NONE)], "state string, severity string")
    got = df.select(SC.crops(F.col("severity"), F.col("state")).alias("c")).collect()
    merged = list(dict.fromkeys(K.STATE_CROPS["Maharashtra"] + K.MODERATE_CROPS))[:6]
    assert got[0]["c"] == merged
    assert got[1]["c"] == K.NORMAL_CROPS[:6]


def test_time_series_cv_folds_do_not_share_dates(spark, sf):
    from verdure.sources.fixtures import panel
    f = DS.time_series_cv_folds(panel(spark, sf).select("grid_id", "date"))
    both = (f.groupBy("fold", "date").agg(F.countDistinct("role").alias("r")).where("r > 1").count())
    assert both == 0


def test_spatial_split_moves_whole_cells(spark, sf):
    from verdure.sources.fixtures import panel
    s = DS.split_spatial(panel(spark, sf))
    assert s.groupBy("grid_id").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0


def test_nonneg_ridge_matches_lstsq_when_interior():
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (500, 3))
    y = x @ np.array([0.2, 0.5, 0.3]) + rng.normal(0, 0.01, 500)
    xx, xy = (x.T @ x).tolist(), (x.T @ y).tolist()
    w = ML.nonneg_ridge(xx, xy, alpha=0.05)
    ref = np.linalg.solve(x.T @ x + 0.05 * np.eye(3), x.T @ y)
    assert np.allclose(w, ref, atol=1e-6)


@pytest.mark.parametrize("n", [4, 7, 12])
def test_projector_rows_reproduce_constant_series(n):
    w = approx_weights(n)
    assert abs(sum(w) - 1.0) < 1e-12


def _lowband(spark):
    """The whole-series transform of an array, as Spark evaluates it."""
    from pyspark.sql import functions as F

    from verdure.functions.wavelet import full_series_sql

    def run(x):
        d = spark.createDataFrame([([float(v) for v in x],)], "x array<double>")
        return np.array(d.select(F.expr(full_series_sql("x")).alias("y")).first().y)
    return run


def test_full_wavelet_is_a_projection_and_keeps_constants(spark):
    full_series_lowband = _lowband(spark)
    rng = np.random.default_rng(11)
    for n in (4, 9, 27, 28, 83):
        x = rng.normal(size=n)
        once = full_series_lowband(x)
        if n % 2 == 0 and (n // 2) % 2 == 0 or n < 28 and n % 2 == 0:
            assert np.allclose(full_series_lowband(once), once, atol=1e-10)
        assert np.allclose(full_series_lowband(np.full(n, 3.5)), 3.5, atol=1e-10)
    x = rng.normal(size=3)
    assert np.allclose(full_series_lowband(x), x)


def test_full_wavelet_level1_matches_causal_weights(spark):
    full_series_lowband = _lowband(spark)
    rng = np.random.default_rng(13)
    for n in range(4, 13):
        x = rng.normal(size=n)
        assert math.isclose(full_series_lowband(x)[-1], float(np.dot(approx_weights(n), x)), abs_tol=1e-12)


def test_wavelet_full_operator(spark, sf):
    from verdure.sources.fixtures import panel
    out = T.wavelet_full(panel(spark, sf), ["ndvi"]).toPandas()
    src = panel(spark, sf).toPandas()
    assert len(out) == len(src)
    j = out.merge(src, on=["grid_id", "date"])
    assert np.allclose(j["ndvi_wavelet_approx"] + j["ndvi_wavelet_detail"], j["ndvi"])


@pytest.mark.parametrize("probs", [[0.5], [0.25, 0.75], [0.0, 0.05, 0.95, 1.0]])
def test_exact_quantiles_match_numpy(spark, probs):
    from verdure.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25)])  # a hot value: 40% of rows
    y = np.concatenate([rng.exponential(size=4000) * 1e9, np.full(1000, np.nan)])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": [None] * 5000}), "x double, y double, z double")
    got = exact_quantiles(df, ["x", "y", "z"], probs, buckets=16)
    assert np.allclose(got["x"], np.quantile(x, probs), rtol=0, atol=1e-12)
    assert np.allclose(got["y"], np.quantile(y[:4000], probs), rtol=1e-12)
    assert got["z"] == [None] * len(probs)


def test_grouped_quantiles_match_numpy(spark):
    from verdure.operators.quantiles import grouped_quantiles
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 6, 3000), "value": np.round(rng.normal(size=3000), 2)})
    got = {r.k: r.q for r in grouped_quantiles(spark.createDataFrame(pdf), ["k"], [0.02, 0.5, 0.98], buckets=7).collect()}
    for k, g in pdf.groupby("k"):
        assert np.allclose(got[k], np.quantile(g.value, [0.02, 0.5, 0.98]), atol=1e-12)


def test_raster_stretch_fills_before_percentiles(spark):
    from verdure.operators.aggregate import raster_stretch
    vals = [0.1, 0.2, 0.4, 0.9, None, None, None, None]
    df = spark.createDataFrame([("d", 0, i, "c", v) for i, v in enumerate(vals)], "date string, lat int, lon int, channel string, value double")
    got = [r.value for r in raster_stretch(df).orderBy("lon").collect()]
    filled = np.array([v if v is not None else 0.3 for v in vals])
    lo, hi = np.percentile(filled, [2, 98])
    assert np.allclose(got, np.clip((filled - lo) / (hi - lo), 0, 1))


def test_composite_reducers_do_not_depend_on_size(spark, sf):
    from verdure.plans.q_sources import COMPOSITE_RULES, scene_samples
    from verdure.sources.readers import composite_month
    s = scene_samples(spark, sf)
    exact = composite_month(s, COMPOSITE_RULES)
    plan = exact._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
    sketch = composite_month(s, {**COMPOSITE_RULES, "s2": "median_sketch"}).toPandas()
    raw = s.where("band = 's2'").withColumn("date", F.trunc(F.col("ts").cast("date"), "month")).toPandas()
    mids = raw.groupby(["grid_id", "date"])["value"].agg(
        lo=lambda v: sorted(v)[(len(v) - 1) // 2], hi=lambda v: sorted(v)[len(v) // 2]).reset_index()
    j = sketch.merge(mids, on=["grid_id", "date"])
    assert ((j["s2"] >= j["lo"]) & (j["s2"] <= j["hi"])).all()


def test_csv_columns_bind_by_name(spark, tmp_path):
    from verdure.sources.readers import read_grid_csvs
    for name, text in (("a.csv", "NDVI,LST,date\n0.4,35.0,1996_01\n"), ("b.csv", "date,LST,extra\n1996_02,30.0,x\n")):
        (tmp_path / f"source_file={name}").mkdir()
        (tmp_path / f"source_file={name}" / "part.csv").write_text(text)
    got = {r.source_file: (r.NDVI, r.LST, r.date) for r in read_grid_csvs(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (0.4, 35.0, "1996_01"), "b.csv": (None, 30.0, "1996_02")}
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        read_grid_csvs(spark, str(tmp_path / "none"))


def test_strict_geojson_raises(spark):
    from verdure.operators.conform import geojson_point
    df = spark.createDataFrame([('{"type":"Point","coordinates":[1.0,2.0]}',), ("broken",)], "`.geo` string")
    assert geojson_point(df).where("longitude IS NULL").count() == 1
    with pytest.raises(Exception, match="GeoJSON"):
        geojson_point(df, strict=True).collect()


def test_last_login_reads_emails(spark):
    from verdure.operators.history import last_login
    users = spark.createDataFrame([(1, "a@x.org"), (2, "b@x.org")], "id long, email string")
    logs = spark.createDataFrame([("user_login", "User logged in: a@x.org", "2024-01-02"), ("user_login", "User logged in: a@x.org", "2024-01-01"),
                                  ("user_signup", "User registered: b@x.org", "2024-01-03"), ("user_login", "no address", "2024-01-04")],
                                 "event string, message string, created_at string")
    assert {r.id: r.last_login for r in last_login(users, logs).collect()} == {1: "2024-01-02", 2: None}


def test_claims_name_known_protocols_only(spark):
    m = spark.createDataFrame([(p, "m", 0.999, 1e-6, 1e-6) for p in [*K.PROTOCOL_NOTES, "chrono_train"]],
                              "protocol string, model string, r2 double, rmse double, mae double")
    got = {r.protocol: r for r in M.claim_text(m).collect()}
    assert got["chrono_train"].note is None and "rolling" not in got["chrono_train"].claim
    assert "not future forecasting" in got[K.SAME_MONTH_PROTOCOL].claim
    assert all(got[p].note == n for p, n in K.PROTOCOL_NOTES.items())


def test_feature_selection_rules():
    from verdure.operators.conform import feature_groups, select_group_features
    names = ["ndvi", "lst", "month", "vhi_lag_1", "vhi_lag_6", "vhi_roll_3", "vhi_roll_12", "vhi_std_3", "vhi_wavelet_detail", "longitude", "odd"]
    assert set(feature_groups(names)) == {"base_remote_sensing", "seasonal", "vhi_lag_roll", "vhi_wavelet", "location"}
    assert select_group_features(names, 1, 1) == sorted(["ndvi", "lst", "month", "vhi_lag_1", "vhi_roll_3", "longitude"])
    assert "vhi_wavelet_detail" in select_group_features(names, 12, 2)
    many = [f"ndvi_lag_{i}" for i in range(1, 40)]
    assert select_group_features(many, 1, 1) == sorted(many)  # too few left: all, not a part


def test_cut_row_split_equals_sorting(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame([(f"g{g:03d}", pd.Timestamp("2020-01-01") + pd.DateOffset(months=int(m))) for g in range(50) for m in range(int(rng.integers(1, 9)))],
                       columns=["grid_id", "date"])
    df = spark.createDataFrame(pdf).withColumn("date", F.to_date("date"))
    got = DS.split_valid_rows(df).toPandas().sort_values(["date", "grid_id"])
    assert (got.split == "fit").tolist() == [i < int(len(pdf) * 0.8) for i in range(len(pdf))]


def test_checkpoint_folder_must_be_shared_on_a_cluster(monkeypatch):
    from verdure import session

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_permutation_importance_covers_every_feature(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 1, (300, 3))
    pdf = pd.DataFrame({"grid_id": [f"g{i}" for i in range(300)], "date": "2020-01-01", "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": 0.7 * x[:, 0]})
    df = ML.assemble(spark.createDataFrame(pdf), ["a", "b", "c"])
    model = ML.fit(ML.linear(), df)
    got = {r.feature: r.importance for r in ML.permutation_importance(model, df, ["a", "b", "c"], repeats=2).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] > 0.1 and abs(got["b"]) < 1e-6 and abs(got["c"]) < 1e-6


def test_global_rank_across_ranges(spark):
    from verdure.operators.joins import global_rank
    rng = np.random.default_rng(31)
    keys = [f"k{int(v):06d}" for v in rng.choice(10**6, 2000, replace=False)]
    df = spark.createDataFrame([(k,) for k in keys + keys[:100]], "grid_id string")  # duplicates collapse
    got = {r["grid_id"]: r["rank"] for r in global_rank(df, "grid_id", partitions=7).collect()}
    want = {k: i for i, k in enumerate(sorted(set(keys)))}
    assert got == want


def test_spatial_exact_count_holds_out_floor_fraction(spark, sf):
    from verdure.sources.fixtures import panel
    p = panel(spark, sf)
    n = p.select("grid_id").distinct().count()
    s = DS.split_spatial(p, exact_count=True)
    held = s.where("split = 'test'").select("grid_id").distinct().count()
    assert held == max(1, int(n * 0.2))
    assert s.count() == p.count()
    assert s.groupBy("grid_id").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0


def test_stream_counts_late_rows_within_the_watermark(spark, tmp_path):
    from verdure.streaming import history_stream as HS
    rows = {"2024-01-01": ["2024-01-01 10:00:00"] * 2, "2024-01-03": ["2024-01-03 09:00:00"]}
    src, sink, ckpt = (str(tmp_path / x) for x in ("src", "sink", "ckpt"))

    def land(day, stamps):
        df = spark.createDataFrame([(i, "S", "D", 80.0, s, "Severe Drought") for i, s in enumerate(stamps)],
                                   "id long, state string, district string, risk_score double, created_at string, severity string")
        df = df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("day", F.lit(day).cast("date"))
        df.write.mode("append").partitionBy("day").parquet(src)
        HS.run_available_now(HS.severity_counts_stream(spark, src), sink, ckpt)
        return {str(r.window.start)[:10]: r.n for r in HS.read_counts(spark, sink).collect()}

    assert land("2024-01-01", rows["2024-01-01"]) == {"2024-01-01": 2}
    assert land("2024-01-03", rows["2024-01-03"]) == {"2024-01-01": 2, "2024-01-03": 1}
    # the watermark now stands at 2024-01-02 09:00: a late row of 01-02 counts, one of 01-01 comes too late
    assert land("2024-01-02", ["2024-01-02 12:00:00"]) == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-03": 1}
    assert land("2024-01-01", ["2024-01-01 11:00:00"]) == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-03": 1}
