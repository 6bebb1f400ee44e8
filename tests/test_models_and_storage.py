"""Searches, stacks, one-pass scoring, permutation, exact sampling, headers, history batches, stream compaction, folds, views."""
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from verdure.functions.constants import DB4_DEC_LO
from verdure.operators import conform as C
from verdure.operators import datasets as DS
from verdure.operators import models as ML
from verdure.operators import quantiles as Q
from verdure.operators import search as SE
from verdure.operators import temporal as T
from verdure.sources import readers as R
from verdure.streaming import history_stream as HS

FEATURES = ["ndvi", "lst", "rainfall", "month_sin", "ndvi_lag_1", "ndvi_lag_6", "ndvi_roll_3", "ndvi_roll_12", "lst_lag_2", "lst_wavelet_approx",
            "lst_wavelet_detail", "ndvi_std_3"]


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 600
    d = pd.DataFrame(rng.random((n, len(FEATURES))), columns=FEATURES)
    d["label"] = (0.5 * d.ndvi + 0.3 * d.ndvi_lag_1 + 0.1 * rng.random(n)).clip(0, 1)
    d["grid_id"], d["date"] = [str(i % 30) for i in range(n)], [f"2000-{i // 30 % 12 + 1:02d}-{i // 360 + 1:02d}" for i in range(n)]
    df = VectorAssembler(inputCols=FEATURES, outputCol=ML.FEATURES_COL).transform(spark.createDataFrame(d))
    return ML.training_table(df.repartition(4, "grid_id"))


# ------------------------------------------------------------------ search
def test_points_decode_to_rules():
    space = SE.Space(tuple(FEATURES))
    assert space.switched == ("lst_lag_roll", "lst_wavelet", "ndvi_lag_roll") and "ndvi_std_3" not in space.features
    assert space.dimensions == len(ML.GBT_SPACE) + 2 + 3
    k = len(ML.GBT_SPACE)
    for u, window in ((0.0, 1), (0.19, 1), (0.2, 2), (0.55, 3), (0.79, 6), (1.0, 12)):
        t = space.decode([0.5] * k + [u, 0.0] + [1.0] * 3)
        assert t.lag_window == window and t.wavelet_level == 1 and "lst_wavelet_detail" not in t.features
        assert ("ndvi_lag_6" in t.features) == (window >= 6) and ("ndvi_roll_12" in t.features) == (window == 12) and "ndvi_roll_3" in t.features
    t = space.decode([0.5] * k + [1.0, 0.9, 1.0, 1.0, 0.41])
    assert t.groups == ("lst_lag_roll", "lst_wavelet") and not any(f.startswith("ndvi_") for f in t.features) and "lst_wavelet_detail" in t.features
    assert SE.Space(tuple(FEATURES), blend=True).decode([0.0] * (k + 3 + 3)).blend == SE.BLEND[0]


def test_slices_hold_the_trials_features(spark, rows):
    space = SE.Space(tuple(FEATURES))
    frozen = SE.superset(rows, space)
    t = space.decode([0.5] * len(ML.GBT_SPACE) + [0.5, 0.0, 0.0, 1.0, 1.0])
    one = SE.sliced(frozen.where("grid_id = '7' AND date = '2000-01-01'"), space, t).first()
    want = rows.where("grid_id = '7' AND date = '2000-01-01'").first()
    assert list(one[SE.SLICE].toArray()) == [want[f] for f in t.features]


def test_swarm_fits_each_trial_once_and_finds_the_best(spark, rows, monkeypatch):
    space = SE.Space(tuple(FEATURES))
    frozen = SE.superset(rows, space)
    asked = []

    def scored(trial, *_):
        asked.append(trial)
        return 1.0 / trial.lag_window + 0.1 * (2 - trial.wavelet_level) + (0.5 if "ndvi_lag_roll" not in trial.groups else 0.0)

    monkeypatch.setattr(SE, "rmse_of", scored)
    monkeypatch.setattr(ML, "decode", lambda p: {"maxDepth": 3})
    best, trials = SE.mixed_swarm(frozen, frozen, space, particles=12, iterations=12, seed=3, inertia=(0.82, 0.38), own_pull=(1.65, 1.15), swarm_pull=(1.1, 1.85))
    t = trials.toPandas()
    assert len(t) == 144 and len(asked) == len(set(asked)) < 144
    assert best.lag_window == 12 and best.wavelet_level == 2 and "ndvi_lag_roll" in best.groups
    assert t.rmse.min() == scored(best) and t[t.iteration == 11].rmse.mean() < t[t.iteration == 0].rmse.mean()
    _, short = SE.mixed_swarm(frozen, frozen, space, particles=2, iterations=30, inertia=(0, 0), own_pull=(0, 0), swarm_pull=(0, 0), patience=2)
    assert short.agg(F.max("iteration")).first()[0] < 29


def test_blended_trial_equals_its_parts(rows):
    space = SE.Space(tuple(FEATURES), blend=True)
    frozen = SE.superset(rows, space)
    t = space.decode([0.2] * len(ML.GBT_SPACE) + [0.9, 0.9, 0.5, 1.0, 1.0, 1.0])
    models = SE.fitted(frozen, space, t)
    got = SE.predicted(models, frozen, space, t)
    both = ML.score_many(models, SE.sliced(frozen, space, t))
    a = {(r.grid_id, r.date): r.y_pred for r in got.collect()}
    for r in both.collect():
        assert a[r.grid_id, r.date] == pytest.approx(min(1, max(0, t.blend * r.p_forest + (1 - t.blend) * r.p_gbt)), abs=1e-12)
    assert "Join" not in plan_text(got)


# ------------------------------------------------------------------ one-pass scoring, stacks, saved models
def test_many_models_score_in_one_pass(rows):
    models = {"gbt": ML.fit(ML.gbt({"maxIter": 3}), rows), "linear": ML.fit(ML.linear(), rows), "again": ML.fit(ML.linear(), rows)}
    wide = ML.score_many(models, rows)
    assert "Join" not in plan_text(wide) and set(wide.columns) - set(rows.columns) == {"p_gbt", "p_linear", "p_again"}
    for name, m in models.items():
        apart = {(r.grid_id, r.date): r.prediction for r in m.transform(rows).collect()}
        assert all(apart[r.grid_id, r.date] == r[f"p_{name}"] for r in wide.collect())
    assert "Join" not in plan_text(ML.ensemble(rows, rows, gbt_params={"maxIter": 2}, forest_params={"numTrees": 2}))


@pytest.mark.parametrize("passthrough", [True, False])
def test_stack_has_no_join_and_sees_features(rows, passthrough):
    base = {"forest": lambda: ML.forest({"numTrees": 3, "maxDepth": 3}), "gbt": lambda: ML.gbt({"maxIter": 2})}
    s = ML.fit_stack(rows, base=base, passthrough=passthrough, meta=ML.boosted_meta if passthrough else lambda: ML.LinearRegression())
    assert s.meta.numFeatures == 2 + len(FEATURES) * passthrough
    out = s.predict(rows)
    assert "Join" not in plan_text(out)
    got = out.toPandas()
    assert len(got) == 600 and got.y_pred.between(0, 1).all() and (got.y_pred - got.label).abs().mean() < 0.12


def test_saved_model_scores_like_the_fitted_one(spark, rows, tmp_path):
    for est in (ML.gbt({"maxIter": 3}), ML.linear()):
        m = ML.fit(est, rows)
        loaded, names = ML.load_model(spark, ML.save_model(m, FEATURES, str(tmp_path / "m"), spark))
        assert names == FEATURES
        again = ML.assemble(rows.drop(ML.FEATURES_COL), names)
        a = {(r.grid_id, r.date): r.prediction for r in loaded.transform(again).collect()}
        assert a == {(r.grid_id, r.date): r.prediction for r in m.transform(rows).collect()}


# ------------------------------------------------------------------ permutation
@pytest.mark.parametrize("n,parts", [(1, 3), (2, 3), (500, 7)])
def test_shift_gives_every_row_the_next_one(spark, n, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        d = spark.range(n).select(F.col("id"), F.md5(F.col("id").cast("string").cast("binary")).alias("o"))
        got = {r.id: r.next for r in ML.shifted(d, "o", "id", "next").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    order = sorted(range(n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert got == {i: order[(k + 1) % n] for k, i in enumerate(order)}


def test_permutation_importance_equals_a_plain_rerun(spark, rows):
    feats = FEATURES[:4]
    df = VectorAssembler(inputCols=feats, outputCol=ML.FEATURES_COL).transform(rows.drop(ML.FEATURES_COL))
    m = ML.fit(ML.linear(), df)
    got = {r.feature: r.importance for r in ML.permutation_importance(m, df, feats, repeats=2).collect()}
    d = df.drop(ML.FEATURES_COL).toPandas()

    def rmse(x):
        t = VectorAssembler(inputCols=feats, outputCol=ML.FEATURES_COL).transform(spark.createDataFrame(x))
        p = m.transform(t).toPandas()
        return float(np.sqrt(((p.prediction.clip(0, 1) - p.label) ** 2).mean()))

    base = rmse(d)
    for f in feats:
        each = []
        for r in range(2):
            key = d.grid_id + "|" + d.date
            order = [hashlib.md5(f"{r}|{k}".encode()).hexdigest() for k in key]
            s = d.iloc[np.argsort(order)].reset_index(drop=True)
            s[f] = np.roll(s[f].to_numpy(), -1)
            each.append(rmse(s))
        assert got[f] == pytest.approx(np.mean(each) - base, abs=1e-9)


# ------------------------------------------------------------------ exact sampling, quantiles
def test_caps_are_exact(spark):
    d = spark.createDataFrame([(str(i % 50), i // 50) for i in range(1000)] + [("7", 3)] * 30 + [(None, 1), ("8", None)], "grid_id string, date int")
    for n in (0, 1, 37, 500, 1031, 1032, 5000):
        got = sorted(((r.grid_id, r.date) for r in DS.cap_rows(d, n).collect()), key=str)
        text = [(hashlib.md5(f"42{r.grid_id or ''}{'' if r.date is None else r.date}".encode()).hexdigest(), str(r.grid_id), str(r.date), r) for r in d.collect()]
        want = sorted(((x[3].grid_id, x[3].date) for x in sorted(text, key=lambda x: x[:3])[:n]), key=str)
        assert got == want and len(got) == min(n, 1032)
    cells = DS.cap_by_grid(d.where("grid_id IS NOT NULL AND date IS NOT NULL"), 200).select("grid_id").distinct().count()
    assert cells == 10
    assert DS.cap_by_grid(d.limit(0), 200).count() == 0


def test_quantiles_of_a_null_group(spark):
    rows = [(k, float(v)) for k in ("a", None) for v in range(9)] + [("b", None)]
    got = {r.k: list(r.q) for r in Q.grouped_quantiles(spark.createDataFrame(rows, "k string, value double"), ["k"], [0.0, 0.25, 0.5], buckets=2).collect()}
    assert got == {"a": [0.0, 2.0, 4.0], None: [0.0, 2.0, 4.0]}


# ------------------------------------------------------------------ files, history, streams
def test_headers_are_read_without_the_files(spark, tmp_path):
    for i, head in enumerate(['a,"b, c",d', "d,a", 'a,"b, c",d']):
        p = tmp_path / f"source_file=f{i}"
        p.mkdir()
        (p / "x.csv").write_text(head + "\n" + "1,2,3\n" * 4_000_000)
    files = R.list_files(spark, str(tmp_path))
    stats = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics()
    def read_so_far():
        return stats.get("file").getLong("bytesRead")
    before = read_so_far()
    index = R.header_index(spark, files)
    assert {k: len(v) for k, v in index.items()} == {("a", "b, c", "d"): 2, ("d", "a"): 1}
    assert read_so_far() - before < 3_000_000  # of 72 MB
    first = R.first_files(spark, str(tmp_path), 2)
    assert [f.split("source_file=")[1] for f in first] == ["f0/x.csv", "f1/x.csv"]
    with pytest.raises(ValueError):
        R.first_files(spark, str(tmp_path), 4)


def test_history_batches_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "h")
    for batch, lo, hi in (("1", 0, 10), ("2", 10, 15), ("1", 0, 10), ("2", 10, 16)):
        R.append_history(spark.range(lo, hi), path, batch)
    spark.range(100, 120).write.parquet(f"{path}/data/batch=b-3/attempt=a-lost")  # a job that died before its commit
    assert sorted(r.id for r in R.read_history(spark, path).collect()) == list(range(16))


def test_stream_files_stay_bounded(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / x) for x in ("src", "sink", "ckpt"))
    day = [(i, "s", "d", 50.0, f"2024-01-{1 + i // 2:02d} 0{i % 2}:00:00", "Mild Drought") for i in range(50)]
    late = [(99, "s", "d", 50.0, "2024-01-01 05:00:00", "Mild Drought")]
    schema = "id long, state string, district string, risk_score double, created_at string, severity string"
    hist = spark.createDataFrame(day, schema).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    for at in range(25):  # files come in the order of their days
        hist.where(F.col("id").between(2 * at, 2 * at + 1)).withColumn("day", F.to_date("created_at")).coalesce(1).write.mode(
            "append").partitionBy("day").parquet(src)
    run = HS.run_counts(HS.severity_counts_stream(spark, src, files_per_batch=1), sink, ckpt, compact_every=5)
    assert run.batches >= 25 and run.dropped_rows == 0
    live = HS.live_folders(spark, sink)
    assert len(live) <= 6
    spark.createDataFrame(late, schema).withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn(
        "day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(src)
    again = HS.run_counts(HS.severity_counts_stream(spark, src, files_per_batch=1), sink, ckpt, compact_every=5)
    assert again.dropped_rows == 1
    got = {str(r.window.start)[:10]: r.n for r in HS.read_counts(spark, sink).collect()}
    assert got == {f"2024-01-{i:02d}": 2 for i in range(1, 26)}
    last = max(e for e, _ in live)
    HS.compact(spark, sink, last)  # a repeated compaction changes nothing
    assert {str(r.window.start)[:10]: r.n for r in HS.read_counts(spark, sink).collect()} == got


# ------------------------------------------------------------------ folds, wavelet, views
def test_fold_ranges_select_the_folds_rows(spark):
    d = spark.createDataFrame([(str(g), f"{1990 + m // 12}-{m % 12 + 1:02d}-01") for g in range(3) for m in range(40) if (g + m) % 7], "grid_id string, date string")
    d = d.withColumn("date", F.to_date("date"))
    for tagged, ranges in ((DS.rolling_origin_folds(d), DS.rolling_origin_ranges(d)), (DS.time_series_cv_folds(d), DS.time_series_cv_ranges(d))):
        folds = ranges.collect()
        assert len(folds) == tagged.select("fold").distinct().count()
        for f in folds:
            for role in ("train", "test"):
                got = DS.fold_rows(d, f, role)
                want = tagged.where((F.col("fold") == f.fold) & (F.col("role") == role)).select("grid_id", "date")
                assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        sizes = {(r.fold, r.role): r.n_rows for r in DS.fold_sizes(d, ranges).collect()}
        assert sizes == {(r.fold, r.role): r["count"] for r in tagged.groupBy("fold", "role").count().collect()}


def lowband(x):
    """The whole transform with dense matrices."""
    x = np.asarray(x, float)
    if len(x) < 4:
        return x

    def matrix(size):
        m = np.zeros((size // 2, size))
        for k in range(size // 2):
            for j, tap in enumerate(DB4_DEC_LO):
                m[k, (4 + 2 * k - j) % size] += tap
        return m

    def even(v):
        return np.append(v, v[-1]) if len(v) % 2 else v

    p = even(x)
    a = matrix(len(p)) @ p
    if len(x) >= 28:
        q = even(a)
        a = (matrix(len(q)).T @ (matrix(len(q)) @ q))[:len(a)]
    return (matrix(len(p)).T @ a)[:len(x)]


def test_wavelet_arrays_equal_matrices(spark):
    rng = np.random.default_rng(6)
    series = {n: rng.random(n) for n in (1, 3, 4, 5, 6, 7, 9, 27, 28, 29, 30, 31, 84, 85)}
    d = spark.createDataFrame([(n, i, float(v)) for n, s in series.items() for i, v in enumerate(s)], "grid_id int, date int, x double").repartition(5)
    out = T.wavelet_full(d, ["x"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan
    got = out.toPandas().sort_values("date")
    for n, s in series.items():
        g = got[got.grid_id == n]
        assert np.allclose(g.x_wavelet_approx, lowband(s), atol=1e-12) and np.allclose(g.x_wavelet_detail, s - lowband(s), atol=1e-12)


def test_views_are_plans_over_the_scans(spark, sf):
    from verdure.plans.views import VIEWS, register_views

    assert set(register_views(spark, sf)) == set(VIEWS)
    plan = spark.sql("SELECT date, avg(ndvi) AS ndvi FROM panel GROUP BY date")._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "InMemoryTableScan" not in plan
    assert C.parse_feature("ndvi_lag_3").group == "ndvi_lag_roll" and json.loads(SE.Space(tuple(FEATURES)).decode([0.0] * 11).as_json())


@pytest.mark.parametrize("exclude", [False, True])
def test_windows_of_several_lengths_are_those_of_each(spark, exclude):
    rows = [(g, f"2000-{m:02d}-01", None if m == 3 else float(10 * m + len(g)), float(m)) for g in ("a", "bb") for m in range(1, 8)] + [("short", "2000-01-01", 1.0, None)]
    df = spark.createDataFrame(rows, "grid_id STRING, date STRING, x DOUBLE, y DOUBLE").selectExpr("grid_id", "CAST(date AS DATE) AS date", "x", "y")
    got = DS.supervised_sequences(df, ["x", "y"], (2, 3, 9), label="y", exclude_current=exclude)
    want = None
    for n in (2, 3, 9):
        one = DS.supervised_sequences(df, ["x", "y"], n, label="y", exclude_current=exclude).withColumn("length", F.lit(n))
        want = one if want is None else want.unionByName(one)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


def test_all_lengths_come_from_one_window(spark, sf):
    from verdure.plans.q_datasets import ds_supervised_seq

    plan = ds_supervised_seq(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("collect_list") == 1


def test_wide_rows_are_dealt_out_by_the_rows_behind_them(spark, sf, monkeypatch):
    from verdure.plans.q_models import ml_data
    from verdure.sources import fixtures as FX

    assert [FX.tasks_for(n, 12) for n in (0, 1, 25_000, 25_001, 600_000, 36_000_000, 36_000_001)] == [1, 1, 1, 2, 12, 36, 48]
    # merged by the bytes of its narrow rows, the panel would be one task per core at most, however large
    monkeypatch.setattr(FX, "ROWS_PER_TASK", 500)
    n = FX.tasks_for(FX.table(spark, sf, "lineitem").count(), spark.sparkContext.defaultParallelism)
    assert ml_data(spark, sf)[0].rdd.getNumPartitions() == n > spark.sparkContext.defaultParallelism


def test_the_cut_of_frozen_rows_is_a_literal(spark, sf):
    from verdure.plans.q_models import ml_data

    train, test, _ = ml_data(spark, sf)
    for part in (train, test):
        assert "scalar-subquery" not in part._jdf.queryExecution().optimizedPlan().toString()
    empty = spark.createDataFrame([], "date DATE")
    assert DS.split_chrono(empty, cut=DS.date_cut_now(empty, 0.8)).count() == 0


def test_ranges_of_shifted_rows_can_be_set(spark):
    df = spark.createDataFrame([(i, f"{i:03d}", float(i)) for i in range(50)], "id INT, o STRING, v DOUBLE")
    for tasks in (1, 4, 60):
        out = ML.shifted(df, "o", "v", "next", tasks)
        assert {r.id: r.next for r in out.collect()} == {i: float((i + 1) % 50) for i in range(50)}
        assert out.rdd.getNumPartitions() == tasks
