"""Model fit, search and scoring on Spark ML.

Every fit is a distributed Spark ML job on the cached training frame; searches
are small driver loops whose evaluations are Spark fits + the grouped metric
aggregate.  Nothing is collected except one metric row per trial.
"""
from __future__ import annotations

import json

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, md5_bucket, severity_label_vhi
from . import metrics as M

FEATURES_COL = "features"


def assemble(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Rows with complete features and label (a cell's first months have no lags; ``complete`` counts what that leaves
    out) -> ML vector column.  A value that is still invalid is an error, never a silent drop."""
    va = VectorAssembler(inputCols=features, outputCol=FEATURES_COL, handleInvalid="error")
    return va.transform(df.na.drop(subset=features + [label]))


def complete(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """n_rows, n_complete: how many rows ``assemble`` keeps."""
    ok = F.lit(True)
    for c in [*features, label]:
        ok = ok & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_complete"))


def gbt(params: dict | None = None, label="label", seed: int = 42) -> GBTRegressor:
    """Boosted trees.  depth -> maxDepth, n_estimators -> maxIter, learning rate ->
    stepSize, subsample -> subsamplingRate, colsample -> featureSubsetStrategy,
    max_bin -> maxBins, min_child_weight -> minInstancesPerNode, gamma -> minInfoGain."""
    p = {"maxDepth": 4, "maxIter": 30, "stepSize": 0.1, "subsamplingRate": 1.0, "maxBins": 32}
    p.update(params or {})
    return GBTRegressor(featuresCol=FEATURES_COL, labelCol=label, seed=seed, **p)


def forest(params: dict | None = None, label="label", seed: int = 42) -> RandomForestRegressor:
    p = {"numTrees": 40, "maxDepth": 8, "featureSubsetStrategy": "onethird"}
    p.update(params or {})
    return RandomForestRegressor(featuresCol=FEATURES_COL, labelCol=label, seed=seed, **p)


def linear(label="label") -> Pipeline:
    scaler = StandardScaler(inputCol=FEATURES_COL, outputCol="__scaled", withMean=True, withStd=True)
    lr = LinearRegression(featuresCol="__scaled", labelCol=label, regParam=0.0)
    return Pipeline(stages=[scaler, lr])


def linear_terms(model) -> tuple[float, list[float]]:
    """(intercept, coefficient per feature) of a fitted ``linear`` pipeline in units of the features themselves."""
    scaler, lr = model.stages
    weights = [float(c) / s if s else 0.0 for c, s in zip(lr.coefficients, scaler.std)]
    return float(lr.intercept) - sum(w * float(m) for w, m in zip(weights, scaler.mean)), weights


def predict(model, df: DataFrame, name: str, lo=0.0, hi=1.0) -> DataFrame:
    out = model.transform(df).withColumn("y_pred", clip("prediction", lo, hi)).withColumn("model", F.lit(name))
    return out.drop("prediction", "__scaled")


def fit(estimator, train: DataFrame, partitions: int | None = None):
    """``partitions``: how many the learner's jobs run over (None: as ``train`` has them)."""
    return estimator.fit(train.coalesce(partitions) if partitions else train)


def fit_predict(estimator, train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    return predict(fit(estimator, train), test, name)


def eval_metrics(preds: DataFrame, protocol: str, label="label") -> DataFrame:
    p = (preds.withColumn("protocol", F.lit(protocol)).withColumnRenamed(label, "y_true")
              .select("protocol", "model", "y_true", "y_pred"))
    reg = M.regression_metrics(p)
    f1 = M.severity_f1(M.severity_confusion(p))
    return reg.join(f1, ["protocol", "model"])


def _writing_to(model, column: str):
    """A copy of a fitted model or pipeline whose predictions go to ``column``."""
    if isinstance(model, PipelineModel):
        *front, last = model.stages
        return PipelineModel([*front, _writing_to(last, column)])
    return model.copy({model.getParam("predictionCol"): column})


def score_many(models: dict, df: DataFrame) -> DataFrame:
    """``df`` with the predictions of every model in a column of its own, ``p_<name>``: chained transforms over the same
    rows, no join."""
    for name, model in models.items():
        df = _writing_to(model, f"p_{name}").transform(df).drop("__scaled")
    return df


def ensemble(train: DataFrame, test: DataFrame, weight: float = 0.5, gbt_params=None, forest_params=None,
             keys=("grid_id", "date")) -> DataFrame:
    """w * forest + (1 - w) * boosted, clipped; both score the rows in one pass."""
    both = score_many({"forest": fit(forest(forest_params), train), "gbt": fit(gbt(gbt_params), train)}, test)
    return both.select(*keys, "label", M.blend_weighted(F.col("p_forest"), F.col("p_gbt"), weight).alias("y_pred"),
                       F.lit("ensemble").alias("model"))


class Stack:
    """Base models and the meta learner over their predictions, with the features passed through or not."""

    def __init__(self, bases: dict, meta, passthrough: bool):
        self.bases, self.meta, self.passthrough = bases, meta, passthrough

    @staticmethod
    def inputs(rows: DataFrame, names: list[str], passthrough: bool) -> DataFrame:
        cols = [f"p_{n}" for n in names] + [FEATURES_COL] * passthrough
        return VectorAssembler(inputCols=cols, outputCol="__meta").transform(rows)

    def predict(self, rows: DataFrame, keys=("grid_id", "date")) -> DataFrame:
        out = self.meta.transform(self.inputs(score_many(self.bases, rows), list(self.bases), self.passthrough))
        return out.select(*keys, "label", clip("prediction", 0.0, 1.0).alias("y_pred"), F.lit("stack").alias("model"))


def boosted_meta(seed: int = 91) -> GBTRegressor:
    return GBTRegressor(maxDepth=3, maxIter=30, stepSize=0.1, seed=seed)


def fit_stack(train: DataFrame, folds: int = 3, base=None, meta=boosted_meta, passthrough: bool = True) -> Stack:
    """Stacking with out-of-fold base predictions: base models fitted on k - 1 cell folds predict the held-out fold, in
    chained transforms over the fold's rows; the union of the folds trains the meta learner, on the predictions and, with
    ``passthrough``, the features; base models refitted on all training rows feed it later."""
    base = base or {"forest": forest, "gbt": gbt}
    tagged = train.withColumn("__fold", (md5_bucket("grid_id", seed="stack") % folds).cast("int"))
    oof = None
    for k in range(folds):
        fit_rows, hold = tagged.where(F.col("__fold") != k), tagged.where(F.col("__fold") == k)
        part = score_many({n: fit(make(), fit_rows) for n, make in base.items()}, hold)
        oof = part if oof is None else oof.unionByName(part)
    # the meta learner makes many passes: the predictions are frozen like the features
    oof = training_table(Stack.inputs(oof, list(base), passthrough).select("label", "__meta"))
    learner = meta()
    fitted = learner.copy({learner.getParam("featuresCol"): "__meta", learner.getParam("labelCol"): "label"}).fit(oof)
    return Stack({n: fit(make(), train) for n, make in base.items()}, fitted, passthrough)


def stack(train: DataFrame, test: DataFrame, **how) -> DataFrame:
    """Predictions of ``fit_stack`` on ``test``."""
    return fit_stack(train, **how).predict(test)


def gram(df: DataFrame, xs: list[str], y: str = "label"):
    """X'X and X'y in one distributed aggregate (a few sums per partition)."""
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs)]
    aggs += [F.sum(F.col(a) * F.col(y)).alias(f"xy_{i}") for i, a in enumerate(xs)]
    row = df.agg(*aggs).first()
    k = len(xs)
    xx = [[row[f"xx_{i}_{j}"] for j in range(k)] for i in range(k)]
    xy = [row[f"xy_{i}"] for i in range(k)]
    return xx, xy


def nonneg_ridge(xx, xy, alpha: float = 0.05, iters: int = 5000) -> list[float]:
    """min ||y - Xw||^2 + alpha ||w||^2, w >= 0, by projected coordinate descent on
    the (k x k) Gram system — k is the number of base models."""
    k = len(xy)
    w = [0.0] * k
    for _ in range(iters):
        delta = 0.0
        for i in range(k):
            denom = xx[i][i] + alpha
            if denom <= 0:
                continue
            r = xy[i] - sum(xx[i][j] * w[j] for j in range(k) if j != i)
            new = max(0.0, r / denom)
            delta = max(delta, abs(new - w[i]))
            w[i] = new
        if delta < 1e-12:
            break
    return w


def physics_residual(train: DataFrame, test: DataFrame, params=None) -> DataFrame:
    """baseline (vci + tci) / 2, boosted trees on the residual, clipped sum.  When
    the label is VHI itself this is an identity check, not a model."""
    base = (F.col("vci") + F.col("tci")) / 2
    tr = train.withColumn("__resid", F.col("label") - base)
    m = fit(gbt(params, label="__resid"), tr)
    out = m.transform(test.withColumn("__resid", F.lit(0.0)))
    return out.select("grid_id", "date", "label", clip(base + F.col("prediction"), 0.0, 1.0).alias("y_pred"),
                      F.lit("physics_residual").alias("model"))


def persistence(df: DataFrame, keys=("grid_id",), vhi="vhi") -> DataFrame:
    """Forecast next month = last observed VHI."""
    w = Window.partitionBy(*keys).orderBy("date")
    return df.select(*keys, "date", F.lead(vhi, 1).over(w).alias("label"), F.col(vhi).alias("y_pred"),
                     F.lit("persistence").alias("model"))


#: Search space of the boosted trees; a log-scaled dimension is drawn by its exponent.
GBT_SPACE = {"maxDepth": (2, 6), "maxIter": (10, 40), "stepSize": (0.03, 0.3), "subsamplingRate": (0.6, 1.0),
             "minInstancesPerNode": (1, 12), "minInfoGain": (0.0, 0.01)}
LOG_SCALED = {"stepSize"}


def decode(point) -> dict:
    """Parameters of a point of the unit cube (one coordinate per dimension, in order)."""
    out = {}
    for u, (name, (lo, hi)) in zip(np.clip(point, 0.0, 1.0), GBT_SPACE.items()):
        v = lo * (hi / lo) ** u if name in LOG_SCALED else lo + (hi - lo) * u
        out[name] = int(round(v)) if isinstance(lo, int) else float(v)
    return out


def refit(params: dict, *parts: DataFrame):
    """The winner, fitted on all rows of ``parts`` (training and validation)."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return fit(gbt(params), rows)


def _score(params, fit_rows, valid) -> float:
    """Validation RMSE of one trial: a fit plus a single aggregate."""
    preds = fit_predict(gbt(params), fit_rows, valid, "trial")
    err = F.col("y_pred") - F.col("label")
    return float(preds.agg(F.sqrt(F.avg(err * err))).first()[0])


TRIALS = "trial INT, params STRING, rmse DOUBLE"


def random_search(fit_rows: DataFrame, valid: DataFrame, trials: int = 12, seed: int = 42):
    """Uniform trials over all dimensions of the space; (best parameters, trials DataFrame)."""
    points = np.random.default_rng(seed).random((trials, len(GBT_SPACE)))
    scores = [_score(decode(p), fit_rows, valid) for p in points]
    log = [(i, json.dumps(decode(p)), s) for i, (p, s) in enumerate(zip(points, scores))]
    return decode(points[int(np.argmin(scores))]), fit_rows.sparkSession.createDataFrame(log, TRIALS)


def swarm_search(fit_rows: DataFrame, valid: DataFrame, particles: int = 5, iterations: int = 4, seed: int = 42,
                 inertia=(0.72, 0.50), own_pull: float = 1.35, swarm_pull: float = 1.65, patience: int | None = None):
    """Particle swarm (Kennedy and Eberhart) on the unit cube, all particles moved at once as matrices; inertia falls
    linearly.  ``patience``: stop after so many iterations without a better score.  Each evaluation is a Spark fit and one
    aggregate; (best parameters, trials DataFrame)."""
    rng = np.random.default_rng(seed)
    at = rng.random((particles, len(GBT_SPACE)))
    speed = np.zeros_like(at)
    own, own_score = at.copy(), np.full(particles, np.inf)
    log, stale = [], 0
    for weight in np.linspace(*inertia, iterations):
        score = np.array([_score(decode(p), fit_rows, valid) for p in at])
        log += [(len(log) + i, json.dumps(decode(p)), float(s)) for i, (p, s) in enumerate(zip(at, score))]
        stale = 0 if score.min() < own_score.min() else stale + 1
        better = score < own_score
        own[better], own_score[better] = at[better], score[better]
        if patience is not None and stale >= patience:
            break
        leader = own[own_score.argmin()]
        toward_own, toward_leader = rng.random(at.shape), rng.random(at.shape)
        speed = weight * speed + own_pull * toward_own * (own - at) + swarm_pull * toward_leader * (leader - at)
        at = np.clip(at + speed, 0.0, 1.0)
    return decode(own[own_score.argmin()]), fit_rows.sparkSession.createDataFrame(log, TRIALS)


def feature_importance(model, features: list[str], top: int = 10, spark=None) -> DataFrame:
    """Normalised importances, top N (sequence offsets summed per base feature)."""
    imp = model.featureImportances.toArray()
    agg: dict[str, float] = {}
    for f, v in zip(features, imp):
        base = f.split("__t-")[0]
        agg[base] = agg.get(base, 0.0) + float(v)
    total = sum(agg.values()) or 1.0
    rows = sorted(((k, v / total) for k, v in agg.items()), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE")


def shifted(rows: DataFrame, order: str, value: str, out: str, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``value`` of the next row in the order of the column ``order``, the last row taking the first one's.

    Range partitions by ``order``; inside each the next row is a lead, and its last row takes the first value of the next
    partition from a table with one row per partition, which is what is broadcast.  No group is larger than a range.
    ``tasks``: number of ranges, and of the tasks that hold the result (None: as Spark merges them by their bytes)."""
    by_range = rows.repartitionByRange(tasks, order) if tasks else rows.repartitionByRange(order)
    # files pin the ranges, also when an executor is lost
    placed = training_table(by_range.withColumn("__part", F.spark_partition_id()))
    # the first and the last row of a range; ranges are joined in a cycle
    edge = training_table(placed.groupBy("__part").agg(F.min_by(value, order).alias("__first")))
    numbered = edge.select("__part", "__first", F.row_number().over(Window.orderBy("__part")).alias("__n"))
    ranges = edge.count()
    before = numbered.select((F.pmod(F.col("__n") - 2, F.lit(ranges)) + 1).alias("__n"), F.col("__first").alias("__next"))
    ends = numbered.select("__part", "__n").join(before, "__n").select("__part", "__next")
    if tasks:
        placed = placed.repartition(tasks, "__part")
    lead = F.lead(value).over(Window.partitionBy("__part").orderBy(order))
    last = F.lead(F.lit(True)).over(Window.partitionBy("__part").orderBy(order)).isNull()
    inside = placed.withColumns({"__lead": lead, "__last": last}).join(F.broadcast(ends), "__part")
    return inside.withColumn(out, F.when(F.col("__last"), F.col("__next")).otherwise(F.col("__lead"))).drop(
        "__part", "__lead", "__last", "__next")


#: Rows of a task that scores each of them once a feature.
SCORED_A_TASK = 10_000


def permutation_importance(model, test: DataFrame, features: list[str], repeats: int = 3, label="label") -> DataFrame:
    """RMSE increase after permuting one feature, for every feature.  In each repeat the rows stand in the order of an md5 of
    their key and that repeat, and every row takes the feature from the next one (cyclic), so each row is partner of exactly
    one.  Rows are scored once per feature and repeat, in one pass."""
    key = F.concat_ws("|", F.col("grid_id"), F.col("date").cast("string"))
    raw = test.select("grid_id", "date", label, F.array(*[F.col(f).cast("double") for f in features]).alias("__x"))
    paired, tasks = None, -(-max(1, raw.count()) // SCORED_A_TASK)
    for r in range(repeats):
        part = raw.withColumn("__order", F.concat(F.md5(F.concat(F.lit(f"{r}|"), key).cast("binary")), key))
        part = shifted(part, "__order", "__x", "__y", tasks).select(label, "__x", "__y", F.lit(r).alias("__rep"))
        paired = part if paired is None else paired.unionByName(part)
    # feature -1: nothing replaced, the base
    j = paired.withColumn("__f", F.explode(F.array(*[F.lit(i) for i in range(-1, len(features))])))
    swapped = F.transform("__x", lambda v, i: F.when(i == F.col("__f"), F.col("__y")[i]).otherwise(v))
    j = j.select(label, "__f", "__rep", array_to_vector(swapped).alias(FEATURES_COL))
    m = M.regression_metrics(predict(model, j, "perm").withColumnRenamed(label, "y_true"), group=("__f", "__rep"), willmott=False)
    per = m.groupBy("__f").agg(F.avg("rmse").alias("rmse"))
    base = per.where("__f = -1").select("rmse").scalar()
    names = F.array(*[F.lit(f) for f in features])
    return per.where("__f >= 0").select(F.element_at(names, F.col("__f") + 1).alias("feature"), (F.col("rmse") - base).alias("importance"))


def save_model(model, features: list[str], path: str, spark) -> str:
    """A fitted model or pipeline, and the features of its vector in order, into shared storage."""
    whole = model if isinstance(model, PipelineModel) else PipelineModel([model])
    whole.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(i, f) for i, f in enumerate(features)], "position INT, feature STRING").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/features")
    return path


def load_model(spark, path: str) -> tuple[PipelineModel, list[str]]:
    """(model, features) as saved; a scoring job needs nothing else of the training run."""
    features = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("position").collect()]
    return PipelineModel.load(f"{path}/model"), features


def batch_score(model, df: DataFrame) -> DataFrame:
    """Transform, clip to [0, 1], severity label, risk = (1 - vhi) * 100."""
    p = model.transform(df).withColumn("predicted_vhi", clip("prediction", 0.0, 1.0))
    return p.withColumns({"severity": severity_label_vhi("predicted_vhi"),
                          "risk_score": (1 - F.col("predicted_vhi")) * 100}).drop("prediction")


def training_table(df: DataFrame) -> DataFrame:
    """Freeze the assembled training frame for the many fits that follow: a reliable checkpoint in the shared
    ``spark.checkpoint.dir``.  A lost executor re-reads files instead of recomputing the feature pipeline, and no cache
    is left behind."""
    from ..session import cut_lineage
    return cut_lineage(df)
