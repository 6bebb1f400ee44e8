"""Mixed swarm search: model parameters, lag window, wavelet level, feature groups and blend weight in one point.

A particle is a point of the unit cube.  ``Space.decode`` reads from it the numeric parameters of the boosted trees, one of the
lag windows, a wavelet level, which feature groups are on and, if asked for, the weight of a forest in a blend.  All trials
read one frozen table whose vector holds the features of every group; a trial takes its own by index (``VectorSlicer``), so
no trial touches the feature pipeline.  Points that decode to the same trial are fitted once.  Each fit is a Spark ML job and
one aggregate; only trials, a handful of numbers each, are on the driver.
"""
from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import conform as C
from . import models as ML

SUPERSET, SLICE = "superset", "trial_features"
LAG_WINDOWS, WAVELET_LEVELS = (1, 2, 3, 6, 12), (1, 2)
#: A group is on where its coordinate reaches this.
GROUP_ON = 0.42
#: Range of the forest's weight in a blend.
BLEND = (0.15, 0.90)


@dataclass(frozen=True)
class Trial:
    params: tuple          # (name, value) of the boosted trees
    lag_window: int
    wavelet_level: int
    groups: tuple          # groups that are on
    features: tuple        # what these rules leave of the superset
    blend: float | None = None

    def as_json(self) -> str:
        return json.dumps(dict(self.params))


@dataclass(frozen=True)
class Space:
    """Dimensions: the numeric ones of ``ML.GBT_SPACE``, window, level, (blend,) and one per feature group that can be off."""
    features: tuple
    lag_windows: tuple = LAG_WINDOWS
    wavelet_levels: tuple = WAVELET_LEVELS
    blend: bool = False
    switched: tuple = field(init=False)

    def __post_init__(self):
        groups = C.feature_groups(list(self.features))
        object.__setattr__(self, "features", tuple(sorted(f for g in groups.values() for f in g)))
        object.__setattr__(self, "switched", tuple(sorted(set(groups) - C.ALWAYS)))

    @property
    def dimensions(self) -> int:
        return len(ML.GBT_SPACE) + 2 + self.blend + len(self.switched)

    def decode(self, point) -> Trial:
        u = np.clip(np.asarray(point, float), 0.0, 1.0)
        k = len(ML.GBT_SPACE)

        def pick(choices, x):
            return choices[min(int(x * len(choices)), len(choices) - 1)]

        window, level = pick(self.lag_windows, u[k]), pick(self.wavelet_levels, u[k + 1])
        weight = float(BLEND[0] + (BLEND[1] - BLEND[0]) * u[k + 2]) if self.blend else None
        mask = u[k + 2 + self.blend:] >= GROUP_ON
        off = {g for g, on in zip(self.switched, mask) if not on}
        features = C.select_group_features(list(self.features), window, level, off)
        return Trial(tuple(ML.decode(u[:k]).items()), window, level, tuple(g for g in self.switched if g not in off), tuple(features), weight)


def superset(rows: DataFrame, space: Space) -> DataFrame:
    """``rows`` with the vector of all features of the space, frozen for the trials."""
    return ML.training_table(VectorAssembler(inputCols=list(space.features), outputCol=SUPERSET, handleInvalid="error").transform(
        rows.drop(SUPERSET)).select("grid_id", "date", "label", SUPERSET))


def sliced(rows: DataFrame, space: Space, trial: Trial) -> DataFrame:
    at = [space.features.index(f) for f in trial.features]
    return VectorSlicer(inputCol=SUPERSET, outputCol=SLICE, indices=at).transform(rows)


def fitted(rows: DataFrame, space: Space, trial: Trial) -> dict:
    """The trial's models by name: boosted trees, and a forest if it blends."""
    own = sliced(rows, space, trial)
    models = {"gbt": ML.gbt(dict(trial.params)).setFeaturesCol(SLICE).fit(own)}
    if trial.blend is not None:
        models["forest"] = ML.forest().setFeaturesCol(SLICE).fit(own)
    return models


def predicted(models: dict, rows: DataFrame, space: Space, trial: Trial) -> DataFrame:
    """``rows`` with y_pred of the trial's models, blended where there are two."""
    out = ML.score_many(models, sliced(rows, space, trial))
    raw = F.col("p_gbt") if trial.blend is None else trial.blend * F.col("p_forest") + (1 - trial.blend) * F.col("p_gbt")
    return out.withColumn("y_pred", ML.clip(raw, 0.0, 1.0)).drop(SLICE, *[f"p_{m}" for m in models])


def rmse_of(trial: Trial, space: Space, fit_rows: DataFrame, valid: DataFrame) -> float:
    err = F.col("y_pred") - F.col("label")
    return float(predicted(fitted(fit_rows, space, trial), valid, space, trial).agg(F.sqrt(F.avg(err * err))).first()[0])


TRIALS = ("trial INT, iteration INT, particle INT, params STRING, lag_window INT, wavelet_level INT, groups ARRAY<STRING>, "
          "features ARRAY<STRING>, blend DOUBLE, rmse DOUBLE")


def mixed_swarm(fit_rows: DataFrame, valid: DataFrame, space: Space, particles: int = 5, iterations: int = 4, seed: int = 42,
                inertia=(0.72, 0.50), own_pull=(1.35, 1.35), swarm_pull=(1.65, 1.65), patience: int | None = None):
    """(best trial, trials DataFrame) of a particle swarm on the unit cube of ``space``; ``fit_rows`` and ``valid`` as from ``superset``.

    Inertia and pulls go linearly from their first to their second value (equal ones: constant), ``patience`` stops after
    so many iterations without a better score."""
    rng = np.random.default_rng(seed)
    at = rng.random((particles, space.dimensions))
    speed = rng.normal(0, 0.08, at.shape)
    own, own_score = at.copy(), np.full(particles, np.inf)
    memo, log, stale = {}, [], 0
    for i, (w, c1, c2) in enumerate(zip(*(np.linspace(*r, iterations) for r in (inertia, own_pull, swarm_pull)))):
        trials = [space.decode(p) for p in at]
        for t in trials:
            if t not in memo:
                memo[t] = rmse_of(t, space, fit_rows, valid)
        score = np.array([memo[t] for t in trials])
        log += [(len(log) + p, i, p, t.as_json(), t.lag_window, t.wavelet_level, list(t.groups), list(t.features), t.blend, memo[t])
                for p, t in enumerate(trials)]
        stale = 0 if score.min() < own_score.min() else stale + 1
        better = score < own_score
        own[better], own_score[better] = at[better], score[better]
        if patience is not None and stale >= patience:
            break
        leader = own[own_score.argmin()]
        speed = w * speed + c1 * rng.random(at.shape) * (own - at) + c2 * rng.random(at.shape) * (leader - at)
        at = np.clip(at + speed, 0.0, 1.0)
    return space.decode(own[own_score.argmin()]), fit_rows.sparkSession.createDataFrame(log, TRIALS)
