"""Funnel for very many features: variance → forest → LASSO → forward selection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from yieldscope.operators import linear, prepare, scale, trees
from yieldscope.operators.correlate import strongest
from yieldscope.operators.gram import grams
from yieldscope.operators.profile import moments
from yieldscope.operators.split import hash_fold
from yieldscope.sources.observations import Observations

# Sizes by the number of features (exclusive upper bound, parameters).
PRESETS = (
    (100, dict(forest_top_n=15, lasso_top_n=10, max_features=5, folds=5, variance=False)),
    (1000, dict(forest_top_n=50, lasso_top_n=20, max_features=10, folds=5, variance=True)),
    (10000, dict(forest_top_n=100, lasso_top_n=50, max_features=15, folds=5, variance=True)),
    (None, dict(forest_top_n=200, lasso_top_n=100, max_features=20, folds=10, variance=True,
                correlated_top_n=5000)),
)
VARIANCE_FROM, VARIANCE_FLOOR = 100, 0.01


@dataclass
class Funnel:
    """Features left after each stage, the forward history and the final R²."""

    stages: dict[str, list[str]]
    history: list[dict]
    alpha: float
    r2: float
    adjusted_r2: float


def preset(features: int) -> dict:
    return dict(next(p for bound, p in PRESETS if bound is None or features < bound))


def prescreen(obs: Observations, rows: int, forest_top_n: int = 15, lasso_top_n: int = 10,
              max_features: int = 5, folds: int = 5, variance: bool = True,
              correlated_top_n: int | None = None, rounds: int = 10, forest_trees: int = 50,
              depth: int = trees.DEPTH, seed: int = 42, parallel: int = 2) -> Funnel:
    """Run the funnel on complete observations; see ``preset`` for sizes.

    Everything after the forest works on one table of product sums per fold.
    """
    stages: dict[str, list[str]] = {}
    if correlated_top_n is not None and len(obs.names) > correlated_top_n:
        obs = obs.select([r["feature"] for r in
                          strongest(obs, rows, correlated_top_n).collect()])
        stages["correlation"] = list(obs.names)
    if variance and len(obs.names) > VARIANCE_FROM:
        kept = prepare.high_variance(moments(obs), VARIANCE_FLOOR).select("idx").orderBy("idx")
        obs = obs.select([obs.names[r["idx"]] for r in kept.collect()])
        stages["variance"] = list(obs.names)

    importance = trees.importance_statistics(trees.bootstrap_importance(
        obs, rounds=rounds, trees=forest_trees, depth=depth, seed=seed, parallel=parallel))
    stages["forest"] = [r["feature"] for r in
                        trees.top_features(importance, forest_top_n).collect()]

    scaled = scale.standardize(obs.select(stages["forest"]))
    centred = scaled.df.withColumn("y", F.col("y") - F.lit(obs.df.agg(F.avg("y")).first()[0]))
    parts = grams(centred, hash_fold(folds, seed))
    fit = linear.lasso_cv(parts, 10.0 ** np.linspace(-8, -1, 50))
    chosen = [j for j in np.argsort(-np.abs(fit["coefs"]), kind="stable")
              if fit["coefs"][j] != 0][:lasso_top_n]
    stages["lasso"] = [stages["forest"][j] for j in chosen]

    history = linear.step_forward_cv({f: g.keep(chosen) for f, g in parts.items()},
                                     stages["lasso"], max_features)
    stages["final"] = history[-1]["included"] if history else []
    whole = linear.total(parts).keep(chosen)
    at = [stages["lasso"].index(n) for n in stages["final"]]
    r2, adjusted = linear.ols_score(whole, at) if at else (0.0, 0.0)
    return Funnel(stages, history, fit["alpha"], r2, adjusted)
