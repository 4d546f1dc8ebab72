"""Random-forest importance: bootstrap rounds, one labelled table, and their comparison."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yieldscope.functions.scalars import scaled_importance
from yieldscope.operators.prepare import all_double
from yieldscope.operators.profile import describe_groups
from yieldscope.operators.ranks import ranked
from yieldscope.operators.split import in_test
from yieldscope.sources.observations import Observations, col

# Forests keep the node that a row has reached in each tree (cacheNodeIds), else every level
# walks all rows down from the root again.
DEPTH = 30      # the deepest trees Spark ML grows: as good as fully grown

def bootstrap_importance(obs: Observations, label: str = "y", task: str = "regression",
                         rounds: int = 10, trees: int = 100, test: float = 0.3, depth: int = DEPTH,
                         seed: int = 42, parallel: int = 2) -> DataFrame:
    """``(iteration, feature, importance, std, s, s_rank, i_rank)`` per round and feature.

    Each round fits a forest on another random 1 − ``test`` of the rows. ``std``
    is the spread of a feature's importance over the trees, ``s`` the importance
    divided by it.
    """
    points = obs.df.select("row_id", F.col(label).cast("double").alias("label"),
                           array_to_vector("features").alias("vector")).persist()

    def one(i: int) -> pd.DataFrame:
        options = dict(labelCol="label", featuresCol="vector", numTrees=trees, maxDepth=depth,
                       cacheNodeIds=True, seed=seed + i)
        forest = (RandomForestClassifier(featureSubsetStrategy="sqrt", **options)
                  if task == "classification" else
                  RandomForestRegressor(featureSubsetStrategy="all", **options))
        model = forest.fit(points.filter(~in_test(test, seed + i)))
        per_tree = np.array([t.featureImportances.toArray() for t in model.trees])
        return pd.DataFrame({"iteration": i, "feature": obs.names,
                             "importance": model.featureImportances.toArray(),
                             "std": per_tree.std(axis=0)})

    try:
        with ThreadPoolExecutor(parallel) as pool:
            table = pd.concat(pool.map(one, range(rounds)), ignore_index=True)
    finally:
        points.unpersist()
    frame = obs.df.sparkSession.createDataFrame(
        table, "iteration int, feature string, importance double, std double")
    frame = frame.withColumn("s", scaled_importance(F.col("importance"), F.col("std")))
    frame = ranked(frame, "s", by=["iteration"], alias="s_rank")
    frame = frame.withColumn("s_rank", F.when(F.col("s").isNotNull(), F.col("s_rank")))
    return ranked(frame, "importance", by=["iteration"], alias="i_rank")


def importance_statistics(rounds: DataFrame) -> DataFrame:
    """The eight statistics of importance per feature, with the rank of the mean."""
    stats = describe_groups(rounds, "feature", "importance")
    return ranked(stats, "mean", descending=True, alias="standard_importance_rank")


def top_features(stats: DataFrame, top_n: int | None, score: str = "mean") -> DataFrame:
    """Features with a positive score, the ``top_n`` highest (None keeps all)."""
    kept = stats.filter(F.col(score) > 0).orderBy(F.desc(score), "feature")
    return kept if top_n is None else kept.limit(top_n)


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """``(feature, importance)``: chunk importances ``(feature, importance, n)`` weighted by rows."""
    weighted = F.sum(F.col("importance") * F.col("n")) / F.sum("n")
    return chunks.groupBy("feature").agg(weighted.alias("importance"))


def cumulative_share(importances: DataFrame, value: str = "value",
                     name: str = "param") -> DataFrame:
    """Running share of total importance, from the most important feature down."""
    down = W.orderBy(F.desc(value), name)          # one row per feature
    running = F.sum(value).over(down.rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum(value).over(W.partitionBy(F.lit(0)))
    return importances.select(name, value, F.row_number().over(down).alias("place"),
                              (running / whole).alias("share"))


def ranking_agreement(a: DataFrame, b: DataFrame, top_n: int = 5) -> DataFrame:
    """``(overlap, spearman)`` of two tables ``(feature, importance)``."""
    def top(t: DataFrame) -> DataFrame:
        return t.orderBy(F.desc("importance"), "feature").limit(top_n)

    shared = top(a).join(top(b).select("feature"), "feature", "left_semi")
    ra = ranked(a, "importance", alias="ra").select("feature", "ra")
    rb = ranked(b, "importance", alias="rb").select("feature", "rb")
    overlap = shared.agg(F.count(F.lit(1)).alias("overlap")).scalar()
    return ra.join(rb, "feature").agg(F.corr("ra", "rb").alias("spearman")).select(
        overlap.alias("overlap"), "spearman")


def forest_importance(df: DataFrame, label: str | None = None, trees: int = 500, depth: int = DEPTH,
                      seed: int = 42, max_memory_mb: int = 1024):
    """Classifier importance of a labelled table: ``(fitted stages, importance table)``.

    The label is the named or the first column, all others are features. Labels
    are indexed by frequency and features with at most four values are taken as
    categories.
    """
    label = label or df.columns[0]
    features = [c for c in df.columns if c != label]
    data = all_double(df)
    safe = [f"f{i}" for i in range(len(features))]     # names may contain dots
    data = data.select(col(label).alias("Label"),
                       *[col(f).alias(s) for f, s in zip(features, safe)])
    indexer = StringIndexer(inputCol="Label", outputCol="indexedLabel").fit(data)
    stages = Pipeline(stages=[
        VectorAssembler(inputCols=safe, outputCol="features"),
        indexer,
        VectorIndexer(inputCol="features", outputCol="indexedFeatures", maxCategories=4),
        RandomForestClassifier(labelCol="indexedLabel", featuresCol="indexedFeatures",
                               maxDepth=depth, numTrees=trees, seed=seed,
                               maxMemoryInMB=max_memory_mb, cacheNodeIds=True),
        IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=indexer.labels),
    ])
    model = stages.fit(data)
    values = model.stages[3].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return model, df.sparkSession.createDataFrame(rows, "param string, value double")
