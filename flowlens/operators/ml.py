"""Spark ML baselines on flow and graph features."""

from __future__ import annotations

import math

from pyspark.ml import Model
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest

TREES, DEPTH, SEED = 100, 15, 42
#: Rows of a partition that a model is trained on, at most about.
ROWS = 250_000


def balanced(train: DataFrame, y: str = "y") -> DataFrame:
    """Adds weight: n / (2 * rows of the class). The counts are two rows."""
    n = train.groupBy(y).agg(F.count("*").alias("k"))
    whole = n.agg(F.sum("k").alias("all"))
    w = n.crossJoin(whole).select(y, (F.col("all") / (2.0 * F.col("k"))).alias("weight"))
    return train.join(F.broadcast(w), y)


def vector(rows: DataFrame, features: str = "features") -> DataFrame:
    return rows.withColumn("vector", array_to_vector(F.transform(features, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))))


def spread(train: DataFrame) -> DataFrame:
    """``train`` dealt evenly, a whole number of partitions for each core. A model passes
    over its rows again and again, and every pass waits for the largest partition."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    return train.repartition(cores * max(1, math.ceil(train.count() / (cores * ROWS))))


def train_forest(train: DataFrame, trees: int = TREES, depth: int = DEPTH, y: str = "y", subset: str = "auto") -> Model | forest.Forest:
    """Spark ML's forest; the nodes that a row has reached are kept from level to level, as
    walking down all trees again costs more the deeper they are. With a third of the
    features for each node it is ``forest.fit``, whose nodes cost what their rows do."""
    if subset == "onethird":
        return forest.fit(train, trees, depth, y, SEED)
    rows = spread(balanced(train.select("features", y), y))
    data = vector(rows).select("vector", F.col(y).cast("double").alias("label"), "weight")
    model = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy=subset, seed=SEED, cacheNodeIds=True)
    return model.fit(data)


def feature_importance(train: DataFrame, model: Model, names: list[str], top: int = 10) -> DataFrame:
    """feature, importance: the model's own few numbers, as rows."""
    rows = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray(), strict=True)]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def score_flows(model: Model | forest.Forest, rows: DataFrame) -> DataFrame:
    """Adds Probability of the positive class."""
    out = model.transform(vector(rows))
    return out.select(*rows.columns, vector_to_array("probability")[1].alias("Probability"))


def oversampled(train: DataFrame, y: str = "y") -> DataFrame:
    """Positives repeated by the ratio of the classes, as the net has no class weight."""
    n = train.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q"))
    times = F.when((F.col(y) == 1) & (F.col("p") > 0), F.greatest(F.expr("cast(q div p as int)"), F.lit(1))).otherwise(1)
    return train.crossJoin(F.broadcast(n)).withColumn("_k", F.explode(F.array_repeat(F.lit(1), times))).drop("_k", "p", "q")


def train_edge_mlp(train: DataFrame, inputs: int = 32, rounds: int = 50, y: str = "y") -> Model:
    rows = oversampled(spread(train.select("features", y)), y)
    data = vector(rows).select("vector", F.col(y).cast("double").alias("label"))
    return MultilayerPerceptronClassifier(featuresCol="vector", labelCol="label", layers=[inputs, 32, 32, 2], maxIter=rounds, seed=SEED).fit(data)


def context_features(edges: DataFrame, ends: tuple[str, ...] = ("src_context", "dst_context")) -> DataFrame:
    """Edge features with the context vectors of both ends appended."""
    return edges.withColumn("features", F.concat("features", *[F.transform(c, lambda v: v.cast("float")) for c in ends])).drop(*ends)


def train_context_forest(rich: DataFrame, trees: int = TREES, depth: int = DEPTH) -> forest.Forest:
    """The forest on edge features and host context (``context_features``): entropy,
    neighbourhood means, memory. Nine tenths of the vector are context, so a split looks
    at a third of it, lest the edge's own features hardly ever come up."""
    return train_forest(rich, trees, depth, subset="onethird")
