"""Link prediction on edge features."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .walks import edge_vectors


def fit_links(pairs: DataFrame, vectors: DataFrame, kind: str = "hadamard", label: str = "label") -> PipelineModel:
    """pairs (src, dst, label): 1 for edges, 0 for pairs that are none."""
    x = edge_vectors(pairs, vectors, kind).join(pairs, ["src", "dst"]).withColumn("x", array_to_vector("feature"))
    return Pipeline(stages=[LogisticRegression(featuresCol="x", labelCol=label)]).fit(x)


def score_links(model: PipelineModel, pairs: DataFrame, vectors: DataFrame, kind: str = "hadamard") -> DataFrame:
    """src, dst, score: the probability of an edge."""
    x = edge_vectors(pairs.select("src", "dst"), vectors, kind).withColumn("x", array_to_vector("feature"))
    return model.transform(x).select("src", "dst", vector_to_array("probability")[1].alias("score"))


def candidates(edges: DataFrame) -> DataFrame:
    """(src, dst) with src < dst, of nodes that share a neighbour but no edge; edges: both directions."""
    two = edges.select(F.col("src").alias("via"), F.col("dst").alias("a")).join(edges.select(F.col("src").alias("via"), F.col("dst").alias("b")), "via").filter("a < b")
    return two.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
