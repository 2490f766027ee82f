"""Decision tree anomaly classifier."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import prf1


class DecisionTree:
    """criterion: gini or entropy; max_features: a featureSubsetStrategy, which makes it a forest of one tree;
    class_weight: label to weight."""

    def __init__(self, criterion: str = "gini", max_depth: int = 5, max_features: str | None = None, class_weight: dict[int, float] | None = None, seed: int = 0):
        self.criterion, self.max_depth, self.max_features, self.class_weight, self.seed = criterion, max_depth, max_features, class_weight, seed
        self.model: PipelineModel | None = None

    def fit(self, rows: DataFrame, features: list[str], label: str = "label") -> DecisionTree:
        common = {"featuresCol": "_features", "labelCol": label, "impurity": self.criterion, "maxDepth": self.max_depth, "seed": self.seed}
        if self.class_weight:
            weight = F.lit(1.0)
            for k, w in self.class_weight.items():
                weight = F.when(F.col(label) == k, w).otherwise(weight)
            rows, common["weightCol"] = rows.withColumn("_weight", weight), "_weight"
        tree = RandomForestClassifier(numTrees=1, featureSubsetStrategy=self.max_features, **common) if self.max_features else DecisionTreeClassifier(**common)
        self.model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), tree]).fit(rows)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(rows)
        return out.select(*rows.columns, F.col("prediction").cast("int").alias("anomaly"))

    def evaluate(self, rows: DataFrame, label: str = "label") -> DataFrame:
        return prf1(self.predict(rows), "anomaly", label)
