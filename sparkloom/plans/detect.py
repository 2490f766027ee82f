"""End-to-end anomaly detection on event sequences."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import features
from ..operators.invariants import InvariantsMiner
from ..operators.metrics import prf1


def detect(train: DataFrame, test: DataFrame, instance: str, event: str, weighting: str | None = None, normalization: str | None = None, **miner) -> tuple[InvariantsMiner, DataFrame]:
    """Mines invariants on the features of train and predicts on test, which is weighted and centred as train was.
    train and test: a row for each event. Returns the miner and (instance, anomaly) of test."""
    long = features.counts(train, instance, event)
    model = features.fit(long, weighting, normalization)
    events = sorted(r.event for r in model.vocabulary.select("event").collect())  # a row per event type
    mined = InvariantsMiner(**miner).fit(features.wide(model.transform(long), events), events)
    other = model.transform(features.counts(test, instance, event))
    return mined, mined.predict(features.wide(other, events)).select("instance", "anomaly")


def evaluate(predicted: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Precision, recall and F1 of (instance, anomaly) against labels (key, label)."""
    return prf1(predicted.join(labels.select(labels[key].alias("instance"), label), "instance"), "anomaly", label)
