"""Named entities by any recogniser: a function of a list of texts that gives, for each, (start, end, label) spans.
No model comes with the package."""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType().add("char_start", "integer").add("char_end", "integer").add("entity", "string").add("value", "string"))


def recognise(df: DataFrame, column: str, recogniser: Callable[[list[str]], list[list[tuple[int, int, str]]]], name: str = "named") -> DataFrame:
    """df with an array of spans, by batches; labels are strings. Null texts have none."""

    def run(texts: pd.Series) -> pd.Series:
        plain = texts.fillna("").tolist()
        return pd.Series([[(a, z, label, t[a:z]) for a, z, label in found] for t, found in zip(plain, recogniser(plain))])

    return df.withColumn(name, F.pandas_udf(run, SPANS)(F.col(column)))
