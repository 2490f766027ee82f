"""Binary precision, recall and F1."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prf1(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1; 0 for 0/0."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    n = rows.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
