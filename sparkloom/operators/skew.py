"""Joins on keys of which a few may hold much of all rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than this share of the rows, so that there are no more hot keys than this many.
MOST_HOT = 1000


def skew_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, most: int = MOST_HOT) -> DataFrame:
    """The inner join of rows with keyed, which has one row per key and, in column count, how many of rows have it.

    Hot keys, `most` at most whatever the sizes are, meet by a broadcast and never fill a task; all others by a
    shuffle that hot rows take no part in. rows should be a written table: it is counted and read twice. Null keys
    join nothing."""
    floor = rows.count() // most
    marked = rows.join(F.broadcast(keyed.filter(F.col(count) > floor).select(*keys, F.struct(*[c for c in keyed.columns if c not in keys]).alias("hot_"))), keys, "left")
    hot = marked.filter("hot_ is not null").select(*rows.columns, *[F.col(f"hot_.{c}").alias(c) for c in keyed.columns if c not in keys])
    cold = marked.filter("hot_ is null").select(*rows.columns).join(keyed.filter(F.col(count) <= floor), keys)
    return hot.unionByName(cold.select(*hot.columns))
