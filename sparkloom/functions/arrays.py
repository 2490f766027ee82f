"""Functions on token arrays and vectors."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.kernel import longest_common


def matched(template: Column, toks: Column, wild: bool = True) -> Column:
    """Greedy in-order matches: for each template token, the first equal one behind the last match; '*' is skipped."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))

    def step(a, t):
        rest = F.slice(toks, a["last"] + 1, F.greatest(F.size(toks) - a["last"], F.lit(0)))
        at = F.array_position(rest, t).cast("int")
        hit = (at > 0) & (t != "*") if wild else at > 0
        return F.struct(F.when(hit, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(hit, a["last"] + at).otherwise(a["last"]).alias("last"))

    return F.aggregate(template, start, step, lambda a: a["n"])


def fits(template: Column, toks: Column) -> Column:
    """Every constant of the template is somewhere among the tokens."""
    return F.forall(template, lambda t: (t == "*") | F.array_contains(toks, t))


def is_empty(c: Column) -> Column:
    return F.size(c) == 0


def not_empty(c: Column) -> Column:
    return F.size(c) > 0


def overlay(a: Column, b: Column) -> Column:
    """Map a with the entries of map b that are not null over it."""
    new = F.map_filter(b, lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(new, k)), new)


def wildcards(template: Column) -> Column:
    """0-based positions of '*'."""
    return F.filter(F.transform(template, lambda t, i: F.when(t == "*", i).otherwise(-1)), lambda i: i >= 0)


def positional_params(template: Column, toks: Column) -> Column:
    """Array of (char_start, char_end, value): tokens unlike the template's at the same place, then all that are past
    the template as one, offsets counting one separator per token."""
    start = lambda i: F.aggregate(F.slice(toks, F.lit(1), i), F.lit(0), lambda a, t: a + F.length(t) + 1)
    row = lambda v, i: F.struct(start(i).alias("char_start"), (start(i) + F.length(v)).alias("char_end"), v.alias("value"))
    n = F.least(F.size(template), F.size(toks))
    unlike = F.filter(F.transform(F.slice(toks, F.lit(1), n), lambda t, i: F.when(t != F.get(template, i), row(t, i))), lambda x: x.isNotNull())
    rest = F.array_join(F.slice(toks, n + 1, F.greatest(F.size(toks) - n, F.lit(0))), " ")
    return F.when(F.size(toks) > n, F.concat(unlike, F.array(row(rest, n)))).otherwise(unlike)


def char_vector(text: Column, vocabulary: Column, length: Column | int) -> Column:
    """Indices of a text's characters in a map, unknown ones and padding 0, cut or padded to length."""
    length = F.lit(length) if isinstance(length, int) else length
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    found = F.transform(F.slice(chars, F.lit(1), length), lambda c: F.coalesce(F.try_element_at(vocabulary, c), F.lit(0)))
    return F.concat(found, F.array_repeat(F.lit(0), F.greatest(length - F.size(found), F.lit(0))))


def edge_average(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def edge_hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def edge_l1(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def edge_l2(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y) * (x - y))


EDGE_FEATURES = {"average": edge_average, "hadamard": edge_hadamard, "l1": edge_l1, "l2": edge_l2}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


@F.pandas_udf(T.ArrayType(T.StringType()))
def longest_common_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest common subsequence of two token arrays; null if one is."""
    return pd.Series([None if x is None or y is None else longest_common(list(x), list(y)) for x, y in zip(a, b)])
