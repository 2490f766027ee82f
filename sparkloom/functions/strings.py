"""String functions on columns."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends: \r\n or any of Python's.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLOCK_ID = r"(blk_-?\d+)"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def nascii(c: Column) -> Column:
    """Each run of non-ASCII characters as <NASCII>."""
    return F.regexp_replace(c, r"[^\x00-\x7F]+", "<NASCII>")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_lines(c: Column) -> Column:
    """The lines of a text; the end of the last line starts no further one."""
    parts = F.split(c, LINE_END)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def tokens(c: Column) -> Column:
    """Split at white space; empty tokens at the edges stay."""
    return F.split(c, r"\s+")


def word_tokens(c: Column) -> Column:
    """Split at white space, '=', ':' and ','; empty tokens go."""
    return F.filter(F.split(c, r"[\s=:,]"), lambda t: t != "")


def join_tokens(c: Column) -> Column:
    return F.array_join(c, " ")


def token_index(line: Column, start: Column) -> Column:
    """How many tokens begin before the character offset start."""
    return F.size(F.filter(F.split(F.substring(line, F.lit(1), start), r"\s+"), lambda t: t != ""))


def char_start(toks: Column, i: Column) -> Column:
    """Offset of token i in the tokens joined by single spaces; null if there is none."""
    before = F.aggregate(F.slice(toks, F.lit(1), i), F.lit(0), lambda a, t: a + F.length(t) + 1)
    return F.when((i >= 0) & (i < F.size(toks)), before)


def short_hash(c: Column) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, 8)


def long_hash(c: Column) -> Column:
    """128 bits, for ids of rows of which there may be very many."""
    return F.md5(c.cast("binary"))


def block_ids(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(BLOCK_ID), 1))


def edge_token(a: Column, b: Column) -> Column:
    """One token for an undirected edge."""
    return F.concat_ws("|", F.array_sort(F.array(a, b)))


#: Ways of writing an indicator so that it is not clicked, and what is meant.
REFANGED = (
    (r"(?i)\bhxxp", "http"),
    (r"\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?", "."),
    (r"\s?[\[({]\s?(?:@|at)\s?[\])}]\s?", "@"),
    (r"\[:\]", ":"),
    (r"\[/\]", "/"),
)


def refang(c: Column) -> Column:
    """Indicators written so as not to be clicked, as they were meant."""
    for pattern, plain in REFANGED:
        c = F.regexp_replace(c, pattern, plain)
    return c


#: Kind and pattern of indicators of compromise, looked for in refanged text.
INDICATORS = {
    "url": r"(?i)\bhttps?://[^\s<>\"']+",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.])",
    "ipv6": r"(?i)(?<![\w:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![\w:])|(?<![\w:])(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6}(?![\w:])",
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "hash": r"(?i)\b(?:[0-9a-f]{128}|[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b",
    "yara": r"(?s)\brule\s+\w+(?:\s*:\s*[\w ]+)?\s*\{.*?\bcondition\s*:.*?\}",
}


def indicators(c: Column) -> Column:
    """Sorted distinct array of (kind, value)."""
    plain = refang(c)
    tagged = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    found = [F.transform(F.regexp_extract_all(plain, F.lit(rx), 0), tagged(kind)) for kind, rx in INDICATORS.items()]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def log_format(fmt: str) -> tuple[list[str], str]:
    """Columns and pattern of a format such as '<Date> <Process>: <content>'; columns are the groups, in order."""
    columns, pattern = [], "^"
    for part in re.findall(r"<[^<>]+>|[^<]+|<", fmt):
        if len(part) > 2 and part[0] == "<" and part[-1] == ">":
            columns.append(part[1:-1])
            pattern += "(.*?)"
        else:
            pattern += re.sub(" +", r"\\s+", part)
    return columns, pattern + "$"
