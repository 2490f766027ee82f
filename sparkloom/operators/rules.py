"""Detection rules as column predicates, and correlation rules over events."""
from __future__ import annotations

import re
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import quoted


class RuleError(ValueError):
    """A rule that cannot be read or compiled; code is what a command that compiles rules exits with."""

    code = 4


class RuleYamlError(RuleError):
    code = 3


class BackendError(RuleError):
    """A condition that makes no column."""

    code = 8


class UnsupportedError(RuleError):
    """A modifier that columns have no test for."""

    code = 9


class NotDoneError(RuleError):
    """A condition that counts events: a correlation rule, see threshold."""

    code = 42


class SomeFieldsError(RuleError):
    """The table lacks some of a rule's fields."""

    code = 80


class AllFieldsError(RuleError):
    """The table lacks all of a rule's fields."""

    code = 90


def rule_files(paths: list[str | Path]) -> list[Path]:
    """Files of rules under paths, recursive, without dot-files."""
    found = [f for p in map(Path, paths) for f in ([p] if p.is_file() else sorted(p.rglob("*")))]
    return [f for f in found if f.is_file() and not any(x.startswith(".") for x in f.parts[-1:])]


def load_rules(paths: list[str | Path]) -> list[dict]:
    out = []
    for f in rule_files(paths):
        try:
            out += [r for r in yaml.safe_load_all(f.read_text()) if r]
        except yaml.YAMLError as e:
            raise RuleYamlError(f"{f}: {e}") from e
    return out


def _like(c: str, value) -> str:
    """Equality, ignoring case, with * and ? as wildcards."""
    rx = "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in str(value))
    return f"CAST({c} AS STRING) RLIKE {quoted(f'(?is)^{rx}$')}"


def _column(name: str) -> str:
    return ".".join(f"`{x}`" for x in name.split("."))


#: What a modifier of a field tests; {c} is the column, {v} the value.
_TESTS = {
    "contains": "contains(lower(CAST({c} AS STRING)), lower({v}))", "startswith": "startswith(lower(CAST({c} AS STRING)), lower({v}))",
    "endswith": "endswith(lower(CAST({c} AS STRING)), lower({v}))", "re": "CAST({c} AS STRING) RLIKE {v}",
}


def _field(key: str, value) -> str:
    name, *how = key.split("|")
    c, modes = _column(name), [h for h in how if h != "all"]
    if value is None:
        return f"{c} IS NULL"
    if len(modes) > 1 or modes and modes[0] not in _TESTS:
        raise UnsupportedError(f"unknown modifier in {key}")
    values = value if isinstance(value, list) else [value]
    return _fold([_TESTS[modes[0]].format(c=c, v=quoted(str(v))) if modes else _like(c, v) for v in values], "all" in how)


def _fold(tests: list[str], every: bool) -> str:
    if not tests:
        return str(every).upper()
    return tests[0] if len(tests) == 1 else "(" + (" AND " if every else " OR ").join(f"({t})" for t in tests) + ")"


def _selection(body, text: list[str]) -> str:
    """A map: all its fields; a list: any of its maps or phrases; a phrase: in any text column, ignoring case."""
    if isinstance(body, dict):
        return _fold([_field(k, v) for k, v in body.items()], True)
    items = body if isinstance(body, list) else [body]
    phrase = lambda i: _fold([_TESTS["contains"].format(c=_column(c), v=quoted(str(i))) for c in text], False)
    return _fold([_selection(i, text) if isinstance(i, dict) else phrase(i) for i in items], False)


def fields(rule: dict) -> set[str]:
    """The fields that a rule's selections name."""
    def named(body) -> set[str]:
        if isinstance(body, dict):
            return {k.split("|")[0] for k in body}
        return set().union(*map(named, body)) if isinstance(body, list) else set()

    return set().union(*(named(v) for k, v in rule.get("detection", {}).items() if k not in ("condition", "timeframe")))


def check_fields(rule: dict, columns: list[str]) -> None:
    """Raises if a table of these columns lacks fields of the rule."""
    used = fields(rule)
    if missing := sorted(used - set(columns)):
        raise (SomeFieldsError if len(missing) < len(used) else AllFieldsError)(f"no column for {', '.join(missing)}")


def compile_rule(rule: dict, text: list[str]) -> Column:
    return F.expr(rule_sql(rule, text))


def rule_sql(rule: dict, text: list[str]) -> str:
    """The rule's condition over its named selections, as SQL: and, or, not, parentheses, 1 of / all of (them, or
    name*). Null fields match nothing."""
    try:
        detection = dict(rule["detection"])
        condition = detection.pop("condition")
    except (KeyError, TypeError) as e:
        raise RuleError("a rule needs detection with a condition") from e
    if not isinstance(condition, str):
        raise BackendError(f"no condition but {condition!r}")
    if "|" in condition:
        raise NotDoneError(f"a condition that counts: {condition}")
    named = {k: f"coalesce({_selection(v, text)}, FALSE)" for k, v in detection.items() if k != "timeframe"}
    toks = re.findall(r"\(|\)|[^\s()]+", str(condition))
    at = 0

    def peek() -> str:
        return toks[at].lower() if at < len(toks) else ""

    def take() -> str:
        nonlocal at
        at += 1
        if at > len(toks):
            raise RuleError(f"condition breaks off: {condition}")
        return toks[at - 1]

    def either() -> str:
        out = both()
        while peek() == "or":
            take()
            out = f"({out} OR {both()})"
        return out

    def both() -> str:
        out = unary()
        while peek() == "and":
            take()
            out = f"({out} AND {unary()})"
        return out

    def unary() -> str:
        t = take()
        if t.lower() == "not":
            return f"(NOT {unary()})"
        if t == "(":
            out = either()
            if take() != ")":
                raise RuleError(f"unbalanced condition: {condition}")
            return out
        if t.lower() in ("1", "any", "all") and peek() == "of":
            take()
            what = take()
            chosen = [c for k, c in named.items() if what == "them" or re.fullmatch(re.escape(what).replace(r"\*", ".*"), k)]
            if not chosen:
                raise RuleError(f"nothing is named {what}")
            return _fold(chosen, t.lower() == "all")
        if t not in named:
            raise RuleError(f"unknown selection {t}")
        return named[t]

    out = either()
    if at != len(toks):
        raise RuleError(f"cannot read condition: {condition}")
    return out


def apply_rules(df: DataFrame, rules: list[dict], text: list[str]) -> DataFrame:
    """df with alerts: the titles of the rules that match, in one pass."""
    hits = [F.when(compile_rule(r, text), F.lit(r.get("title", f"rule {i}"))) for i, r in enumerate(rules)]
    return df.withColumn("alerts", F.filter(F.array(*hits), lambda t: t.isNotNull()) if hits else F.array().cast("array<string>"))


def brute_force(events: DataFrame, ts: str, actor: str, subject: str, failed: Column, succeeded: Column, least: int = 5, minutes: int = 15) -> DataFrame:
    """Successes (actor, success_at, n_failures, n_subjects) of actors with at least `least` failures on different
    subjects in the minutes before. Failures are looked up by buckets of that many minutes (an event and the bucket
    before), an equi-join instead of a range join."""
    span = minutes * 60
    e = events.select(F.col(actor).alias("actor"), F.col(subject).alias("subject"), F.col(ts).cast("timestamp").alias("at"), failed.alias("bad"), succeeded.alias("good")).withColumn("bucket", F.floor(F.unix_micros("at") / (span * 1_000_000)))
    bad = e.filter("bad").select("actor", F.col("subject").alias("s"), F.col("at").alias("bad_at"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    good = e.filter("good").select("actor", "at", "bucket").distinct()
    near = good.join(bad, ["actor", "bucket"]).filter((F.col("bad_at") < F.col("at")) & (F.unix_micros("bad_at") >= F.unix_micros("at") - span * 1_000_000))
    out = near.groupBy("actor", F.col("at").alias("success_at")).agg(F.count("*").alias("n_failures"), F.countDistinct("s").alias("n_subjects"))
    return out.filter(F.col("n_subjects") >= least)


def threshold(events: DataFrame, ts: str, keys: list[str], what: Column, least: int, window: str, slide: str | None = None) -> DataFrame:
    """keys, window_start, n of windows with at least so many events; streams with a watermark as well."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.filter(what).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(*keys, F.col("w.start").alias("window_start"), "n")


def not_listed(values: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return values.join(allowed.select(key).distinct(), key, "left_anti")


def listed(values: DataFrame, blacklist: DataFrame, key: str) -> DataFrame:
    return values.join(blacklist.select(key).distinct(), key, "left_semi")
