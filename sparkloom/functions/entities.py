"""Entity extraction with rewriting, in column expressions.

Steps are SQL text, which the JVM parses at once; as Column objects, 18 of them take a thousand round trips. The
patterns run in order, each on the text that the ones before have rewritten. A list of edits maps offsets in that
text back to the line as it came: the last pattern's edits come first, each pattern's from left to right, and an offset
goes through them one by one; it grows by what an edit has taken away if it lies behind what was put there.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .strings import quoted

#: The entity patterns; their order is part of their meaning.
PATTERNS = {
    "uri": r"(?P<uri>/(?!(dev|proc))([\w\.]+/)+\w+\.php)",
    "url": r"(?P<url>https?:\/\/(www\.)?[-a-zA-Z0-9@:%._\+~#=]{2,256}\.[a-z]{2,6}\b([-a-zA-Z0-9@:%_\+.~#?&//=]*))",
    "email_ip_address_password": r"(?P<email>[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+):(?P<ip_address>.+?):(?P<password>[^\s]+)",
    "email_password": r"(?P<email>[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+):(?P<password>[^\s]+)",
    "email": r"(?P<email>[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)",
    "device": r"(?P<device>/dev(/[\w\.]+)+)",
    "process": r"(?P<process>/proc(/[\w\.]+)+)",
    "ip_address_user_password": r"(?P<ip_address>(tcp/)?([0-9]{1,3}\.){3}[0-9]{1,3}((\+[0-9]{1,3})|:[0-9]{1,5})?);(?P<user>.+?);(?P<password>[^\s]+)",
    "ip_address": r"(?P<ip_address>(tcp/)?([0-9]{1,3}\.){3}[0-9]{1,3}((\+[0-9]{1,3})|:[0-9]{1,5})?)",
    "memory_address": r"(?P<memory_address>0x[a-zA-Z0-9]+((-|\s)[a-zA-Z0-9]+)?)",
    "uuid": r"(?P<uuid>\b[0-9a-fA-F]{8}\b-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-\b[0-9a-fA-F]{12}\b)",
    "memory_k": r"(?P<memory_k>\b\d+[kK][bB]?\b)",
    "disk_mb": r"(?P<disk_mb>\b\d+[mM][bB]?\b)",
    "disk_gb": r"(?P<disk_gb>\b\d+[gG][bB]?\b)",
    "clock_speed": r"(?P<clock_speed>\b\d+(\.\d+)?GHz\b)",
    "file": r"(?P<file>/(?!(dev|proc))([\w\.]+/)+\w+(?!\.php)(\.\w+)?)",
    "version": r"(?P<version>\b[vV]?\d+(\.\d+)+(-[0-9a-zA-Z]+)?\b)",
    "number": r"(?P<number>\b(?<=\s)\d+(?=\s)\b)",
}

#: Start of a run of a mail name's characters, or the end of the match before.
_RUN = r"(?>(?<![\w.+-])|\G)"
#: First slash of a path (a later one starts nothing that the one before it would not, unless that one is barred), and
#: the segments up to its name.
_SLASH = r"(?=/)(?>\G|(?<![\w.])|(?<!/(?!dev|proc)[\w.]{1,40}))"
_PATH = r"(?=[\w.])(?:(?!//)[\w./]){2,}(?<=[\w.]/)"
#: Patterns by key that match the same in Java's engine without recursion or a new scan from each place of a run: it
#: recurses once for each round of a group of varying length, and overflows its stack on a token of some kilobytes.
#: Loops are over single characters here, or give nothing back. A look at the first character spares most places the rest.
_MAIL = r"(?P<email>[\w.+-]++@[\p{Alnum}-]++\.[\p{Alnum}.-]++)"
_FLAT = {
    "uri": rf"{_SLASH}(?P<uri>/(?!(dev|proc)){_PATH}\w+\.php)",
    "email_ip_address_password": rf"{_RUN}{_MAIL}:(?P<ip_address>.+?):(?P<password>[^\s]+)",
    "email_password": rf"{_RUN}{_MAIL}:(?P<password>[^\s]+)",
    "email": _RUN + _MAIL,
    "device": r"(?P<device>/dev(/[\w\.]++)++)",
    "process": r"(?P<process>/proc(/[\w\.]++)++)",
    "ip_address_user_password": r"(?=[t\d])" + PATTERNS["ip_address_user_password"],
    "ip_address": r"(?=[t\d])" + PATTERNS["ip_address"],
    "uuid": r"(?=[\da-fA-F])" + PATTERNS["uuid"],
    "memory_k": r"(?=\d)" + PATTERNS["memory_k"],
    "disk_mb": r"(?=\d)" + PATTERNS["disk_mb"],
    "disk_gb": r"(?=\d)" + PATTERNS["disk_gb"],
    "clock_speed": r"(?=\d)" + PATTERNS["clock_speed"],
    "file": rf"{_SLASH}(?P<file>/(?!(dev|proc)){_PATH}\w+(?!\.php)(\.\w+)?)",
    "version": r"(?=[vV\d])(?P<version>\b[vV]?\d+\.\d(?:(?!\.(?!\d))[\d.])*(?<=\d)(-[0-9a-zA-Z]+)?\b)",
    "number": r"(?=\d)" + PATTERNS["number"],
}
_FLAT_OF = {PATTERNS[k]: v for k, v in _FLAT.items()}
#: What a text must hold, or else it need not be searched for the pattern.
_HOLDS = {"uri": ".php", "url": "://", "email_ip_address_password": "@", "email_password": "@", "email": "@", "device": "/dev/", "process": "/proc/", "ip_address_user_password": ";", "ip_address": ".", "memory_address": "0x", "uuid": "-", "clock_speed": "GHz", "file": "/", "version": "."}

#: A token and the space behind it.
_TOKEN = r"\S++\s*+"
#: Characters of marks, as SQL writes them.
CUT, SEP, FILL = "\\u0001", "\\u0002", "\\u0003"

SPAN = "struct<char_start:int,char_end:int,entity:string,value:string>"


def java(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern for Java's engine, with groups by number instead of name, and the names' numbers in order."""
    flat, names, number = _FLAT_OF.get(pattern, pattern), {}, 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?:\?P<(\w+)>|(?!\?))", flat):
        if m.group().startswith("("):
            number += 1
            if m[1]:
                names[m[1]] = number
    return re.sub(r"\(\?P<\w+>", "(", flat), names


def numbered(pattern: str) -> str:
    """The pattern as it stands, with groups by number instead of name."""
    return re.sub(r"\(\?P<\w+>", "(", pattern)


def _back(p: str) -> str:
    """Through the steps' edits, the last step's first."""
    return f"aggregate(_edits, {p}, (p, e) -> if(e.at <= p, p + e.shift, p))"


def _run(text: str) -> str:
    """What makes a mark of CUT or SEP one that the text does not hold: nothing, or a longer run of FILL than any of its own."""
    longest = f"array_max(transform(regexp_extract_all({text}, '{FILL}+', 0), r -> length(r)))"
    return f"if(contains({text}, '{CUT}') or contains({text}, '{SEP}'), repeat('{FILL}', 1 + coalesce({longest}, 0)), '')"


def _step(df: DataFrame, key: str, pattern: str, whole: bool) -> DataFrame:
    """One pattern. whole: '*' for each match and the pattern's name as entity, instead of <GROUP> for each group.

    The pattern is searched for once: matches are put between marks, with their groups behind them, and cut out there."""
    rx, groups = java(pattern)
    held = {key: 0} if whole else groups
    new = "*" if whole else (";" if key == "ip_address_user_password" else ":").join(f"<{g.upper()}>" for g in held)
    q, n, cut, sep = quoted(rx), len(new), f"concat('{CUT}', _run)", f"concat('{SEP}', _run)"
    alone = list(held.values()) == [0] or len(held) == 1 and PATTERNS.get(key) == pattern  # the group is the match
    # gap, match, gap, ..., gap, each the first of an array if the match's groups come behind it
    parts = f"split(regexp_replace(_text, {q}, concat({cut}, '$0', {''.join(f'{sep}, {quoted(f"${g}")}, ' for g in held.values() if not alone)}{cut})), {cut}, -1)"
    parts = parts if alone else f"transform({parts}, x -> split(x, {sep}, -1))"
    needs = f"contains(_text, {quoted(_HOLDS[key])})" if PATTERNS.get(key) == pattern and key in _HOLDS else "true"
    df = df.withColumn("_parts", F.expr(f"if({needs}, {parts}, array())"))
    first = lambda x: x if alone else f"get({x}, 0)"
    part = lambda i: first(f"get(_parts, {i})")
    group = lambda i, k: part(i) if alone else f"get(get(_parts, {i}), {k + 1})"

    def span(k: int, name: str, i, start: str) -> str:
        # the groups left of this one in the match, each with one character behind
        start = " + ".join([start, *(f"length({group(i, j)}) + 1" for j in range(k))])
        return f"named_struct('char_start', {_back(start)}, 'char_end', {_back(f'{start} + length({group(i, k)})')}, 'entity', {quoted(name)}, 'value', {group(i, k)})"

    edit = lambda i, start: f"named_struct('at', {start} + {n}, 'shift', length({part(i)}) - {n})"
    # one match, as most lines have, in plain expressions; more of them in lambdas
    at = f"length({part(0)})"
    one = {"_spans": f"concat(_spans, array({', '.join(span(k, x, 1, at) for k, x in enumerate(held))}))", "_edits": f"concat(array({edit(1, at)}), _edits)", "_text": f"concat({part(0)}, {quoted(new)}, {part(2)})"}
    ends = f"aggregate(sequence(0, size(_parts) - 1), array(0), (s, i) -> array_append(s, element_at(s, -1) + length({part('i')})))"
    every = lambda x: f"get(transform(array({ends}), ends -> transform(sequence(1, size(_parts) - 2, 2), i -> {x})), 0)"
    more = {"_spans": f"concat(_spans, {', '.join(every(span(k, x, 'i', 'get(ends, i)')) for k, x in enumerate(held))})", "_edits": f"concat({every(edit('i', 'get(ends, i)'))}, _edits)", "_text": f"array_join(transform(_parts, (x, i) -> if(i % 2 = 0, {first('x')}, {quoted(new)})), '')"}
    out = {k: f"if(size(_parts) = 3, {one[k]}, if(size(_parts) > 1, {more[k]}, {k}))" for k in one if held or k != "_spans"}
    df = df.withColumns({k: F.expr(x) for k, x in out.items()}).drop("_parts")
    return df if new else df.withColumn("_run", F.expr(_run("_text")))  # what is taken away may join two runs


def to_line(p: Column, edits: Column) -> Column:
    """The offset in the line of an offset in the rewritten text."""
    return F.aggregate(edits, p.cast("int"), lambda p, e: F.when(e["at"] <= p, p + e["shift"]).otherwise(p))


def extract_entities(df: DataFrame, column: str, patterns: dict[str, str] | None = None, whole: bool = False) -> DataFrame:
    """df with rewritten (text), edits (see to_line) and entities: char_start and char_end in the line as it came, token_start, token_end,
    entity, value, sorted by char_start and then by pattern. Null lines have null for both."""
    out = df.withColumn("_text", F.col(column)).withColumn("_spans", F.array().cast(f"array<{SPAN}>")).withColumn("_edits", F.array().cast("array<struct<at:int,shift:int>>")).withColumn("_run", F.expr(_run("_text")))
    for key, pattern in (patterns or PATTERNS).items():
        out = _step(out, key, pattern, whole)
    line = "`" + column.replace("`", "``") + "`"
    # for each character of the line, how many tokens have begun
    pieces = f"split(regexp_replace(if(contains({line}, '{CUT}'), translate({line}, '{CUT}', '{SEP}'), {line}), {quoted(_TOKEN)}, '{CUT}$0'), '{CUT}', -1)"
    out = out.withColumn("_token", F.expr(f"if(size(_spans) > 0, flatten(transform({pieces}, (x, i) -> array_repeat(i, length(x)))), cast(array() as array<int>))"))
    token = "if(x.s.char_start > 0, get(_token, x.s.char_start - 1), 0)"
    ordered = "sort_array(transform(_spans, (s, i) -> named_struct('a', s.char_start, 'i', i, 's', s)))"
    fields = {"char_start": "x.s.char_start", "char_end": "x.s.char_end", "token_start": token, "token_end": f"{token} + 1", "entity": "x.s.entity", "value": "x.s.value"}
    full = F.expr(f"transform({ordered}, x -> named_struct({', '.join(f'{quoted(k)}, {v}' for k, v in fields.items())}))")
    # always true, but not for the optimizer, which else copies all steps into every filter on what comes out of them
    here = F.rand(0) + 1.0 > 0.0  # a plain comparison of rand would be folded; ids of rows are not there in streams
    return out.withColumn("entities", F.when(F.col(column).isNotNull() & here, full)).withColumn("rewritten", F.when(here, F.col("_text"))).drop("_text", "_spans", "_run", "_token").withColumnRenamed("_edits", "edits")
