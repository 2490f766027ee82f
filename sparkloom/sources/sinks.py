"""Sinks."""
from __future__ import annotations

import uuid

from pyspark.ml.feature import Word2VecModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import upsert
from ..operators.rules import RuleError, check_fields, load_rules, rule_files, rule_sql


def structured_pair(assigned: DataFrame, counts: DataFrame, path: str) -> None:
    """<path>_structured.csv and <path>_templates.csv."""
    assigned.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}_structured.csv")
    counts.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}_templates.csv")


def sequence_csv(seqs: DataFrame, path: str, column: str = "events") -> None:
    seqs.withColumn(column, F.to_json(column)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def fan_out(parsed: DataFrame, folder: str, batch: int | str | None = None) -> None:
    """One pass over a persisted batch: parsed logs as JSON lines, new templates as text, in a folder of the batch's
    own, which a retry of the same batch replaces. Without a batch, a new one each time."""
    own = f"batch={uuid.uuid4().hex if batch is None else batch}"
    parsed = parsed.persist()
    try:
        parsed.drop("is_new").write.mode("overwrite").json(f"{folder}/parsed_logs/{own}")
        parsed.filter("is_new").select("log_key").write.mode("overwrite").text(f"{folder}/log_keys/{own}")
    finally:
        parsed.unpersist()


#: Buckets of a table of merge_table: a batch rewrites those alone that its keys fall into.
BUCKETS = 64


def _files(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p, p(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark, path: str) -> list[str]:
    p, fs = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p(path))] if fs.exists(p(path)) else []


def _versions(spark, path: str) -> dict[int, int]:
    """Of each bucket that has rows, the version that holds it now: the newest manifest."""
    newest = max((int(x[1:]) for x in _listed(spark, f"{path}/manifests") if "_SUCCESS" in _listed(spark, f"{path}/manifests/{x}")), default=None)
    return {} if newest is None else {r.bucket: r.version for r in spark.read.schema("bucket int, version int").json(f"{path}/manifests/m{newest}").collect()}


def merge_table(new: DataFrame, path: str, keys: list[str], order: str, buckets: int = BUCKETS) -> None:
    """Upserts a batch into a Parquet table. Rows lie in buckets by a hash of their keys; a batch reads and rewrites
    the buckets that it touches, as a new version beside the old one, and then writes a manifest that names each
    bucket's version. A reader follows the newest manifest, so a batch that breaks off changes nothing. One writer at
    a time; buckets must stay the same."""
    spark = new.sparkSession
    new = new.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    try:
        held, touched = _versions(spark, path), [r.bucket for r in new.select("bucket").distinct().collect()]  # buckets at most
        number = max((int(x[1:]) for d in ("manifests", "data") for x in _listed(spark, f"{path}/{d}")), default=0) + 1
        old = _read(spark, path, {b: v for b, v in held.items() if b in touched})
        merged = upsert(old if old is not None else new.limit(0), new, ["bucket", *keys], order)
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/v{number}")
    finally:
        new.unpersist()
    now = held | dict.fromkeys(touched, number)
    spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.json(f"{path}/manifests/m{number}")
    p, fs = _files(spark, path)
    for bucket in touched:  # the version before this one stays for those who read it now
        for v in _listed(spark, f"{path}/data"):
            if int(v[1:]) < held.get(bucket, 0):
                fs.delete(p(f"{path}/data/{v}/bucket={bucket}"), True)


def _read(spark, path: str, versions: dict[int, int]) -> DataFrame | None:
    if not versions:
        return None
    out = None
    for v in sorted(set(versions.values())):
        names = [f"{path}/data/v{v}/bucket={b}" for b, x in sorted(versions.items()) if x == v]
        part = spark.read.option("basePath", f"{path}/data/v{v}").parquet(*names)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_table(spark, path: str) -> DataFrame:
    return _read(spark, path, _versions(spark, path)).drop("bucket")


def vectors_text(model: Word2VecModel, path: str) -> None:
    """word2vec's text format: a line for each word."""
    v = model.getVectors()
    v.select(F.concat_ws(" ", "word", F.array_join(F.transform(_array(v), lambda x: x.cast("string")), " "))).write.mode("overwrite").text(path)


def _array(v: DataFrame):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(v["vector"])


def compiled_rules(paths: list[str], out: str, text: list[str] = ("line",), columns: list[str] | None = None) -> int:
    """Writes a line for each rule: its title and its condition as SQL over a table with the given text columns (and
    columns, if they are to be checked). Returns 0 or the code of what went wrong: 1 the output, 5 a rule's file (the
    others are still compiled), else RuleError's (3 YAML, 4 a rule, 8 a condition, 9 a modifier, 42 a count, 80 or 90
    some or all fields missing), which ends it."""
    code = 0
    try:
        with open(out, "w", encoding="utf-8") as f:
            for path in rule_files(paths):
                try:
                    for i, rule in enumerate(load_rules([path])):
                        if columns is not None:
                            check_fields(rule, columns)
                        f.write(f"{rule.get('title', f'rule {i}')}\t{rule_sql(rule, list(text))}\n")
                except (OSError, UnicodeDecodeError):
                    code = 5
                except RuleError as e:
                    return e.code
    except OSError:
        return 1
    return code


def flag_urls(scored: DataFrame, folder: str) -> None:
    """Writes malicious_warning back to the graph's urls: scored has key and malicious_warning."""
    vertices = f"{folder}/vertices"
    seq = (read_table(scored.sparkSession, vertices).agg(F.max("seq")).first()[0] or 0) + 1
    props = F.create_map(F.lit("malicious_warning"), F.col("malicious_warning").cast("string"))
    merge_table(scored.select(F.lit("urls").alias("collection"), "key", props.alias("props"), F.lit(seq).cast("long").alias("seq")), vertices, ["collection", "key"], "seq")
