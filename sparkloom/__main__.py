"""python -m sparkloom COMMAND: mine, parse, load, analyze, train, detect, crawl, rules, passthrough."""
from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _arguments(args: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sparkloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, *places: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=what)
        for x in places:
            c.add_argument(x)
        return c

    for name, what in (("mine", "a log file to tables of lines and templates"), ("parse", "logs to parsed logs and a graph")):
        c = command(name, what, "path", "out")
        c.add_argument("--format", default="<content>")
        c.add_argument("--maxlines", type=int, default=-1)
        c.add_argument("--tau", type=float, default=0.5)
    c.add_argument("--stream", action="store_true", help="path is a folder of JSON lines of raw logs; what is new in it is parsed and loaded")
    c = command("load", "parsed logs (JSON lines) to a graph", "path", "out")
    c.add_argument("--stream", action="store_true")
    c = command("train", "labelled URLs (CSV) to a model", "path", "model")
    c.add_argument("--bilstm", action="store_true", help="a character BiLSTM, in place of logistic regression")
    for name in ("--embed-dim", "--batch-size", "--epochs"):
        c.add_argument(name, type=int, help="of the BiLSTM")
    command("analyze", "mark the URLs of a graph by a model", "graph", "model")
    c = command("detect", "anomalous sessions of structured logs (CSV with content and event_id)", "train", "test", "out")
    c.add_argument("--weighting", choices=["tf-idf"])
    c.add_argument("--normalization", choices=["zero-mean", "sigmoid"])
    c = command("crawl", "documents (a Parquet table for each collection) to raw logs", "config", "tables", "out")
    c.add_argument("--maxlines", type=int, default=-1)
    c = sub.add_parser("rules", help="detection rules to SQL")
    c.add_argument("paths", nargs="+")
    c.add_argument("--out", required=True)
    c.add_argument("--text", nargs="+", default=["line"])
    c.add_argument("--columns", nargs="+")
    sub.add_parser("passthrough", help="standard input to standard output")
    return p.parse_args(args)


def main(args: list[str] | None = None) -> int:
    a = _arguments(args)
    from .operators import sequences, urls
    from .plans import batch, detect, parse
    from .schemas import PARSED_LOG, RAW_LOG
    from .sources import readers, sinks
    from .streaming import streams

    if a.command == "passthrough":
        sys.stdout.writelines(sys.stdin)
        return 0
    if a.command == "rules":
        return sinks.compiled_rules(a.paths, a.out, a.text, a.columns)
    spark = SparkSession.builder.appName("sparkloom").getOrCreate()
    if a.command == "mine":
        batch.mine_file(spark, a.path, a.out, a.format, a.tau)
    elif a.command == "parse" and a.stream:
        raw = spark.readStream.schema(RAW_LOG).json(a.path).withColumn("seq", F.xxhash64("id", "line"))  # files have no order
        streams.load(streams.parse_stream(raw, "seq", a.format), a.out, f"{a.out}/checkpoint", "seq").awaitTermination()
    elif a.command == "parse":
        lines = readers.limited(readers.text_lines(spark, a.path), a.maxlines).withColumn("seq", F.monotonically_increasing_id())
        raw = lines.select(F.col("seq").cast("string").alias("id"), F.lit(a.path).alias("source_collection"), "line", F.expr(readers.NO_META).alias("metadata"), "seq")
        print(parse.run_pipeline(spark, raw, "seq", a.out, a.format))
    elif a.command == "load":
        schema = T.StructType(PARSED_LOG.fields).add("is_new", "boolean")
        reader = spark.readStream if a.stream else spark.read
        parsed = reader.schema(schema).option("recursiveFileLookup", True).json(a.path).fillna(False, ["is_new"]).withColumn("seq", F.lit(0))
        if a.stream:
            streams.load(parsed, a.out, f"{a.out}/checkpoint", "seq").awaitTermination()
        else:
            parse.load_graph(parsed, a.out, 0)
    elif a.command == "train":
        sizes = {k: v for k, v in (("dims", a.embed_dim), ("batch", a.batch_size), ("epochs", a.epochs)) if v is not None}
        rows = readers.labelled_urls(spark, a.path)
        model, held = urls.train_bilstm(rows, **sizes) if a.bilstm else urls.train(rows)
        urls.save(model, a.model, urls.metrics(held))
    elif a.command == "analyze":
        found = sinks.read_table(spark, f"{a.graph}/vertices").filter("collection = 'urls'").select("key", F.col("name").alias("url"))
        sinks.flag_urls(urls.score(urls.load(a.model), found), a.graph)
    elif a.command == "detect":
        logs = [readers.structured_csv(spark, x).withColumn("n", F.monotonically_increasing_id()) for x in (a.train, a.test)]
        events = [sequences.session_sequences(x, "n").select("block_id", F.explode("events").alias("event")) for x in logs]
        _, out = detect.detect(*events, "block_id", "event", a.weighting, a.normalization)
        out.write.mode("overwrite").option("header", True).csv(a.out)
    elif a.command == "crawl":
        config = readers.load_config(a.config)
        tables = {c["name"]: spark.read.parquet(f"{a.tables}/{c['name']}.parquet") for c in config["collections"]}
        readers.limited(readers.crawl(tables, config), a.maxlines).write.mode("overwrite").json(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
