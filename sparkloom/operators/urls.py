"""URL scoring.

Two models: a character BiLSTM (`train_bilstm`, see bilstm), and one that Spark ML fits on all rows wherever they are,
hashed character 3-grams under a logistic regression (`train`). Scoring, saving and loading take either.
"""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import char_vector
from . import bilstm

#: Characters of a vocabulary that is broadcast.
SMALL = 200_000


def characters(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.withColumn("_chars", F.filter(F.split(F.coalesce(url, F.lit("")), ""), lambda c: c != ""))


def text_model(urls: DataFrame, order: str, url: str = "url") -> DataFrame:
    """(char, idx, first_row, first_pos): distinct characters in first-seen order, from 1, so that 0 is padding."""
    seen = urls.select(order, F.posexplode(F.filter(F.split(url, ""), lambda c: c != "")).alias("pos", "char"))
    first = seen.groupBy("char").agg(F.min(F.struct(F.col(order).alias("r"), "pos")).alias("f"))
    from pyspark.sql import Window

    idx = F.row_number().over(Window.orderBy("f.r", "f.pos"))  # a row per distinct character
    return first.select("char", idx.alias("idx"), F.col("f.r").alias("first_row"), F.col("f.pos").alias("first_pos"))


def index_vectors(urls: DataFrame, vocabulary: DataFrame, length: int, url: str = "url") -> DataFrame:
    """urls with vector: character indices, cut or padded to length."""
    table = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("char", "idx"))).alias("_v")).withColumn("_one", F.lit(1))
    small = vocabulary.count() <= SMALL  # characters: Unicode has no more than some ten thousand in use
    return urls.withColumn("_one", F.lit(1)).join(F.broadcast(table) if small else table, "_one").withColumn("vector", char_vector(F.col(url), F.col("_v"), length)).drop("_v", "_one")


def train(urls: DataFrame, url: str = "url", label: str = "label", buckets: int = 1 << 16, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """The model from 80 % of urls, and its predictions on the rest."""
    rows = characters(urls.select(url, label), url)
    fit, held = rows.randomSplit([0.8, 0.2], seed)
    model = Pipeline(stages=[NGram(n=3, inputCol="_chars", outputCol="_grams"), HashingTF(numFeatures=buckets, inputCol="_grams", outputCol="_tf"), LogisticRegression(featuresCol="_tf", labelCol=label, regParam=0.01, maxIter=30)]).fit(fit)
    return model, score(model, held, url)


def metrics(predicted: DataFrame, label: str = "label") -> DataFrame:
    """n and accuracy of predictions, a row."""
    return predicted.agg(F.count("*").alias("n"), F.avg((F.col("malicious_warning") == (F.col(label) == 1)).cast("double")).alias("accuracy"))


def train_bilstm(urls: DataFrame, url: str = "url", label: str = "label", **sizes) -> tuple[bilstm.Model, DataFrame]:
    """As train, for the BiLSTM; sizes as in bilstm.train and bilstm.fit."""
    return bilstm.train(urls, url, label, **sizes)


def save(model: PipelineModel | bilstm.Model, path: str, history: DataFrame | None = None, spark: SparkSession | None = None) -> None:
    """The model, in place of one that is there, and the table of its metrics beside it, to which each saving adds."""
    if isinstance(model, bilstm.Model):
        bilstm.save(model, spark or SparkSession.active(), f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    if history is not None:
        history.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/history")


def load(path: str, spark: SparkSession | None = None) -> PipelineModel | bilstm.Model:
    spark = spark or SparkSession.active()
    stages = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/model/stages")
    if stages.getFileSystem(spark._jsc.hadoopConfiguration()).exists(stages):
        return PipelineModel.load(f"{path}/model")
    return bilstm.load(spark, f"{path}/model")


def score(model: PipelineModel | bilstm.Model, urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with malicious_warning; streams as well."""
    if isinstance(model, bilstm.Model):
        return bilstm.score(model, urls, url)
    keep = [c for c in urls.columns if c != "_chars"]
    return model.transform(characters(urls.select(*keep), url)).select(*keep, (F.col("prediction") == 1).alias("malicious_warning"))


def classify(model: PipelineModel | bilstm.Model, urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with verdict, bad or good; an empty URL raises."""
    checked = F.when(F.length(F.coalesce(url, F.lit(""))) == 0, F.raise_error(F.lit("empty URL")).cast("string")).otherwise(F.col(url))
    return score(model, urls.withColumn(url, checked), url).withColumn("verdict", F.when(F.col("malicious_warning"), "bad").otherwise("good")).drop("malicious_warning")


def enrich_params(parsed: DataFrame, scored: DataFrame, key: str = "log_id") -> DataFrame:
    """parsed with meta.malicious_warning on each url parameter; scored: (url, malicious_warning)."""
    verdicts = scored.groupBy("url").agg(F.max("malicious_warning").alias("w"))
    found = parsed.select(key, F.explode(F.array_distinct(F.filter("params", lambda p: p["entity"] == "url")["value"])).alias("url")).join(verdicts, "url")
    maps = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("url", "w"))).alias("_w"))
    return parsed.join(maps, key, "left").withColumn("params", F.transform("params", lambda p: p.withField("meta", F.when(p["entity"] == "url", F.struct(F.try_element_at("_w", p["value"]).alias("malicious_warning")))))).drop("_w")
