"""The queries of this subpackage, and their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat, isomedia, langid, license, linededup, mixing, packing, simhash, sketch, suffix
from .common import documents


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_dedup": lambda s, d: simhash.simhash_components(documents(s, d)),
        "op2_chat_format": lambda s, d: chat.chat_report(_conversations(s, d)),
        "op3_suffix_dedup": lambda s, d: suffix.repeated_passages(documents(s, d)),
        "op4_language_id": lambda s, d: langid.language_report(documents(s, d)),
        "op5_doc_fingerprint": lambda s, d: sketch.sketch_report(documents(s, d)),
        "op6_media_columns": lambda s, d: isomedia.media_report(documents(s, d)),
        "op7_license_scan": lambda s, d: license.license_report(documents(s, d)),
        "op8_line_dedup": lambda s, d: linededup.line_report(documents(s, d)),
        "op9_packing": lambda s, d: packing.pack(documents(s, d)),
        "op10_mixing": lambda s, d: mixing.mix_report(documents(s, d)),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.ORACLE, "op8_line_dedup": linededup.ORACLE, "op10_mixing": mixing.ORACLE}
