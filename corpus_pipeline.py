"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents; the last
adds the token ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import bpe, language, line_dedup, mixing, near_dedup
from triagelake.llm.common import read, save, scratch


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised with enough certainty go."""
    return language.keep_language(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents stay, with their n_chars counted anew."""
    out = line_dedup.dedup_lines(docs).drop("__n_lines", "__n_dropped")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it."""
    names = docs.columns
    mixed = mixing.mix(docs).where(F.col("__times") > 0)
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*names)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the token ids and their digests."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [("language", language_stage), ("lines", line_stage), ("near", near_stage), ("mix", mix_stage), ("tokens", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = save(stage(spark, docs, sf_dir), f"{folder}/{i}")
    return docs


ORACLE_SQL = None
