"""Shared plumbing of the training-data operators: inputs, scratch tables, worker set-up.

Scratch tables live in the folder that ``spark.checkpoint.dir`` names (shared by the driver
and all executors), so a lost executor never takes intermediate results with it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id: smaller than every real id.
NULL_ID = -(2**63)
#: ASCII white space as the contracts define it: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
_ROOT = str(Path(__file__).resolve().parents[2])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package and keeps Arrow batches of long texts small."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    env.setdefault("OMP_NUM_THREADS", "1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run's tables, below spark.checkpoint.dir (set here only if it is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="triagelake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back, which cuts the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def word_count(text: Column) -> Column:
    """Words of a text; one short string a text, no array of them."""
    marks = F.regexp_replace(F.btrim(text, F.lit(WHITE)), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.char_length(marks), F.lit(0)).cast("long")
