"""Live scans: files that arrive in a folder become findings, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernel
from ..operators import scan


def findings_stream(spark: SparkSession, folder: str, cfg: kernel.Config | None = None) -> DataFrame:
    """A streaming DataFrame of findings of the files in a folder, old and new; append mode, stateless."""
    shape = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(shape).load(folder)
    return scan.findings(raw.select(F.col("path").alias("input_id"), "content"), cfg)


def table_stream(spark: SparkSession, path: str, id_col: str, text_col: str, cfg: kernel.Config | None = None) -> DataFrame:
    """Findings of a text table of Parquet files read as a stream."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path)
    return scan.findings(scan.inputs_of(rows, id_col, text_col), cfg)


def write_events(found: DataFrame, output: str, checkpoint: str):
    """Appends JSON Lines events exactly once; the file sink's log is the completion marker of each batch."""
    line = F.to_json(F.struct(F.lit("string").alias("event"), F.struct(*found.columns).alias("data")), {"ignoreNullFields": "false"})
    return found.select(line.alias("value")).writeStream.format("text").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(output)
