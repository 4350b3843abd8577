"""The scan: summaries, findings, matches, entropy windows and coverage of inputs.

``inputs`` are rows of input_id and content (binary). Findings come from one Arrow pass without a
shuffle; everything after is DataFrame algebra on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import columns, kernel
from ..functions.patterns import Pattern, load

_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


DETAIL = _struct(("pattern", _S), ("text", _S), ("offset", _L), ("end_offset", _L), ("validation", _struct(("status", _S), ("reason", _S))), ("evidence", _struct(("before", _S), ("after", _S), ("boundary_warning", _S))))
_FOUND = [("matches", T.ArrayType(_S)), ("has_actionable_match", _B), ("match_details", T.ArrayType(DETAIL)), ("match_details_truncated", _B), ("match_details_omitted", T.MapType(_S, _L))]
LAYER = _struct(("depth", _L), ("encoding", _S), ("source_offset", _L), ("source_end_offset", _L), ("offset_space", _S), ("text", _S), *_FOUND, ("next_decode", _S))
FINDING = _struct(("offset", _L), ("encoding", _S), ("extraction", _S), ("length", _L), ("value", _S), *_FOUND, ("decoded", _S), ("decoded_layers", T.ArrayType(LAYER)), ("truncated", _B), ("decode_status", _S))


def inputs_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of a text table as inputs; a null text is an empty input."""
    return df.select(F.col(id_col).alias("input_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("content"))


def select_range(inputs: DataFrame, offset: int = 0, length: int | None = None) -> DataFrame:
    """The selected bytes; an offset beyond an input's end is an error."""
    size = F.octet_length("content")
    part = F.substring("content", offset + 1, length if length is not None else 2**31 - 1)
    bad = F.raise_error(F.concat(F.lit("offset is beyond the end of input "), F.col("input_id").cast("string")))
    return inputs.withColumn("content", F.when(size < offset, bad.cast("binary")).otherwise(part))


def findings(inputs: DataFrame, cfg: kernel.Config | None = None, rules: list[Pattern] | None = None) -> DataFrame:
    """A row for each finding: input_id, seq (order of emission), then the finding's fields.

    A byte order mark that conflicts with the configuration fails the query, as it fails a batch."""
    cfg = (cfg or kernel.Config()).validated()
    rules = rules if rules is not None else load(categories=list(cfg.categories))
    schema = T.StructType([inputs.schema["input_id"], T.StructField("seq", _L), *FINDING.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for key, content in zip(batch.column("input_id").to_pylist(), batch.column("content").to_pylist()):
                for i, f in enumerate(kernel.findings(content or b"", rules, cfg)):
                    f["match_details_omitted"] = list(f["match_details_omitted"].items())
                    for layer in f["decoded_layers"]:
                        layer["match_details_omitted"] = list(layer["match_details_omitted"].items())
                    rows.append({"input_id": key, "seq": i} | f)
                    if len(rows) >= 2048:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return inputs.select("input_id", "content").mapInArrow(run, schema)


def observations(found: DataFrame) -> DataFrame:
    """Match details of findings and decoded layers, each with its place in the order of observation. One pass over ``found``."""
    null = lambda t: F.lit(None).cast(t)
    own = F.transform("match_details", lambda d, i: F.struct(F.lit(-1).alias("layer"), i.alias("n"), d.alias("d"), d["offset"].alias("source_offset"), d["end_offset"].alias("source_end_offset"), F.lit(0).cast("long").alias("decode_depth"), null("string").alias("decode_encoding"), null("long").alias("decoded_offset"), null("long").alias("decoded_end_offset")))
    deep = F.flatten(F.transform("decoded_layers", lambda x, k: F.transform(x["match_details"], lambda d, i: F.struct(k.alias("layer"), i.alias("n"), d.alias("d"), x["source_offset"].alias("source_offset"), x["source_end_offset"].alias("source_end_offset"), x["depth"].alias("decode_depth"), x["encoding"].alias("decode_encoding"), d["offset"].alias("decoded_offset"), d["end_offset"].alias("decoded_end_offset")))))
    both = found.select("input_id", "seq", F.col("encoding").alias("source_encoding"), "extraction", F.explode(F.concat(own, deep)).alias("o"))
    return both.select(
        "input_id", "seq", "o.layer", "o.n", F.col("o.d.pattern").alias("category"), F.col("o.d.text").alias("value"), F.col("o.d.validation.status").alias("validation_status"), F.col("o.d.validation.reason").alias("validation_reason"),
        "o.source_offset", "o.source_end_offset", "source_encoding", "extraction", "o.decode_depth", "o.decode_encoding", "o.decoded_offset", "o.decoded_end_offset", F.col("o.d.evidence").alias("evidence"),
    )


def upstream_omissions(found: DataFrame) -> DataFrame:
    """Details omitted upstream, by category."""
    maps = found.select(F.explode("match_details_omitted")).unionByName(found.select(F.explode("decoded_layers").alias("l")).select(F.explode("l.match_details_omitted")))
    return maps.groupBy(F.col("key").alias("category")).agg(F.sum("value").alias("omitted"))


def coverage(found: DataFrame) -> DataFrame:
    """One row of limit counters for each input that has findings."""
    layers = lambda test: F.exists("decoded_layers", test)
    cut = F.col("match_details_truncated")
    limited_layer = layers(lambda x: x["next_decode"].isin("byte_limit", "depth_limit"))
    return found.groupBy("input_id").agg(
        F.count_if("truncated").alias("truncated_strings"),
        F.count_if(cut).alias("strings_with_omitted_details"),
        F.sum(F.size(F.filter("decoded_layers", lambda x: x["match_details_truncated"]))).alias("decoded_layers_with_omitted_details"),
        F.count_if((F.col("decode_status") == "limit") | limited_layer).alias("decode_limited_strings"),
        F.bool_or(F.col("has_actionable_match") | layers(lambda x: x["has_actionable_match"])).alias("has_actionable_indicators"),
    )


def entropy_of(counts):
    """Shannon entropy in bits of each row of byte counts; 0 for no bytes. Terms are added in order of byte values."""
    import numpy as np

    counts = np.atleast_2d(counts).astype(float)
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1) + 0.0


def summaries(inputs: DataFrame) -> DataFrame:
    """Size, MIME type, MD5, SHA-256 and entropy of each input; no shuffle, one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            values = []
            for content in batch.column("content").to_pylist():
                values.append(float(entropy_of(np.bincount(np.frombuffer(content, np.uint8), minlength=256))[0]))
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "content"]
            names = [x for x in batch.schema.names if x != "content"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(values, pa.float64())], names=[*names, "entropy"])

    c = F.col("content")
    kept = inputs.select("input_id", F.octet_length(c).cast("long").alias("size_bytes"), columns.mime_type(c).alias("mime_type"), F.md5(c).alias("md5"), F.sha2(c, 256).alias("sha256"), "content")
    shape = T.StructType([*[f for f in kept.schema if f.name != "content"], T.StructField("entropy", T.DoubleType())])
    return kept.mapInArrow(run, shape)


def entropy_regions(inputs: DataFrame, window: int = 4096, threshold: float = 7.0, base: int = 0) -> DataFrame:
    """Entropy of consecutive windows: offset, length, entropy, high. One pass over each input, without a shuffle."""
    schema = T.StructType([inputs.schema["input_id"], *[T.StructField(n, t) for n, t in (("offset", _L), ("length", _L), ("entropy", T.DoubleType()), ("high", _B))]])
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for i, content in enumerate(batch.column("content")):
                data = np.frombuffer(content.as_py() or b"", np.uint8)
                for start in range(0, len(data), 1024 * window):  # blocks of windows, so that counts stay small
                    part = data[start : start + 1024 * window]
                    w = np.arange(len(part)) // window
                    rows = int(w[-1]) + 1
                    counts = np.bincount(w * 256 + part, minlength=rows * 256).reshape(rows, 256)
                    e = entropy_of(counts)
                    key = pa.concat_arrays([batch.column("input_id").slice(i, 1)] * rows)
                    values = (start + np.arange(rows) * window + base, counts.sum(1), e, e >= threshold)
                    yield pa.RecordBatch.from_arrays([key, *[pa.array(v, t) for v, t in zip(values, kinds)]], names=schema.names)

    return inputs.select("input_id", "content").mapInArrow(run, schema)


def hex_dump(inputs: DataFrame, base: int = 0) -> DataFrame:
    """Hex dump lines of 16 bytes, with their offsets."""
    starts = F.sequence(F.lit(0), F.octet_length("content") - 1, F.lit(16))
    rows = inputs.where(F.octet_length("content") > 0).select("input_id", "content", F.explode(starts).alias("i"))
    chunk = F.substring("content", F.col("i") + 1, F.lit(16))
    return rows.select("input_id", (F.col("i") + base).cast("long").alias("offset"), columns.hex_row(chunk, F.col("i") + base).alias("line"))
