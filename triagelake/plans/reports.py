"""Sinks: JSON reports, JSON Lines events, text, CSV and bundles, from findings and indexes."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import scan

_KEEP_NULLS = {"ignoreNullFields": "false"}


def report_json(inputs: DataFrame, found: DataFrame | None, regions: DataFrame | None = None, metadata: dict | None = None) -> DataFrame:
    """(input_id, report): one JSON report for each input. ``strings`` is null if none were looked for."""
    out = scan.summaries(inputs).select("input_id", F.struct(F.col("input_id").cast("string").alias("file_path"), "size_bytes", "mime_type", "md5", "sha256", "entropy").alias("file_summary"))
    if found is None:
        out = out.withColumns({"strings": F.lit(None).cast("string"), "analysis_coverage": F.lit(None).cast("string")})
    else:
        fields = [f.name for f in scan.FINDING.fields]
        strings = found.groupBy("input_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.struct(*[F.to_json(F.struct(*fields), _KEEP_NULLS).alias("j")]).alias("f")))), lambda x: x["f"]["j"]).alias("s"))
        limits = scan.coverage(found)
        out = out.join(strings, "input_id", "left").join(limits.select("input_id", F.struct(*[c for c in limits.columns if c != "input_id"]).alias("analysis_coverage")), "input_id", "left")
        out = out.withColumn("strings", F.concat(F.lit("["), F.array_join(F.coalesce("s", F.array().cast("array<string>")), ","), F.lit("]"))).drop("s")
    if regions is not None:
        packed = regions.groupBy("input_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "entropy", "high"))).alias("entropy_regions"))
        out = out.join(packed, "input_id", "left")
    rest = [c for c in out.columns if c not in ("input_id", "strings")]
    head = F.to_json(F.struct(F.lit(1).alias("schema_version"), *rest, F.lit(True).alias("complete"), F.lit(True).alias("processing_complete")), _KEEP_NULLS)
    body = F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), F.lit(',"strings":'), F.coalesce("strings", F.lit("null")), F.lit(',"metadata":' + json.dumps(metadata or {})), F.lit("}"))
    return out.select("input_id", body.alias("report"))


def events(inputs: DataFrame, found: DataFrame, regions: DataFrame | None = None, live: bool = False) -> DataFrame:
    """JSON Lines events (phase, input_id, seq, line): summary first, or start first and summary last if live; complete closes."""
    line = lambda kind, data: F.to_json(F.struct(F.lit(kind).alias("event"), data.alias("data")), _KEEP_NULLS)
    s = scan.summaries(inputs)
    summary = s.select(F.lit(6 if live else 0).alias("phase"), "input_id", F.lit(0).cast("long").alias("seq"), line("summary", F.struct(*[c for c in s.columns if c != "input_id"])).alias("line"))
    strings = found.select(F.lit(1).alias("phase"), "input_id", "seq", line("string", F.struct(*[f.name for f in scan.FINDING.fields])).alias("line"))
    parts = [summary, strings]
    if regions is not None:
        parts.append(regions.select(F.lit(2).alias("phase"), "input_id", F.col("offset").alias("seq"), line("entropy", F.struct("offset", "length", "entropy", "high")).alias("line")))
    if live:
        parts.append(inputs.select(F.lit(-1).alias("phase"), "input_id", F.lit(0).cast("long").alias("seq"), line("start", F.struct(F.col("input_id").cast("string").alias("input"))).alias("line")))
    parts.append(inputs.select(F.lit(9).alias("phase"), "input_id", F.lit(0).cast("long").alias("seq"), line("complete", F.struct(F.lit(True).alias("processing_complete"))).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def text_lines(found: DataFrame) -> DataFrame:
    """Human text: one tab-separated line a finding, controls escaped."""
    names = F.coalesce(F.array_join("matches", ","), F.lit(""))
    return found.select("input_id", "seq", F.concat_ws("\t", F.format_string("0x%08x", "offset"), "encoding", F.col("length").cast("string"), names, columns.escape_controls(F.col("value"))).alias("line"))


def index_csv(index: DataFrame, context: dict | None = None) -> list[str]:
    """Lines of the indicator CSV: header, a row for each key, a closing context row; all quoted, CRLF."""
    head = ["record_type", "category", "value", "validation_status", "validation_reason", "observed_occurrences", "locations_json", "locations_omitted", "context_json"]
    q = lambda x: '"' + str(x).replace('"', '""') + '"'
    rows = index.orderBy("category", "value", "validation_status").toLocalIterator()
    lines = [",".join(map(q, head))]
    lines += [",".join(map(q, ["indicator", r["category"], r["value"], r["validation_status"], r["validation_reason"], r["observed_occurrences"], r["locations_json"], r["locations_omitted"], ""])) for r in rows]
    return [x + "\r\n" for x in [*lines, ",".join(map(q, ["context", *[""] * 7, json.dumps(context or {}, separators=(",", ":"))]))]]


def replace_file(path: str, data: bytes) -> None:
    """Writes a sibling file, then renames it over the target."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def bundle(folder: str, payloads: dict[str, bytes], limit: int = 256 << 20) -> dict:
    """Writes payloads into a new private folder and the manifest with sizes and digests last."""
    if sum(map(len, payloads.values())) > limit:
        raise ValueError("bundle is too large")
    os.mkdir(folder, 0o700)
    receipts = {}
    for name, data in payloads.items():
        with open(Path(folder, name), "xb") as f:
            f.write(data)
        receipts[name] = {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    manifest = {"schema_version": 1, "processing_complete": True, "artifacts": receipts}
    temp = Path(folder, ".manifest.tmp")
    temp.write_text(json.dumps(manifest, indent=2) + "\n")
    os.link(temp, Path(folder, "manifest.json"))  # fails if it exists: never replaced
    temp.unlink()
    return manifest
