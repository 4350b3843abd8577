"""Inputs: single files and ranges, folders, and completed batches with strict JSON."""

from __future__ import annotations

import json
import os
import stat
from collections import deque
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import select_range

MAX_LINE, MAX_JSON_DEPTH, MAX_MEMBERS, MAX_NAME, MAX_STRING = 256 << 10, 64, 256, 256, 4 << 20


def number(text: str) -> int:
    """Decimal or 0x hexadecimal."""
    return int(text, 16) if text[:2].lower() == "0x" else int(text)


def files(spark: SparkSession, *paths: str, offset: int = 0, length: int | None = None) -> DataFrame:
    """Files of any store as inputs (input_id is the path); selected ranges only."""
    raw = spark.read.format("binaryFile").load(list(paths))
    return select_range(raw.select(F.col("path").alias("input_id"), "content", F.col("modificationTime").alias("modified"), F.col("length").alias("size")), offset, length)


def changed(spark: SparkSession, before: DataFrame, *paths: str) -> DataFrame:
    """Inputs whose size or time differ from a listing made before (columns input_id, size, modified)."""
    now = spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("input_id"), F.col("length").alias("s"), F.col("modificationTime").alias("m"))
    return before.join(now, "input_id", "left").where(~(F.col("size").eqNullSafe(F.col("s")) & F.col("modified").eqNullSafe(F.col("m")))).select("input_id")


def bytes_input(spark: SparkSession, name: str, data: bytes) -> DataFrame:
    """One input from memory (standard input, say)."""
    return spark.createDataFrame([(name, bytearray(data))], "input_id string, content binary")


def discover(root: str, output: str | None = None, recursive: bool = True, prune=None, errors: list | None = None) -> Iterator[tuple]:
    """Breadth-first entries of a local folder: path, size, kind, in_output. Links are never followed; hidden files count.

    ``prune(path)`` says which folders are not entered. Folders and entries that cannot be read are noted in ``errors``
    (path, code) and passed over; without such a list they raise."""
    base = os.path.realpath(root)
    if os.path.islink(root) or not os.path.isdir(base):
        raise ValueError("the input is no folder, or a link")
    out = os.path.realpath(output) if output else None
    if out and (out == base or base.startswith(out + os.sep)):
        raise ValueError("the output must not be or hold the input")
    queue = deque([""])
    while queue:
        here = queue.popleft()
        try:
            with os.scandir(os.path.join(base, here)) as listing:
                found = sorted(listing, key=lambda e: os.fsencode(e.name))
        except OSError:
            if errors is None:
                raise
            errors.append((here, "directory_read"))
            continue
        for e in found:
            path = f"{here}/{e.name}" if here else e.name
            try:
                info = e.stat(follow_symlinks=False)
            except OSError:
                if errors is None:
                    raise
                errors.append((path, "entry_metadata"))
                continue
            kind = "link" if stat.S_ISLNK(info.st_mode) else "directory" if stat.S_ISDIR(info.st_mode) else "file" if stat.S_ISREG(info.st_mode) else "special"
            inside = bool(out) and (e.path == out or e.path.startswith(out + os.sep))
            yield path, info.st_size, kind, inside
            if kind == "directory" and recursive and not inside and not (prune and prune(path)):
                queue.append(path)


def entries(spark: SparkSession, root: str, **options) -> DataFrame:
    rows = [r for r in discover(root, **options)]
    return spark.createDataFrame(rows, "path string, size long, kind string, in_output boolean")


# ---- strict JSON of batch artifacts ------------------------------------------------------------


def strict_json(text: str) -> object:
    """Parses JSON; refuses repeated keys, deep nesting, too many members, long names or strings, NaN."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("repeated key")
        if len(items) > MAX_MEMBERS or any(len(k.encode()) > MAX_NAME for k in out):
            raise ValueError("object is too large")
        return out

    def refuse(x: str) -> None:
        raise ValueError(f"{x} is no JSON")

    value = json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)
    stack = [(value, 1)]
    while stack:
        v, depth = stack.pop()
        if depth > MAX_JSON_DEPTH:
            raise ValueError("nested too deeply")
        if isinstance(v, str) and len(v.encode()) > MAX_STRING:
            raise ValueError("string is too long")
        stack += [(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    return value


def json_lines(path: str) -> list[dict]:
    """Records of a journal; a last line without its newline is an error."""
    data = Path(path).read_bytes()
    if data and not data.endswith(b"\n"):
        raise ValueError("torn last line")
    lines = data.split(b"\n")[:-1]
    if any(len(x) > MAX_LINE for x in lines):
        raise ValueError("line is too long")
    return [strict_json(x.decode()) for x in lines]


JOURNAL = "sequence long, entry_id long, path string, display_path string, record_type string, status string, reason string, report_id string, location string, selected_bytes long, duration_ms long, has_actionable boolean"


def journal_rows(records: list[dict]) -> list[tuple]:
    rows = []
    for r in records:
        o = r.get("outcome") or {}
        rep = o.get("report") or {}
        path = f"{r['path']['encoding']}\0{r['path']['value']}"
        rows.append((r["sequence"], r["entry_id"], path, r.get("display_path"), r["record_type"], o.get("status"), o.get("reason"), rep.get("report_id"), rep.get("location"), rep.get("selected_bytes"), rep.get("duration_ms"), rep.get("has_actionable_indicators")))
    return rows


def journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(journal_rows(json_lines(path)), JOURNAL)
