"""Folder runs: discovery, selection, scan of every file, reports, journal, manifest; and batch export."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import time
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns, kernel, patterns
from ..operators import indicators, journal, scan
from ..operators.selection import Policy, pruned, skip_reasons
from ..sources import files
from . import reports

DOMAIN = b"triagelake:relative-path:v1\0"
TAG = "unix-bytes-base64"


def report_id(path: str, domain: bytes = DOMAIN, tag: str = TAG, raw: bytes | None = None) -> str:
    """Names a path, not its contents. Pass the domain tag of another producer to get its ids."""
    raw = os.fsencode(path) if raw is None else raw
    return hashlib.sha256(domain + tag.encode() + b"\0" + raw).hexdigest()


def run(spark: SparkSession, root: str, output: str, cfg: kernel.Config | None = None, policy: Policy | None = None, recursive: bool = True, pattern_source: str | None = None, domain: bytes = DOMAIN, validation: str = "all") -> dict:
    """Scans a folder into a new output folder; returns the manifest.

    Files are read and scanned on the executors (the folder is on shared storage); each file is
    ``complete``, ``limited`` or ``failed`` by itself. Reports are written by the driver from an
    iterator, one partition at a time, so no more than that is held."""
    cfg, policy = (cfg or kernel.Config()).validated(), (policy or Policy()).checked()
    rules = patterns.load(pattern_source, list(cfg.categories))
    os.makedirs(output, exist_ok=False)
    started = int(time.time() * 1000)
    unread: list[tuple[str, str]] = []
    found = skip_reasons(files.entries(spark, root, output=output, recursive=recursive, prune=lambda p: pruned(policy, p), errors=unread), policy, recursive)
    rows = found.where((F.col("kind") != "directory") | F.col("reason").isNotNull()).orderBy(F.col("path").cast("binary")).collect()
    batch = uuid.uuid4().hex
    taken = [(i, r["path"]) for i, r in enumerate(rows, 1) if r["reason"] is None]
    base = os.path.realpath(root)

    def scan_one(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for i, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.append((i, path, *_outcome(os.path.join(base, path), rules, cfg)))
            cols = list(zip(*out)) if out else [[]] * 7
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["entry_id", "path", "status", "reason", "selected_bytes", "has_actionable", "report"])

    shape = "entry_id long, path string, status string, reason string, selected_bytes long, has_actionable boolean, report string"
    todo = spark.createDataFrame(taken, "entry_id long, path string")
    scanned = todo.repartition(max(1, min(len(taken), 4 * spark.sparkContext.defaultParallelism)), "entry_id").mapInArrow(scan_one, shape) if taken else todo.limit(0).mapInArrow(scan_one, shape)
    done = {}
    for r in scanned.toLocalIterator():
        rid = report_id(r["path"], domain)
        place = f"results/{rid[:2]}/{rid}.json"
        if r["report"] is not None:
            Path(output, place).parent.mkdir(parents=True, exist_ok=True)
            with open(Path(output, place), "x") as f:
                f.write(r["report"])
        done[r["entry_id"]] = (r["status"], r["reason"], {"report_id": rid, "location": place, "selected_bytes": r["selected_bytes"], "duration_ms": 0, "has_actionable_indicators": r["has_actionable"]})
    lines, errors, seq = [], [], 0
    for i, r in enumerate(rows, 1):
        record = {"schema_version": 1, "batch_id": batch, "entry_id": i, "path": {"encoding": TAG, "value": base64.b64encode(os.fsencode(r["path"])).decode()}, "display_path": r["path"].encode("utf-8", "replace").decode()}
        status, reason, rep = done.get(i, ("skipped", r["reason"], None))
        if status != "skipped":
            seq += 1
            lines.append(record | {"sequence": seq, "record_type": "admission"})
        outcome = {"status": status} | ({"report": rep} if status in ("complete", "limited") else {"reason": reason})
        seq += 1
        lines.append(record | {"sequence": seq, "record_type": "terminal", "outcome": outcome})
        if status == "failed":
            errors.append({"schema_version": 1, "batch_id": batch, "entry_id": i, "scope": "file", "display_path": record["display_path"], "stage": "scan", "code": reason, "message": reason})
    for path, code in unread:
        errors.append({"schema_version": 1, "batch_id": batch, "entry_id": None, "scope": "discovery", "display_path": path.encode("utf-8", "replace").decode(), "stage": "discovery", "code": code, "message": code})
    for name, body in (("files.jsonl", lines), ("errors.jsonl", errors)):
        Path(output, name).write_text("".join(json.dumps(x) + "\n" for x in body))
    rows_ = files.journal_rows(lines)
    counts = journal.counters(spark.createDataFrame(rows_, files.JOURNAL)).first().asDict()
    counts |= {"discovery_errors": len(unread), "queued": 0, "active": 0}
    manifest = {
        "schema_version": 1, "batch_id": batch, "status": "complete", "discovery_complete": True, "stop_reasons": [], "started_unix_ms": started, "finished_unix_ms": int(time.time() * 1000),
        "configuration": {"recursive": recursive, "analysis": cfg.as_dict(), "patterns_sha256": patterns.fingerprint(rules, b"triagelake:patterns:v1\0")}, "counters": counts, "artifacts": {"files": "files.jsonl", "errors": "errors.jsonl", "reports": "results"},
    }
    reports.replace_file(str(Path(output, "manifest.json")), (json.dumps(manifest, indent=2) + "\n").encode())
    return manifest


def _outcome(path: str, rules: list, cfg: kernel.Config) -> tuple:
    try:
        before = os.lstat(path)
        fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
        with os.fdopen(fd, "rb") as f:
            data = f.read()
        after = os.lstat(path)
    except OSError:
        return "failed", "input_open", None, None, None
    same = lambda s: (s.st_ino, s.st_size, s.st_mtime_ns, s.st_ctime_ns)
    if same(before) != same(after):
        return "failed", "file_changed", None, None, None
    try:
        body = kernel.selected(data, cfg.offset, cfg.length)
    except ValueError:
        return "failed", "input_range", None, None, None
    try:
        strings = list(kernel.findings(data, rules, cfg)) if cfg.strings else None
    except ValueError:  # a byte order mark against the configured encoding
        return "failed", "string_analysis", None, None, None
    cut = any(map(kernel.limited, strings or []))
    acts = None if strings is None else any(f["has_actionable_match"] or any(x["has_actionable_match"] for x in f["decoded_layers"]) for f in strings)
    bins = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    layers = [x for f in strings or [] for x in f["decoded_layers"]]
    limits = {
        "truncated_strings": sum(f["truncated"] for f in strings or []), "strings_with_omitted_details": sum(f["match_details_truncated"] for f in strings or []),
        "decoded_layers_with_omitted_details": sum(x["match_details_truncated"] for x in layers),
        "decode_limited_strings": sum(f["decode_status"] == "limit" or any(x["next_decode"] in ("byte_limit", "depth_limit") for x in f["decoded_layers"]) for f in strings or []),
    }
    summary = {"size_bytes": len(body), "mime_type": columns.mime_of(body), "entropy": float(scan.entropy_of(bins)[0]), "md5": hashlib.md5(body).hexdigest(), "sha256": hashlib.sha256(body).hexdigest()}
    report = {"schema_version": 1, "file_summary": summary, "scan_range": {"offset": cfg.offset, "length": len(body), "requested_length": cfg.length}, "strings": strings, "analysis_coverage": None if strings is None else limits | {"limited": cut}, "complete": not cut, "processing_complete": True}
    if cfg.entropy:
        w = cfg.entropy_window
        parts = [np.bincount(np.frombuffer(body[at : at + w], np.uint8), minlength=256) for at in range(0, len(body), w)]
        values = scan.entropy_of(np.array(parts)).tolist() if parts else []
        report["entropy_regions"] = [{"offset": cfg.offset + i * w, "length": int(p.sum()), "entropy": e, "high": e >= cfg.entropy_threshold} for i, (p, e) in enumerate(zip(parts, values))]
    report["metadata"] = {"configuration": cfg.as_dict(), "patterns_sha256": patterns.fingerprint(rules, b"triagelake:patterns:v1\0")}
    return "limited" if cut else "complete", None, len(body), acts, json.dumps(report, ensure_ascii=False)


class BatchError(ValueError):
    pass


def read_batch(spark: SparkSession, folder: str) -> tuple[dict, DataFrame, DataFrame]:
    """(manifest, journal, findings keyed by entry) of a completed batch; raises BatchError if it does not reconcile."""
    manifest = files.strict_json(Path(folder, "manifest.json").read_text())
    if manifest.get("status") != "complete":
        raise BatchError("batch is not complete")
    book = files.journal(spark, str(Path(folder, "files.jsonl"))).persist()
    errs = files.json_lines(str(Path(folder, "errors.jsonl")))
    errors = spark.createDataFrame([(e.get("entry_id"), e["scope"], e["code"]) for e in errs], "entry_id long, scope string, code string")
    if not all(journal.gaps(book).first()) and book.head(1):
        raise BatchError("sequence or entry gap")
    for name, bad in (("pairs", journal.pair_faults(book)), ("paths", journal.duplicates(book)), ("reports", journal.duplicates(book, "location")), ("diagnostics", journal.diagnostic_faults(errors, book))):
        if bad.head(1):
            raise BatchError(f"journal {name} do not reconcile")
    ours = journal.counters(book).first().asDict()
    if any(manifest["counters"].get(k, v) != v for k, v in ours.items()):
        raise BatchError("counters differ from the journal")
    named = [(r["entry_id"], r["location"]) for r in book.where("location IS NOT NULL").collect()]
    for _, location in named:
        p = Path(folder, location)
        if p.is_symlink() or not os.path.realpath(p).startswith(os.path.realpath(folder) + os.sep):
            raise BatchError("report is outside the batch")
    schema = T.StructType([T.StructField("entry_id", T.LongType()), T.StructField("report", T.StringType())])
    root = os.path.realpath(folder)

    def load(batches):
        import pyarrow as pa

        for b in batches:
            texts = [Path(root, x).read_text() for x in b.column(1).to_pylist()]
            for t in texts:
                files.strict_json(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["entry_id", "report"])

    texts = spark.createDataFrame(named, "entry_id long, location string").mapInArrow(load, schema)
    parsed = texts.select("entry_id", F.from_json("report", T.StructType([T.StructField("strings", T.ArrayType(scan.FINDING))])).alias("r"))
    found = parsed.select(F.col("entry_id").alias("input_id"), F.posexplode("r.strings").alias("seq", "f")).select("input_id", F.col("seq").cast("long"), "f.*")
    return manifest, book, found


def export(spark: SparkSession, folder: str, output: str, limits: indicators.Limits | None = None, validation: str = "all") -> int:
    """Aggregates a completed batch into a bundle; 0 if nothing was limited, else 1."""
    limits = limits or indicators.Limits()
    manifest, book, found = read_batch(spark, folder)
    paths = journal.entries(book).where("location IS NOT NULL").select(F.col("entry_id").alias("input_id"), "path", "report_id", "location")
    ordered = paths.withColumn("path_key", F.concat(F.split("path", "\0")[0].cast("binary"), F.lit(b"\0"), F.unbase64(F.split("path", "\0")[1])))
    obs = scan.observations(found).join(ordered, "input_id").persist()
    index = indicators.batch_index(obs, limits, ["path_key", "seq", "layer", "n"], validation=validation).persist()
    total, seen = obs.count(), indicators.accepted(obs, validation).count()
    names = {r["input_id"]: r.asDict() for r in ordered.collect()}
    places = {bytes(r["path_key"]): r for r in names.values()}
    rows = []
    for r in index.orderBy(*indicators.KEY).collect():  # at most limits.keys rows
        at = []
        for x in r["locations"]:
            p = places[bytes(x["path_key"])]
            enc, value = p["path"].split("\0")
            at.append({"path": {"encoding": enc, "value": value}, "report_id": p["report_id"], "report_location": p["location"]} | {k: x[k] for k in indicators.PLACE})
        rows.append({k: r[k] for k in (*indicators.KEY, "observed_occurrences", "distinct_file_entries")} | {"locations": at, "location_observations_omitted": r["location_observations_omitted"], "validation_reasons": r["validation_reasons"], "reason_observations_omitted": r["reason_observations_omitted"]})
    kept = sum(r["observed_occurrences"] for r in rows)
    c = manifest["counters"]
    failed = not manifest["discovery_complete"] or bool(manifest["stop_reasons"]) or any(c.get(k, 0) for k in ("discovery_errors", "failed", "cancelled"))
    limited = kept < seen or any(r["location_observations_omitted"] or r["reason_observations_omitted"] for r in rows)
    counts = {"file_entries": c["eligible"], "source_counters": c, "retained_unique_keys": len(rows), "observed_occurrences": total, "filtered_observations": total - seen, "unretained_key_observations": seen - kept, "selected_bytes": journal.selected_bytes(book).first().asDict()}
    order = sorted(range(len(rows)), key=lambda i: (-rows[i]["distinct_file_entries"], *(rows[i][k].encode() for k in indicators.KEY)))[: limits.summary_keys]
    ranked = []
    for rank, i in enumerate(order, 1):
        shown: list[dict] = []
        for x in rows[i]["locations"]:
            if len(shown) < limits.sources_per_key and (not shown or shown[-1]["path"] != x["path"]):
                shown.append(x)
        ranked.append({"rank": rank, "indicator_index": i, **{k: rows[i][k] for k in (*indicators.KEY, "distinct_file_entries", "observed_occurrences")}, "source_entries_not_shown": rows[i]["distinct_file_entries"] - len(shown), "source_samples": shown})
    scan_state = "incomplete" if failed else "empty" if not c["eligible"] else "limited" if c.get("limited") else "complete_within_configured_scope"
    head = {"schema_version": 1, "source_batch_id": manifest["batch_id"], "processing_complete": True, "validation_filter": validation, "coverage": {"scan": scan_state, "aggregation": "limited" if limited else "complete", "import": "valid_complete_batch", "presentation": validation}, "counts": counts}
    reasons = [r.asDict() for r in journal.outcome_reasons(book).orderBy("outcome", "reason").collect()]
    quote = lambda x: '"' + str(x).replace('"', '""') + '"'
    dump = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    columns = [*indicators.KEY, "observed_occurrences", "distinct_file_entries", "location_observations_omitted", "locations", "validation_reasons", "reason_observations_omitted"]
    csv = [",".join(map(quote, columns))] + [",".join(quote(dump(r[k]) if isinstance(r[k], (list, dict)) else r[k]) for k in columns) for r in rows]
    reports.bundle(output, {
        "indicators.json": json.dumps(head | {"kind": "batch_indicator_export", "indicators": rows}, ensure_ascii=False).encode(),
        "summary.json": json.dumps(head | {"kind": "batch_summary", "ranking": {"entries": ranked, "keys_not_shown": len(rows) - len(ranked)}, "outcome_reasons": {"entries": reasons}}, ensure_ascii=False).encode(),
        "indicators.csv": "".join(x + "\r\n" for x in csv).encode(),
    })
    return int(failed or limited or bool(c.get("limited")))
