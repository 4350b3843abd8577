"""Indicator indexes, rankings and comparison, over observations of findings.

The single-input index removes identical places and skips what exceeds a budget, later smaller
entries may still fit; the batch index keeps repeats and freezes after the first refusal. Both
orders are total, so results do not depend on partitioning.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["category", "value", "validation_status"]
PLACE = ["source_offset", "source_end_offset", "source_encoding", "extraction", "decode_depth", "decode_encoding", "decoded_offset", "decoded_end_offset"]


@dataclass(frozen=True)
class Limits:
    """Budgets of the batch index (fixed defaults)."""

    keys: int = 10_000
    key_bytes: int = 16 << 20
    locations_per_key: int = 64
    location_bytes: int = 16 << 20
    reasons_per_key: int = 16
    reason_bytes: int = 1 << 20
    summary_keys: int = 20
    sources_per_key: int = 8
    reason_keys: int = 128
    reason_key_bytes: int = 64 << 10


def accepted(obs: DataFrame, validation: str = "all") -> DataFrame:
    """``all``; ``actionable``: candidate or validated; or one status."""
    if validation == "all":
        return obs
    if validation == "actionable":
        return obs.where(F.col("validation_status") != "invalid")
    if validation in ("candidate", "validated", "invalid"):
        return obs.where(F.col("validation_status") == validation)
    raise ValueError(f"unknown validation filter {validation}")


def single_index(obs: DataFrame, validation: str = "all", max_keys: int = 10_000, max_bytes: int = 16 << 20, max_locations: int = 64) -> DataFrame:
    """The index of each input: occurrences, first places without repeats, places left out.

    The key budget and the byte budget are a fold in order of observation within one input, so
    each input is folded by itself; its rows are one finding stream, bounded by the scan's caps."""
    import pandas as pd

    order = ["seq", "layer", "n"]
    cols = ["input_id", *order, *KEY, "validation_reason", *PLACE, "evidence"]
    shape = "input_id {0}, category string, value string, validation_status string, validation_reason string, observed_occurrences long, locations_json string, locations long, locations_omitted long, skipped_occurrences long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, key=None, kind="stable")
        entries: dict = {}
        used = skipped = 0
        for r in pdf.to_dict("records"):
            key = tuple(r[k] for k in KEY)
            size = len(key[0].encode()) + len(key[1].encode())
            if key not in entries:
                if len(entries) >= max_keys or size > max_bytes - used:
                    skipped += 1
                    continue
                used += size
                entries[key] = {"reason": r["validation_reason"], "n": 0, "at": {}, "omitted": 0}
            e = entries[key]
            e["n"] += 1
            proof = r["evidence"] if isinstance(r["evidence"], dict) else r["evidence"].asDict()
            place = {k: (None if r[k] is None or r[k] != r[k] else int(r[k]) if isinstance(r[k], float) else r[k]) for k in PLACE} | {"evidence": proof}
            text = json.dumps(place, ensure_ascii=False, default=int)
            if text in e["at"]:
                continue
            context = len(proof["before"].encode()) + len(proof["after"].encode())
            if len(e["at"]) == max_locations or context > max_bytes - used:
                e["omitted"] += 1
            else:
                used += context
                e["at"][text] = None
        rows = [(pdf["input_id"].iloc[0], *k, e["reason"], e["n"], "[" + ",".join(e["at"]) + "]", len(e["at"]), e["omitted"], skipped) for k, e in sorted(entries.items(), key=lambda x: tuple(s.encode() for s in x[0]))]
        return pd.DataFrame(rows, columns=["input_id", *KEY, "validation_reason", "observed_occurrences", "locations_json", "locations", "locations_omitted", "skipped_occurrences"])

    kind = dict(obs.dtypes)["input_id"]
    return accepted(obs, validation).select(*cols).groupBy("input_id").applyInPandas(fold, shape.format(kind))


def counted(obs: DataFrame, entry: str = "input_id") -> DataFrame:
    """Occurrences and distinct entries of each key. Counts merge before the shuffle; a hot key is no hot task."""
    per = obs.groupBy(*KEY, entry).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*KEY).agg(F.sum("n").alias("observed_occurrences"), F.count(F.lit(1)).alias("distinct_file_entries"))


def admitted_keys(obs: DataFrame, limits: Limits, order: list[str]) -> DataFrame:
    """Keys in order of first observation up to the first that exceeds a budget; then none (freeze).

    Only keys are ordered, one row each; beyond ``limits.keys`` rows nothing can be admitted, so
    the running sum is taken over the first of them."""
    first = obs.groupBy(*KEY).agg(F.min(F.struct(*order)).alias("first"))
    head = first.orderBy("first").limit(limits.keys)
    size = F.octet_length("category") + F.octet_length("value")
    run = F.sum(size).over(W.orderBy("first").rowsBetween(W.unboundedPreceding, 0))
    return head.withColumn("bytes", run).where(F.col("bytes") <= limits.key_bytes).select(*KEY)


def batch_index(obs: DataFrame, limits: Limits | None = None, order: list[str] | None = None, entry: str = "input_id", validation: str = "all") -> DataFrame:
    """The cross-input index: counts, distinct entries, reasons, first places in canonical order."""
    limits = limits or Limits()
    order = order or [entry, "seq", "layer", "n"]
    obs = accepted(obs, validation)
    keys = F.broadcast(admitted_keys(obs, limits, order))  # at most limits.keys rows
    kept = obs.join(keys, KEY)
    ranked = first_places(kept, limits.locations_per_key, order)
    places = ranked.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(*order, *PLACE))).alias("locations"))
    reasons = kept.groupBy(*KEY, "validation_reason").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    place = F.row_number().over(W.partitionBy(*KEY).orderBy("first"))
    reasons = reasons.withColumn("r", place).groupBy(*KEY).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("r") <= limits.reasons_per_key, F.struct("validation_reason", "n"))))).alias("validation_reasons"),
        F.coalesce(F.sum(F.when(F.col("r") > limits.reasons_per_key, F.col("n"))), F.lit(0)).alias("reason_observations_omitted"),
    )
    out = counted(kept, entry).join(places, KEY).join(reasons, KEY)
    return out.withColumn("location_observations_omitted", F.col("observed_occurrences") - F.size("locations"))


def first_places(obs: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first observations of each key: within hashed slices first, then over what is left, so no hot key is sorted in one task."""
    slice_ = F.pmod(F.xxhash64(*order), F.lit(64))
    part = obs.withColumn("s", slice_).withColumn("r", F.row_number().over(W.partitionBy(*KEY, "s").orderBy(*order))).where(F.col("r") <= most)
    return part.withColumn("r", F.row_number().over(W.partitionBy(*KEY).orderBy(*order))).where(F.col("r") <= most).drop("s", "r")


def ranking(index: DataFrame, most: int = 20) -> DataFrame:
    """Rank by distinct entries, then category, value, status in byte order; ``most`` rows."""
    top = index.orderBy(F.desc("distinct_file_entries"), *KEY).limit(most)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("distinct_file_entries"), *KEY)))


def ranked_sources(index: DataFrame, most: int = 20, sources: int = 8, entry: str = "input_id") -> DataFrame:
    """The ranking with the first place of each new entry among the kept places, at most ``sources``."""
    top = ranking(index, most)
    changed = F.filter("locations", lambda x, i: (i == 0) | (F.get("locations", i - 1)[entry] != x[entry]))
    return top.withColumn("source_samples", F.slice(changed, 1, sources)).withColumn("source_entries_not_shown", F.col("distinct_file_entries") - F.size("source_samples"))


# ---- comparison ------------------------------------------------------------------------------

MAX_ENTRIES, MAX_POSITIONS, MAX_CHANGES = 10_000, 8, 1000


def comparison_entries(found: DataFrame) -> DataFrame:
    """(side columns kept) kind, text, offset, seq order of the strings and indicators of findings."""
    named = lambda status: F.initcap(status)
    strings = found.select("input_id", "seq", F.lit("string").alias("list"), F.concat_ws(":", "encoding", "extraction").alias("kind"), F.col("value").alias("text"), "offset", F.lit(-1).alias("layer"), F.lit(-1).alias("n"))
    layers = found.select("input_id", "seq", F.posexplode("decoded_layers").alias("layer", "l"))
    deep = layers.select("input_id", "seq", F.lit("string").alias("list"), F.concat(F.lit("decoded-"), F.col("l.depth").cast("string")).alias("kind"), F.col("l.text").alias("text"), F.col("l.source_offset").alias("offset"), "layer", F.lit(-1).alias("n"))
    raw = found.select("input_id", "seq", F.posexplode("match_details").alias("n", "d")).select("input_id", "seq", F.lit("indicator").alias("list"), F.concat_ws(":", "d.pattern", named(F.col("d.validation.status"))).alias("kind"), F.col("d.text").alias("text"), F.col("d.offset").alias("offset"), F.lit(-1).alias("layer"), "n")
    inner = layers.select("input_id", "seq", "layer", "l", F.posexplode("l.match_details").alias("n", "d"))
    inner = inner.select("input_id", "seq", F.lit("indicator").alias("list"), F.concat(F.lit("decoded-"), F.col("l.depth").cast("string"), F.lit(":"), F.col("d.pattern"), F.lit(":"), named(F.col("d.validation.status"))).alias("kind"), F.col("d.text").alias("text"), F.col("l.source_offset").alias("offset"), "layer", "n")
    return strings.unionByName(deep).unionByName(raw).unionByName(inner)


def framed_key(kind: F.Column, text: F.Column) -> F.Column:
    """SHA-256 of the kind's length (64-bit little-endian), the kind and the text."""
    size = F.octet_length(kind).cast("long")
    byte = lambda i: F.lpad(F.hex(F.shiftright(size, 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0")
    little = F.unhex(F.concat(*[byte(i) for i in range(8)]))
    return F.sha2(F.concat(little, kind.cast("binary"), text.cast("binary")), 256)


def comparison_index(entries: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Per list and key: kind, preview, count, first offsets. ``entries`` is read twice: write it first if it is dear."""
    order = order or ["seq", "layer", "n"]
    keyed = entries.withColumn("key", framed_key(F.col("kind"), F.col("text")))
    counts = keyed.groupBy("list", "key").agg(
        F.first("kind").alias("kind"), F.substring(F.first("text"), 1, 256).alias("preview"), (F.char_length(F.first("text")) > 256).alias("preview_truncated"),
        F.count(F.lit(1)).alias("count"), (F.count(F.lit(1)) > MAX_POSITIONS).alias("offsets_truncated"), F.min(F.struct(*order)).alias("first"),
    )
    # the first places within hashed slices of a key, then over what is left: no list grows with the input
    slim = keyed.select("list", "key", *order, "offset").withColumn("s", F.pmod(F.xxhash64(*order), F.lit(64)))
    part = slim.withColumn("r", F.row_number().over(W.partitionBy("list", "key", "s").orderBy(*order))).where(F.col("r") <= MAX_POSITIONS)
    part = part.withColumn("r", F.row_number().over(W.partitionBy("list", "key").orderBy(*order))).where(F.col("r") <= MAX_POSITIONS)
    places = part.groupBy("list", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "offset"))), lambda x: x["offset"]).alias("offsets"))
    return counts.join(places, ["list", "key"])


def bounded(index: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """The first ``most`` keys of each list in order of arrival, for the comparison of single files; ``incomplete``: keys were left out."""
    parts = [index.where(F.col("list") == x).orderBy("first").limit(most) for x in ("string", "indicator")]
    sizes = index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n") > most, F.lit(False)).alias("incomplete"))
    return parts[0].unionByName(parts[1]).drop("first").crossJoin(F.broadcast(sizes))


def incomplete_index(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether keys of either side were left out, so that a change may be none."""
    cut = [x.select("incomplete") if "incomplete" in x.columns else x.select(F.lit(False).alias("incomplete")).limit(0) for x in (before, after)]
    return cut[0].unionByName(cut[1]).agg(F.coalesce(F.bool_or("incomplete"), F.lit(False)).alias("incomplete_index"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(list, key, change, before, after, incomplete_index): added, removed or changed, by a full outer join on the key."""
    entry = ["kind", "preview", "preview_truncated", "count", "offsets", "offsets_truncated"]
    b = before.select("list", "key", F.struct(*entry).alias("before"))
    a = after.select("list", "key", F.struct(*entry).alias("after"))
    joined = b.join(a, ["list", "key"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return joined.withColumn("change", change).where(F.col("change").isNotNull()).crossJoin(F.broadcast(incomplete_index(before, after)))


def entropy_changes(before: DataFrame, after: DataFrame, tolerance: float = 1e-9, pair: tuple[str, ...] = ()) -> DataFrame:
    """Windows (offset, length, entropy) that differ between two inputs, or within each of many pairs named by columns."""
    keys = [*pair, "offset"]
    b = before.select(*keys, F.struct("length", "entropy").alias("before"))
    a = after.select(*keys, F.struct("length", "entropy").alias("after"))
    j = b.join(a, keys, "full_outer")
    same = (F.col("before.length") == F.col("after.length")) & (F.abs(F.col("before.entropy") - F.col("after.entropy")) <= tolerance)
    return j.where(~F.coalesce(same, F.lit(False)))
