"""Substring dedup of 20-word windows behind a count-min prefilter.

A window's anchor is the smallest hash among its 16 five-word grams. Equal windows have equal
anchors at different places, so a window occurs at most as often as its anchor's places: counting
anchors overestimates the counts of windows with an eighth of the entries in the sketch.

1. Each partition sketches the anchors of its documents: (row, cell) counts of a count-min
   sketch, kept sparse. The partial sketches are merged by adding cells, distributed by cell;
   cells counted twice or more become a bitmap of bounded size (``MAX_BITS``), which is shared.
2. A second pass emits only windows whose anchor is estimated repeated in every row of the
   sketch; each block of words sends the first place of a window and settles the others itself,
   so a window that stands in a third of all documents sends one row a block. Exact groups of the
   95-bit window hashes then tell the earliest place; all later ones are removals.
   The sketch only overestimates, so no repeated window is lost; beyond ``MAX_BITS`` it lets
   more windows through, never fewer.
3. Removals meet their document by id, and words under them are dropped.

Order of places: doc_id, then place. Defined cases: null text has no words; a null id counts as
smaller than all; rows that repeat id and text are one document and come out alike; rows that
repeat an id with other texts are ordered by text hash; texts under 20 words stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, prepare, read, scratch
from .near_dedup import mix64
from .near_dedup import word_hashes as hashes

WINDOW, GRAM = 20, 5
DEPTH = 2
MIN_BITS, MAX_BITS = 20, 29
#: Words of a block whose windows are settled together.
BLOCK_WORDS = 1_000_000
#: Marks rows of settled windows; no second hash has this value.
SETTLED = 2**31 - 1
_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)
_BASE1, _BASE2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def rolling(w: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hashes of all runs of n words, each from its own words only."""
    if len(w) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(w) - n + 1, np.uint64)
    if n <= 5:
        for j in range(n):
            out = out * base + w[j : len(w) - n + 1 + j]
        return mix64(out)
    half = n // 2
    part = np.zeros(len(w) - half + 1, np.uint64)
    for j in range(half):
        part = part * base + w[j : len(w) - half + 1 + j]
    part = mix64(part)
    out = part[: len(out)] * base + part[half : half + len(out)] if n % 2 == 0 else None
    return mix64(out)


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over runs of n (a power of two)."""
    step = 1
    while step < n:
        x = f(x[:-step], x[step:])
        step *= 2
    return x


def anchors(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each window, hashes at the places that are an anchor of some window)."""
    if len(w) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    g = rolling(w, GRAM, _A | np.uint64(1))
    runs = WINDOW - GRAM + 1
    low = _slide(g, runs, np.minimum)
    # a place is an anchor if some window over it has no smaller hash: the largest minimum over it is its own
    padded = np.concatenate([np.zeros(runs - 1, np.uint64), low, np.zeros(runs - 1, np.uint64)])
    high = _slide(padded, runs, np.maximum)
    return low, g[high == g]


def cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell numbers of a sketch row, in one numbering over all rows."""
    h = mix64(anchor ^ np.uint64((row + 1) * int(_C) & 0xFFFFFFFFFFFFFFFF))
    return (h >> np.uint64(64 - bits)).astype(np.int64) + (row << bits)


def _sketch(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.minimum(n, 2).astype(np.int8))], names=["cell", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                at = anchors(hashes((text or "").encode().split()))[1]
                if len(at):
                    held += [cells(at, r, bits) for r in range(DEPTH)]
                    size += DEPTH * len(at)
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _emit(bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value

        def settle(block: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
            h1s, h2s, docs, starts = [], [], [], []
            ids = sorted(block)
            for i, key in enumerate(ids):
                w = block[key]
                low, _ = anchors(w)
                often = np.ones(len(low), bool)
                for r in range(DEPTH):
                    c = cells(low, r, bits)
                    often &= (bitmap[c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
                at = np.flatnonzero(often)
                if len(at):
                    h1s.append(rolling(w, WINDOW, _BASE1)[at])
                    h2s.append(rolling(w, WINDOW, _BASE2)[at] % np.uint64(SETTLED))
                    docs.append(np.full(len(at), i))
                    starts.append(at)
            if not h1s:
                return
            h1, h2, doc, start = map(np.concatenate, (h1s, h2s, docs, starts))
            order = np.lexsort((h2, h1))  # stable: places stay in order within equal windows
            same = np.zeros(len(order), bool)
            same[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            later = np.zeros(len(order), bool)
            later[order] = same
            own = np.array(ids, np.int64)
            send = ~later
            d = own[doc[send]]
            rest = (h2[send].astype(np.int64) << 32) | start[send].astype(np.int64)
            # rows settled here go along to their document, marked by a second hash that no window has
            who = own[doc[later]]
            h = np.concatenate([h1[send].astype(np.int64), mix64(who[:, 0].astype(np.uint64) ^ who[:, 1].astype(np.uint64)).astype(np.int64)])
            d = np.concatenate([d, who])
            rest = np.concatenate([rest, (SETTLED << 32) | start[later].astype(np.int64)])
            for i in range(0, len(h), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[i : i + 65536, 0], d[i : i + 65536, 1], rest[i : i + 65536], h[i : i + 65536])], names=["d", "t", "rest", "h"])

        block: dict[tuple[int, int], np.ndarray] = {}
        size = 0
        for batch in batches:
            for d, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (d, t) in block:
                    continue
                w = hashes((text or "").encode().split())
                if len(w) >= WINDOW:
                    block[d, t] = w
                    size += len(w)
                if size > BLOCK_WORDS:
                    yield from settle(block)
                    block, size = {}, 0
        if block:
            yield from settle(block)

    return run


def covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n words lie in a window at one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + WINDOW, n), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_starts(docs: DataFrame, folder: str, text_col: str = "text") -> DataFrame:
    """(d, t, starts): starts of windows of each document whose words also start earlier. docs: d, t, text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, int(np.ceil(np.log2(max(1, size // 12))))))
    sums = docs.select(text_col).mapInArrow(_sketch(bits), "cell long, n byte").groupBy("cell").agg(F.sum("n").alias("n")).where("n >= 2")
    # the builtin numbers bits from 1 within buckets of 32768
    maps = sums.groupBy(F.bitmap_bucket_number(F.col("cell") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 1)).alias("bits"))
    whole = np.zeros(DEPTH << (bits - 3), np.uint8)
    for r in maps.collect():
        at = (r["bucket"] - 1) * 4096
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        whole[at : at + 4096] = part[: len(whole) - at]
    shared = spark.sparkContext.broadcast(whole)
    sent = docs.mapInArrow(_emit(bits, shared), "d long, t long, rest long, h long")
    # dealt by h before the second hash is taken out of ``rest``: in this order of columns rows compress best
    sent = sent.repartition("h").withColumn("h2", F.shiftright("rest", 32))
    place = F.rank().over(W.partitionBy("h", "h2").orderBy("d", "t", "rest"))
    gone = sent.withColumn("k", place).where((F.col("k") > 1) | (F.col("h2") == SETTLED))
    return gone.groupBy("d", "t").agg(F.collect_list(F.col("rest").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")).alias("starts"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and, if kept, the words that stay as ``text_col``; columns so named are replaced."""
    spark = docs.sparkSession
    prepare(spark)
    folder = scratch(spark, "substrings")
    keyed = docs.withColumns({"__d": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "__t": F.xxhash64(F.col(text_col))})
    gone = repeated_starts(keyed.select(F.col("__d").alias("d"), F.col("__t").alias("t"), F.col(text_col).alias("text")), folder)
    joined = keyed.join(gone.withColumnsRenamed({"d": "__d", "t": "__t", "starts": "__starts"}), ["__d", "__t"], "left").drop("__d", "__t")
    new = ["n_words", "n_removed", "kept_sha256"]
    carried = [f for f in docs.schema if f.name not in [*new, text_col]]
    names = [f.name for f in carried]
    schema = T.StructType([*carried, *([T.StructField(text_col, T.StringType())] if keep_text else []), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, gone_n, sha = [], [], [], []
            for text, a in zip(batch.column(text_col).to_pylist(), batch.column("__starts")):
                words = (text or "").encode().split()
                n.append(len(words))
                if a.is_valid:
                    at = a.values.to_numpy(zero_copy_only=False).astype(np.int64)
                    kept = [w for w, c in zip(words, covered(len(words), at).tolist()) if not c]
                else:
                    kept = words
                gone_n.append(len(words) - len(kept))
                body = b" ".join(kept)
                sha.append(hashlib.sha256(body).hexdigest())
                texts.append(body.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], *([pa.array(texts, pa.string())] if keep_text else []), pa.array(n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(sha, pa.string())], names=[f.name for f in schema])

    return joined.mapInArrow(run, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 19)) AS s, ws FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS k FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM k),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS i FROM r WHERE n > 1),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
t AS (SELECT x.doc_id, count(g.i) AS gone, string_agg(x.word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept
      FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t ON w.doc_id = t.doc_id
"""


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (n_words, n_removed, kept_sha256); for tests."""
    first: dict[tuple, tuple[int, int]] = {}
    words = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(words):
        for s in range(len(words[d]) - WINDOW + 1):
            first.setdefault(tuple(words[d][s : s + WINDOW]), (d, s))
    out = {}
    for d, w in words.items():
        gone = {s + j for s in range(len(w) - WINDOW + 1) if first[tuple(w[s : s + WINDOW])] != (d, s) for j in range(WINDOW)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
