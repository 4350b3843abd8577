"""MinHash near-dedup with DartMinHash signatures.

Documents are bags of five-word shingles (lower-cased words; fewer than five words make one
shingle), their similarity is the weighted Jaccard index, and documents at ``SIMILARITY`` or more
are linked. DartMinHash (Christiani, 2020): every unit of a shingle's weight is a region into
which darts are thrown by a hashed Poisson process along the rank axis; the darts that a document
holds up to a rank of about (k ln k + 2k) / weight are dealt over k coordinates and each
coordinate keeps its earliest dart. Two documents share a coordinate with the probability of
their similarity. Bands of coordinates then join.

1. Equal shingle bags are collapsed to one representative (smallest id).
2. Representatives that share a band form a bucket. Each is compared exactly with the bucket
   centre (smallest id) it shares most bands with; the links found are united into classes.
3. In buckets that still hold more than one class, members of different classes are compared
   exactly, in tiles of at most ``TILE`` members; only links that unite classes are emitted.
4. Classes are the connected components. Up to ``ONE_TASK`` links (16 bytes each) are united by one task,
   which takes the driver fewer jobs and threads; more are united by min-label propagation with pointer jumping.

No group is gathered beyond a tile, no list of pairs within a class is emitted, and no link
between different texts of a bucket is lost; a pair at 0.8 shares none of the 24 bands of 6
coordinates with probability 0.0007.

Defined cases: texts without words are alone in their class; rows that repeat id and text are one
document; a null id, and an id that rows repeat with *different* texts, is replaced by a negative
number made from id and text, so each such text is a document of its own (shown with its real id);
a class is named by its smallest real id (null if it has none); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read, save, scratch

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
TILE, TILE_UNITS = 1024, 4_000_000
#: Most links that one task unites; more are shuffled.
ONE_TASK = 2_000_000
#: Documents sketched together, and about how many of their shingles.
GROUP_DOCS, GROUP_SHINGLES = 128, 50_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NULL_BASE = -(2**62)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 8 hash bytes; a bounded cache."""

    def __missing__(self, word: bytes) -> bytes:
        h = hashlib.blake2b(word, digest_size=8).digest()
        if len(self) < 300_000 and len(word) < 64:
            self[word] = h
        return h


_STATE: dict = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    import triagelake.llm.near_dedup as home  # the worker's own module: its cache outlives a task

    cache = home._STATE.setdefault("words", WordHashes())
    return np.frombuffer(b"".join(map(cache.__getitem__, words)), "<u8").astype(np.uint64)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (ascending) and how often each occurs."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    w = word_hashes(words)
    n = min(SHINGLE, len(w))
    h = np.full(len(w) - n + 1, np.uint64(n))
    for j in range(n):
        h = mix64(h * _A + w[j : len(w) - n + 1 + j])
    return np.unique(h, return_counts=True)


def bag_key(elements: np.ndarray, counts: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes() + counts.astype("<i8").tobytes(), digest_size=16).digest()


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def dart_minhash(bags: list[tuple[np.ndarray, np.ndarray]], k: int = BANDS * ROWS) -> np.ndarray:
    """k dart ids for each bag (elements, positive weights); a fraction of a unit region keeps the darts inside it."""
    out, todo, factor = np.zeros((len(bags), k), np.uint64), np.arange(len(bags)), 1.0
    while len(todo):
        some = [bags[i] for i in todo]
        elements, weights = np.concatenate([e for e, _ in some]), np.concatenate([w for _, w in some]).astype(np.float64)
        bag = np.repeat(np.arange(len(some)), [len(e) for e, _ in some])
        limits = factor * (k * np.log(k) + 2 * k) / np.bincount(bag, weights, len(some))
        whole = np.ceil(weights).astype(np.int64)
        index = np.repeat(np.arange(len(elements)), whole)
        unit = np.arange(len(index)) - np.repeat(np.cumsum(whole) - whole, whole)
        share = np.minimum(1.0, weights[index] - unit)
        region = mix64(elements[index] + (unit.astype(np.uint64) + np.uint64(1)) * _A)
        bag = bag[index]
        limit, rank, n = limits[bag], np.zeros(len(region)), 0
        ids, ranks, slots = [], [], []
        while len(region):
            n += 1
            dart = mix64(region ^ np.uint64(n * int(_C) & 0xFFFFFFFFFFFFFFFF))
            # the gap to the next dart of a region is exponential: darts are a Poisson process in rank
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            inside = rank <= limit
            region, rank, limit, share, bag, dart = (x[inside] for x in (region, rank, limit, share, bag, dart))
            hit = slice(None)
            if (share < 1).any():
                hit = (mix64(dart ^ _B) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share
            ids.append(dart[hit])
            ranks.append(rank[hit])
            slots.append(bag[hit] * k + (mix64(ids[-1] + _A) % np.uint64(k)).astype(np.int64))
        flat, order, slot = np.concatenate(ids), np.concatenate(ranks), np.concatenate(slots)
        best = np.full(len(some) * k, np.inf)
        np.minimum.at(best, slot, order)
        first = order == best[slot]
        got = np.zeros(len(some) * k, np.uint64)
        np.maximum.at(got, slot[first], flat[first])
        done = np.isfinite(best).reshape(-1, k).all(1)
        out[todo[done]] = got.reshape(-1, k)[done]
        # where a coordinate stayed empty, throw over twice the ranks: that adds the later darts
        todo, factor = todo[~done], factor * 2
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    rows = signatures.reshape(-1, BANDS, ROWS)
    h = np.repeat((np.arange(1, BANDS + 1, dtype=np.uint64) * _A)[None], len(rows), 0)
    for j in range(ROWS):
        h = mix64(h * _A + rows[:, :, j])
    return h.astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [shingles(text) for text in batch.column(1).to_pylist()]
        sizes = [int(c.sum()) for _, c in bags]
        keys = [bag_key(e, c) if len(e) else None for e, c in bags]
        found: list = [[] for _ in bags]
        real = [i for i, (e, _) in enumerate(bags) if len(e)]
        part, size = [], 0
        for n, i in enumerate(real):
            part.append(i)
            size += len(bags[i][0])
            if size > GROUP_SHINGLES or len(part) == GROUP_DOCS or n + 1 == len(real):
                for j, b in zip(part, bands(dart_minhash([bags[j] for j in part]))):
                    found[j] = b
                part, size = [], 0
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "real", "key", "n", "bands"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[str | None, tuple] = (None, ())
    for batch in batches:
        a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
        keep = []
        for x, y in zip(ta, tb):
            if last[0] != x:
                last = (x, shingles(x))
            keep.append(jaccard(last[1], shingles(y)) >= SIMILARITY)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(mask), pa.array(b, pa.int64()).filter(mask)], names=["a", "b"])


def tile_links(ids: list[int], labels: list[int], bags: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links of SIMILARITY or more that unite the classes of a tile's members, exactly."""
    n = len(ids)
    order = np.argsort([int(c.sum()) for _, c in bags], kind="stable")
    ids, labels, bags = [ids[i] for i in order], [labels[i] for i in order], [bags[i] for i in order]
    total = np.array([int(c.sum()) for _, c in bags], np.int64)
    parent = {label: label for label in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # unit (shingle, repeat) incidences: the common units of two bags are the sum of the minima
    units = [mix64(np.repeat(e, c) + (np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64) * _C) for e, c in bags]
    flat = np.concatenate(units)
    member = np.repeat(np.arange(n), total)
    _, inverse, seen = np.unique(flat, return_inverse=True, return_counts=True)
    often = seen[inverse] > 1
    column = np.cumsum(seen > 1) - 1
    member, column = member[often], column[inverse[often]]
    width = int(column.max()) + 1 if len(column) else 0
    common = np.zeros((n, n), np.float32)
    by = np.argsort(column, kind="stable")
    member, column = member[by], column[by]
    step = max(256, (8 << 20) // max(1, n))
    for start in range(0, width, step):
        i, j = np.searchsorted(column, [start, start + step])
        dense = np.zeros((n, min(step, width - start)), np.float32)
        dense[member[i:j], column[i:j] - start] = 1
        common += dense @ dense.T
    union = total[:, None] + total[None] - common
    x, y = np.nonzero(np.triu(common >= SIMILARITY * union - 1e-6, 1))
    out = []
    for i, j in zip(x.tolist(), y.tolist()):
        a, b = root(labels[i]), root(labels[j])
        if a != b and common[i, j] / union[i, j] >= SIMILARITY:
            parent[a] = b
            out.append((ids[i], ids[j]))
    return out


def _tiles(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("id").sort_values("id")
    links = tile_links(pdf["id"].tolist(), pdf["label"].tolist(), [shingles(t) for t in pdf["text"]]) if pdf["label"].nunique() > 1 else []
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (ascending) and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        x, y = root[i], root[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1))
    nodes, labels = united(a, b)
    for k in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(labels[k : k + (1 << 16)])], names=["id", "label"])


def components(edges: DataFrame, folder: str, one_task: int = ONE_TASK) -> DataFrame:
    """(id, label) of every node of edges (a, b), a written table; label is the smallest id of its component."""
    edges = edges.where(F.col("a") != F.col("b"))
    if edges.count() <= one_task:
        return save(edges.select("a", "b").coalesce(1).mapInArrow(_united, "id long, label long"), f"{folder}/labels")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = save(both, f"{folder}/edges")
    labels = save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), f"{folder}/labels-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        step = save(step, f"{folder}/step-{turn}")
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = step.join(jump, "label", "left").select("id", F.least("label", F.coalesce("far", "label")).alias("label"), "old")
        new = save(new, f"{folder}/labels-{turn}")
        labels = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, real, rep, class, name) for each row: id as ``node_ids`` makes it and the real one, rep the smallest id of the same
    bag, class that of the whole class, and the class's name."""
    spark = docs.sparkSession
    prepare(spark)
    folder = scratch(spark, "near")
    keyed = node_ids(docs, folder, id_col, text_col)
    texts = keyed.select(F.col("__id").alias("id"), F.col(text_col).alias("text"))
    sketches = save(keyed.select("__id", text_col, F.col("__real").alias("real")).mapInArrow(_sketch, "id long, real long, key binary, n long, bands array<long>"), f"{folder}/sketches")
    # only bags that occur more than once are joined, from a written table: a hot bag's partition can be split
    reps = sketches.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "rep")
    reps = save(reps, f"{folder}/reps")
    member = save(sketches.join(reps, "key", "left").select("id", "real", "n", F.coalesce("rep", "id").alias("rep"), "bands"), f"{folder}/members")
    rows = save(member.where("id = rep").select("id", F.col("n").alias("units"), F.explode("bands").alias("band")).distinct(), f"{folder}/bands")
    # written before they are joined, so that a hot bucket's partition can be split
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("total"), F.min("id").alias("centre")).where("n > 1")
    shared = save(shared, f"{folder}/shared")
    buckets = save(rows.join(shared, "band"), f"{folder}/buckets")
    wanted = save(texts_of(texts, buckets.select("id").distinct(), f"{folder}/wanted"), f"{folder}/texts")
    votes = buckets.where("id <> centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("v"))
    best = votes.groupBy("id").agg(F.max_by("centre", F.struct("v", -F.col("centre"))).alias("a")).select("a", F.col("id").alias("b"))
    best = save(best, f"{folder}/best")
    pairs = best.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(wanted.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    links = save(pairs.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long"), f"{folder}/links-1")
    found = components(links, f"{folder}/cc-1")

    labelled = buckets.select("band", "id", "total").join(found, "id", "left").select("band", "id", "total", F.coalesce("label", "id").alias("label"))
    mixed = labelled.groupBy("band").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.expr("bit_xor(xxhash64(id))").alias("s")
    ).where("x <> y")
    # one bucket for each set of members, and no bucket of two that were compared before
    mixed = mixed.groupBy("n", "a", "b", "s").agg(F.min("band").alias("band"))
    mixed = mixed.join(best.withColumn("n", F.lit(2).cast("long")), ["n", "a", "b"], "left_anti").select("band", "n")
    open_ = save(labelled.join(save(mixed, f"{folder}/mixed"), "band"), f"{folder}/open")
    # a tile holds two parts of a bucket, bounded in members and in shingles
    blocks = F.greatest(F.ceil(F.col("n") / (TILE // 2)), F.ceil(F.col("total") / (TILE_UNITS // 2))).cast("int")
    tiles = open_.withColumn("g", F.when((F.col("n") <= TILE) & (F.col("total") <= TILE_UNITS), 1).otherwise(F.least(blocks, F.col("n").cast("int")))).withColumn("me", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    tiles = tiles.select("band", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), "id", "label")
    more = tiles.join(wanted, "id").groupBy("band", "i", "j").applyInPandas(_tiles, "a long, b long")
    more = save(more.distinct(), f"{folder}/links-2")
    final = components(links.union(more), f"{folder}/cc-2")
    out = member.select("id", "real", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left").select("id", "real", "rep", F.coalesce("label", "rep").alias("class"))
    # a class that a made-up id names is renamed by its smallest real one; only such classes are gathered, counts merged first
    out = save(out, f"{folder}/classes")
    named = out.where(F.col("class") <= _NULL_BASE).groupBy("class").agg(F.min("real").alias("name"))
    return out.join(save(named, f"{folder}/names"), "class", "left").select("id", "real", "rep", "class", F.when(F.col("class") <= _NULL_BASE, F.col("name")).otherwise(F.col("class")).alias("name"))


def node_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __real, the id, and __id, which differs between different texts: the id itself unless it is null or rows
    repeat it with other texts."""
    keyed = docs.withColumns({"__real": F.col(id_col).cast("long"), "__hash": F.xxhash64(F.col(text_col))})
    twice = keyed.where(F.col("__real").isNotNull()).groupBy("__real").agg(F.min("__hash").alias("a"), F.max("__hash").alias("b")).where("a <> b")
    twice = save(twice.select("__real", F.lit(True).alias("__twice")), f"{folder}/twice")
    made = F.lit(_NULL_BASE) - F.shiftrightunsigned(F.xxhash64("__real", "__hash"), 3)
    return keyed.join(twice, "__real", "left").withColumn("__id", F.when(F.col("__real").isNull() | F.col("__twice").isNotNull(), made).otherwise(F.col("__real"))).drop("__hash", "__twice")


def texts_of(texts: DataFrame, ids: DataFrame, path: str) -> DataFrame:
    """One text of each of the ids. A bitmap of hashed ids of bounded size is shared first, so that
    texts that are surely not wanted are not shuffled; the exact join follows."""
    spark = texts.sparkSession
    ids = save(ids, path)
    bits = min(30, max(20, int(np.ceil(np.log2(16 * max(1, ids.count()))))))
    at = F.pmod(F.xxhash64("id"), F.lit(1 << bits)) + 1
    maps = ids.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in maps.collect():
        whole[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("at").to_numpy()
            hit = (shared.value[c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
            yield batch.select(["id", "text"]).filter(pa.array(hit))

    near = texts.withColumn("at", at - 1).mapInArrow(run, "id long, text string")
    return near.join(ids, "id", "left_semi").dropDuplicates(["id"])


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), representative (the document is that one)."""
    found = classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("real").alias("doc_id"), F.col("name").alias("class_id"), (F.col("id") == F.col("class")).alias("representative"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: one document of each class stays (the one with the smallest id, once)."""
    found = classes(docs.select("doc_id", "text")).where(F.col("id") == F.col("class")).select(F.col("id").alias("__id")).distinct()
    own = node_ids(docs, scratch(docs.sparkSession, "near"))
    return own.join(found, "__id", "left_semi").dropDuplicates(["__id"]).select(*docs.columns)
