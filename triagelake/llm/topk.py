"""Exact top-k by inner product: best-first search in M-trees.

Vectors become integers floor(1024 * x). Adding the coordinate sqrt(M^2 - |x|^2) to every stored
vector (0 to the query) turns the largest inner product into the smallest Euclidean distance:
d^2 = |q|^2 + M^2 - 2 <q, x>. Vectors are dealt over trees of a bounded number of rows; each
tree is bulk-loaded into pages whose routing entries hold covering radii and distances to the
parent. A search takes pages in the order of their lower bound and skips an entry without a
distance computation when |d(q, parent) - d(entry, parent)| - radius shows it cannot win.
Bounds use floats with slack; the scores compared are exact integers.

The query set is searched against all trees in blocks (block of queries x tree), and the best k
of each block are merged, so a task holds one tree and one block of queries.

Defined cases: vectors that are null or hold a null or non-finite component, and rows with a null
id take no part; vectors of another length than the query's are no candidates (empty ones score 0
with one another); rows
that bear the query's id are its own; ties go to the smaller id. Repeated rows stay separate.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, read, save, scratch

TREE_ROWS = 8192
QUERY_ROWS = 1024
PAGE, FAN = 64, 16


def augmented(x: np.ndarray) -> tuple[np.ndarray, float]:
    norm = (x.astype(np.float64) ** 2).sum(1)
    m2 = float(norm.max()) if len(x) else 0.0
    return np.hstack([x.astype(np.float64), np.sqrt(np.maximum(m2 - norm, 0.0))[:, None]]), m2


def build(ids: np.ndarray, x: np.ndarray) -> tuple[list[dict], float]:
    """Pages of an M-tree over the rows of x; page 0 is the root."""
    z, m2 = augmented(x)
    pages: list[dict] = []

    def make(rows: np.ndarray, pivot: np.ndarray) -> int:
        at = len(pages)
        page: dict = {}
        pages.append(page)
        dist = np.sqrt(((z[rows] - pivot) ** 2).sum(1))
        if len(rows) <= PAGE:
            order = np.lexsort((ids[rows], dist))
            page |= {"leaf": True, "ids": ids[rows][order], "x": x[rows][order], "to_parent": dist[order]}
            return at
        chosen, near = [int(np.argmax(dist))], None
        for _ in range(FAN - 1):
            d = ((z[rows] - z[rows[chosen[-1]]]) ** 2).sum(1)
            near = d if near is None else np.minimum(near, d)
            if near.max() <= 0:
                break
            chosen.append(int(np.argmax(near)))
        pivots = z[rows[chosen]]
        if len(chosen) == 1:  # all equal: pages of any even share
            groups = [g for g in np.array_split(rows[np.argsort(ids[rows], kind="stable")], FAN) if len(g)]
            pivots = np.repeat(pivots, len(groups), 0)
        else:
            d2 = ((z[rows] ** 2).sum(1)[:, None] - 2 * z[rows] @ pivots.T) + (pivots**2).sum(1)
            which = d2.argmin(1)
            groups = [rows[which == i] for i in range(len(chosen))]
            pivots, groups = pivots[[i for i, g in enumerate(groups) if len(g)]], [g for g in groups if len(g)]
            if len(groups) == 1:
                groups = [g for g in np.array_split(rows, FAN) if len(g)]
                pivots = np.repeat(pivots[:1], len(groups), 0)
        radius = np.array([math.sqrt(((z[g] - p) ** 2).sum(1).max()) for g, p in zip(groups, pivots)])
        page |= {"leaf": False, "pivots": pivots, "radius": radius, "to_parent": np.sqrt(((pivots - pivot) ** 2).sum(1)), "least_id": np.array([ids[g].min() for g in groups])}
        page["child"] = np.array([make(g, p) for g, p in zip(groups, pivots)])
        return at

    make(np.arange(len(ids)), z.mean(0) if len(ids) else np.zeros(z.shape[1]))
    pages[0]["root"] = z.mean(0)
    return pages, m2


def search(pages: list[dict], m2: float, q: np.ndarray, q_id: int | None, k: int, counts: list[int] | None = None) -> list[tuple[int, int]]:
    """The k best (score, id) of a tree: largest score, then smallest id."""
    qa = np.append(q.astype(np.float64), 0.0)
    base = float((q.astype(np.float64) ** 2).sum()) + m2
    qi = q.astype(np.int64)
    best: list[tuple[int, int]] = []  # heap of (score, -id): the worst on top

    def most(low: np.ndarray) -> np.ndarray:
        """The largest integer score that a distance of low or more allows; slack for rounding."""
        low = np.maximum(low, 0.0)
        return np.floor((base - low * low) / 2 + 1e-6 * (1 + base) ** 0.5 + 1e-9 * base + 1e-6)

    def beaten(bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        if len(best) < k:
            return np.zeros(len(bound), bool)
        score, minus = best[0]
        return (bound < score) | ((bound == score) & (least > -minus))

    heap: list[tuple[float, int, int, float]] = [(-math.inf, -(2**63), 0, float(np.sqrt(((qa - pages[0]["root"]) ** 2).sum())))]
    while heap:
        bound, least, at, dq = heapq.heappop(heap)
        if len(best) == k and (-bound < best[0][0] or (-bound == best[0][0] and least > -best[0][1])):
            if -bound < best[0][0]:
                break
            continue
        page = pages[at]
        if page["leaf"]:
            ok = ~beaten(most(np.abs(dq - page["to_parent"])), page["ids"])
            if q_id is not None:
                ok &= page["ids"] != q_id
            if counts is not None:
                counts[0] += int(ok.sum())
            scores = page["x"][ok].astype(np.int64) @ qi
            for s, i in zip(scores.tolist(), page["ids"][ok].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            continue
        ok = ~beaten(most(np.abs(dq - page["to_parent"]) - page["radius"]), page["least_id"])
        if not ok.any():
            continue
        d = np.sqrt(((page["pivots"][ok] - qa) ** 2).sum(1))
        bounds = most(d - page["radius"][ok])
        keep = ~beaten(bounds, page["least_id"][ok])
        for b, l, c, x in zip(bounds[keep].tolist(), page["least_id"][ok][keep].tolist(), page["child"][ok][keep].tolist(), d[keep].tolist()):
            heapq.heappush(heap, (-b, l, c, x))
    return sorted(((s, -i) for s, i in best), key=lambda p: (-p[0], p[1]))


def _pages_out(pdf: pd.DataFrame) -> pd.DataFrame:
    import pickle

    pdf = pdf.sort_values("id", kind="stable")
    pages, m2 = build(pdf["id"].to_numpy(np.int64), np.stack([np.asarray(x, np.int64) for x in pdf["x"]]))
    return pd.DataFrame({"tree": pdf["tree"].iloc[0], "dim": pdf["dim"].iloc[0], "page": range(len(pages)), "m2": m2, "body": [pickle.dumps(p, protocol=5) for p in pages]})


def _searcher(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import pickle

        rows: list[tuple[int, int, int, int]] = []
        if len(left) and len(right):
            left = left.sort_values("page")
            pages, m2 = [pickle.loads(b) for b in left["body"]], float(left["m2"].iloc[0])
            for i, (q_id, x) in enumerate(zip(right["id"].tolist(), right["x"])):
                rows += [(int(right["row"].iloc[i]), q_id, vec, score) for score, vec in search(pages, m2, np.asarray(x, np.int64), q_id, k)]
        return pd.DataFrame(rows, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    return run


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, x (array<long>), dim of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * 1024).cast("long"))
    odd = F.exists(F.col(vector_col), lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.size(vector_col).alias("dim"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, tree_rows: int = TREE_ROWS) -> DataFrame:
    """The k best candidates of each query. Both have id, x, dim (see ``integers``)."""
    spark = candidates.sparkSession
    prepare(spark)
    folder = scratch(spark, "topk")
    n = max(1, candidates.count())
    trees, blocks = -(-n // tree_rows), -(-max(1, queries.count()) // QUERY_ROWS)
    dealt = candidates.withColumn("tree", F.pmod(F.xxhash64("id", "x"), F.lit(trees)).cast("int"))
    pages = dealt.groupBy("tree", "dim").applyInPandas(_pages_out, "tree int, dim int, page int, m2 double, body binary")
    pages = save(pages, f"{folder}/pages")
    asked = save(queries.withColumn("row", F.monotonically_increasing_id()), f"{folder}/queries")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    left = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    key = ["dim", "tree", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_searcher(k), "row long, query_id long, vec_id long, score long")
    order = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(rows.where(F.col("id") % 100 == 0), rows)


OP3_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(CASE WHEN len(q.x) = 0 THEN 0 ELSE list_inner_product(q.x, c.x) END AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def brute_force(rows: Iterator[tuple[int, list[int]]], k: int = 10, every: int = 100) -> list[tuple[int, int, int, int]]:
    """What ``op3_topk`` must return; for tests."""
    rows = list(rows)
    out = []
    for q, x in rows:
        if q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out
