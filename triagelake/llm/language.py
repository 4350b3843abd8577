"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams (1 to 4 characters of the lower-cased text, all that is no letter a space) are hashed to
``DIM`` columns. Document frequencies are counted over all documents that may be learnt from.
The regression is trained by follow-the-regularised-leader (FTRL-proximal) with an elastic-net
penalty on ``SAMPLE`` labelled rows, the ones whose hashed id is smallest; a held-back fifth of
them sets the temperature that calibrates the probabilities.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without a label
(null lang) or id are never learnt from but are predicted; if nothing can be learnt all rows are
``und``; whole texts are used; repeated rows are predicted alike; columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, prepare, read

DIM = 1 << 16
#: Labelled rows that the classifier is fitted on (bound of what reaches the driver).
SAMPLE = 2000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.5, 4
#: Below this calibrated probability the pipeline rejects a document.
MIN_SCORE = 0.5
_MULTIPLIERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters (Unicode categories L*)."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns (ascending) and counts of a text's n-grams of 1 to 4 characters."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(letters()[c], c, 0x20)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0x20) | (c[:-1] != 0x20)
    c = c[keep].astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0)
    parts, h = [], np.zeros(len(c), np.uint64)
    for n, m in enumerate(_MULTIPLIERS[: len(c)]):
        h = (h[: len(c) - n] * np.uint64(0x100000001B3)) ^ c[n:]
        parts.append((h * m) >> np.uint64(48))
    at = np.concatenate(parts).astype(np.int64)  # 16 bits: DIM columns
    if len(at) > 4096:
        count = np.bincount(at, minlength=DIM)
        cols = np.flatnonzero(count)
        return cols, count[cols].astype(np.float64)
    cols, count = np.unique(at, return_counts=True)
    return cols, count.astype(np.float64)


def vector(cols: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[cols]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm > 0 else x


class Ftrl:
    """Per-coordinate FTRL-proximal for a softmax over ``classes``."""

    def __init__(self, classes: int, dim: int = DIM, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((dim, classes)), np.zeros((dim, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, cols: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[cols], self.n[cols]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, cols: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(cols)
        p = softmax((x @ w)[None])[0]
        p[label] -= 1
        g = x[:, None] * p
        sigma = (np.sqrt(self.n[cols] + g * g) - np.sqrt(self.n[cols])) / self.alpha
        self.z[cols] += g - sigma * w
        self.n[cols] += g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by a search in shrinking steps."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high = np.log(0.05), np.log(5.0)
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray) -> dict | None:
    """The model from (columns, counts, label) rows, in a given order."""
    rows = [r for r in rows if len(r[0])]
    names = sorted({r[2] for r in rows})
    if not names:
        return None
    data = [(c, vector(c, v.astype(np.float64), idf).astype(np.float32), names.index(lang)) for c, v, lang in rows]
    held = [d for i, d in enumerate(data) if i % 5 == 4]
    train = [d for i, d in enumerate(data) if i % 5 != 4]
    model, rng = Ftrl(len(names)), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            model.step(*train[i])
    w = model.weights()
    logits = np.array([x @ w[c] for c, x, _ in held]).reshape(len(held), len(names))
    return {"names": names, "w": w.astype(np.float32), "idf": idf.astype(np.float32), "t": temperature(logits, np.array([d[2] for d in held], int))}


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """How many documents hold each column, over all rows; each task sends one row a column at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    df[grams(text)[0]] += 1
                    n += 1
        cols = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cols, -1)), pa.array(np.append(df[cols], n))], names=["c", "n"])

    rows = docs.select(text_col).mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIM, np.int64)
    real = rows["c"].to_numpy() >= 0
    df[rows["c"].to_numpy()[real]] = rows["n"].to_numpy()[real]
    return df, int(rows["n"].to_numpy()[~real].sum())


def train(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict | None:
    """Fits on the rows where ``learn`` holds and lang is not null."""
    usable = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    df, n = document_frequencies(usable, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("lang"), pa.array([c.astype("<u4").tobytes() for c, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names=["k", "lang", "c", "v"]
            )

    key = F.xxhash64(F.lit("lang-sample"), F.col(id_col))
    picked = usable.select(key.alias("k"), F.col(id_col).alias("i")).orderBy("k", "i").limit(sample)
    edge = picked.agg(F.max("k").alias("k")).first()["k"]
    if edge is None:
        return None
    rows = usable.where(key <= edge).select(key.alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).limit(2 * sample)
    # the driver holds 8 bytes a column of a sampled text: compact arrays, one partition of rows at a time
    got = []
    for r in rows.mapInArrow(features, "k long, lang string, c binary, v binary").toLocalIterator():
        got.append((r["k"], r["lang"], np.frombuffer(bytes(r["c"]), "<u4"), np.frombuffer(bytes(r["v"]), "<f4")))
    got.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    return fit([(c, v, lang) for _, lang, c, v in got], idf)


def predict_one(model: dict | None, text: str | None) -> tuple[str, float]:
    if model is None or not has_letter(text):
        return "und", 0.0
    cols, count = grams(text)
    if not len(cols):
        return model["names"][0], 1.0 / len(model["names"])
    p = softmax((vector(cols, count, model["idf"]) @ model["w"][cols])[None] / model["t"])[0]
    best = int(p.argmax())
    return model["names"][best], float(min(1.0, max(0.0, p[best])))


def predict(docs: DataFrame, model: dict | None, text_col: str = "text", keep_text: bool = True, new: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score, named by ``new`` (columns so named are replaced)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    carried = [f for f in docs.schema if f.name.lower() not in new and (keep_text or f.name != text_col)]
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict_one(shared.value, t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, *new])

    return docs.mapInArrow(run, T.StructType([*carried, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType())]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(crc_of_id(doc_id) % 4 == 2, F.lit(False))


def learnable(doc_id):
    return F.coalesce(crc_of_id(doc_id) % 4 != 2, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, learnable(F.col("doc_id")))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, model, keep_text=False)


def keep_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The pipeline's filter: rows whose language is recognised with enough certainty. All columns stay as they are,
    whatever their names; a null or letterless text goes; rows with a null id are judged, but not learnt from."""
    prepare(docs.sparkSession)
    model = train(docs, learnable(F.col("doc_id")))
    found = predict(docs, model, new=("__lang_pred", "__lang_score"))
    return found.where((F.col("__lang_pred") != "und") & (F.col("__lang_score") >= min_score)).select(*docs.columns)
