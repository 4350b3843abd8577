"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

The lines of all documents are hashed in one pass, dealt into batches of descending document id.
A batch's distinct keys, with the number of its documents and the largest of them, are written as
a table bucketed and sorted by key, and merge-anti-joined with the runs written so far: only keys
that no run holds are *fresh*, and their largest document is in this batch, whatever comes later.
The fresh keys are the batch's own run, at level 0; counts are kept apart. When a level holds
``FANOUT`` runs they are compacted into one run of the next level. Runs hold disjoint keys, and as
all these tables are bucketed alike, merging with a run neither shuffles nor sorts it again.

Keys are 128-bit hashes (two independently seeded 64-bit hashes), so that no two lines of a
100 TB corpus are taken for each other. Nothing is collected; hot lines are pre-aggregated.

Defined cases: a null or empty text is one empty line; a null id counts as smaller than every
id; rows that repeat both id and text are one document; all input columns are kept; an empty
table gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, WHITE, save, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FANOUT = 3
#: Batches at least, and documents in a batch beyond that.
BATCHES, BATCH_DOCS = 6, 2_000_000_000
KEY = ["__h1", "__h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line whose key is long enough: __batch, __d, __t (text hash), __pos, key hashes."""
    lines = docs.select(
        "__batch",
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__d"),
        F.xxhash64(F.col(text_col)).alias("__t"),
        F.posexplode(lines_of(F.col(text_col))).alias("__pos", "__line"),
    )
    trimmed = lines.select("__batch", "__d", "__t", "__pos", F.btrim("__line", F.lit(WHITE)).alias("__k")).where(F.char_length("__k") >= min_chars)
    key = F.translate("__k", UPPER, LOWER)
    return trimmed.select("__batch", "__d", "__t", "__pos", F.xxhash64(key).alias("__h1"), F.xxhash64(F.lit(0x5EED), key).alias("__h2"))


@dataclass
class LineRuns:
    """The levelled runs. ``add`` takes batches in descending order of document id."""

    spark: SparkSession
    folder: str
    levels: list[list[str]] = field(default_factory=lambda: [[]])
    counts: list[str] = field(default_factory=list)
    made: list[str] = field(default_factory=list)

    def _write(self, df: DataFrame) -> str:
        """Writes a table bucketed and sorted by key. df is dealt by key as buckets are, so that a bucket is one file."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"line_runs_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        self.made.append(name)
        return name

    def add(self, lines: DataFrame) -> None:
        own = lines.select(*KEY, "__d").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n"), F.max("__d").alias("__top"))
        batch = self._write(own)
        self.counts.append(batch)
        fresh = self.spark.table(batch).select(*KEY, "__top")
        for run in self.runs():
            fresh = fresh.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._write(fresh))
        self._compact()

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= FANOUT:
                merged = reduce(DataFrame.unionByName, map(self.spark.table, self.levels[k]))
                merged = self._write(merged.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *KEY))
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys of at least ``min_docs`` documents, with the largest of them."""
        counts = reduce(DataFrame.unionByName, map(self.spark.table, self.counts)).groupBy(*KEY).agg(F.sum("__n").alias("__n"))
        return reduce(DataFrame.unionByName, map(self.spark.table, self.runs())).join(counts.where(F.col("__n") >= min_docs), KEY).select(*KEY, "__top")

    def drop(self) -> None:
        """Forgets the tables' names; the files go with the scratch folder."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def batch_of(docs: DataFrame, n: int, id_col: str) -> Column:
    """The number of the batch of each row: n ranges of ids of about equal numbers of rows, from the largest ids down."""
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts), reverse=True)
    if not cuts:
        return F.lit(0)
    return F.coalesce(sum((F.col(id_col).cast("long") <= c).cast("int") for c in cuts), F.lit(len(cuts)))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """The rows of docs with ``text`` rid of lines that stand in ``min_docs`` documents or more,
    except in the largest id holding the line; adds __n_lines and __n_dropped."""
    spark = docs.sparkSession
    folder = scratch(spark, "line-dedup")
    batches = max(batches, -(-docs.count() // BATCH_DOCS))
    lines = keyed_lines(docs.withColumn("__batch", batch_of(docs, batches, id_col)), min_chars, id_col, text_col)
    lines.write.partitionBy("__batch").parquet(f"{folder}/lines")
    lines = spark.read.schema(lines.schema).parquet(f"{folder}/lines")
    runs, ordered = LineRuns(spark, folder), "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(ordered)
    spark.conf.set(ordered, "true")  # a bucket of one file is read as it was sorted
    try:
        for i in range(batches):
            runs.add(lines.where(F.col("__batch") == i).drop("__batch"))
        # written first, so that the join's two sides are plain exchanges and a hot line's partition can be split
        frequent = save(runs.frequent(min_docs), f"{folder}/frequent")
    finally:
        spark.conf.set(ordered, before)
        runs.drop()
    drop = lines.drop("__batch").join(frequent, KEY).where(F.col("__d") < F.col("__top"))
    # A bit for each line: filtering a document costs one look-up a line, however many lines go.
    bits = drop.groupBy("__d", "__t", F.floor(F.col("__pos") / 64).cast("int").alias("__w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("__pos") % 64).cast("int"))).alias("__b")
    )
    bits = bits.groupBy("__d", "__t").agg(
        F.map_from_entries(F.collect_list(F.struct("__w", "__b"))).alias("__m"), F.max("__w").alias("__last"), F.sum(F.bit_count("__b")).alias("__n_dropped")
    )
    bits = bits.select(
        "__d", "__t", "__n_dropped", F.transform(F.sequence(F.lit(0), F.col("__last")), lambda w: F.coalesce(F.element_at("__m", w), F.lit(0).cast("long"))).alias("__bits")
    )
    keyed = docs.withColumns({"__d": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "__t": F.xxhash64(F.col(text_col))})
    joined = keyed.join(bits, ["__d", "__t"], "left")
    stays = F.filter(
        lines_of(F.col(text_col)),
        lambda line, i: F.getbit(F.coalesce(F.get("__bits", F.floor(i / 64).cast("int")), F.lit(0).cast("long")), (i % 64).cast("int")) == 0,
    )
    return joined.withColumns(
        {
            "__n_lines": F.size(lines_of(F.col(text_col))).cast("long"),
            "__n_dropped": F.coalesce("__n_dropped", F.lit(0)).cast("long"),
            text_col: F.when(F.col("__bits").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(stays, "\n")),
        }
    ).drop("__d", "__t", "__bits")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import read

    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, (f.top IS NOT NULL AND k.doc_id < f.top) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
