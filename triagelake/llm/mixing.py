"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words: its weight's share of all words, at most ``MAX_COPIES``
times its own size, the excess being shared again by weight. With r = target / size, every
document of the source gets floor(r) certain whole copies. The rest of the target is filled by a
Pareto order sample of unequal probabilities: a document's inclusion probability p grows about as
the square root of its size (by powers of two, so that a sample is no mere matter of the longest
texts), scaled for each source so that the expected words are the rest; where it would exceed 1 the
document is certain. Documents are ranked by their random odds u/(1-u) divided by their inclusion
odds p/(1-p) and taken in that order. The size of the sample is fixed in words, the unit of the
targets: it ends where the words taken come nearest to the rest.

The cut in each source's order is found from sums over ranges of the rank, refined once, and an
ordered pass over the one range that holds it: no source is ever gathered in a task. Sources are
rows of a table, numbered by a range-partitioned sort, and the level at which targets stop is found
by a few sums over it; their table is broadcast up to ``BROADCAST_SOURCES`` rows (checked) and joined
beyond.

u comes from md5 of seed, id and text: reruns agree, and rows that repeat id and text are taken
alike. A null text has size 0 and is never taken; a null source is a source of its own, ordered
last; a null id is an id like any other; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, save, scratch, word_count

MAX_COPIES = 3
BROADCAST_SOURCES = 100_000
BINS = 4096
SEED = "mix-1"


def uniform(seed: str, doc_id: Column, text: Column) -> Column:
    """In (0, 1), from 52 bits of md5."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    bits = F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def sized(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """__s: the source in a struct, so that null groups and joins like any other; __size: words; __u; __v: the measure of inclusion."""
    out = docs.withColumns({"__s": F.struct(F.col(source_col).alias("s")), "__size": word_count(F.col(text_col)), "__u": uniform(seed, F.col(id_col), F.col(text_col))})
    k = F.length(F.bin("__size")) - 1
    return out.withColumn("__k", k).withColumn("__v", measure(F.col("__k")))


def measure(k: Column) -> Column:
    """About the square root of 2^k, in numbers that doubles hold exactly."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(k / 2).cast("int")).cast("double") * F.when(k % 2 == 0, 1.0).otherwise(1.5)


def numbered(sums: DataFrame, path: str) -> DataFrame:
    """Adds __rank, from 1 in order of source (null last). Sorted in ranges; only the ranges' sizes are gathered."""
    key = [F.col("__s.s").isNull(), F.col("__s.s")]
    parts = save(sums.repartitionByRange(*key).withColumn("__part", F.spark_partition_id()), path)
    sizes = sorted(map(tuple, parts.groupBy("__part").agg(F.count(F.lit(1))).collect()))
    before, start = [], 0
    for part, n in sizes:
        before.append((part, start))
        start += n
    starts = parts.sparkSession.createDataFrame(before, "__part int, __before long")
    rank = F.row_number().over(W.partitionBy("__part").orderBy(*key))
    return parts.withColumn("__rank", rank).join(F.broadcast(starts), "__part").withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__part", "__before")


def targets(slim: DataFrame, folder: str, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_COPIES) -> DataFrame:
    """A row for each source: __s, __source_size, __target, __copies and __rest, the words beyond the certain copies. All
    comparisons are of exact integers."""
    sums = slim.groupBy("__s").agg(F.sum("__size").alias("__n"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))
    rows = save(numbered(sums, f"{folder}/sums").withColumn("__w", turn.cast("long")), f"{folder}/sources")
    wide = lambda c: F.col(c).cast("decimal(38,0)") if isinstance(c, str) else F.lit(c).cast("decimal(38,0)")
    total, left = rows.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum("__w"), F.lit(1))).first()
    rest = total
    while True:  # pour until none is above; every turn stops at least one more source
        above = F.col("__w").cast("decimal(10,0)") * F.lit(rest).cast("decimal(25,0)") > F.lit(cap).cast("decimal(3,0)") * F.col("__n").cast("decimal(20,0)") * F.lit(left).cast("decimal(14,0)")
        got = rows.agg(F.sum(F.when(above, cap * F.col("__n"))), F.sum(F.when(~above, F.col("__w")))).first()
        now = (total - (got[0] or 0), got[1] or 1)
        if now == (rest, left):
            break
        rest, left = now
    share = F.col("__w").cast("decimal(10,0)") * F.lit(rest).cast("decimal(25,0)")
    per = F.col("__n").cast("decimal(20,0)") * F.lit(left).cast("decimal(14,0)")
    copies = F.when(above, cap).when(F.col("__n") > 0, F.floor(share / per)).otherwise(0).cast("long")
    rows = rows.withColumns({"__copies": copies, "__target": F.when(above, (cap * F.col("__n")).cast("double")).otherwise(share.cast("double") / F.lit(float(left)))})
    # the quotient of decimals is rounded: correct it by the exact remainder
    back = share - F.col("__copies").cast("decimal(3,0)") * per
    rows = rows.withColumn("__copies", F.when(above, F.col("__copies")).when(back < 0, F.col("__copies") - 1).otherwise(F.col("__copies")))
    back = share - F.col("__copies").cast("decimal(3,0)") * per
    out = rows.select("__s", F.col("__n").alias("__source_size"), "__target", "__copies", F.when(above | (F.col("__n") == 0), 0.0).otherwise(back.cast("double") / F.lit(float(left))).alias("__rest"))
    return save(out, f"{folder}/targets")


def small(df: DataFrame) -> DataFrame:
    """A table of sources, to be broadcast if it has at most BROADCAST_SOURCES rows."""
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def scales(slim: DataFrame, goal: DataFrame) -> DataFrame:
    """__theta of each source with a rest: min(1, theta * v) are inclusion probabilities whose expected words are the rest."""
    kinds = slim.where("__size > 0").groupBy("__s", "__k", "__v").agg(F.sum("__size").alias("__words"))  # at most 63 rows a source
    kinds = kinds.join(goal.where("__rest > 0").select("__s", "__rest"), "__s")
    down = W.partitionBy("__s").orderBy(F.desc("__k"))
    sure = F.coalesce(F.sum("__words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    low = F.sum(F.col("__words") * F.col("__v")).over(W.partitionBy("__s").orderBy("__k").rowsBetween(W.unboundedPreceding, 0))
    theta = kinds.withColumn("__theta", (F.col("__rest") - sure) / low).where(F.col("__theta") * F.col("__v") <= 1)
    return theta.groupBy("__s").agg(F.max_by("__theta", "__k").alias("__theta"))


def rank() -> Column:
    """The Pareto rank: random odds by inclusion odds; 0 if the document is certain."""
    p, u = F.col("__theta") * F.col("__v"), F.col("__u")
    return F.when(p >= 1, 0.0).otherwise((u / (1 - u)) / (p / (1 - p)))


def _cut_bin(df: DataFrame, bin_: Column, start: Column) -> DataFrame:
    """For each source the first bin in which the words taken reach the rest of the target."""
    sums = df.groupBy("__s", bin_.alias("__bin")).agg(F.sum("__size").alias("__words"), F.first("__rest").alias("__rest"), F.first(start).alias("__start"))
    run = F.sum("__words").over(W.partitionBy("__s").orderBy("__bin"))
    sums = sums.withColumn("__before", F.col("__start") + run - F.col("__words")).withColumn("__after", F.col("__start") + run)
    return sums.where(F.col("__after") >= F.col("__rest")).groupBy("__s").agg(F.min(F.struct("__bin", "__before")).alias("x")).select("__s", "x.__bin", "x.__before")


def plan(slim: DataFrame, folder: str, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A row for each source: __s, __source_size, __target, __copies, __theta, and __least and __most: documents ranked below
    the one, or up to the other, are taken once more."""
    goal = targets(slim, folder, weights)
    goal = save(goal.join(scales(slim, goal), "__s", "left"), f"{folder}/plan")
    part = slim.where("__size > 0").join(small(goal.where("__theta > 0").select("__s", "__rest", "__theta")), "__s")
    some = part.withColumn("__q", rank()).withColumn("__at", F.col("__q") / (1 + F.col("__q")) * BINS).select("__s", "__size", "__rest", "__q", "__at")
    coarse, fine = F.floor("__at"), F.floor((F.col("__at") - F.floor("__at")) * BINS)
    first = save(_cut_bin(some, coarse, F.lit(0).cast("long")).withColumnsRenamed({"__bin": "__b1", "__before": "__before1"}), f"{folder}/cut-1")
    inner = some.withColumn("__c", coarse).join(small(first), "__s").where(F.col("__c") == F.col("__b1"))
    second = save(_cut_bin(inner, fine, F.col("__before1")).withColumnsRenamed({"__bin": "__b2", "__before": "__before2"}), f"{folder}/cut-2")
    last = inner.withColumn("__f", fine).join(small(second), "__s").where(F.col("__f") == F.col("__b2"))
    ties = last.groupBy("__s", "__q").agg(F.sum("__size").alias("__words"), F.first("__rest").alias("__rest"), F.first("__before2").alias("__start"))
    before = F.col("__start") + F.sum("__words").over(W.partitionBy("__s").orderBy("__q")) - F.col("__words")
    nearer = F.col("__rest") - F.col("__before") >= F.col("__words") / 2
    cut = ties.withColumn("__before", before).groupBy("__s").agg(F.min("__q").alias("__least"), F.max(F.when(nearer, F.col("__q"))).alias("__most"))
    return save(goal.join(cut, "__s", "left"), f"{folder}/cuts")


def apply_plan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Adds __source_size, __target and __times, the copies of the document in the mix."""
    joined = docs.join(small(known), "__s")
    q = rank()
    more = F.when(F.col("__theta") > 0, F.when((q <= F.col("__most")) | (q < F.col("__least")), 1)).otherwise(0)
    times = F.when(F.col("__size") == 0, 0).otherwise(F.col("__copies") + F.coalesce(more, F.lit(0)))
    return joined.withColumn("__times", times.cast("long")).drop("__s", "__copies", "__theta", "__least", "__most", "__rest", "__k", "__v")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    """docs with __size, __source_size, __target, __times; the caller repeats or drops rows by __times."""
    folder = scratch(docs.sparkSession, "mixing")
    whole = sized(docs, seed)
    slim = save(whole.select("__s", "__size", "__u", "__k", "__v"), f"{folder}/slim")
    return apply_plan(whole, plan(slim, folder, weights)).drop("__u")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "mixing")
    docs = sized(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text", "source")
    slim = save(docs, f"{folder}/slim")
    out = apply_plan(slim, plan(slim, folder))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__times") * F.col("__size")).alias("taken"))


OP2_SQL = r"""
WITH d0 AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
d1 AS (SELECT *, length(bin(size)) - 1 AS k FROM d0),
d AS (SELECT *, (1::BIGINT << (k // 2))::DOUBLE * CASE WHEN k % 2 = 0 THEN 1.0 ELSE 1.5 END::DOUBLE AS v FROM d1),
n AS (SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, sum(n) OVER ()::BIGINT AS total, sum(n) OVER ()::BIGINT - coalesce(sum(3 * n) OVER (ORDER BY n * 6 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pool,
  sum(w) OVER (ORDER BY n * 6 // w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS ws FROM n),
c AS (SELECT *, w * pool > 3 * n * ws AS capped FROM o),
t AS (SELECT *, (total - coalesce(sum(3 * n) FILTER (capped) OVER (), 0))::BIGINT AS l, (sum(w) FILTER (NOT capped) OVER ())::BIGINT AS ww FROM c),
g AS (SELECT source, n, CASE WHEN capped THEN (3 * n)::DOUBLE ELSE (w * l)::DOUBLE / ww::DOUBLE END AS target, CASE WHEN capped THEN 3 WHEN n > 0 THEN w * l // (ww * n) ELSE 0 END AS copies,
  CASE WHEN capped OR n = 0 THEN 0.0 ELSE (w * l % (ww * n))::DOUBLE / ww::DOUBLE END AS rest FROM t),
y AS (SELECT source, k, v, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY ALL),
z AS (SELECT y.source, k, v, (rest - coalesce(sum(words) OVER (PARTITION BY y.source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(words * v) OVER (PARTITION BY y.source ORDER BY k ROWS UNBOUNDED PRECEDING) AS theta FROM y JOIN g ON y.source IS NOT DISTINCT FROM g.source WHERE rest > 0),
s AS (SELECT source, max_by(theta, k) AS theta FROM z WHERE theta * v <= 1 GROUP BY source),
q AS (SELECT d.*, n, target, copies, rest, CASE WHEN size > 0 AND theta > 0 THEN CASE WHEN theta * v >= 1 THEN 0.0 ELSE (u / (1 - u)) / ((theta * v) / (1 - theta * v)) END END AS q
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN s ON d.source IS NOT DISTINCT FROM s.source),
r AS (SELECT *, sum(size) OVER (PARTITION BY source, q) AS words, sum(size) OVER (PARTITION BY source ORDER BY q RANGE UNBOUNDED PRECEDING) AS run FROM q WHERE q IS NOT NULL)
SELECT doc_id, size, n AS source_size, target, (size * (copies + CASE WHEN rest - (run - words)::DOUBLE >= words::DOUBLE / 2 THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
UNION ALL SELECT doc_id, size, n, target, (size * copies)::BIGINT FROM q WHERE q IS NULL
"""
