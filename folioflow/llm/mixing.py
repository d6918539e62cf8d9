"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every document is offered in up to ``max_copies`` rounds; in each round its place in its source's queue comes from an
MD5 of id and round. A copy's virtual finish time is the cumulative number of words of its source's queue, itself
included, over the source's target. Ordered by finish time over all sources, the copies are taken until the next one
would exceed the total budget.

No queue is ever gathered in one task: cumulative sums are made of sums by hash bucket (a source has 4,096 a round)
plus a window within the bucket, and the global order is cut by sums over 4,096 bins of finish time for each unit of
it, of which only the bin with the budget's end is ordered row by row. Sources get their weights by rank, in one window over
a table of one row per source.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows without an id queue by
their place in the input; repeated rows are documents of their own, ordered by their place in the input; sizes of 0 take 0
words; an empty table gives an empty result; of other columns none is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import saved, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
#: Sources are broadcast up to so many, about 100 bytes each; more of them are joined by shuffling.
BROADCAST_SOURCES = 100_000
BUCKET_HEX, BINS = 3, 4096


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source (_src): source_size and target. Shares above max_copies times the size are reshared by weight."""
    sizes = sized.groupBy("_src").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy("_src")) - 1) % len(weights)
    s = sizes.select("_src", "source_size", (F.lit(max_copies) * F.col("source_size")).alias("_cap"), F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place + 1).cast("int")).alias("_weight"))
    s = saved(s)
    total, all_weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    budget = share * total
    level = budget / all_weights if all_weights else 0.0
    while True:  # each round caps at least one source more, and two numbers come to the driver
        above = F.lit(level) * F.col("_weight") > F.col("_cap")
        capped, free = s.agg(F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0))).first()
        new = (budget - capped) / free if free else level
        if new <= level:
            break
        level = new
    target = F.when(F.lit(level) * F.col("_weight") > F.col("_cap"), F.col("_cap").cast("double")).otherwise(F.lit(level) * F.col("_weight"))
    return s.select("_src", "source_size", target.alias("target"))


def schedule(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """Every copy on offer: _row, doc_id, source, round, size, source_size, target, finish, bin, and taken (its words, or 0)."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z")).alias("_src"))
    sized = saved(sized.withColumn("_row", F.monotonically_increasing_id()))
    targets = source_targets(sized, weights, share, max_copies)
    few = targets.count() <= BROADCAST_SOURCES
    copies = sized.join(F.broadcast(targets) if few else targets, "_src")
    copies = copies.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(max_copies))))
    copies = copies.withColumn("_order", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row"), F.col("_row").cast("string"))), F.lit(":"), F.col("round").cast("string"))))
    copies = copies.withColumn("_bucket", F.substring("_order", 1, BUCKET_HEX))
    keys = ["_src", "round", "_bucket"]
    own = F.sum("_sum").over(Window.partitionBy("_src").orderBy("round", "_bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = copies.groupBy(keys).agg(F.sum("size").alias("_sum")).select(*keys, F.coalesce(own, F.lit(0)).alias("_before"))
    inside = F.sum("size").over(Window.partitionBy(keys).orderBy("_order", "doc_id", "_row").rowsBetween(Window.unboundedPreceding, 0))
    queued = copies.withColumn("_inside", inside).join(before, keys)
    queued = queued.withColumn("finish", F.when(F.col("target") > 0, (F.col("_before") + F.col("_inside")).cast("double") / F.col("target")).otherwise(0.0))
    queued = saved(queued.withColumn("bin", F.least(F.floor(F.col("finish") * BINS), F.lit(2 * BINS)).cast("int")).drop("_before", "_inside", "_bucket"))

    budget = share * (sized.agg(F.sum("size")).first()[0] or 0)
    bins = queued.groupBy("bin").agg(F.sum("size").alias("n"))
    ends = bins.select("bin", "n", F.sum("n").over(Window.orderBy("bin")).alias("end"))
    last = ends.where(F.col("end") > budget).agg(F.min(F.struct("bin", (F.col("end") - F.col("n")).alias("before"))).alias("x")).first()["x"]
    if last is None:
        return queued.withColumn("taken", F.col("size"))
    there = queued.where(F.col("bin") == last["bin"])
    running = F.lit(last["before"]) + F.sum("size").over(Window.orderBy("finish", "_src", "round", "_order", "doc_id", "_row").rowsBetween(Window.unboundedPreceding, 0))
    there = there.withColumn("taken", F.when(running <= budget, F.col("size")).otherwise(0))
    rest = queued.where(F.col("bin") != last["bin"]).withColumn("taken", F.when(F.col("bin") < last["bin"], F.col("size")).otherwise(0))
    return rest.unionByName(there)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words of all its copies that the mix takes)."""
    s = schedule(docs, weights, share, max_copies)
    first = lambda c: F.first(c).alias(c)
    return s.groupBy("_row").agg(*[first(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").cast("long").alias("taken")).drop("_row")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'z') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY src),
b AS (SELECT 1.5::DOUBLE * sum(size) AS budget FROM d),
k AS (SELECT src, source_size, w, 2 * source_size AS cap, coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
             sum(w) OVER (ORDER BY 2.0 * source_size / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s),
l AS (SELECT (budget - done::DOUBLE) / free::DOUBLE AS level FROM k, b WHERE (budget - done::DOUBLE) / free::DOUBLE * w <= cap ORDER BY 2.0 * source_size / w, src LIMIT 1),
t AS (SELECT src, source_size, CASE WHEN level * w > cap THEN cap::DOUBLE ELSE level * w END AS target FROM k, l),
c AS (SELECT d.doc_id, d.src, d.size, t.source_size, t.target, r, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r) AS o FROM d JOIN t ON d.src = t.src, (VALUES (1), (2)) AS x(r)),
f AS (SELECT *, CASE WHEN target > 0 THEN CAST(sum(size) OVER (PARTITION BY src ORDER BY r, o, doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / target ELSE 0.0 END AS finish FROM c),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, src, r, o, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN run <= budget THEN size ELSE 0 END) AS BIGINT) AS taken FROM g, b GROUP BY doc_id, size, source_size, target
"""
