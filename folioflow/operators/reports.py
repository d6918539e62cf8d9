"""Map/reduce reports over documents, the general map/reduce surface, and its cost model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import whitespace_tokens


def map_phase(rows: DataFrame, mapper: Callable[[dict], list[tuple]], schema: str = "key string, value double") -> DataFrame:
    """Pairs that a Python mapper gives for each row; rows on which it fails give none. Prefer expressions where they do."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for record in b.to_dict("records"):
                try:
                    out += list(mapper(record))
                except Exception:  # noqa: BLE001  the surface's rule: a failing record is skipped
                    continue
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def reduce_phase(pairs: DataFrame, reducer: Callable[[object, list], object], schema: str = "key string, result double") -> DataFrame:
    """(key, result) by a Python reducer over all values of a key; keys on which it fails are left out.

    An arbitrary reducer needs a key's values in one task; use ``aggregate`` where an aggregate does, which combines
    before the shuffle.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        try:
            return pd.DataFrame([(key[0], reducer(key[0], b["value"].tolist()))], columns=names)
        except Exception:  # noqa: BLE001  the surface's rule: a failing key is skipped
            return pd.DataFrame(columns=names)

    return pairs.groupBy("key").applyInPandas(run, schema)


def map_reduce(rows: DataFrame, mapper: Callable, reducer: Callable, pairs: str = "key string, value double", result: str = "key string, result double") -> DataFrame:
    return reduce_phase(map_phase(rows, mapper, pairs), reducer, result)


def aggregate(rows: DataFrame, key: Column, **aggregates: Column) -> DataFrame:
    """Group-by with combiners: the map/reduce jobs whose mapper and reducer are expressions."""
    return rows.groupBy(key.alias("key")).agg(*[a.alias(name) for name, a in aggregates.items()])


def count_by(rows: DataFrame, key: Column) -> DataFrame:
    return aggregate(rows, key, n=F.count("*"))


def average_by(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    return aggregate(rows, key, average=F.avg(value))


def statistics_by(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    return aggregate(rows, key, n=F.count(value), total=F.sum(value), average=F.avg(value), minimum=F.min(value), maximum=F.max(value))


def first_per_group(df: DataFrame, by: str, order: str, n: int = 100) -> DataFrame:
    """The first ``n`` rows of each group in order; each task drops what can't be among them before the shuffle."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_place") <= n).drop("_place")


def filtered_count(rows: DataFrame, predicate: Column) -> DataFrame:
    return rows.where(predicate).agg(F.count("*").alias("n"))


def counted_words(docs: DataFrame) -> DataFrame:
    """Words over three characters, punctuation and all, of the title and of the content's first 50 tokens."""
    first = F.slice(whitespace_tokens(F.col("content")), 1, 50)
    return docs.select(F.explode(F.filter(F.concat(whitespace_tokens(F.col("title")), first), lambda w: F.length(w) > 3)).alias("word"))


def word_count(docs: DataFrame, n: int = 20) -> DataFrame:
    return counted_words(docs).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def category_statistics(docs: DataFrame) -> DataFrame:
    """Per category: documents, mean content length, mean processing time, percentage with tags."""
    time = F.coalesce(F.col("processing_time"), F.lit(0.0)) if "processing_time" in docs.columns else F.lit(0.0)
    tagged = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, 1).otherwise(0)
    return docs.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count("*").alias("count"), F.avg(F.length(F.coalesce("content", F.lit("")))).alias("avg_content_length"), F.avg(time).alias("avg_processing_time"), (F.avg(tagged) * 100).alias("with_tags_percentage")
    )


def tag_counts(docs: DataFrame, n: int = 10) -> DataFrame:
    return docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def tag_pairs(docs: DataFrame, n: int = 10) -> DataFrame:
    """(tag1, tag2, n): unordered pairs of places in a document's tags; a tag that stands twice pairs with itself."""
    t = F.col("tags")
    pairs = F.flatten(F.transform(t, lambda a, i: F.transform(F.filter(t, lambda b, j: j > i), lambda b: F.struct(F.least(a, b).alias("tag1"), F.greatest(a, b).alias("tag2")))))
    return docs.where(F.size("tags") > 1).select(F.explode(pairs).alias("p")).groupBy("p.tag1", "p.tag2").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag1", "tag2").limit(n)


def state_transitions(pairs: DataFrame, n: int = 15) -> DataFrame:
    """(transition, n, percentage of all rows): 'previous → current', missing states as 'unknown'."""
    name = F.concat(F.coalesce("from_state", F.lit("unknown")), F.lit(" → "), F.coalesce("to_state", F.lit("unknown")))
    total = pairs.agg(F.count("*").alias("total"))
    top = pairs.groupBy(name.alias("transition")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "transition").limit(n)
    return top.crossJoin(F.broadcast(total)).select("transition", "n", (F.col("n") / F.col("total") * 100).alias("percentage"))  # one row


def efficiency_by_state(rows: DataFrame) -> DataFrame:
    """Per state: rows, mean throughput, utilization and queue, bottleneck rate in percent."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.groupBy(F.coalesce("state", F.lit("unknown")).alias("state")).agg(
        F.count("*").alias("count"), F.avg(zero("throughput")).alias("avg_throughput"), F.avg(zero("utilization")).alias("avg_utilization"), F.avg(zero("queue_length")).alias("avg_queue_length"),
        (F.avg(F.coalesce(F.col("bottleneck").cast("int"), F.lit(0))) * 100).alias("bottleneck_rate"),
    )


def system_health(rows: DataFrame) -> DataFrame:
    """One row: mean throughput, utilization and queue; the score is the utilization, at most 1."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    u = F.avg(zero("utilization"))
    return rows.agg(F.avg(zero("throughput")).alias("avg_throughput"), u.alias("avg_utilization"), F.avg(zero("queue_length")).alias("avg_queue_length"), F.least(u, F.lit(1.0)).alias("health_score"))


def workflow(rows: DataFrame) -> DataFrame:
    """Per state: mean time in it, its place among the slowest, and the bottleneck percentage over all rows."""
    rate = rows.agg((F.avg(F.coalesce(F.col("bottleneck").cast("int"), F.lit(0))) * 100).alias("bottleneck_rate"))
    times = rows.where("state is not null").groupBy("state").agg(F.avg(F.coalesce(F.col("time_in_state"), F.lit(0.0))).alias("avg_time"))
    return times.withColumn("place", F.row_number().over(Window.orderBy(F.desc("avg_time"), "state"))).crossJoin(F.broadcast(rate))  # a row per state; one row


def multi_key_statistics(rows: DataFrame) -> DataFrame:
    """(kind, key, count, total) by category, by state, and by each of the first three tags, in one pass."""
    one = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.cast("double").alias("value"))
    keys = F.concat(
        F.array(one("cat", F.coalesce("category", F.lit("unknown")), F.length(F.coalesce("content", F.lit(""))))),
        F.array(one("state", F.coalesce("state", F.lit("unknown")), F.lit(1))),
        F.transform(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 3), lambda t: one("tag", t, F.lit(1))),
    )
    return rows.select(F.explode(keys).alias("x")).groupBy("x.kind", "x.key").agg(F.count("*").alias("count"), F.sum("x.value").alias("total"))


def job_cost(rows: DataFrame, pairs: DataFrame, name: str, seconds: float | None = None) -> DataFrame:
    """One row of cost metrics of a job whose mapped pairs are (key, value) and whose result has a row a key.

    Communication is the bytes of keys and values, storage the bytes of one key and value each; without a time, the
    throughput part of the score is left out.
    """
    n = rows.agg(F.count("*").alias("input_size"))
    size = F.octet_length(F.col("key").cast("string")) + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
    by_key = pairs.groupBy("key").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("one"))
    m = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("map_output_size"), F.count("*").alias("unique_keys"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("communication_cost"), F.coalesce(F.sum("one"), F.lit(0)).alias("storage_cost"))
    d = n.crossJoin(m).withColumn("output_size", F.col("unique_keys"))  # one row each
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    map_selectivity = clamp(1 - F.try_divide(F.col("map_output_size"), F.col("input_size") * 10))
    reduce_selectivity = F.when(F.col("map_output_size") > 0, clamp(1 - F.try_divide(F.col("output_size"), F.col("map_output_size")))).otherwise(0.0)
    throughput = F.col("input_size") / F.lit(float(seconds)) if seconds else F.lit(0.0)
    d = d.select(
        F.lit(name).alias("job"), *[F.col(c).cast("long").alias(c) for c in ("input_size", "map_output_size", "unique_keys", "output_size")],
        F.try_divide(F.col("map_output_size"), F.col("input_size")).alias("expansion_factor"), F.try_divide(F.col("map_output_size"), F.col("unique_keys")).alias("avg_values_per_key"), F.try_divide(F.col("input_size"), F.col("output_size")).alias("compression_ratio"),
        (F.col("input_size") + F.col("map_output_size") + F.col("output_size")).cast("long").alias("computation_cost"), F.col("communication_cost").cast("long").alias("communication_cost"), F.col("storage_cost").cast("long").alias("storage_cost"),
        map_selectivity.alias("map_selectivity"), reduce_selectivity.alias("reduce_selectivity"), F.lit(seconds or 0.0).cast("double").alias("total_time"), throughput.alias("throughput"),
    )
    return d.withColumn("score", 30 * F.col("map_selectivity") + 30 * F.col("reduce_selectivity") + 40 * F.least(F.col("throughput") / 1000, F.lit(1.0)))


def advice() -> Column:
    """Advice of a job's metrics, joined by '; '."""
    rules = (
        (F.col("map_selectivity") < 0.3, "the map step makes many pairs: filter earlier"), (F.col("reduce_selectivity") < 0.3, "the reduce step shrinks little: check the aggregation"),
        (F.col("communication_cost") > F.col("computation_cost"), "much communication: use combiners"), (F.col("total_time") > 1.0, "long: consider more partitions"), (F.col("score") > 70, "well optimized"),
    )
    return F.array_join(F.array_compact(F.array(*[F.when(c, text) for c, text in rules])), "; ")


def compare_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with advice and whether they are the best or the worst by score."""
    ends = jobs.agg(F.max_by("job", F.struct("score", "job")).alias("best"), F.min_by("job", F.struct("score", "job")).alias("worst"))
    return jobs.crossJoin(F.broadcast(ends)).select(*jobs.columns, (F.col("job") == F.col("best")).alias("is_best"), (F.col("job") == F.col("worst")).alias("is_worst"), advice().alias("advice"))  # one row


def document_report(docs: DataFrame, states: DataFrame) -> dict[str, DataFrame]:
    """The five analyses as tables; ``show`` prints them."""
    return {"words": word_count(docs), "categories": category_statistics(docs), "tags": tag_counts(docs), "tag pairs": tag_pairs(docs), "transitions": state_transitions(states), "efficiency": efficiency_by_state(states)}


def show(report: dict[str, DataFrame], rows: int = 20) -> None:
    for title, table in report.items():
        print(title)
        table.show(rows, truncate=False)
