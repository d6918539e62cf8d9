"""Bloom filter and reservoir sample as batch operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.hashing import bloom_positions, priority


def bloom_filter(items: DataFrame, m: int = 10_000, k: int = 3, item: str = "item") -> DataFrame:
    """The filter as its set positions (pos): at most m rows, whatever the input."""
    return items.where(F.col(item).isNotNull()).select(F.explode(bloom_positions(F.col(item), m, k)).alias("pos")).distinct()


def bloom_contains(probes: DataFrame, bits: DataFrame, m: int = 10_000, k: int = 3, item: str = "item") -> DataFrame:
    """(item, contained) of each distinct probe: contained if all its positions are set."""
    p = probes.select(F.col(item).alias("item")).where("item is not null").distinct().select("item", F.explode(F.array_distinct(bloom_positions(F.col("item"), m, k))).alias("pos"))
    hit = p.join(bits.withColumn("hit", F.lit(1)), "pos", "left")
    return hit.groupBy("item").agg((F.count("*") == F.count("hit")).alias("contained"))


def false_positive_probability(m: Column, k: Column, n: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(F.pow(1 - F.exp(-k * n / m), k))


def bloom_statistics(items: DataFrame, m: int = 10_000, k: int = 3, item: str = "item") -> DataFrame:
    """One row: size, hashes, items (repeats included), bits set, fill ratio, theoretical false-positive rate."""
    bits = bloom_filter(items, m, k, item).agg(F.count("*").alias("bits_set"))
    n = items.agg(F.count(item).alias("num_items"))
    p = false_positive_probability(F.lit(float(m)), F.lit(float(k)), F.col("num_items"))
    return n.crossJoin(bits).select(F.lit(m).cast("long").alias("size"), F.lit(k).cast("long").alias("num_hashes"), "num_items", "bits_set", (F.col("bits_set") / m).alias("fill_ratio"), (p).alias("false_positive_rate"))


def optimal_parameters(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) for n items at false-positive rate p, both cut to whole numbers; one hash at least."""
    if n <= 0 or not 0 < p < 1:
        raise ValueError("n must be positive and p between 0 and 1")
    m = int(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, int(m / n * math.log(2)))


def reservoir(rows: DataFrame, k: int, *key: str, seed: str = "42") -> DataFrame:
    """A uniform sample of k rows: those of the smallest hash priority. It distributes and repeats alike, as a reservoir would not."""
    return rows.orderBy(priority(seed, *[F.col(c) for c in key]), *key).limit(k)
