"""Keyed document store: first write wins, lookup, delete, and statistics of hash buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.hashing import code_point_bucket


def insert_all(docs: DataFrame, order: str = "ord") -> DataFrame:
    """One row per _id: the first by ``order``. Aggregates before it shuffles, so copies of an id don't meet in one task."""
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(order))
    return docs.groupBy("_id").agg(first.alias("d")).select("d.*")


def lookup(docs: DataFrame, key: str) -> DataFrame:
    return docs.where(F.col("_id") == key)


def delete(docs: DataFrame, key: str) -> DataFrame:
    return docs.where(F.col("_id") != key)


def bucket_statistics(docs: DataFrame, size: int = 2500) -> DataFrame:
    """One row: items, table size, load factor, empty buckets, longest chain, mean chain of buckets in use."""
    chains = docs.groupBy(code_point_bucket(F.col("_id"), size).alias("bucket")).agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    used = F.count("*")
    return chains.agg(
        total.cast("long").alias("total_items"), F.lit(size).cast("long").alias("table_size"), (total / size).alias("load_factor"), (F.lit(size) - used).cast("long").alias("empty_buckets"),
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_chain_length"), F.round(F.coalesce(F.try_divide(total, used), F.lit(0.0)), 2).alias("avg_chain_length"),
    )
