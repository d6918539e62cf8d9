"""Documents, accesses, states and graphs as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import normalized_tokens, whitespace_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than the cluster has cores is dealt out anew; larger ones stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_id, ord, title (first six tokens), content, tags (distinct ones of the first three normalized tokens), category (source)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select(
        F.col("doc_id").cast("string").alias("_id"), F.col("doc_id").alias("ord"), F.array_join(F.slice(whitespace_tokens(F.col("text"), lower=False), 1, 6), " ").alias("title"),
        F.col("text").alias("content"), F.array_distinct(F.slice(normalized_tokens(F.col("text")), 1, 3)).alias("tags"), F.col("source").alias("category"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.from_json("props", "k int")["k"].alias("k"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, document_id, seq."""
    return events(spark, sf_dir).select("user_id", F.col("k").cast("string").alias("document_id"), F.col("event_id").alias("seq"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id", F.col("event_type").alias("query"), "ts", F.col("k").alias("results_count"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_state, to_state, state, time_in_state (minutes to the user's next event), throughput, utilization, queue_length, bottleneck."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, sf_dir)
    minutes = (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 60_000_000.0
    return e.select(
        "event_id", F.lag("event_type").over(w).alias("from_state"), F.col("event_type").alias("to_state"), F.col("event_type").alias("state"), minutes.alias("time_in_state"),
        F.col("value").alias("throughput"), (F.col("value") / 500).alias("utilization"), F.col("k").cast("double").alias("queue_length"), (F.col("event_type") == "error").alias("bottleneck"),
    )


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: consecutive documents of a user, one edge per step."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, sf_dir).select(F.lpad(F.col("k").cast("string"), 3, "0").alias("src"), F.lead(F.lpad(F.col("k").cast("string"), 3, "0")).over(w).alias("dst"))
    return e.where("dst is not null")


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (user), seq, bit (clicks)."""
    return events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "click").cast("int").alias("bit"))
