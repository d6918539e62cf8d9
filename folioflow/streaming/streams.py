"""Structured Streaming forms of the stream summaries.

Each function takes a streaming DataFrame and returns one; ``run_available`` drives a query over what is there and
gives its result as a table in the shared folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from folioflow.functions.hashing import bloom_positions
from folioflow.operators.dgim import Buckets
from folioflow.operators.shared import shared_folder


def events_stream(spark: SparkSession, folder: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of files, with ``ts`` as a timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, event_type, n) of event-time windows; a window is given out once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n")).select("window.start", "window.end", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("window")).agg(F.count("*").alias("n")).select("user_id", "window.start", "window.end", "n")


def frequencies(items: DataFrame, item: str) -> DataFrame:
    """Running frequency of each item (update or complete mode)."""
    return items.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("f"))


def distinct_items(items: DataFrame, item: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each item once; the watermark bounds what is remembered."""
    return items.withWatermark(time, late).dropDuplicatesWithinWatermark([item]).select(item)


def user_documents(accesses: DataFrame) -> DataFrame:
    """Running accesses of each user to each document (update mode); ``access.user_totals`` sums them up by user."""
    return accesses.groupBy("user_id", "document_id").agg(F.count("*").alias("n"))


def first_documents(docs: DataFrame) -> DataFrame:
    """Documents as they arrive, the first of each _id only: the ids are the state."""
    return docs.dropDuplicates(["_id"])


def bloom_bits(items: DataFrame, item: str, m: int = 10_000, k: int = 3) -> DataFrame:
    """Positions of the filter as they are set: at most m rows of state."""
    return items.select(F.explode(bloom_positions(F.col(item).cast("string"), m, k)).alias("pos")).dropDuplicates(["pos"])


def dgim(bits: DataFrame, window: int) -> DataFrame:
    """(key, clock, estimate) after each batch of (key, seq, bit): the buckets of a key are its state."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, times, sizes = state.get if state.exists else (0, [], [])
        b = Buckets(window, clock, list(zip(times, sizes, strict=True)))
        for x in sorted((r for d in batches for r in zip(d["seq"], d["bit"], strict=True))):  # a micro-batch of one key
            b.update(int(x[1]))
        state.update((b.clock, [t for t, _ in b.buckets], [s for _, s in b.buckets]))
        yield pd.DataFrame({"key": [key[0]], "clock": [b.clock], "estimate": [b.count()]})

    return bits.groupBy("key").applyInPandasWithState(fold, "key string, clock long, estimate long", "clock long, times array<long>, sizes array<long>", "update", GroupStateTimeout.NoTimeout)


def call_monitor(calls: DataFrame, key: str, order: str, window: int = 3600) -> DataFrame:
    """(key, clock, estimate) after each batch: about how many of the key's last ``window`` calls there were, each call a one."""
    return dgim(calls.select(F.col(key).cast("string").alias("key"), F.col(order).alias("seq"), F.lit(1).alias("bit")), window)


def reservoir(rows: DataFrame, k: int, seed: str = "42") -> DataFrame:
    """(shard, id) of a uniform sample after each batch: each of a few shards keeps its k smallest hash priorities.

    Rows are (id); the k smallest over all shards are the sample, the same as the batch form draws.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for d in batches:
            kept = sorted({*kept, *(hashlib.md5(f"{seed}:{x}".encode()).hexdigest() + ":" + str(x) for x in d["id"])})[:k]
        state.update((kept,))
        yield pd.DataFrame({"shard": key[0], "priority": [x.split(":")[0] for x in kept], "id": [x.split(":", 1)[1] for x in kept]})

    sharded = rows.select(F.col("id").cast("string").alias("id"), F.pmod(F.xxhash64("id"), F.lit(16)).cast("int").alias("shard"))
    return sharded.groupBy("shard").applyInPandasWithState(fold, "shard int, priority string, id string", "kept array<string>", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str = "append", name: str | None = None) -> DataFrame:
    """Run a query over what its source has, and read the written result; in update mode the last batch's rows of each key win by ``batch``.

    A query with a name goes on from the state of its last run; ``reset`` forgets it.
    """
    spark = stream.sparkSession
    root = _root(spark, name or uuid.uuid4().hex)

    spark.createDataFrame([], StructType([*stream.schema.fields, StructField("batch", IntegerType())])).write.mode("ignore").parquet(f"{root}/out/batch-none")  # a stream without a batch has no rows

    def write(batch: DataFrame, number: int) -> None:  # a batch that is run again overwrites what it has written
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch-{number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out/*")


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stream-{name}"


def reset(spark: SparkSession, name: str) -> None:
    """Forget the state and the results of a named query: its next run starts from nothing, and reads its source anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_root(spark, name))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
