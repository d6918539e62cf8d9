"""DGIM: an approximate count of ones in a sliding window, and its exact twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Buckets:
    """State of one stream: clock and buckets (time of the newest one, size), oldest first.

    Buckets expire only when a one arrives, so counts after many zeros may include expired ones, unless
    ``expire_on_read`` is asked for. Every bit but 0 counts as a one.
    """

    def __init__(self, window: int, clock: int = 0, buckets: list[tuple[int, int]] | None = None, expire_on_read: bool = False):
        if window <= 0:
            raise ValueError("the window must be positive")
        self.window, self.clock, self.buckets, self.expire_on_read = window, clock, list(buckets or []), expire_on_read

    def update(self, bit: int) -> None:
        self.clock += 1
        if bit == 0:
            return
        self.buckets.append((self.clock, 1))
        size = 1
        while sum(s == size for _, s in self.buckets) > 2:
            oldest = [i for i, (_, s) in enumerate(self.buckets) if s == size][:2]
            self.buckets[oldest[1]] = (self.buckets[oldest[1]][0], 2 * size)
            del self.buckets[oldest[0]]
            size *= 2
        self.buckets = self._live()

    def _live(self) -> list[tuple[int, int]]:
        return [b for b in self.buckets if b[0] > self.clock - self.window]

    def count(self) -> int:
        """All sizes, of the oldest half (rounded down)."""
        live = self._live() if self.expire_on_read else self.buckets
        return sum(s for _, s in live[1:]) + live[0][1] // 2 if live else 0


def sliding_exact(bits: DataFrame, window: int, key: str = "key", order: str = "seq") -> DataFrame:
    """Ones among the last ``window`` bits of each key, at every bit."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(window - 1), 0)
    return bits.withColumn("exact", F.sum((F.col("bit") != 0).cast("long")).over(w))


def sliding_estimate(bits: DataFrame, window: int, key: str = "key", order: str = "seq", expire_on_read: bool = False) -> DataFrame:
    """(key, seq, estimate, n_buckets) at every bit: a fold over each key's bits in order, in bounded state.

    Keys are dealt and sorted over the tasks and streamed through, so that no key's bits are held at once.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current = None, None
        for b in batches:
            out = []
            for k, s, bit in zip(b["key"], b["seq"], b["bit"], strict=True):
                if state is None or k != current:
                    state, current = Buckets(window, expire_on_read=expire_on_read), k
                state.update(bit)
                out.append((k, s, state.count(), len(state.buckets)))
            yield pd.DataFrame(out, columns=["key", "seq", "estimate", "n_buckets"])

    dealt = bits.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("seq"), F.col("bit").cast("int").alias("bit")).repartition("key").sortWithinPartitions("key", "seq")
    return dealt.mapInPandas(fold, "key string, seq long, estimate long, n_buckets long")


def comparison(bits: DataFrame, window: int) -> DataFrame:
    """Per key, at its last bit: exact and estimated count, difference, error in percent (0 if there are no ones), buckets."""
    exact = sliding_exact(bits, window).groupBy(F.col("key").cast("string").alias("key")).agg(F.max_by("exact", "seq").alias("exact"))
    estimate = sliding_estimate(bits, window).groupBy("key").agg(F.max_by(F.struct("estimate", "n_buckets"), "seq").alias("x")).select("key", "x.*")
    last = exact.join(estimate, "key")
    gap = F.abs(F.col("exact") - F.col("estimate"))
    return last.select("key", "exact", "estimate", gap.alias("difference"), F.when(F.col("exact") > 0, gap / F.col("exact") * 100).otherwise(0.0).alias("error_percentage"), "n_buckets")


def all_ones_estimate(n: int) -> int:
    """Closed form of the estimate after n ones in a window that holds them all."""
    if n == 0:
        return 0
    oldest = 1 << ((n + 1).bit_length() - 2)
    return n - oldest + oldest // 2
