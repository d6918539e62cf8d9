"""Character shingles of whole texts in numpy, for what only needs their numbers: counts, places, MinHash signatures.

A shingle of up to three characters is one 64-bit number, 21 bits a character (its code point and one), so numbers and
shingles are one to one. Texts come lower-cased from the JVM, so that the shingles are those of ``char_shingles``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.hashing import MINHASH_EMPTY, MINHASH_MODULUS, minhash_coefficients
from folioflow.functions.text import text_or_empty

#: The longest shingle that is a number.
LONGEST, BITS = 3, 21
#: Shingles that are numbered at once, and bytes of hash numbers that a worker remembers.
AT_ONCE, REMEMBERED = 1 << 15, 64 << 20
#: Shingles whose counts a task holds; with more, it gives them out and begins anew.
HELD = 1 << 20


def runs(text: str | None, k: int) -> np.ndarray:
    """Numbers of all runs of k characters in order; a shorter text is its own run, an empty one has none."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = max(len(c) - k + 1, min(len(c), 1))
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(c))):
        out |= c[j : j + n] << np.uint64(BITS * j)
    return out


def shingle(number: int) -> str:
    out = ""
    while number:
        out += chr((number & ((1 << BITS) - 1)) - 1)
        number >>= BITS
    return out


def lowered(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select(F.col("_id").alias("id"), F.lower(text_or_empty(text)).alias("text"))


class NumberSigner:
    """MinHash signatures of numbered shingles; the hash numbers of a shingle are remembered, as 32 bits each."""

    def __init__(self, num_hashes: int, seed: int = 42):
        ab = np.array(minhash_coefficients(num_hashes, seed), np.uint64)
        self.a, self.b, self.m = ab[:, 0], ab[:, 1], np.uint64(MINHASH_MODULUS)
        self.most = max(AT_ONCE, REMEMBERED // (4 * num_hashes))
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.rows, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, len(self.a)), np.uint32), 0

    def _hashed(self, numbers: np.ndarray) -> np.ndarray:
        """Places in ``rows`` of different numbers in order, at most AT_ONCE."""
        at = np.searchsorted(self.known, numbers)
        there = np.zeros(len(numbers), bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] == numbers
        new = numbers[~there]
        if len(new) and self.n + len(new) > self.most:
            self._forget()
            return self._hashed(numbers)
        if len(new):
            x = np.array([int.from_bytes(hashlib.md5(shingle(int(v)).encode("utf-8", "surrogatepass")).digest()) % MINHASH_MODULUS for v in new], np.uint64)[:, None]
            if self.n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(len(new), len(self.rows), 4096), len(self.a)), np.uint32)])
            self.rows[self.n : self.n + len(new)] = (self.a * x % self.m + self.b) % self.m
            self.known, self.at = np.insert(self.known, at[~there], new), np.insert(self.at, at[~there], np.arange(self.n, self.n + len(new)))
            self.n += len(new)
            at = np.searchsorted(self.known, numbers)
        return self.at[at]

    def signatures(self, texts, k: int) -> Iterator[np.ndarray]:
        """The signature of each text."""
        group, size = [], 0
        for t in texts:
            own = np.unique(runs(t, k))
            if group and size + len(own) > AT_ONCE:
                yield from self._group(group)
                group, size = [], 0
            group.append(own)
            size += len(own)
        yield from self._group(group)

    def _group(self, group: list[np.ndarray]) -> Iterator[np.ndarray]:
        if len(group) > 1:
            numbers, inverse = np.unique(np.concatenate(group), return_inverse=True)
            rows, ends = self._hashed(numbers)[inverse] if len(numbers) else inverse, np.cumsum([len(x) for x in group])
            for end, own in zip(ends, group, strict=True):
                yield self.rows[rows[end - len(own) : end]].min(0).astype(np.int64) if len(own) else np.full(len(self.a), MINHASH_EMPTY, np.int64)
        elif group and len(group[0]):
            least = []
            for i in range(0, len(group[0]), AT_ONCE):
                at = self._hashed(group[0][i : i + AT_ONCE])  # makes new rows
                least.append(self.rows[at].min(0))
            yield np.minimum.reduce(least).astype(np.int64)
        elif group:
            yield np.full(len(self.a), MINHASH_EMPTY, np.int64)


def text_signatures(docs: DataFrame, text: Column, num_hashes: int, k: int, seed: int = 42) -> DataFrame:
    """(id, signature) of the distinct shingles of each text."""

    @F.pandas_udf("array<long>")
    def sign(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        signer = NumberSigner(num_hashes, seed)
        for t in texts:
            yield pd.Series(list(signer.signatures(t, k)), dtype=object)

    return lowered(docs, text).select("id", sign("text").alias("signature"))


def _least(values: np.ndarray, counts: np.ndarray, last: np.ndarray | None):
    order = np.argsort(values, kind="stable")
    at = np.flatnonzero(np.diff(values[order], prepend=values[order[:1]] + np.uint64(1)))
    return values[order][at], np.add.reduceat(counts[order], at), np.maximum.reduceat(last[order], at) if last is not None else None


def run_counts(docs: DataFrame, text: Column, k: int) -> DataFrame:
    """(shingle, n, last): how often each run of k characters occurs in all texts, and its last place in any; shorter texts have none."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        size = 0

        def given() -> Iterator[pd.DataFrame]:
            v, n, last = held[0]
            yield pd.DataFrame({"shingle": [shingle(int(x)) for x in v], "n": n, "last": last})
            held.clear()

        for batch in batches:
            for t in batch["text"]:
                x = runs(t, k) if t is not None and len(t) >= k else runs("", k)
                if len(x):
                    held.append((x, np.ones(len(x), np.int64), np.arange(len(x))))
                    size += len(x)
                if size > HELD:
                    held[:] = [_least(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from given()
                        size = 0
        if held:
            held[:] = [_least(*map(np.concatenate, zip(*held, strict=True)))]
            yield from given()

    found = lowered(docs, text).select("text").mapInPandas(counted, "shingle string, n long, last long")
    return found.groupBy("shingle").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def set_sizes(docs: DataFrame, text: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """(n) of each text, the number of its distinct shingles, and one row with the number of shingles over all texts."""

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([len(np.unique(runs(t, k))) for t in texts], dtype="int64")

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        n = 0
        for batch in batches:
            for t in batch["text"]:
                held.append(runs(t, k))
                n += len(held[-1])
                if n > HELD:
                    held = [np.unique(np.concatenate(held))]
                    n = len(held[0])
                    if n > HELD // 2:
                        yield pd.DataFrame({"s": held[0].astype(np.int64)})
                        held, n = [], 0
        if held:
            yield pd.DataFrame({"s": np.unique(np.concatenate(held)).astype(np.int64)})

    t = lowered(docs, text)
    return t.select(size("text").alias("n")), t.select("text").mapInPandas(distinct, "s long").agg(F.count_distinct("s").alias("total_unique_shingles"))
