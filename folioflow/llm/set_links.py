"""The exact check of near-duplicates by the Jaccard similarity of word shingles: it verifies SimHash's pairs and finds the rest.

Pairs that SimHash links are verified first. What it misses (at a similarity of 4/5 about 10 of 64 bits differ) comes
from a set join between the groups that these links make; it gives links, not all pairs.

A text's set holds the hashes of its ``SHINGLE``-word shingles. Sets are ordered by how common a shingle is in a bounded
sample, then by hash; two sets of similarity 4/5 or more share one of the first fifth of their elements, so these are a
set's keys. Sets meet at their keys and are verified by their whole intersections. The order only affects the cost.

To not list the pairs of a large group, sets that meet are first verified each with one other of its key, in rounds;
only pairs that these links have not yet connected are then verified one by one. A set that no other of its key can be
alike to, outside its group, leaves the rounds. Components are those of all pairs.

Defined results: texts with fewer words than a shingle are one shingle; texts without words have the empty set, and
are alike; equal sets are one class.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import saved
from folioflow.llm.substring_dedup import Hashes
from folioflow.operators.graph import components

SHINGLE = 5
#: The sample that orders shingles: about so many texts, so many shingles, each in so many of the texts.
SAMPLE, COMMON, TEXTS = 4000, 1 << 16, 4
#: Compare so many pairs of a key at once.
PAIRS = 1 << 18
#: A task gives out pairs whenever it has about so many.
GIVEN = 1 << 16
#: While a round finds so many links, and this part of all links, another one follows before all pairs between groups are verified.
MANY = 100
#: A task holds about so many sets of a key: keys with more are dealt in parts, anew in each round, and in the end by pairs of parts.
CHUNK, BROADCAST_KEYS = 1 << 14, 100_000
#: Such keys are found by one set in so many; this decides how keys are dealt, not what is found.
ONE_IN = 16
#: Ids of sets whose texts are compared are broadcast up to so many, 16 bytes each.
BROADCAST_IDS = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's shingles."""
    w = text.encode().translate(_LOWER).split() if text else []
    if not w:
        return np.zeros(0, np.int64)
    at = np.arange(max(1, len(w) - SHINGLE + 1))
    return np.unique(Hashes(w).of(at, np.minimum(at + SHINGLE, len(w))).view(np.int64))


def least_overlap(n):
    """Elements that a set of ``n`` shares at least with any set of similarity 4/5 or more."""
    return (4 * n + 4) // 5


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and in how many."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    few = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).distinct()

    @F.pandas_udf("array<long>")
    def sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([shingle_set(t) for t in s], dtype=object)

    counts = few.select(F.explode(sets("text")).alias("s")).groupBy("s").count().where(F.col("count") >= TEXTS)
    rows = sorted((r["s"], r["count"]) for r in counts.orderBy(F.desc("count"), "s").limit(COMMON).collect())
    return np.array([s for s, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)


def keyed(docs: DataFrame, fingerprint: Callable[[np.ndarray], int]):
    """Function of a text column to (fp, sim, n, m, sketch, keys): the set's hash, its fingerprint, its size, its parities by 64 bits and its sketch, and its keys in order."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    @F.pandas_udf("fp long, sim long, n int, m long, sketch binary, keys array<long>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        common, times = shared.value
        for t in texts:
            rows = []
            for x in map(shingle_set, t):
                seen = np.zeros(len(x), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    seen = np.where(common[at] == x, times[at], 0)
                keys = x[np.lexsort((x, seen))][: len(x) - least_overlap(len(x)) + 1]
                rows.append((np.uint64(xxh3_64_intdigest(x.tobytes())).astype(np.int64), fingerprint(x), len(x), int(parities(x).view(np.int64)[0]), sketch(x), keys))
            yield pd.DataFrame(rows, columns=["fp", "sim", "n", "m", "sketch", "keys"])

    return find


def parities(x: np.ndarray, bits: int = 64) -> np.ndarray:
    """Whether an odd number of the set's elements falls on each bit, as bytes. Sets differ in as many elements as bits at least."""
    return np.packbits((np.bincount(x & (bits - 1), minlength=bits) & 1).astype(np.uint8))


def sketch(x: np.ndarray) -> bytes:
    """Parities on 2 to 4 bits for each element, so that they tell sets of any size apart."""
    return parities(x, 1 << max(6, (2 * len(x)).bit_length())).tobytes()


def differ(a: bytes, b: bytes) -> int:
    """Elements in which two sets differ at least; the longer sketch is folded onto the shorter."""
    n = min(len(a), len(b))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, n), axis=0) for s in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def _fits(n1, p1, m1, n2, p2, m2):
    """Whether sets of sizes n and parities m that share their elements at places p can be alike."""
    return (5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2)) & (9 * np.minimum(n1 - p1, n2 - p2) >= 4 * (n1 + n2)) & (9 * np.bitwise_count((m1 ^ m2).view(np.uint64)).astype(np.int64) <= n1 + n2)


def _along(fp, n, place, m, group, alone, turn: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each set of a key the next one, in a round of the turn's order, that is of another group and can be alike; clears ``alone`` of sets that have one."""
    if group.min() == group.max():
        return
    order = np.argsort((fp ^ np.int64(turn)) * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) + group)
    back, fp, n, place, m, group = order, fp[order], n[order], place[order], m[order], group[order]
    left = np.arange(len(fp))
    for off in range(1, len(fp)):
        to = (left + off) % len(fp)
        ok = (group[left] != group[to]) & _fits(n[left], place[left], m[left], n[to], place[to], m[to])
        x, y = fp[left[ok]], fp[to[ok]]
        yield np.minimum(x, y), np.maximum(x, y)
        alone[back[left[ok]]] = False
        left = left[~ok]
        if not len(left):
            break


def _between(fp, n, place, m, group, alone) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a key between groups; nothing is left to do with its sets."""
    if group.min() == group.max():
        return
    order = np.argsort(fp)
    fp, n, place, m, group = fp[order], n[order], place[order], m[order], group[order]
    step = max(1, PAIRS // len(fp))
    for i in range(0, len(fp), step):
        s = slice(i, i + step)
        ok = (group[s, None] != group[None, :]) & (fp[s, None] < fp[None, :]) & _fits(n[s, None], place[s, None], m[s, None], n[None, :], place[None, :], m[None, :])
        x, y = np.nonzero(ok)
        yield fp[x + i], fp[y]


ROW = ("k", "c", "chunks", "fp", "n", "place", "m", "g")


def _chunked(rows: DataFrame) -> DataFrame:
    """Adds ``chunks``: into how many parts a key's sets are dealt, so that no task holds more than about CHUNK sets of one key."""
    some = rows.where(F.pmod(F.xxhash64("fp", F.lit(99)), F.lit(ONE_IN)) == 0)
    hot = saved(some.groupBy("k").count().where(F.col("count") * ONE_IN > CHUNK // 2))
    n_hot = hot.count()
    if not n_hot:
        return rows.withColumn("chunks", F.lit(1).cast("long"))
    parts = hot.select(F.col("k").alias("hot"), F.ceil(F.col("count") * ONE_IN / CHUNK).alias("parts"))
    parts = F.broadcast(parts) if n_hot <= BROADCAST_KEYS else parts
    return rows.join(parts, F.col("k") == F.col("hot"), "left").withColumn("chunks", F.coalesce("parts", F.lit(1)).cast("long")).drop("hot", "parts")


def _dealt(rows: DataFrame, turn: int, whole: bool) -> DataFrame:
    """Adds ``c``, the part of its key that a row is dealt to; ``whole`` sends it to every pair of parts that has its own."""
    own = F.pmod(F.xxhash64("fp", F.lit(turn)), F.col("chunks"))
    if not whole:
        return rows.withColumn("c", own)
    others = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    blocks = F.transform(others, lambda j: F.least(own, j) * F.col("chunks") + F.greatest(own, j))
    return rows.withColumn("c", F.explode(blocks))


def _meeting(keys: DataFrame, pick) -> DataFrame:
    """Rows (a, b) that ``pick`` gives of each part of a key, and, for which b is null, the rows to go on with: those that met one, and all of keys in several parts."""

    def given(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        a, b = map(np.concatenate, zip(*found, strict=True))
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates().assign(**dict.fromkeys(ROW, None))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def groups(*columns) -> Iterator[pd.DataFrame]:
            k, c, chunks = columns[:3]
            at = np.flatnonzero((np.diff(k, prepend=k[:1] - 1) != 0) | (np.diff(c, prepend=c[:1]) != 0))
            sizes = np.diff(at, append=len(k))
            found, n_found, done = [], 0, chunks == 1
            for i in np.flatnonzero(sizes > 1):
                s = slice(at[i], at[i] + sizes[i])
                alone = np.ones(sizes[i], bool)
                for x, y in pick(*(column[s] for column in columns[3:]), alone):
                    found.append((x, y))
                    n_found += len(x)
                    if n_found >= GIVEN:
                        yield given(found)
                        found, n_found = [], 0
                done[s] &= alone
            if n_found:
                yield given(found)
            yield pd.DataFrame({"a": None, "b": None} | {name: x[~done] for name, x in zip(ROW, columns, strict=True)})

        rest: list[tuple] = []  # of the last part, which may go on in the next batch
        for x in batches:
            if len(x):
                new = tuple(x[name].to_numpy().astype(np.int64) for name in ROW)
                if rest and new[0][0] == new[0][-1] == rest[-1][0][-1] and new[1][0] == new[1][-1] == rest[-1][1][-1]:
                    rest.append(new)
                    continue
                all_ = tuple(np.concatenate(x) for x in zip(*rest, new, strict=True))
                k, c = all_[:2]
                cut = np.searchsorted(k, k[-1])
                cut += np.searchsorted(c[cut:], c[-1])
                rest = [tuple(x[cut:] for x in all_)]
                if cut:
                    yield from groups(*(x[:cut] for x in all_))
        if rest:
            yield from groups(*(np.concatenate(x) for x in zip(*rest, strict=True)))

    return keys.select(*ROW).repartition("k", "c").sortWithinPartitions("k", "c").mapInPandas(meet, "a long, b long, " + ", ".join(f"{c} long" for c in ROW))


def _alike():
    @F.pandas_udf("boolean")
    def alike(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in columns:
            found = []
            for a, b in zip(map(shingle_set, x), map(shingle_set, y), strict=True):
                found.append(9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b)))
            yield pd.Series(found, dtype=bool)

    return alike


def _close():
    @F.pandas_udf("boolean")
    def close(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for x, y, n, m in columns:
            yield pd.Series([9 * differ(a, b) <= k for a, b, k in zip(x, y, n + m, strict=True)], dtype=bool)

    return close


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 4/5 or more; ``sets`` has fp, n, sketch and row of each set, ``docs`` a row's text. Sketches rule out, texts decide."""
    for v in "ab":
        pairs = pairs.join(sets.select(F.col("fp").alias(v), F.col("n").alias(f"n{v}"), F.col("sketch").alias(f"s{v}")).hint("shuffle_merge"), v)
    pairs = saved(pairs.where(_close()("sa", "sb", "na", "nb")).select("a", "b"))
    ids = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    ids = saved(sets.select("fp", "row").join(ids.hint("shuffle_merge"), "fp"))
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_merge"), "row")
    for v in "ab":
        pairs = pairs.join(texts.select(F.col("fp").alias(v), F.col("text").alias(f"t{v}")).hint("shuffle_merge"), v)
    return saved(pairs.where(_alike()("ta", "tb")).select("a", "b"))


def _grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``g``, the group that the links put a row's set in."""
    named = saved(components(links.toDF("id1", "id2")))
    return rows.join(named.hint("shuffle_merge"), F.col("fp") == F.col("id"), "left").withColumn("g", F.coalesce("component", "fp")).drop("id", "component")


def roots(sets: DataFrame, docs: DataFrame, tried: DataFrame) -> DataFrame:
    """(v, root) of each set (fp, n, m, sketch, keys, row) that is linked to another; ``docs`` (row, text) has the text of its row.

    ``tried`` has the pairs (a, b), a < b, that are verified first; the set join finds the links between their groups.
    """
    links = verified(tried, sets, docs)
    n_links, turn, last = links.count(), 0, False
    rows = _chunked(_grouped(sets, links).select("fp", "n", "m", "g", F.posexplode("keys").alias("place", "k")))
    while True:
        met = saved(_meeting(_dealt(rows, turn, whole=last), _between if last else functools.partial(_along, turn=turn)))
        pairs = met.where("b is not null").select("a", "b").distinct()
        pairs = saved(pairs.join(tried.hint("shuffle_merge"), ["a", "b"], "left_anti"))
        tried = tried.union(pairs)
        new = verified(pairs, sets, docs)
        links = links.union(new)
        if last:
            return saved(components(links.toDF("id1", "id2"))).select(F.col("id").alias("v"), F.col("component").alias("root"))
        found, turn = new.count(), turn + 1
        n_links += found
        last = found < max(MANY, n_links // MANY)
        rows = _grouped(met.where("k is not null").drop("a", "b", "g", "c"), links)
