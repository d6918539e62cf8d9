"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has 64 bits by majority over the XXH64 hashes of its word shingles. Fingerprints link at up to 3
differing bits; then one of their two halves differs in at most 1. Anchors of a half are the words of a covering code
of radius 1: the [31, 26] Hamming code on 31 of the bits, all values of the other. Each fingerprint is replicated to
all anchors within radius plus threshold, 2, of its halves (17 each at most) and is at home at its nearest; of two
fingerprints whose halves differ in at most 1, one's home is among the other's anchors. Per anchor, homes are compared
with the fingerprints there, and a spanning path of each local component is given out, so that what is written grows
with the number of fingerprints, not with the pairs of a group.

Copies meet once, as one fingerprint; links, components and fingerprints stay in tables.

Defined results: texts with fewer words than a shingle are one shingle, texts without words (null, empty, blank) have
fingerprint zero and link like any other; long texts are hashed whole, a slice of shingles at a time; repeated rows
are documents of their own; null ids never name a component unless all its ids are null; an empty table gives an
empty result; other columns are passed on by ``deduplicated`` and read by nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import set_links
from folioflow.llm.common import saved
from folioflow.operators.graph import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
SLICE = 1 << 16
#: Compare so many pairs of an anchor at once; larger groups are first split by the bytes of the other half.
PAIRS = 1 << 22
#: Anchors of over about so many fingerprints, by one in ONE_IN of them, are dealt by the other half's bytes; so many such anchors are broadcast.
HOT, ONE_IN, BROADCAST_HOT = 1 << 14, 16, 100_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 bits as a signed number."""
    from xxhash import xxh64_digest

    w = text.encode().translate(_LOWER).split() if text else []
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    first, last = [0, *(ends[: len(w) - shingle] + 1).tolist()] if len(w) > shingle else [0], ends[min(shingle, len(w)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(last), SLICE):
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(first[i : i + SLICE], last[i : i + SLICE], strict=True)])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes(), "big", signed=True)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64 bits by majority over shingles that are given by their hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[i : i + SLICE].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([fingerprint(t, shingle) for t in s], dtype="int64")

    return fp(text)


def _errors() -> list[list[int]]:
    """By syndrome: the patterns of up to 2 bits of a half that turn it into a word of the code; the first leads home."""
    out = []
    for s in range(32):
        one = [0] if s == 0 else [1 << (s - 1)]
        two = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if 0 < i < i ^ s] if s else []
        out.append(one + [one[0] | (1 << 31)] + two)
    return out


def _anchored(fps: DataFrame) -> DataFrame:
    """(k, fp, home): each fingerprint at every anchor within reach; k is the half's number and the anchor."""
    halves = F.array(F.struct(F.lit(0).cast("long").alias("n"), F.shiftrightunsigned("fp", 32).alias("x")), F.struct(F.lit(1).cast("long").alias("n"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("x")))
    d = fps.select("fp", F.explode(halves).alias("half")).select("fp", "half.n", "half.x")
    syndrome = F.lit(0)
    for bit in range(5):  # parity of the places whose number has the bit
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> bit & 1)
        syndrome = syndrome + F.shiftleft(F.bit_count(F.col("x").bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), bit)
    table = F.array(*[F.array(*[F.lit(e).cast("long") for e in row]) for row in _errors()])
    d = d.select("fp", "n", "x", F.posexplode(F.element_at(table, (syndrome + 1).cast("int"))).alias("place", "error"))
    return d.select(F.shiftleft("n", 32).bitwiseOR(F.col("x").bitwiseXOR(F.col("error"))).alias("k"), "fp", (F.col("place") == 0).alias("home"))


def _links(homes: np.ndarray, there: np.ndarray, shift: int, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of a home, places of those it links to)."""
    step = max(1, PAIRS // max(1, len(there)))
    if len(homes) * len(there) <= PAIRS:
        close = np.bitwise_count(there[homes][:, None] ^ there[None, :]) <= distance
        for i, h in enumerate(homes):
            yield h, np.flatnonzero(close[i])
        return
    for byte in range(4):  # the other half differs in at most 3 bits, so one of its 4 bytes is equal
        value = (there >> np.uint64(shift + 8 * byte)) & np.uint64(255)
        for v in np.unique(value[homes]):
            own, part = homes[value[homes] == v], np.flatnonzero(value == v)
            step = max(1, PAIRS // len(part))
            for a in range(0, len(own), step):
                close = np.bitwise_count(there[own[a : a + step]][:, None] ^ there[part][None, :]) <= distance
                for i, h in enumerate(own[a : a + step]):
                    yield h, part[close[i]]


def _paths(there: np.ndarray, home: np.ndarray, k: int, distance: int) -> list[np.ndarray]:
    """Sorted members of each local component of two or more, by union-find."""
    up = np.arange(len(there))

    def roots(x: np.ndarray) -> np.ndarray:
        r = up[x]
        while (up[r] != r).any():
            r = up[r]
        up[x] = r
        return r

    for h, linked in _links(np.flatnonzero(home), there, 0 if k >> 32 == 0 else 32, distance):
        r = roots(np.append(linked, h))
        up[r] = r.min()
    order = np.argsort(roots(np.arange(len(there))), kind="stable")
    names, first, n = np.unique(up[order], return_index=True, return_counts=True)
    return [np.sort(there[order[f : f + m]]) for f, m in zip(first[n > 1], n[n > 1], strict=True)]


def _split(anchored: DataFrame, fps: DataFrame) -> DataFrame:
    """Adds ``s``: 0, or for anchors of over about HOT fingerprints each of the other half's four bytes: of two that link, one byte at least is equal."""
    some = _anchored(fps.where(F.pmod(F.xxhash64("fp", F.lit(99)), F.lit(ONE_IN)) == 0))
    hot = saved(some.groupBy("k").count().where(F.col("count") * ONE_IN > HOT).select(F.col("k").alias("hot")))
    n_hot = hot.count()
    if not n_hot:
        return anchored.withColumn("s", F.lit(0))
    other = F.when(F.shiftright("k", 32) == 0, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32))
    bytes_ = F.array(*[(F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(255)) + 256 * i + 1).cast("int") for i in range(4)])
    d = anchored.join(F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot, F.col("k") == F.col("hot"), "left")
    return d.select("k", "fp", "home", F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(bytes_)).alias("s"))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links whose components are those of all links among distinct fingerprints ``fp``."""
    if not 0 <= distance <= 3:
        raise ValueError("halves that differ in at most 1 bit are sure up to a distance of 3")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def groups(k: np.ndarray, part: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pd.DataFrame:
            at = np.flatnonzero((np.diff(k, prepend=k[:1] - 1) != 0) | (np.diff(part, prepend=part[:1]) != 0))
            sizes, homes = np.diff(at, append=len(k)), np.add.reduceat(home, at) if len(at) else at
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for i in np.flatnonzero((sizes > 1) & (homes > 0)):
                s = slice(at[i], at[i] + sizes[i])
                for p in _paths(fp[s], home[s], int(k[at[i]]), distance):
                    a.append(p[:-1])
                    b.append(p[1:])
            return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)}).drop_duplicates()

        rest: list[tuple] = []  # of the last group, which may go on in the next batch
        for x in batches:
            if len(x):
                new = (x["k"].to_numpy(), x["s"].to_numpy(), x["fp"].to_numpy().view(np.uint64), x["home"].to_numpy().astype(np.int64))
                if rest and new[0][0] == new[0][-1] == rest[-1][0][-1] and new[1][0] == new[1][-1] == rest[-1][1][-1]:
                    rest.append(new)
                    continue
                columns = [np.concatenate(c) for c in zip(*rest, new, strict=True)]
                k, part = columns[:2]
                cut = np.searchsorted(k, k[-1])
                cut += np.searchsorted(part[cut:], part[-1])
                rest = [tuple(c[cut:] for c in columns)]
                if cut:
                    yield groups(*(c[:cut] for c in columns))
        if rest:
            yield groups(*(np.concatenate(c) for c in zip(*rest, strict=True)))

    dealt = _split(_anchored(fps), fps).repartition("k", "s").sortWithinPartitions("k", "s")
    return dealt.mapInPandas(compare, "a long, b long").distinct()


def classes(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of ``docs`` (doc_id, fp)."""
    first = saved(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(links(first.select("fp"), distance).toDF("id1", "id2"))
    linked = saved(linked.join(first, F.col("id") == F.col("fp")).select("fp", "component", "first_id"))
    ids = saved(linked.groupBy("component").agg(F.min("first_id").alias("component_id")).withColumnRenamed("component", "root"))
    named = saved(linked.join(ids, F.col("component") == F.col("root")).select(F.col("fp").alias("v"), "root", "component_id"))
    out = first.join(named, F.col("fp") == F.col("v"), "left")
    return saved(out.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, fingerprint, component_id."""
    d = saved(docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp")))
    c = classes(d).select(F.col("fp").alias("v"), "component_id")
    return d.join(c, F.col("fp") == F.col("v"), "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of ``fp`` that span the SimHash components of ``sets`` (fp, sim): each with the first of its fingerprint, and the firsts of fingerprints that ``links`` gives."""
    first = saved(sets.groupBy("sim").agg(F.min("fp").alias("first")))
    same = sets.select("sim", "fp").join(first, "sim").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = links(first.select(F.col("sim").alias("fp")))
    for v in "ab":
        near = near.join(first.select(F.col("sim").alias(v), F.col("first").alias(f"f{v}")), v)
    return saved(same.union(near.select(F.least("fa", "fb"), F.greatest("fa", "fb"))))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near-duplicates: the one of the smallest id (null last), then the first in the input.

    Near-duplicates have a 5-word Jaccard similarity of 4/5 or more. Fingerprints over the same shingles give the first
    pairs; ``set_links`` verifies these and finds those that differ in more bits.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text"))
    d = saved(packed.select("doc", set_links.keyed(packed, fingerprint_of)("text").alias("x"), F.monotonically_increasing_id().alias("row")).select("doc", "row", "x.*"))
    ids = d.select(F.col("doc.doc_id").alias("doc_id"), "fp", "row")
    sets = saved(d.where("n > 0").groupBy("fp").agg(F.min_by(F.struct("sim", "n", "m", "sketch", "keys"), "row").alias("x"), F.min("row").alias("row")).select("fp", "row", "x.*"))
    roots = set_links.roots(sets, d.select("row", F.col("doc.text").alias("text")), candidates(sets))
    stays = ids.join(roots, F.col("fp") == F.col("v"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x"))
    # the texts are always dealt by row: one plan at every size
    return d.join(saved(stays.select("x.row")).hint("shuffle_merge"), "row", "left_semi").select("doc.*")
