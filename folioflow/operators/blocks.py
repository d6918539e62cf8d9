"""All pairs of signatures, block against block, without listing candidates.

Classes are packed into blocks, of which each pair is one row for a task: no candidate is shuffled or written. In a task
the columns that have a value at a place (or an equal band) are a bitmap, so that 64 pairs are judged by one operation:
bitmaps of bands are united for candidates, bitmaps of places are added up in binary for the number of equal places.
Memory is bounded by the size of two blocks; time grows with the square of the classes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.shared import written

#: Classes of a block at most; blocks are smaller, down to the second figure, while there are fewer than cores.
BLOCK, SMALL = 1 << 15, 1 << 12
#: Columns and rows that are judged at once.
COLUMNS, ROWS = 1 << 12, 64
#: Pairs that a task gives out at once.
GIVEN = 1 << 16


class Block(NamedTuple):
    """Classes by columns: numbers of the values at each place and of the bands, what the numbers stand for, ids, members, groups."""

    places: list[np.ndarray]
    values: list[np.ndarray]
    bands: list[np.ndarray]
    buckets: list[np.ndarray]
    ids: np.ndarray
    members: np.ndarray
    groups: np.ndarray
    names: np.ndarray


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, numbers = np.unique(x, return_inverse=True)
    return values, numbers.ravel().astype(np.uint16 if len(values) < 1 << 16 else np.uint32)


def block(ids, signatures, members, groups, num_bands: int) -> Block:
    s = np.stack(signatures)
    places = [_numbered(s[:, p]) for p in range(s.shape[1])]
    n = s.shape[1] // num_bands
    bands = []
    for b in range(num_bands):
        key = np.stack([places[p][1] for p in range(b * n, b * n + n)], axis=1).astype(np.uint32)
        rows = np.ascontiguousarray(key.astype(">u4")).view(f"V{4 * n}").ravel()  # compares as bytes, by value
        values, numbers = _numbered(rows)
        bands.append((values, numbers))
    names, at = (np.unique(groups, return_inverse=True)) if groups is not None else (np.array([None]), np.zeros(len(s), np.int64))
    return Block([x for _, x in places], [v for v, _ in places], [x for _, x in bands], [v for v, _ in bands], np.asarray(ids, object), np.asarray(members, np.int64), at.ravel().astype(np.uint32), names)


def _found(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each asked value is among the known ones, which are sorted; their number if it is not."""
    at = np.searchsorted(known, asked)
    there = known[np.minimum(at, len(known) - 1)] == asked
    return np.where(there, at, len(known))


class Facing:
    """The numbers of one block's classes in terms of another block's."""

    def __init__(self, rows: Block, columns: Block, places: bool):
        to = [_found(c, r) for c, r in zip(columns.values, rows.values, strict=True)]
        self.places = [t[x] for t, x in zip(to, rows.places, strict=True)] if places else []
        self.bands, n = [], len(to) // len(rows.bands)
        for b, (known, asked, x) in enumerate(zip(columns.buckets, rows.buckets, rows.bands, strict=True)):
            own = asked.view(">u4").reshape(len(asked), n).astype(np.int64)
            mapped = np.stack([to[b * n + i][own[:, i]] for i in range(n)], axis=1)
            there = np.all([mapped[:, i] < len(columns.values[b * n + i]) for i in range(n)], axis=0)
            at = _found(known, np.ascontiguousarray(mapped.astype(">u4")).view(f"V{4 * n}").ravel())
            self.bands.append(np.where(there, at, len(known))[x])
        self.groups = _found(columns.names, rows.names)[rows.groups] if rows.names[0] is not None else rows.groups


class Maps:
    """Bitmaps of some columns by the number of a feature; the first is empty."""

    def __init__(self, features: list[np.ndarray], counts: list[int], n: int):
        self.words, self.local, parts, used = -(-n // 64), [], [], 1
        bit, word = np.uint64(1) << (np.arange(n, dtype=np.uint64) & np.uint64(63)), np.arange(n) >> 6
        for x, count in zip(features, counts, strict=True):
            order = np.argsort(x, kind="stable")
            new = np.diff(x[order].astype(np.int64), prepend=-1) != 0
            rank = np.cumsum(new) - 1
            local = np.zeros(count + 1, np.int64)
            local[x[order][new]] = used + np.arange(int(new.sum()))
            key = rank * self.words + word[order]
            at = np.flatnonzero(np.diff(key, prepend=-1))
            own = np.zeros(int(new.sum()) * self.words, np.uint64)
            own[key[at]] = np.bitwise_or.reduceat(bit[order], at)
            parts.append(own.reshape(-1, self.words))
            used += len(parts[-1])
            self.local.append(local)
        self.bits = np.concatenate([np.zeros((1, self.words), np.uint64), *parts])


class Adder:
    """Adds bitmaps up, as binary digits of the number of those that have a bit; works in buffers of its own."""

    def __init__(self, shape: tuple[int, int]):
        self.shape, self.free, self.levels = shape, [], []

    def buffer(self) -> np.ndarray:
        return self.free.pop() if self.free else np.empty(self.shape, np.uint64)

    def add(self, x: np.ndarray, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        own = self.levels[level]
        own.append(x)
        if len(own) == 3:
            a, b, c = own
            t = self.buffer()
            np.bitwise_xor(a, b, out=t)
            np.bitwise_and(a, b, out=a)
            np.bitwise_and(t, c, out=b)
            np.bitwise_xor(t, c, out=c)
            np.bitwise_or(a, b, out=a)
            self.free += [b, t]
            self.levels[level] = [c]
            self.add(a, level + 1)

    def digits(self) -> list[np.ndarray]:
        """The digits, lowest first; the adder is empty then, and ``release`` takes the buffers back."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) == 2:
                a, b = self.levels[level]
                t = self.buffer()
                np.bitwise_and(a, b, out=t)
                np.bitwise_xor(a, b, out=a)
                self.free.append(b)
                self.levels[level] = [a]
                self.add(t, level + 1)
            level += 1
        out, self.levels = [x[0] if x else None for x in self.levels], []
        return out

    def release(self, *used) -> None:
        self.free += [x for x in used if x is not None]


def at_least(digits: list, n: int, like: np.ndarray) -> np.ndarray:
    """Bitmap of the numbers that are n or more."""
    out = np.full_like(like, np.uint64(0xFFFFFFFFFFFFFFFF))
    if n >= 1 << len(digits):
        out[:] = 0
        return out
    for k, d in enumerate(digits):
        if n >> k & 1:
            out = out & d if d is not None else np.zeros_like(like)
        elif d is not None:
            out = out | d
    return out


class Judge:
    """Judges all pairs of two blocks: of each part, ``found`` is the candidates' bitmap, and ``digits`` their equal places where they are added up."""

    def __init__(self, num_bands: int, least: int, num_hashes: int):
        self.num_bands, self.least = num_bands, least
        clean = num_bands - (num_hashes - least)  # so many bands are equal at least, by pigeonhole
        self.clean = max(1, clean)
        self.places = least > 1 and clean < max(2, num_bands // 4)  # then bands alone say little

    def parts(self, rows: Block, facing: Facing, columns: Block, cut: list[tuple[int, int, Maps]], whole: bool):
        n, by_place = len(rows.ids), self.places or whole
        features = [*(facing.places if by_place else facing.bands), facing.groups]
        per = len(facing.places) // self.num_bands if by_place else 1
        adders: dict = {}
        for start, end, maps in cut:
            at = np.stack([local[x] for local, x in zip(maps.local, features, strict=True)], axis=1)
            for r in range(0, n, ROWS):
                here = np.ascontiguousarray(at[r : r + ROWS].T)
                if not here[-1].any():
                    continue  # no group in common
                adder = adders.setdefault((here.shape[1], maps.words), Adder((here.shape[1], maps.words)))
                found = np.zeros(adder.shape, np.uint64)
                counted = by_place or self.clean > 1
                for b in range(self.num_bands):
                    own = []
                    for p in range(b * per, b * per + per):
                        x = adder.buffer()
                        np.take(maps.bits, here[p], axis=0, out=x, mode="clip")
                        own.append(x)
                    if by_place:
                        t = adder.buffer()
                        np.copyto(t, own[0])
                        for x in own[1:]:
                            np.bitwise_and(t, x, out=t)
                        np.bitwise_or(found, t, out=found)
                        adder.release(t)
                    elif not counted:
                        np.bitwise_or(found, own[0], out=found)
                    for x in own:
                        adder.add(x) if counted else adder.release(x)
                digits = adder.digits() if counted else []
                if by_place:
                    found &= at_least(digits, self.least, found)
                elif counted:
                    found = at_least(digits, self.clean, found)
                found &= maps.bits[here[-1]]
                yield r, start, end, found, digits
                adder.release(*digits)


def _bytes(x: np.ndarray) -> np.ndarray:
    """A bitmap's bits as bytes."""
    return np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")


def _marked(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a bitmap's bits."""
    r, w = np.nonzero(found)
    bits = np.unpackbits(found[r, w].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, c = np.nonzero(bits)
    return r[k], w[k] * 64 + c


class Pairing:
    """Goes over rows of two blocks each; the left block's bitmaps are kept while it stays the same."""

    def __init__(self, num_hashes: int, num_bands: int, least: int, whole: bool = False):
        self.judge, self.whole = Judge(num_bands, least, num_hashes), whole
        self.number, self.columns, self.cut = None, None, []

    def blocks(self, batches: Iterator[pd.DataFrame]):
        by_place = self.judge.places or self.whole
        for batch in batches:
            for a, b, left, right in zip(batch["a"], batch["b"], batch["left"], batch["right"], strict=True):
                if a != self.number:
                    x = self.columns = pickle.loads(left)
                    self.number, self.cut = a, []
                    features = [*(x.places if by_place else x.bands), x.groups]
                    counts = [len(v) for v in [*(x.values if by_place else x.buckets), x.names]]
                    for s in range(0, len(x.ids), COLUMNS):
                        e = min(s + COLUMNS, len(x.ids))
                        self.cut.append((s, e, Maps([f[s:e] for f in features], counts, e - s)))
                rows = pickle.loads(right)
                yield a, b, self.columns, rows, Facing(rows, self.columns, True)


def _pairs(num_hashes: int, num_bands: int, least: int):
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Pairing(num_hashes, num_bands, least)
        for a, b, columns, rows, facing in of.blocks(batches):
            mine, theirs = np.stack(columns.places, axis=1).astype(np.int32), np.stack(facing.places, axis=1).astype(np.int32)
            out, n_out = [], 0
            for r, start, _, found, _ in of.judge.parts(rows, facing, columns, of.cut, False):
                x, y = _marked(found)
                x, y = x + r, y + start
                if a == b:
                    x, y = x[x < y], y[x < y]
                for s in range(0, len(x), GIVEN):
                    i, j = x[s : s + GIVEN], y[s : s + GIVEN]
                    same = np.count_nonzero(theirs[i] == mine[j], axis=1)
                    ok = same >= least
                    i, j, same = i[ok], j[ok], same[ok]
                    if len(i):
                        out.append((i, j, same))
                        n_out += len(i)
                    if n_out >= GIVEN:
                        yield _given(rows, columns, out)
                        out, n_out = [], 0
            if out:
                yield _given(rows, columns, out)

    return pairs


def _given(rows: Block, columns: Block, out: list) -> pd.DataFrame:
    i, j, same = map(np.concatenate, zip(*out, strict=True))
    x, y, nx, ny = rows.ids[i], columns.ids[j], rows.members[i], columns.members[j]
    swap = (x > y).astype(bool)
    return pd.DataFrame({"grp": rows.names[rows.groups[i]], "id1": np.where(swap, y, x), "id2": np.where(swap, x, y), "n1": np.where(swap, ny, nx), "n2": np.where(swap, nx, ny), "same": same})


def _counts(num_hashes: int, num_bands: int):
    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, sums = Pairing(num_hashes, num_bands, 0), {}
        for a, b, columns, rows, facing in of.blocks(batches):
            ids, total = sums.setdefault(b, (rows.ids, np.zeros(len(rows.ids), np.int64)))
            for r, start, end, found, _ in of.judge.parts(rows, facing, columns, of.cut, False):
                n = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
                more = columns.members[start:end] - 1
                heavy = np.flatnonzero(more)
                if len(heavy):
                    w = int(heavy[-1]) // 64 + 1
                    n += (_bytes(np.ascontiguousarray(found[:, :w])).astype(np.float64) @ np.pad(more, (0, 64))[: 64 * w].astype(np.float64)).astype(np.int64)
                total[r : r + len(n)] += n
            if a == b:
                total -= rows.members  # itself
        for ids, total in sums.values():
            yield pd.DataFrame({"id": ids, "other": total})

    return counts


def _histogram(num_hashes: int, num_bands: int, least: int):
    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, total = Pairing(num_hashes, num_bands, least, whole=True), np.zeros(num_hashes + 1, np.int64)
        for a, b, columns, rows, facing in of.blocks(batches):
            own = np.zeros(num_hashes + 1, np.int64)
            for r, start, end, found, digits in of.judge.parts(rows, facing, columns, of.cut, True):
                at = np.flatnonzero(_bytes(found))
                same = np.zeros(len(at), np.uint8 if len(digits) <= 8 else np.int64)
                for k, d in enumerate(digits):
                    if d is not None:
                        same |= _bytes(d).ravel()[at].astype(same.dtype) << k
                n1, n2 = rows.members[r : r + len(found)], columns.members[start:end]
                if n1.max() == 1 and n2.max() == 1:
                    own += np.bincount(same, minlength=num_hashes + 1)
                else:
                    width = 64 * found.shape[1]
                    own += np.bincount(same, weights=n1[at // width] * n2[at % width].astype(np.float64), minlength=num_hashes + 1).astype(np.int64)
            if a == b:
                own[num_hashes] -= int((rows.members**2).sum()) if least <= num_hashes else 0
            total += own * (1 if a == b else 2)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"same": at, "w": total[at]})

    return histogram


class Blocks:
    """The classes (id, signature, members), packed; a class meets only those of its group where groups (a string column ``grp``) are given."""

    def __init__(self, classes: DataFrame, num_hashes: int, num_bands: int, grouped: bool = False):
        self.num_hashes, self.num_bands, self.grouped = num_hashes, num_bands, grouped
        self.kind = classes.schema["id"].dataType.simpleString()
        n, cores = classes.count(), classes.sparkSession.sparkContext.defaultParallelism
        parts = max(1, -(-n // BLOCK), min(cores, -(-n // SMALL)))
        c = classes.where("id is not null")
        c = c.where("grp is not null").repartitionByRange(parts, "grp", "id") if grouped else c.repartition(parts)

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number, rest = TaskContext.get().partitionId() << 24, None
            for batch in batches:
                rest = batch if rest is None else pd.concat([rest, batch])
                while len(rest) >= BLOCK:
                    yield packed(rest[:BLOCK], number)
                    rest, number = rest[BLOCK:], number + 1
            if rest is not None and len(rest):
                yield packed(rest, number)

        def packed(x: pd.DataFrame, number: int) -> pd.DataFrame:
            x = x.sort_values(["grp", "members"] if grouped else ["members"], ascending=[True, False] if grouped else False, kind="stable")
            own = block(x["id"].to_numpy(object), list(x["signature"]), x["members"].to_numpy(), x["grp"].to_numpy(object) if grouped else None, num_bands)
            return pd.DataFrame({"block": [number], "low": [own.names[0]], "high": [own.names[-1]], "data": [pickle.dumps(own, protocol=5)]})

        if grouped:
            c = c.sortWithinPartitions("grp", "id")
        self.rows = written(c.select("id", "signature", "members", *(["grp"] if grouped else [])).mapInPandas(pack, "block long, low string, high string, data binary"), compression="uncompressed")

    def _least(self, threshold: float) -> int:
        return next((k for k in range(self.num_hashes + 1) if k / float(self.num_hashes) >= threshold), self.num_hashes + 1)

    def _facing(self, once: bool) -> DataFrame:
        a, b = (self.rows.select(F.col("block").alias(x), F.col("data").alias(y), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x, y in (("a", "left"), ("b", "right")))
        both = a.crossJoin(b)  # rows of whole blocks
        both = both.where("a <= b") if once else both
        both = both.where("low_a <= high_b and low_b <= high_a") if self.grouped else both
        return both.select("a", "b", "left", "right")

    def pairs(self, threshold: float) -> DataFrame:
        """(grp, id1, id2, n1, n2, same): pairs of classes, id1 < id2, that share a band, with at least the threshold of places equal."""
        found = self._facing(True).mapInPandas(_pairs(self.num_hashes, self.num_bands, self._least(threshold)), f"grp string, id1 {self.kind}, id2 {self.kind}, n1 long, n2 long, same long")
        return found.withColumn("similarity", F.col("same") / F.lit(float(self.num_hashes)))

    def counts(self) -> DataFrame:
        """(id, other): of each class the members of other classes that share a band."""
        found = self._facing(False).mapInPandas(_counts(self.num_hashes, self.num_bands), f"id {self.kind}, other long")
        return found.groupBy("id").agg(F.sum("other").alias("other"))

    def histogram(self, threshold: float) -> DataFrame:
        """(similarity, w): ordered pairs of members of two classes that share a band, by the places that are equal."""
        found = self._facing(True).mapInPandas(_histogram(self.num_hashes, self.num_bands, self._least(threshold)), "same long, w long")
        return found.groupBy((F.col("same") / F.lit(float(self.num_hashes))).alias("similarity")).agg(F.sum("w").alias("w"))
