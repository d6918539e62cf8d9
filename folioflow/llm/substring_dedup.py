"""Substring deduplication with a log-structured index of window fingerprints.

A window is 35 consecutive words of a text. Two equal windows hold the same 8-word grams, so their smallest gram by
hash (the leftmost on ties), the windows' anchor, is the same gram at the same place in them. The index holds anchors
in place of windows: about one for every 14 words; a window can only repeat if its anchor does.

The index lives in a folder and grows batch by batch: ``append`` writes a batch's anchors by document, and one immutable
run of them by fingerprint, bucketed and sorted, with occurrences (up to 2) and the range of their stretches' hashes. The
new run is merge-joined with every older one, bucket by bucket and without a shuffle of either, to find the fingerprints
that history and batch share; more than ``FAN_IN`` runs are compacted into one by outer merge joins. ``save`` and
``load`` carry the index from process to process. Batches may come in any order and number: the result is that of all
documents at once.

Verification looks at the occurrences of repeated anchors. Where the stretch of words that all windows of an anchor
cover is equal to another's, those windows repeat. Where stretches of one anchor differ, their windows are compared
one by one (of equal stretches one stands for all), by two 64-bit hashes over all words that share nothing. Documents
of earlier batches are read again only for places that such an anchor needs, so a later batch can be judged alone.

Defined results: a null or blank text has no words; a text of fewer than 35 words has no window; windows of one text
and of repeated rows repeat like any other; long texts are processed whole; an empty table gives an empty result; rows
are told apart by id (null is an id) and a hash of the text; of other columns none is read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folioflow.llm.common import saved
from folioflow.operators.shared import shared_folder

WINDOW, GRAM = 35, 8
FAN_IN, BATCHES = 2, 3
#: Odd bases of the two polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hash of any stretch of a text's words, from one running sum; powers are kept between texts."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, words: list[bytes], base: int = BASES[0]):
        from xxhash import xxh3_64_intdigest

        n = len(words)
        if base not in self._powers or len(self._powers[base][0]) < n:
            size = 1 << max(12, n.bit_length())
            up = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
            self._powers[base] = (up(base), up(pow(base, -1, 1 << 64)))
        power, self.inverse = self._powers[base]
        seed = 0 if base == BASES[0] else base  # the second hash has word hashes of its own
        h = np.fromiter((xxh3_64_intdigest(w, seed) for w in words) if seed else map(xxh3_64_intdigest, words), np.uint64, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[first]) * self.inverse[first])


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: fingerprint, hash of its stretch, its first window, and how many windows (at most 28) it has."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.int32), none.astype(np.int32)
    hashes, at = Hashes(words), np.arange(len(words) - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    place = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).argmin(1) + np.arange(n)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    end = np.append(first[1:], n)
    anchor = place[first]
    shape = ((anchor - first) << 8 | (end - first)).astype(np.uint64)
    stretch = _mix(hashes.of(first, end - 1 + WINDOW) ^ _mix(shape))
    return grams[anchor].view(np.int64), stretch.view(np.int64), first.astype(np.int32), (end - first).astype(np.int32)


def _split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _anchors(text: str) -> Column:
    @F.pandas_udf("h array<long>, u array<long>, first array<int>, n array<int>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([anchors(_split(t)) for t in s], columns=["h", "u", "first", "n"])

    return find(F.col(text))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and th: a hash of the text that tells rows of one id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def anchored(docs: DataFrame) -> DataFrame:
    """doc_id, th and the struct of arrays a of every row's anchors."""
    return _keyed(docs).select("doc_id", "th", _anchors("text").alias("a"))


class FingerprintIndex:
    """Log-structured index of anchors: runs (h, n, lo, hi) as bucketed tables, the anchors of each batch by document, and the fingerprints found to repeat."""

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.found: list[str] = []
        self.shared: list[str] = []
        self.schema: list[str] = []  # of the anchors, as JSON

    def _path(self, kind: str) -> str:
        return f"{shared_folder(self.spark)}/index-{kind}-{uuid.uuid4().hex}"

    def _run(self, path: str) -> DataFrame:
        """A run as a table that knows its buckets; runs of other processes are registered first."""
        name = "run_" + path.rsplit("-", 1)[-1]
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (h BIGINT, n INT, lo BIGINT, hi BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _write_run(self, rows: DataFrame) -> str:
        path = self._path("run")
        rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).option("compression", "zstd").saveAsTable("run_" + path.rsplit("-", 1)[-1], format="parquet")
        return path

    def _write(self, kind: str, rows: DataFrame) -> str:
        path = self._path(kind)
        rows.write.option("compression", "zstd").parquet(path)
        return path

    def append(self, found: DataFrame) -> None:
        """Index one batch: the rows of ``anchored``."""
        found = found.select("doc_id", "th", "a")
        self.schema = [found.schema.json()]
        self._add(self._write("found", found))

    def append_all(self, found: DataFrame, batches: int) -> None:
        """Index the rows of ``anchored``, with a column ``batch``, one batch after the other; they are written once."""
        path, self.schema = self._path("found"), [found.drop("batch").schema.json()]
        found.write.option("compression", "zstd").partitionBy("batch").parquet(path)
        for k in range(batches):
            self._add(f"{path}#{k}")

    def _read(self, found: str) -> DataFrame:
        """The anchors at a path, or of one batch of it."""
        path, _, batch = found.partition("#")
        own = StructType.fromJson(json.loads(self.schema[0]))
        if not batch:
            return self.spark.read.schema(own).parquet(path)
        return self.spark.read.schema(StructType([*own.fields, StructField("batch", IntegerType())])).parquet(path).where(F.col("batch") == int(batch)).drop("batch")

    def _add(self, found: str) -> None:
        self.found.append(found)
        rows = self._read(found).select(F.explode(F.arrays_zip("a.h", "a.u")).alias("x")).select("x.*")
        counts = rows.groupBy("h").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi"))
        new = self._write_run(counts)
        self.shared.append(self._write("shared", self._run(new).where("n > 1").select("h", "lo", "hi")))
        for old in self.runs:
            both = self._run(new).alias("x").join(self._run(old).alias("y").hint("merge"), "h")
            self.shared.append(self._write("shared", both.select("h", F.least("x.lo", "y.lo").alias("lo"), F.greatest("x.hi", "y.hi").alias("hi"))))
        self.runs.append(new)
        if len(self.runs) > FAN_IN:
            self.compact()

    def compact(self) -> None:
        """All runs as one, by outer merge joins; what repeats is written down as one table."""
        self.shared = [self._write("shared", self.repeated())]
        merged = self._run(self.runs[0])
        for path in self.runs[1:]:
            both = merged.alias("x").join(self._run(path).alias("y").hint("merge"), "h", "full_outer")
            n = F.least(F.coalesce("x.n", F.lit(0)) + F.coalesce("y.n", F.lit(0)), F.lit(2)).cast("int")
            merged = both.select("h", n.alias("n"), F.least("x.lo", "y.lo").alias("lo"), F.greatest("x.hi", "y.hi").alias("hi"))
        self.runs = [self._write_run(merged)]

    def repeated(self) -> DataFrame:
        """(h, lo, hi): fingerprints that occur twice or more in all that was appended, and the range of their stretches."""
        return _union([self.spark.read.parquet(p) for p in self.shared]).groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def anchors(self, first: int = 0, end: int | None = None) -> DataFrame | None:
        """The anchors by document of some batches."""
        parts = self.found[first:end]
        return _union([self._read(x) for x in parts]) if parts else None

    def save(self, path: str) -> None:
        """Write down which tables the index has."""
        rows = [(kind, k, p, self.buckets) for kind in ("schema", "runs", "found", "shared") for k, p in enumerate(getattr(self, kind))]
        self.spark.createDataFrame(rows, "kind string, k int, path string, buckets int").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        rows = spark.read.schema("kind string, k int, path string, buckets int").json(path).orderBy("k").collect()
        index = cls(spark, rows[0]["buckets"] if rows else None)
        for r in rows:
            getattr(index, r["kind"]).append(r["path"])
        return index


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _pack(first: Column, n: Column) -> Column:
    return F.shiftleft(first.cast("long"), 8).bitwiseOR(n.cast("long"))


def _occurrences(found: DataFrame, old: bool) -> DataFrame:
    """(h, u, old, doc_id, th, at) of every anchor."""
    x = found.select("doc_id", "th", F.explode(F.arrays_zip("a.h", "a.u", "a.first", "a.n")).alias("x"))
    return x.select(F.col("x.h").alias("h"), F.col("x.u").alias("u"), F.lit(old).alias("old"), "doc_id", "th", _pack(F.col("x.first"), F.col("x.n")).alias("at"))


def suspects(index: FingerprintIndex, first: int = 0) -> DataFrame:
    """Per row (old, doc_id, th) with repeated anchors: stretches (packed) that repeat, that are to check, and that stand for their equals.

    Rows of batches before ``first`` are history: they have only what the others are compared with.
    """
    repeated = saved(index.repeated().select("h", (F.col("lo") < F.col("hi")).alias("mixed")))
    rows = saved(_occurrences(index.anchors(first), False).join(repeated, "h"))
    differing, history = rows.where("mixed").drop("mixed"), index.anchors(0, first) if first else None
    if history is not None:
        differing = saved(differing.union(_occurrences(history, True).join(repeated.where("mixed").select("h"), "h", "left_semi")))
    kinds = saved(differing.groupBy("h", "u").agg(F.count("*").alias("n"), F.min(F.struct("old", "doc_id", "th", "at")).alias("one")))
    k = kinds.select(F.col("h").alias("h2"), F.col("u").alias("u2"), "n")
    place = ["old", "doc_id", "th", "at"]
    new = differing.where("not old").join(k, (F.col("h") == F.col("h2")) & (F.col("u") == F.col("u2")))
    found = rows.where("not mixed").select(*place, F.lit("sure").alias("kind"))
    found = found.union(new.select(*place, F.when(F.col("n") > 1, "sure").otherwise("check").alias("kind")))
    found = found.union(kinds.where("n > 1").select("one.*", F.lit("stand").alias("kind")))
    if history is not None:
        found = found.union(kinds.where("n = 1 and one.old").select("one.*", F.lit("check").alias("kind")))
    return found.groupBy("old", "doc_id", "th").agg(*[F.collect_set(F.when(F.col("kind") == c, F.col("at"))).alias(c) for c in ("sure", "check", "stand")])


def _starts(packed) -> np.ndarray:
    """Window starts of packed stretches."""
    p = np.asarray([] if packed is None else packed, np.int64)
    n = p & 255
    return np.repeat(p >> 8, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _marked(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n words the windows at these starts cover."""
    edge = np.zeros(n + WINDOW + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge)[:n] > 0


def _finished(words: list[bytes], starts: np.ndarray, keep_text: bool) -> tuple:
    gone = _marked(len(words), starts)
    kept = b" ".join(compress(words, ~gone))
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None


DONE = "n_words long, n_removed long, kept_sha256 string, kept string"


def _looker(keep_text: bool):
    @F.pandas_udf(f"done struct<{DONE.replace(' ', ': ').replace(',: ', ', ')}>, text string, start array<int>, h1 array<long>, h2 array<long>, weight array<int>")
    def look(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, sure, check, stand in columns:
            done, rest = [], []
            for t, a, b, c in zip(texts, sure, check, stand, strict=True):
                w = _split(t)
                asked, standing = _starts(b), _starts(c)
                s = np.concatenate([asked, standing])
                if len(s):
                    one, two = (Hashes(w, base).of(s, s + WINDOW).view(np.int64) for base in BASES)
                    weight = np.repeat([1, 2], [len(asked), len(standing)])
                    rest.append((t, s.astype(np.int32), one, two, weight.astype(np.int32)))
                else:
                    rest.append((None, None, None, None, None))
                done.append((0, 0, None, None) if len(asked) else _finished(w, _starts(a), keep_text))
            out = pd.DataFrame(rest, columns=["text", "start", "h1", "h2", "weight"])
            out.insert(0, "done", [dict(zip(("n_words", "n_removed", "kept_sha256", "kept"), x, strict=True)) for x in done])
            yield out

    return look


def _finisher(keep_text: bool):
    @F.pandas_udf(DONE)
    def finish(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, sure, found in columns:
            rows = [_finished(_split(t), np.concatenate([_starts(a), np.asarray([] if b is None else b, np.int64)]), keep_text) for t, a, b in zip(texts, sure, found, strict=True)]
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept"])

    return finish


def without_repeats(docs: DataFrame, index: FingerprintIndex, first: int = 0, history: DataFrame | None = None, keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and (keep_text) the kept words.

    ``docs`` are the documents of the index's batches from ``first`` on, ``history`` those of the batches before; they
    are judged by all that the index holds.
    """
    if (history is not None) != bool(first):
        raise ValueError("history are the documents of the batches before the first that is judged")
    s = saved(suspects(index, first))
    d = _keyed(docs).alias("d").join(s.where("not old").alias("s"), _same("d", "s"), "left").select("d.*", "s.sure", "s.check", "s.stand")
    asked = F.size(F.coalesce("check", F.array().cast("array<long>"))) > 0
    d = saved(d.select("doc_id", "th", F.when(asked, F.col("sure")).alias("sure"), asked.alias("asked"), _looker(keep_text)("text", "sure", "check", "stand").alias("x")))
    hashed = lambda x: x.where("x.start is not null").select("doc_id", "th", F.explode(F.arrays_zip("x.start", "x.h1", "x.h2", "x.weight")).alias("w")).select("doc_id", "th", "w.*")
    windows, others = hashed(d), []
    if history is not None:  # a place of the index stands in one of the rows of its id and text
        o = _keyed(history).alias("d").join(s.where("old").alias("s"), _same("d", "s")).select("d.*", "s.sure", "s.check", "s.stand").dropDuplicates(["doc_id", "th"])
        others = [saved(hashed(o.select("doc_id", "th", _looker(False)("text", "sure", "check", "stand").alias("x"))))]
    twice = saved(_union([windows, *others]).groupBy("h1", "h2").agg(F.sum("weight").alias("n")).where("n > 1").select("h1", "h2"))
    starts = windows.where("weight = 1").join(twice, ["h1", "h2"], "left_semi").groupBy("doc_id", "th").agg(F.collect_set("start").alias("start"))
    rest = d.where("asked").select("doc_id", "th", "sure", F.col("x.text").alias("text")).alias("d").join(starts.alias("s"), _same("d", "s"), "left")
    rest = rest.select(F.col("d.doc_id").alias("doc_id"), _finisher(keep_text)("d.text", "d.sure", "s.start").alias("done"))
    columns = ["doc_id", "done.n_words", "done.n_removed", "done.kept_sha256", *(["done.kept"] if keep_text else [])]
    return d.where("not asked").select("doc_id", F.col("x.done").alias("done")).unionByName(rest).select(*columns)


def digest(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The contract's rows; the documents are indexed in batches, by a hash of their ids, of which texts are read once."""
    index = FingerprintIndex(docs.sparkSession)
    index.append_all(anchored(docs.select("doc_id", "text")).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), batches)
    return without_repeats(docs, index, keep_text=False)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE g IN (SELECT g FROM rep)),
wrd AS (SELECT doc_id, w[p] AS x, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM wrd ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
