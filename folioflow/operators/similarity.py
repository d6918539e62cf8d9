"""Similarity search: exact Jaccard, MinHash signatures, banded locality-sensitive hashing, duplicate groups.

Texts whose signatures are equal are one class for all that follows: only class representatives (their smallest ids)
meet in bands, so that a group of copies costs one row, not its square; pairs of documents list the members again.
Classes meet block by block (``blocks``), so that candidates are neither shuffled nor written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.hashing import MINHASH_EMPTY, MINHASH_MODULUS, minhash_coefficients
from folioflow.functions.text import char_shingles, jaccard, positioned_shingles, text_or_empty, word_shingles
from folioflow.operators import set_join
from folioflow.operators import shingles as numbered
from folioflow.operators.blocks import Blocks
from folioflow.operators.graph import components, forest
from folioflow.operators.shared import written

#: Bytes of the numbers of shingles that a worker remembers.
REMEMBERED = 64 << 20
#: Members of a class that a task pairs at once with those of another.
MEMBERS = 256


def full_text() -> Column:
    return F.concat(text_or_empty(F.col("title")), F.lit(" "), text_or_empty(F.col("content")))


def shingled(docs: DataFrame, k: int = 3, mode: str = "char", text: Column | None = None) -> DataFrame:
    """(id, shingles): distinct shingles of each document."""
    if mode not in ("char", "word"):
        raise ValueError(f"unknown mode {mode}")
    t = full_text() if text is None else text
    # the generator makes a column of the set, computed once whatever is done with it
    return docs.select(F.col("_id").alias("id"), F.explode(F.array(char_shingles(t, k) if mode == "char" else word_shingles(t, k))).alias("shingles"))


def position_counts(docs: DataFrame, k: int = 3, text: Column | None = None) -> DataFrame:
    """(shingle, n, last): how often each shingle occurs in all documents, and its last position in any."""
    if k > numbered.LONGEST:
        return positions(docs, k, text).groupBy("shingle").agg(F.count("*").alias("n"), F.max("position").cast("long").alias("last"))
    return numbered.run_counts(docs, full_text() if text is None else text, k)


def positions(docs: DataFrame, k: int = 3, text: Column | None = None) -> DataFrame:
    """(id, shingle, position)."""
    return docs.select(F.col("_id").alias("id"), F.explode(positioned_shingles(full_text() if text is None else text, k)).alias("x")).select("id", "x.shingle", "x.position")


def shingle_statistics(sets: DataFrame) -> DataFrame:
    """One row: documents, distinct shingles over all, mean, least and most shingles of a document."""
    sizes = sets.agg(F.count("*").alias("num_documents"), F.avg(F.size("shingles")).alias("avg_shingles_per_doc"), F.min(F.size("shingles")).alias("min_shingles"), F.max(F.size("shingles")).alias("max_shingles"))
    return sizes.crossJoin(sets.select(F.explode("shingles").alias("s")).agg(F.count_distinct("s").alias("total_unique_shingles")))  # one row each


def text_shingle_statistics(docs: DataFrame, k: int = 3, text: Column | None = None) -> DataFrame:
    """``shingle_statistics`` of documents' character shingles, without the sets."""
    if k > numbered.LONGEST:
        return shingle_statistics(shingled(docs, k, "char", text))
    sizes, distinct = numbered.set_sizes(docs, full_text() if text is None else text, k)
    s = sizes.agg(F.count("*").alias("num_documents"), F.avg("n").alias("avg_shingles_per_doc"), F.min("n").cast("int").alias("min_shingles"), F.max("n").cast("int").alias("max_shingles"))
    return s.crossJoin(distinct)  # one row each


def similarity_to(sets: DataFrame, doc_id: str, threshold: float = 0.5, top: int = 10) -> DataFrame:
    """(id, similarity): documents nearest to one, by exact Jaccard similarity; one scan, no shuffle but for the top."""
    one = sets.where(F.col("id") == doc_id).select(F.col("shingles").alias("own")).limit(1)
    s = sets.where(F.col("id") != doc_id).crossJoin(F.broadcast(one)).select("id", jaccard(F.col("own"), F.col("shingles")).alias("similarity"))  # one row is broadcast
    return s.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(top)


def jaccard_pairs(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id1, id2, similarity): all pairs of at least the threshold (over 0), exactly, by prefix filtering.

    Shingles are ordered by rarity; of similar sets, the rarest 1 - threshold of each (and one) must meet. Copies
    (equal sets) meet once, as their smallest id; ``set_classes`` gives their members.
    """
    if threshold <= 0:
        raise ValueError("pairs without a common shingle are not searched for: the threshold must be over 0")
    d = written(set_classes(sets).where("id = class_id").select("id", "shingles").where(F.size("shingles") > 0))
    numbers = written(d.select("id", F.size("shingles").alias("n"), F.transform("shingles", lambda s: F.xxhash64(s)).alias("numbers")))  # candidates meet by number, texts decide
    counts = numbers.select(F.explode("numbers").alias("s")).groupBy("s").agg(F.count("*").alias("f"))
    ranked = numbers.select("id", "n", F.explode("numbers").alias("s")).join(counts, "s")
    place = F.row_number().over(Window.partitionBy("id").orderBy("f", "s"))
    prefix = written(ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("id", "n", "s"))
    a, b = prefix.select(F.col("id").alias("id1"), F.col("n").alias("n1"), "s"), prefix.select(F.col("id").alias("id2"), F.col("n").alias("n2"), "s")
    near = a.join(b, "s").where((F.col("id1") < F.col("id2")) & (F.col("n2") >= F.col("n1") * threshold) & (F.col("n1") >= F.col("n2") * threshold)).select("id1", "id2").distinct()
    x = near.join(d.select(F.col("id").alias("id1"), F.col("shingles").alias("s1")), "id1").join(d.select(F.col("id").alias("id2"), F.col("shingles").alias("s2")), "id2")
    return x.select("id1", "id2", jaccard(F.col("s1"), F.col("s2")).alias("similarity")).where(F.col("similarity") >= threshold)


def set_classes(sets: DataFrame) -> DataFrame:
    """(id, shingles, class_id): sets with their class, the smallest id of those that are equal."""
    s = sets.withColumn("h", F.sha2(F.array_join(F.sort_array("shingles"), "\x01"), 256))
    least = s.groupBy("h").agg(F.min("id").alias("class_id"))
    return s.join(least, "h").select("id", "shingles", "class_id")


def text_jaccard_pairs(docs: DataFrame, threshold: float = 0.5, k: int = 5, text: Column | None = None) -> DataFrame:
    """``jaccard_pairs`` of documents' word shingles; keys and sizes are shuffled, texts only of what meets."""
    if threshold <= 0:
        raise ValueError("pairs without a common shingle are not searched for: the threshold must be over 0")
    return set_join.pairs(docs, full_text() if text is None else text, k, threshold)


def text_set_classes(docs: DataFrame, k: int = 5, text: Column | None = None) -> DataFrame:
    """(id, class_id): ``set_classes`` of documents' word shingles, without the sets."""
    return set_join.set_classes(docs, full_text() if text is None else text, k)


class Signer:
    """MinHash signatures of shingle sets in numpy; the numbers of a shingle under all functions are remembered, as 32 bits each."""

    def __init__(self, num_hashes: int, seed: int = 42):
        ab = np.array(minhash_coefficients(num_hashes, seed), np.uint64)
        self.a, self.b, self.m, self.known = ab[:, :1], ab[:, 1:], np.uint64(MINHASH_MODULUS), {}
        self.rows = np.zeros((0, num_hashes), np.uint32)
        self.most = max(4096, REMEMBERED // (4 * num_hashes))

    def _remember(self, shingles: list[str]) -> None:
        x = np.array([int(hashlib.md5(s.encode()).hexdigest(), 16) % MINHASH_MODULUS for s in shingles], np.uint64)[None, :]
        n = len(self.known)
        if n + len(shingles) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(len(shingles), len(self.rows), 4096), len(self.a)), np.uint32)])
        self.rows[n : n + len(shingles)] = (((self.a * x) % self.m + self.b) % self.m).astype(np.uint32).T
        self.known.update(zip(shingles, range(n, n + len(shingles)), strict=True))

    def signature(self, shingles) -> np.ndarray:
        if not len(shingles):
            return np.full(len(self.a), MINHASH_EMPTY, np.int64)
        least = None
        for i in range(0, len(shingles), 4096):
            part = list(shingles[i : i + 4096])
            new = list(dict.fromkeys(s for s in part if s not in self.known))
            if len(self.known) + len(new) > self.most:
                self.known, new = {}, list(dict.fromkeys(part))
            if new:
                self._remember(new)
            own = self.rows[[self.known[s] for s in part]].min(0)
            least = own if least is None else np.minimum(least, own)
        return least.astype(np.int64)


def signatures(sets: DataFrame, num_hashes: int = 100, seed: int = 42) -> DataFrame:
    """(id, signature)."""

    @F.pandas_udf("array<long>")
    def sign(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        signer = Signer(num_hashes, seed)
        for s in columns:
            yield pd.Series([signer.signature(x if x is not None else []) for x in s], dtype=object)

    return sets.select("id", sign("shingles").alias("signature"))


def text_signatures(docs: DataFrame, num_hashes: int = 100, k: int = 3, seed: int = 42, text: Column | None = None) -> DataFrame:
    """(id, signature) of documents by their character shingles: ``signatures`` of ``shingled``, without the sets."""
    if k > numbered.LONGEST:
        return signatures(shingled(docs, k, "char", text), num_hashes, seed)
    return numbered.text_signatures(docs, full_text() if text is None else text, num_hashes, k, seed)


def signature_similarity(a: Column, b: Column, num_hashes: int) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(num_hashes))


def minhash_pair_similarity(signed: DataFrame, id1: str, id2: str, num_hashes: int = 100) -> DataFrame:
    """One row: the estimated similarity of two documents by id, 0 if one is unknown."""
    own = lambda x: F.max(F.when(F.col("id") == x, F.struct("signature")))
    both = signed.where(F.col("id").isin(id1, id2)).agg(own(id1).alias("a"), own(id2).alias("b"))
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.select(F.coalesce(F.when(there, signature_similarity(F.col("a.signature"), F.col("b.signature"), num_hashes)), F.lit(0.0)).alias("similarity"))


def minhash_similar_to(signed: DataFrame, doc_id: str, num_hashes: int = 100, threshold: float = 0.5, top: int = 10) -> DataFrame:
    one = signed.where(F.col("id") == doc_id).select(F.col("signature").alias("own")).limit(1)
    s = signed.where(F.col("id") != doc_id).crossJoin(F.broadcast(one)).select("id", signature_similarity(F.col("own"), F.col("signature"), num_hashes).alias("similarity"))  # one row
    return s.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(top)


def minhash_statistics(sets: DataFrame, num_hashes: int = 100) -> DataFrame:
    """One row: documents, signature size, kilobytes of signatures (8 bytes a number) and of shingles (50 bytes each), ratio."""
    s = sets.agg(F.count("*").alias("num_documents"), F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("shingles"))
    own, full = F.col("num_documents") * num_hashes * 8, F.col("shingles") * 50
    return s.select("num_documents", F.lit(num_hashes).cast("long").alias("signature_size"), (own / 1024).alias("space_signatures_kb"), (full / 1024).alias("space_original_kb"), F.coalesce(F.try_divide(full, own), F.lit(0.0)).alias("compression_ratio"))


class LshIndex:
    """Banded index of signatures: classes of equal signatures, and their representatives' bands."""

    def __init__(self, signed: DataFrame, num_hashes: int = 100, num_bands: int = 20):
        if num_hashes % num_bands:
            raise ValueError("the number of hashes must be a multiple of the number of bands")
        self.num_hashes, self.num_bands, self.rows = num_hashes, num_bands, num_hashes // num_bands
        key = F.sha2(F.array_join("signature", ","), 256)
        self.signed = written(signed.withColumn("k", key))
        self.least = self.signed.groupBy("k").agg(F.min("id").alias("class_id"), F.count("*").alias("members"))
        self.members = written(self.signed.select("id", "k").join(self.least, "k").select("id", "class_id", "members"))

    @cached_property
    def classes(self) -> DataFrame:
        """(id, signature, members) of the representatives."""
        return written(self.signed.join(self.least.select("k", F.col("class_id").alias("id"), "members"), ["k", "id"]).dropDuplicates(["k"]).select("id", "signature", "members"))

    @cached_property
    def blocks(self) -> Blocks:
        return Blocks(self.classes, self.num_hashes, self.num_bands)

    def bands(self) -> DataFrame:
        """(id, members, band, bucket)."""
        cut = F.transform(F.sequence(F.lit(0), F.lit(self.num_bands - 1)), lambda i: F.xxhash64(F.slice(F.col("signature"), i * self.rows + 1, self.rows)))
        return self.classes.select("id", "members", F.posexplode(cut).alias("band", "bucket"))

    def candidates(self) -> DataFrame:
        """(id1, id2) of representatives that share a bucket, each pair once."""
        return self.blocks.pairs(0.0).select("id1", "id2")

    def class_pairs(self, threshold: float = 0.5) -> DataFrame:
        """(id1, n1, id2, n2, similarity): pairs of representatives by signature similarity, with their classes' members."""
        return self.blocks.pairs(threshold).select("id1", "n1", "id2", "n2", "similarity")

    def pairs(self, threshold: float = 0.5) -> DataFrame:
        """(id1, id2, similarity): pairs of documents that share a bucket, by signature similarity; copies are pairs of 1."""
        p = written(self.class_pairs(threshold))
        parts = lambda n: F.ceil(n / MEMBERS)  # noqa: E731 - large classes are dealt in parts
        m = self.members.select("class_id", F.col("id").alias("d"), "members", F.pmod(F.xxhash64("id"), parts(F.col("members"))).alias("part"))
        x = p.where("n1 > 1 or n2 > 1")
        for k in "12":
            x = x.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts(F.col(f"n{k}")) - 1)))
            x = x.join(m.select(F.col("class_id").alias(f"id{k}"), "part", F.col("d").alias(f"d{k}")), [f"id{k}", "part"]).drop("part")
        a = m.where("members > 1").select("class_id", "part", F.col("d").alias("d1"))
        b = m.where("members > 1").select("class_id", F.col("d").alias("d2"), F.explode(F.sequence(F.lit(0).cast("long"), parts(F.col("members")) - 1)).alias("part"))
        own = a.join(b, ["class_id", "part"]).where("d1 < d2").select("d1", "d2", F.lit(1.0).alias("similarity"))
        several = x.select(F.least("d1", "d2"), F.greatest("d1", "d2"), "similarity")
        return p.where("n1 = 1 and n2 = 1").select("id1", "id2", "similarity").union(several).union(own.where(F.lit(1.0) >= threshold))

    def exact_pairs(self, sets: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Candidates verified by exact Jaccard similarity."""
        x = self.candidates().join(sets.select(F.col("id").alias("id1"), F.col("shingles").alias("s1")), "id1").join(sets.select(F.col("id").alias("id2"), F.col("shingles").alias("s2")), "id2")
        return x.select("id1", "id2", jaccard(F.col("s1"), F.col("s2")).alias("similarity")).where(F.col("similarity") >= threshold)

    def _linked(self, threshold: float) -> tuple[DataFrame, DataFrame]:
        """(id, component) of linked classes, and (id, w): pairs of documents between classes, of which each task gives sums only."""
        found = written(forest(self.class_pairs(threshold).select("id1", "id2", (F.col("n1") * F.col("n2")).alias("w"))))
        return components(found.where("id1 <> id2").select("id1", "id2")), found.where("w > 0").groupBy(F.col("id1").alias("id")).agg(F.sum("w").alias("w"))

    def groups(self, threshold: float = 0.9) -> DataFrame:
        """(id, component) of every document with a duplicate: connected classes, named by their smallest id."""
        linked, _ = self._linked(threshold)
        x = self.members.join(linked.withColumnRenamed("id", "class_id"), "class_id", "left")
        return x.where("component is not null or members > 1").select("id", F.coalesce("component", "class_id").alias("component"))

    def candidate_counts(self) -> DataFrame:
        """(id, candidates) of every document: others that share one of its buckets."""
        x = self.members.join(self.blocks.counts().withColumnRenamed("id", "class_id"), "class_id", "left")
        return x.select("id", (F.coalesce("other", F.lit(0)) + F.col("members") - 1).alias("candidates"))

    def statistics(self) -> DataFrame:
        """One row: documents, bands, rows, buckets, mean bucket, mean candidates of a document, theoretical threshold."""
        buckets = self.bands().groupBy("band", "bucket").agg(F.sum("members").alias("n")).agg(F.count("*").alias("total_buckets"), F.avg("n").alias("avg_bucket_size"))
        c = self.candidate_counts().agg(F.count("*").alias("num_documents"), F.avg("candidates").alias("avg_candidates_per_doc"))
        limit = (1 / self.num_bands) ** (1 / self.rows)
        return c.crossJoin(buckets).select("num_documents", F.lit(self.num_bands).cast("long").alias("num_bands"), F.lit(self.rows).cast("long").alias("rows_per_band"), "total_buckets", "avg_bucket_size", "avg_candidates_per_doc", F.lit(limit).alias("theoretical_threshold"))  # one row each

    def savings(self) -> DataFrame:
        """One row: all pairs, estimated comparisons, reduction in percent, speed-up (null without candidates)."""
        c = self.candidate_counts().agg(F.count("*").alias("n"), F.coalesce(F.sum("candidates"), F.lit(0)).cast("double").alias("estimated_comparisons"))
        total = F.col("n") * (F.col("n") - 1) / 2
        return c.select(total.alias("total_pairs"), "estimated_comparisons", ((1 - F.try_divide(F.col("estimated_comparisons"), total)) * 100).alias("reduction_percent"), F.try_divide(total, F.col("estimated_comparisons")).alias("speedup"))

    def pairs_with_members(self, threshold: float) -> DataFrame:
        """(id1, n1, id2, n2, similarity): pairs of classes, and classes of several members with themselves."""
        own = self.classes.where("members > 1").select(F.col("id").alias("id1"), F.col("members").alias("n1"), F.col("id").alias("id2"), F.col("members").alias("n2"), F.lit(1.0).alias("similarity"))
        return self.class_pairs(threshold).union(own)

    def distribution(self, threshold: float = 0.1) -> DataFrame:
        """One row about the similarity of all documents' pairs over the threshold, both directions: count, mean, median, sample deviation, range."""
        own = self.classes.where("members > 1").select(F.lit(1.0).alias("similarity"), (F.col("members") * (F.col("members") - 1)).alias("w"))
        d = written(self.blocks.histogram(threshold).union(own).groupBy("similarity").agg(F.sum("w").alias("w")))  # at most num_hashes + 1 rows
        s, n = F.col("similarity"), F.sum("w")
        mean = F.sum(s * F.col("w")) / n
        variance = (F.sum(s * s * F.col("w")) - n * mean * mean) / (n - 1)
        end = F.sum("w").over(Window.orderBy("similarity"))
        all_ = F.sum("w").over(Window.partitionBy(F.lit(1)))
        low, high = F.floor((all_ + 1) / 2), F.ceil((all_ + 1) / 2)
        mid = d.withColumn("end", end).withColumn("low", low).withColumn("high", high).agg(((F.min(F.when(F.col("end") >= F.col("low"), s)) + F.min(F.when(F.col("end") >= F.col("high"), s))) / 2).alias("median"))
        base = d.agg(F.coalesce(n, F.lit(0)).cast("long").alias("count"), mean.alias("mean"), F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0).alias("stdev"), F.min(s).alias("min"), F.max(s).alias("max"))
        return base.crossJoin(mid)  # one row each

    def similar_by_category(self, categories: DataFrame, threshold: float = 0.7) -> DataFrame:
        """(category, class1, class2, similarity, n1, n2): pairs of classes within a category, with their members in it."""
        c = written(categories.select(F.col("_id").alias("id"), "category").join(self.members.select("id", "class_id"), "id").groupBy("class_id", "category").agg(F.count("*").alias("members")))
        c = c.where("category is not null")
        signed = c.withColumnRenamed("class_id", "id").withColumnRenamed("category", "grp").join(self.classes.select("id", "signature"), "id")
        x = Blocks(signed, self.num_hashes, self.num_bands, grouped=True).pairs(threshold).select(F.col("grp").alias("category"), F.col("id1").alias("class1"), F.col("id2").alias("class2"), "similarity", "n1", "n2")
        own = c.where("members > 1").select("category", F.col("class_id").alias("class1"), F.col("class_id").alias("class2"), F.lit(1.0).alias("similarity"), F.col("members").alias("n1"), F.col("members").alias("n2"))
        return x.union(own)

    def largest_groups(self, threshold: float = 0.9, n: int = 5) -> DataFrame:
        """(component, size, pairs): the duplicate groups of most pairs of documents at the threshold."""
        linked, between = self._linked(threshold)
        x = self.classes.select("id", "members").join(linked, "id", "left").where("component is not null or members > 1").join(between, "id", "left")
        pairs = F.coalesce("w", F.lit(0)) + (F.col("members") * (F.col("members") - 1) / 2).cast("long")
        groups = x.groupBy(F.coalesce("component", "id").alias("component")).agg(F.sum("members").alias("size"), F.sum(pairs).alias("pairs"))
        return groups.orderBy(F.desc("pairs"), "component").limit(n)

    def report(self, threshold: float = 0.9) -> dict[str, DataFrame]:
        """The similarity report as tables."""
        return {"index": self.statistics(), "groups": self.groups(threshold), "largest groups": self.largest_groups(threshold), "distribution": self.distribution(), "savings": self.savings()}


def pair_similarity(sets: DataFrame, id1: str, id2: str) -> DataFrame:
    """One row: the exact similarity of two documents by id, 0 if one is unknown."""
    own = lambda x: F.max(F.when(F.col("id") == x, F.struct("shingles")))
    return sets.where(F.col("id").isin(id1, id2)).agg(own(id1).alias("a"), own(id2).alias("b")).select(F.coalesce(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), jaccard(F.col("a.shingles"), F.col("b.shingles"))), F.lit(0.0)).alias("similarity"))
