"""Keyword search with an inverted index and a relevance score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import normalized_tokens
from folioflow.operators.shared import written


def tag_tokens(tags: Column) -> Column:
    return F.flatten(F.transform(F.coalesce(tags, F.array().cast("array<string>")), normalized_tokens))


def all_tokens(docs: DataFrame) -> Column:
    return F.array_distinct(F.concat(normalized_tokens(F.col("title")), normalized_tokens(F.col("content")), tag_tokens(F.col("tags"))))


def inverted_index(docs: DataFrame) -> DataFrame:
    """Postings (word, _id, ord); write it clustered by word to look words up."""
    return docs.select("_id", "ord", F.explode(all_tokens(docs)).alias("word")).select("word", "_id", "ord")


def query_words(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(normalized_tokens(F.lit(query)).alias("w")).first()["w"]


def search(docs: DataFrame, query: str, n: int = 10) -> DataFrame:
    """The n best rows of ``docs`` with score: one pass without a shuffle but for the top n.

    The score is hits + 3 x title hits + 2 x tag hits, and half the hits more for queries of several words; repeated
    words count repeatedly. Ties go to the document that an earlier query word reaches, then to the one loaded first.
    """
    words = query_words(docs.sparkSession, query)
    if not words:
        return docs.limit(0).withColumn("score", F.lit(0.0))
    q = F.array(*map(F.lit, words))
    hits = lambda tokens: F.size(F.filter(q, lambda w: F.array_contains(tokens, w)))
    tokens = F.struct(all_tokens(docs).alias("all"), normalized_tokens(F.col("title")).alias("title"), tag_tokens(F.col("tags")).alias("tags"))
    d = docs.select("*", F.explode(F.array(tokens)).alias("_t"))  # the generator makes a column of the tokens, computed once
    d = d.withColumn("_hits", hits(F.col("_t.all"))).where("_hits > 0")
    score = F.col("_hits") + 3.0 * hits(F.col("_t.title")) + 2.0 * hits(F.col("_t.tags")) + (0.5 * F.col("_hits") if len(words) > 1 else F.lit(0.0))
    first = F.array_position(F.transform(q, lambda w: F.array_contains(F.col("_t.all"), w)), True)
    return d.withColumn("score", score).withColumn("_first", first).orderBy(F.desc("score"), "_first", "ord").limit(n).drop("_t", "_hits", "_first")


class SearchIndex:
    """Postings on disk, in folders by a hash of the word and sorted by word within: a search reads those of its words only."""

    BUCKETS = 64

    def __init__(self, docs: DataFrame):
        t = docs.select("_id", "ord", F.explode(F.array(F.struct(all_tokens(docs).alias("all"), normalized_tokens(F.col("title")).alias("title"), tag_tokens(F.col("tags")).alias("tags")))).alias("t"))
        p = t.select("_id", "ord", "t", F.explode("t.all").alias("word"))
        p = p.select("word", "_id", "ord", F.array_contains("t.title", F.col("word")).alias("in_title"), F.array_contains("t.tags", F.col("word")).alias("in_tags"))
        p = p.withColumn("bucket", self._bucket(F.col("word")))
        self.postings = written(p.repartition("bucket", F.pmod(F.xxhash64("_id"), F.lit(16))).sortWithinPartitions("bucket", "word"), by="bucket")

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.BUCKETS)).cast("int")

    def lookup(self, words: list[str]) -> DataFrame:
        """Postings of some words, by folder and then by word."""
        spark = self.postings.sparkSession
        buckets = {r[0] for r in spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("w")).select(self._bucket(F.col("w"))).collect()}
        return self.postings.where(F.col("bucket").isin(sorted(buckets)) & F.col("word").isin(words))

    def search(self, query: str, n: int = 10) -> DataFrame:
        """(_id, score) of the n best documents, scored and ordered as by ``search``."""
        words = query_words(self.postings.sparkSession, query)
        if not words:
            return self.postings.limit(0).select("_id", F.lit(0.0).alias("score"))
        weights = F.create_map(*[F.lit(x) for w in dict.fromkeys(words) for x in (w, words.count(w))])
        places = F.create_map(*[F.lit(x) for w in dict.fromkeys(words) for x in (w, words.index(w))])
        each = (1.5 if len(words) > 1 else 1.0) + 3.0 * F.col("in_title").cast("int") + 2.0 * F.col("in_tags").cast("int")
        found = self.lookup(list(dict.fromkeys(words))).groupBy("_id", "ord").agg(F.sum(each * weights[F.col("word")]).alias("score"), F.min(places[F.col("word")]).alias("first"))
        return found.orderBy(F.desc("score"), "first", "ord").limit(n).select("_id", "score")


def search_by_tag(docs: DataFrame, tag: str) -> DataFrame:
    """Documents whose index words (of title, content or tags) include the lower-cased tag."""
    return docs.where(F.array_contains(all_tokens(docs), tag.lower()))


def filter_by_tag(docs: DataFrame, tag: str) -> DataFrame:
    """Documents that carry the tag itself, in any case."""
    return docs.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))


def index_statistics(docs: DataFrame) -> DataFrame:
    """One row: documents and vocabulary."""
    words = inverted_index(docs).agg(F.count_distinct("word").alias("vocabulary_size"))
    return docs.agg(F.count("*").alias("num_documents")).crossJoin(words)  # one row each
