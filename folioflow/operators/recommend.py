"""Recommendations: by shared tags, by popularity, by exploration, and mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.hashing import priority
from folioflow.functions.text import jaccard


def _tags(docs: DataFrame) -> DataFrame:
    return docs.where("tags is not null").select("_id", "ord", F.array_distinct(F.transform("tags", F.lower)).alias("tags"))


def by_tags(docs: DataFrame, document_id: str, n: int = 5) -> DataFrame:
    """(_id, similarity): the n documents that share most tags with one, by Jaccard similarity."""
    t = _tags(docs)
    base = t.where(F.col("_id") == document_id).select(F.col("tags").alias("base_tags")).limit(1)
    near = t.join(F.broadcast(base), F.arrays_overlap("tags", "base_tags")).where(F.col("_id") != document_id)  # one row is broadcast
    return near.select("_id", jaccard(F.col("base_tags"), F.col("tags")).alias("similarity")).orderBy(F.desc("similarity"), "_id").limit(n)


def access_counts(accesses: DataFrame) -> DataFrame:
    return accesses.groupBy("document_id").agg(F.count("*").alias("accesses"), F.min("seq").alias("first_seq"))


def popular(docs: DataFrame, accesses: DataFrame, n: int = 5, exclude: DataFrame | None = None) -> DataFrame:
    """(_id, accesses): the n most accessed of the overall top 100 that are not excluded and are documents."""
    top = access_counts(accesses).orderBy(F.desc("accesses"), "document_id").limit(100)
    if exclude is not None:
        top = top.join(exclude.select("_id"), F.col("document_id") == F.col("_id"), "left_anti")
    return top.join(docs.select("_id"), F.col("document_id") == F.col("_id"), "left_semi").select(F.col("document_id").alias("_id"), "accesses").orderBy(F.desc("accesses"), "_id").limit(n)


def explore(docs: DataFrame, n: int = 5, exclude: DataFrame | None = None, seed: str = "42") -> DataFrame:
    """(_id): n documents drawn by a hash priority; all if there are no more."""
    d = docs if exclude is None else docs.join(exclude.select("_id"), "_id", "left_anti")
    return d.select("_id").orderBy(priority(seed, F.col("_id")), "_id").limit(n)


def hybrid(docs: DataFrame, accesses: DataFrame, document_id: str | None = None, n: int = 5, exploitation_ratio: float = 0.7, seed: str = "42") -> DataFrame:
    """(_id, score, kind): similar, popular and explored documents, in an order drawn by hash priority.

    The base document may itself be popular or explored, and without accesses there are fewer than n.
    """
    exploit = int(n * exploitation_ratio)
    parts = []
    taken = docs.sparkSession.createDataFrame([], "_id string, score double, kind string")
    found = 0
    if document_id:
        similar = by_tags(docs, document_id, exploit // 2).select("_id", F.col("similarity").alias("score"), F.lit("similar").alias("kind"))
        similar = docs.sparkSession.createDataFrame(similar.collect(), similar.schema)  # at most n rows, and their number is needed
        taken, found = similar, similar.count()
        parts.append(similar)
    if exploit > found:
        p = popular(docs, accesses, exploit - found, taken).select("_id", F.least(F.col("accesses") / 100.0, F.lit(1.0)).alias("score"), F.lit("popular").alias("kind"))
        parts.append(p)
        taken = taken.unionByName(p)
    if n > exploit:
        parts.append(explore(docs, n - exploit, taken, seed).select("_id", F.lit(0.5).alias("score"), F.lit("exploration").alias("kind")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(priority(seed, "shuffle", F.col("_id"), F.col("kind")), "_id").limit(n)


def recommend(strategy: str, docs: DataFrame, accesses: DataFrame, document_id: str | None = None, n: int = 5) -> DataFrame:
    """One strategy by name: hybrid, similar, popular or random; others give no rows."""
    if strategy == "hybrid":
        return hybrid(docs, accesses, document_id, n)
    if strategy == "similar" and document_id:
        return by_tags(docs, document_id, n)
    if strategy == "popular":
        return popular(docs, accesses, n)
    if strategy == "random":
        return explore(docs, n)
    return docs.select("_id").limit(0)


def user_statistics(docs: DataFrame, accesses: DataFrame, top: int = 5) -> DataFrame:
    """Per user: accesses, distinct documents, and the tags of most of these documents as 'tag:n' joined by commas."""
    totals = accesses.groupBy("user_id").agg(F.count("*").alias("total_accesses"), F.count_distinct("document_id").alias("unique_documents"))
    tags = accesses.select("user_id", "document_id").distinct().join(docs.select("_id", F.explode("tags").alias("tag")), F.col("document_id") == F.col("_id")).groupBy("user_id", "tag").agg(F.count("*").alias("n"))
    ranked = tags.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "tag"))).where(F.col("r") <= top)
    listed = ranked.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "tag", "n"))), lambda x: F.concat(x["tag"], F.lit(":"), x["n"].cast("string"))), ",").alias("favorite_tags"))
    return totals.join(listed, "user_id", "left").withColumn("favorite_tags", F.coalesce("favorite_tags", F.lit("")))
