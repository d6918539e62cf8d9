"""Access-stream analytics: distinct counts, frequency moments, distributions, popularity, search logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_statistics(items: DataFrame, item: str = "item") -> DataFrame:
    """One row: items, distinct items, duplication rate 1 - distinct/total (0 when empty)."""
    rate = F.coalesce(1 - F.try_divide(F.count_distinct(item), F.count(item)), F.lit(0.0))
    return items.agg(F.count(item).alias("total_count"), F.count_distinct(item).alias("distinct_count"), (rate).alias("duplication_rate"))


def approximate_distinct(items: DataFrame, item: str = "item", error: float = 0.02) -> DataFrame:
    """Distinct items by HyperLogLog++: bounded memory where the exact count need not be."""
    return items.agg(F.approx_count_distinct(item, error).alias("distinct_count"))


def user_distinct(accesses: DataFrame) -> DataFrame:
    """Per user: distinct documents, accesses, revisit rate."""
    n, d = F.count("*"), F.count_distinct("document_id")
    return accesses.groupBy("user_id").agg(d.alias("distinct_documents"), n.alias("total_accesses"), (1 - d / n).alias("revisit_rate"))


def user_totals(counts: DataFrame) -> DataFrame:
    """The same per user, of running counts (user_id, document_id, n, batch) as a stream gives them: the last of each pair counts."""
    last = counts.groupBy("user_id", "document_id").agg(F.max_by("n", "batch").alias("n"))
    d, n = F.count("document_id"), F.sum("n")
    return last.groupBy("user_id").agg(d.alias("distinct_documents"), n.alias("total_accesses"), (1 - d / n).alias("revisit_rate"))


def global_distinct(accesses: DataFrame) -> DataFrame:
    """One row: users, distinct documents, accesses, mean distinct documents of a user."""
    pairs = accesses.groupBy("user_id", "document_id").agg(F.count("*").alias("n"))
    users = F.count_distinct("user_id")
    return pairs.agg(users.alias("total_users"), F.count_distinct("document_id").alias("distinct_documents"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_accesses"), (F.coalesce(F.try_divide(F.count("*"), users), F.lit(0.0))).alias("avg_documents_per_user"))


def top_users(accesses: DataFrame, n: int = 10, by: str = "distinct") -> DataFrame:
    """(user_id, n): users by distinct documents, or by accesses for any other ``by``."""
    c = F.count_distinct("document_id") if by == "distinct" else F.count("*")
    return accesses.groupBy("user_id").agg(c.alias("n")).orderBy(F.desc("n"), "user_id").limit(n)


def frequencies(items: DataFrame, item: str = "item") -> DataFrame:
    return items.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("f"))


def moment(items: DataFrame, k: int, item: str = "item") -> DataFrame:
    """One row: the k-th frequency moment, the sum of f^k."""
    return frequencies(items, item).agg(F.coalesce(F.sum(F.pow("f", F.lit(k))), F.lit(0.0)).alias("moment"))


def entropy_of(f: Column, total: Column) -> Column:
    return F.coalesce(-F.sum(f / total * F.log2(f / total)), F.lit(0.0))


def moments(items: DataFrame, item: str = "item") -> DataFrame:
    """One row: F0, F1, F2, F3, entropy in bits, the coefficient (F2 - F1) / (F1 (F0 - 1)), mean frequency."""
    c = frequencies(items, item)
    total = c.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("f1"))
    f0, f1, f2 = F.count("f"), F.coalesce(F.sum("f"), F.lit(0)), F.coalesce(F.sum(F.col("f") * F.col("f")), F.lit(0))
    gini = F.when((f0 <= 1) | (f1 == 0), 0.0).otherwise(F.try_divide(f2 - f1, f1 * (f0 - 1)))
    return c.crossJoin(F.broadcast(total)).agg(  # one row is broadcast
        f0.alias("f0"), F.coalesce(F.sum("f"), F.lit(0)).cast("long").alias("f1_sum"), f2.cast("long").alias("f2"), F.coalesce(F.sum(F.pow("f", F.lit(3))), F.lit(0.0)).alias("f3"),
        (entropy_of(F.col("f"), F.col("f1"))).alias("entropy"), (gini).alias("gini_coefficient"), (F.coalesce(F.try_divide(f1, f0), F.lit(0.0))).alias("avg_frequency"),
    )


def most_frequent(items: DataFrame, n: int = 10, item: str = "item") -> DataFrame:
    return frequencies(items, item).orderBy(F.desc("f"), "item").limit(n)


#: The labels of the bands of the entropy ratio.
BANDS = ((0.9, "Muy uniforme"), (0.7, "Relativamente uniforme"), (0.5, "Moderadamente concentrada"))
LOWEST_BAND = "Muy concentrada"


def distribution(items: DataFrame, item: str = "item") -> DataFrame:
    """One row: totals, entropy, its maximum log2(F0), their ratio, the coefficient, F2, and the label of the ratio's band."""
    m = moments(items, item)
    most = F.when(F.col("f0") > 0, F.log2("f0")).otherwise(0.0)
    ratio = F.when(most > 0, F.col("entropy") / most).otherwise(0.0)
    label = F.lit(LOWEST_BAND)
    for least, name in reversed(BANDS):
        label = F.when(ratio > least, name).otherwise(label)
    return m.select(F.col("f1_sum").alias("total_accesses"), F.col("f0").alias("unique_documents"), F.col("avg_frequency").alias("avg_accesses_per_doc"), "entropy", most.alias("max_entropy"), ratio.alias("entropy_ratio"), "gini_coefficient", label.alias("distribution_type"), F.col("f2").alias("moment_2"))


def popularity(items: DataFrame, n: int = 10, item: str = "item") -> DataFrame:
    """(item, f, coverage): the n most frequent items, with the share of all accesses that they cover together."""
    c = frequencies(items, item)
    top = c.orderBy(F.desc("f"), "item").limit(n)
    share = top.agg(F.sum("f").alias("covered")).crossJoin(c.agg(F.sum("f").alias("total")))  # one row each
    return top.crossJoin(F.broadcast(share)).select("item", "f", (F.col("covered") / F.col("total")).alias("coverage"))


def _ranked(rows: DataFrame, key: str, n: int) -> DataFrame:
    top = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)
    text = F.concat(F.col(key).cast("string"), F.lit(":"), F.col("n").cast("string"))
    return top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(key).alias("k"), text.alias("t")))), lambda x: x["t"]), ",").alias("list"))


def search_sample_summary(sample: DataFrame, top: int = 5) -> DataFrame:
    """One row about a sample (user_id, query, results_count): sizes, top queries and users, mean and empty results."""
    base = sample.agg(
        F.count("*").alias("total_sampled"), F.count_distinct("query").alias("unique_queries"), F.count_distinct("user_id").alias("unique_users"),
        (F.coalesce(F.avg("results_count"), F.lit(0.0))).alias("avg_results"), F.coalesce(F.sum(F.when(F.col("results_count") == 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("queries_with_no_results"),
    )
    q, u = _ranked(sample, "query", top).withColumnRenamed("list", "most_common_queries"), _ranked(sample, "user_id", top).withColumnRenamed("list", "most_active_users")
    return base.crossJoin(q).crossJoin(u)  # one row each


def query_suggestions(sample: DataFrame, n: int = 10) -> DataFrame:
    return sample.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(n)
