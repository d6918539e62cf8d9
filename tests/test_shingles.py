"""Numbered shingles: the same shingles, counts and signatures as the expressions give."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import shingles, similarity

TEXTS = ["Hello World", "", None, "a", "aB", "\U0001f600\U0001f600x\U0001f600\U0001f600x", "İstanbul ΟΔΟΣ ß", "\x00\x00\x00 a", "aaaaaaaa", "hello world"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "_id long, t string")


def test_same_signatures(spark, docs, monkeypatch):
    monkeypatch.setattr(shingles, "AT_ONCE", 64)  # long texts go in parts, and the table of known shingles is emptied
    monkeypatch.setattr(shingles, "REMEMBERED", 1)
    long = "".join(chr(random.Random(5).randrange(97, 1000) + i % 7) for i in range(700))
    d = docs.union(spark.createDataFrame([(99, long)], "_id long, t string"))
    want = {r["id"]: r["signature"] for r in similarity.signatures(similarity.shingled(d, 3, "char", F.col("t")), 20).collect()}
    for k in (1, 3, 16):
        assert {r["id"]: r["signature"] for r in similarity.text_signatures(d.repartition(k), 20, 3, text=F.col("t")).collect()} == want
    one = similarity.text_signatures(d.where("_id = 0"), 20, 3, text=F.col("t")).first()
    assert one["signature"] == want[0]


def test_same_statistics(docs):
    want = similarity.shingle_statistics(similarity.shingled(docs, 3, "char", F.col("t"))).first().asDict()
    assert similarity.text_shingle_statistics(docs, 3, F.col("t")).first().asDict() == want


@pytest.mark.parametrize("held", [4, 1 << 20])
def test_same_positions(docs, monkeypatch, held):
    monkeypatch.setattr(shingles, "HELD", held)
    want = similarity.positions(docs, 3, F.col("t")).groupBy("shingle").agg(F.count("*").alias("n"), F.max("position").alias("last"))
    assert sorted(map(tuple, similarity.position_counts(docs, 3, F.col("t")).collect())) == sorted(map(tuple, want.collect()))


def test_sets_are_not_made(docs):
    """Expressions over every character ran in interpreted lambdas."""
    for df in (similarity.text_signatures(docs, text=F.col("t")), similarity.text_shingle_statistics(docs, text=F.col("t")), similarity.position_counts(docs, text=F.col("t"))):
        assert "lambdafunction" not in df._jdf.queryExecution().toString()
