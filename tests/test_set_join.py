"""The set join of texts against all pairs, and what it shuffles."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import set_join, similarity


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    out = {"x1": "", "x2": None, "x3": "One two", "x4": "one  TWO ", "x5": " \t\n", "x6": "é b c d e f g", "x7": "a b c d e", "x8": "e d c b a"}
    for i in range(25):
        w = [*(["the", "common", "line", "of", "all", "texts", "here"] * 2), *draw.choices(words, k=draw.randrange(3, 120))]
        for j in range(3):
            out[f"d{i}_{j}"] = " ".join(w)
            w = [*w[: draw.randrange(1, len(w))], *w[-draw.randrange(1, len(w)) :]] if j else w
            w[draw.randrange(len(w))] = "Changed"
    return out


def sets(texts):
    out = {}
    for x, t in texts.items():
        w = [v for v in __import__("re").split(r"[ \t\n\x0b\f\r]+", (t or "").lower()) if v]
        out[x] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


@pytest.mark.parametrize("threshold,key_sets", [(0.8, 2048), (0.8, 3), (0.3, 3)])
def test_all_pairs_of_classes(spark, texts, monkeypatch, threshold, key_sets):
    monkeypatch.setattr(set_join, "KEY_SETS", key_sets)
    of = sets(texts)
    least = {}
    for x in sorted(of):
        least.setdefault(of[x], x)
    want = {}
    for (p, a), (q, b) in itertools.combinations(sorted(least.items(), key=lambda r: r[1]), 2):
        if p and q and len(p & q) / len(p | q) >= threshold:
            want[a, b] = len(p & q) / len(p | q)
    d = spark.createDataFrame(list(texts.items()), "_id string, t string")
    found = similarity.text_jaccard_pairs(d, threshold, 5, F.col("t")).collect()
    assert want and len(found) == len(want) and {(r["id1"], r["id2"]): r["similarity"] for r in found} == pytest.approx(want)
    assert {r["id"]: r["class_id"] for r in similarity.text_set_classes(d, 5, F.col("t")).collect()} == {x: least[s] for x, s in of.items()}
    with pytest.raises(ValueError):
        similarity.text_jaccard_pairs(d, 0.0)


def test_sets_are_not_shuffled(spark, texts):
    d = spark.createDataFrame(list(texts.items()), "_id string, t string")
    for df in (similarity.text_jaccard_pairs(d, 0.8, 5, F.col("t")), similarity.text_set_classes(d, 5, F.col("t"))):
        p = df._jdf.queryExecution().toString()
        assert "shingles" not in p and "lambdafunction" not in p
