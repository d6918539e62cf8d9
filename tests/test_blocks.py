"""Block-wise pairs, document pairs, tag networks without their edges: against brute force, and what their plans hold."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import blocks, graph, similarity


def brute(signed, bands):
    """(id1, id2, equal places) of ids that share a band."""
    out = {}
    for (a, x), (b, y) in itertools.combinations(sorted(signed.items()), 2):
        n = len(x) // bands
        if any(x[i * n : i * n + n] == y[i * n : i * n + n] for i in range(bands)):
            out[a, b] = sum(p == q for p, q in zip(x, y, strict=True))
    return out


def signed_rows(n=150, hashes=20, seed=1):
    draw = random.Random(seed)
    base = [[draw.randrange(4) for _ in range(hashes)] for _ in range(6)]
    return {f"d{i:03}": [v if draw.random() < 0.85 else draw.randrange(2**32 + 1) for v in draw.choice(base)] for i in range(n)}


@pytest.fixture
def small(monkeypatch):
    for name, n in (("BLOCK", 40), ("SMALL", 30), ("COLUMNS", 16), ("ROWS", 8), ("GIVEN", 32)):
        monkeypatch.setattr(blocks, name, n)


@pytest.fixture
def index(spark, small):
    rows = signed_rows()
    rows |= {f"e{i}": rows["d000"] for i in range(5)} | {f"f{i}": rows["d001"] for i in range(300)}
    return rows, similarity.LshIndex(spark.createDataFrame(list(rows.items()), "id string, signature array<long>"), 20, 5)


def near(rows, least):
    return {k: n / 20 for k, n in brute(rows, 5).items() if n >= least}


@pytest.mark.parametrize("least", [0, 8, 15, 18])
def test_pairs_of_documents(index, least):
    """Copies are pairs, and so are all their members with those of a similar class (F10: only representatives were)."""
    rows, i = index
    found = [(r["id1"], r["id2"], r["similarity"]) for r in i.pairs(least / 20).collect()]
    assert len(found) == len(set(found)) and {(a, b): s for a, b, s in found} == near(rows, least)


def test_counts_and_distribution(index):
    rows, i = index
    all_, n = brute(rows, 5), dict.fromkeys(rows, 0)
    for a, b in all_:
        n[a] += 1
        n[b] += 1
    assert {r["id"]: r["candidates"] for r in i.candidate_counts().collect()} == n
    assert i.statistics().first()["avg_candidates_per_doc"] == pytest.approx(sum(n.values()) / len(n))
    assert i.savings().first()["estimated_comparisons"] == sum(n.values())
    d = i.distribution(0.3).first()
    s = [v for v in near(rows, 6).values()]
    assert d["count"] == 2 * len(s) and d["mean"] == pytest.approx(sum(s) / len(s)) and (d["min"], d["max"]) == (min(s), max(s))


def test_groups(index):
    rows, i = index
    up = {x: x for x in rows}

    def root(x):
        return x if up[x] == x else root(up[x])

    pairs = near(rows, 18)
    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for p in pairs for x in p}
    assert {r["id"]: r["component"] for r in i.groups(0.9).collect()} == {x: root(x) for x in linked}
    sums: dict = {}
    for a, _ in pairs:
        sums[root(a)] = sums.get(root(a), 0) + 1
    best = sorted(((-n, x) for x, n in sums.items()))[:5]
    assert [(-r["pairs"], r["component"]) for r in i.largest_groups(0.9).collect()] == best


def test_similar_by_category(spark, index):
    rows, i = index
    category = {x: None if k % 11 == 0 else f"c{k % 3}" for k, x in enumerate(rows)}
    found = i.similar_by_category(spark.createDataFrame(list(category.items()), "_id string, category string"), 0.7).collect()
    members = {r["id"]: r["class_id"] for r in i.members.collect()}
    want: dict = {}
    for (a, b), s in near(rows, 14).items():
        if category[a] == category[b] is not None:
            x, y = sorted((members[a], members[b]))
            want[category[a], x, y] = s
    assert {(r["category"], r["class1"], r["class2"]): r["similarity"] for r in found} == want and len(found) == len(want)


def test_candidates_are_not_shuffled(index):
    """Blocks meet, not buckets; each task sums up (before, candidates were joined, made distinct and joined again)."""
    _, i = index
    for df in (i.candidate_counts(), i.class_pairs(0.9), i.blocks.histogram(0.1)):
        p = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "bucket" not in p and ("CartesianProduct" in p or "BroadcastNestedLoopJoin" in p)


def test_forest_keeps_components_and_sums(spark, monkeypatch):
    monkeypatch.setattr(graph, "IDS_A_TASK", 3)
    pairs = [(f"{i:02}", f"{i + 1:02}", 2) for i in range(20) if i != 9] + [("00", "02", 5)]
    left = graph.forest(spark.createDataFrame(pairs, "id1 string, id2 string, w long").repartition(3))
    rows = left.collect()
    assert sum(r["w"] for r in rows) == 43 and sum(r["w"] for r in rows if r["id1"] == "00" == r["id2"]) == 7
    c = {r["id"]: r["component"] for r in graph.components(left.where("id1 <> id2").select("id1", "id2")).collect()}
    assert c == {f"{i:02}": "00" if i < 10 else "10" for i in range(21)}


def tagged(spark):
    draw = random.Random(3)
    rows = [(f"{i:03}", draw.sample("abcdefghijkl", draw.randrange(4))) for i in range(120)] + [("200", ["x", "y"]), ("201", ["y", "x", "x"]), ("202", ["lonely"]), ("203", None), ("000", ["z"])]
    return spark.createDataFrame(rows, "_id string, tags array<string>")


def test_tag_network_by_first_common_tag(spark, monkeypatch):
    monkeypatch.setattr(graph, "TAG_DOCS", 4)
    d = tagged(spark)
    tags: dict = {}
    for r in d.collect():
        tags.setdefault(r["_id"], set()).update(r["tags"] or [])
    df = graph.tag_network(d)
    found = [tuple(r) for r in df.select("src", "dst").collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in tags for b in tags if a != b and tags[a] & tags[b]}
    assert "keys=[src" not in df._jdf.queryExecution().toString()  # pairs are not made distinct by a shuffle


def test_tag_pagerank_without_edges(spark, monkeypatch):
    d = tagged(spark)
    want = {r["id"]: r["score"] for r in graph.pagerank(graph.tag_network(d), fixed=12).collect()}
    monkeypatch.setattr(graph, "EDGES", -1)
    monkeypatch.setattr(graph, "pagerank", None)
    found = {r["id"]: r["score"] for r in graph.tag_pagerank(d, fixed=12).collect()}
    assert found == pytest.approx(want, rel=1e-12) and sum(found.values()) == pytest.approx(1)
    assert found["200"] == found["201"] and "202" not in found
    none = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "_id string, tags array<string>")
    monkeypatch.undo()
    assert graph.tag_pagerank(none).count() == 0 and graph.tag_pagerank(none.where(F.lit(False))).count() == 0
