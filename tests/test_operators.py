"""Operators on toy inputs with values worked out by hand or by independent formulas."""

import math
import random

import numpy as np
import pytest

from folioflow.functions import hashing, registry, text
from folioflow.operators import access, dgim, graph, markov, recommend, reports, search, similarity, sketches, store, walks
from folioflow.sources import documents
from folioflow.streaming import streams


def F():
    from pyspark.sql import functions

    return functions


def one(df):
    return df.collect()[0]


SEARCH_DOCS = [
    ("doc1", 0, "Python Programming Guide", "Learn Python programming from scratch with simple examples", ["python", "programming"]),
    ("doc2", 1, "Data Science with Python", "Use python and pandas to explore data", ["python", "data"]),
    ("doc3", 2, "Web Development", "Building web pages and web servers", ["web", "development"]),
    ("doc4", 3, "", None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(SEARCH_DOCS, "_id string, ord long, title string, content string, tags array<string>").withColumn("category", F().lit("c"))


def test_search_scores_and_ties(docs):
    rows = search.search(docs, "python programming", 10).select("_id", "score").collect()
    # both words hit, both in the title and in the tags: 2 + 3*2 + 2*2 + 1
    assert [(r["_id"], r["score"]) for r in rows] == [("doc1", 13.0), ("doc2", 6.5)]
    assert search.search(docs, "the and of", 10).count() == 0
    assert search.search(docs, "python python", 10).select("score").first()[0] == 2 + 6 + 4 + 1
    assert [r["_id"] for r in search.search_by_tag(docs, "WEB").collect()] == ["doc3"]
    assert search.filter_by_tag(docs, "Data").count() == 1
    assert one(search.index_statistics(docs))["num_documents"] == 4


def test_normalization_is_unicode(spark):
    d = spark.createDataFrame([("Übung, ÉTÉ para the ñandú_1 no x1",)], "t string")
    assert one(d.select(text.normalized_tokens(F().col("t"))))[0] == ["übung", "été", "ñandú_1"]


def test_store(spark):
    d = spark.createDataFrame([(f"stat{i}", i) for i in range(20)], "_id string, ord long")
    s = one(store.bucket_statistics(d, 100))
    assert (s["total_items"], s["load_factor"], s["empty_buckets"], s["max_chain_length"], s["avg_chain_length"]) == (20, 0.2, 80, 1, 1.0)
    twice = d.union(d.withColumn("ord", F().col("ord") + 100))
    assert store.insert_all(twice).agg(F().max("ord")).first()[0] == 19
    assert store.lookup(d, "stat3").count() == 1 and store.lookup(d, "none").count() == 0 and store.delete(d, "stat3").count() == 19
    assert one(store.bucket_statistics(d.limit(0), 100))["avg_chain_length"] == 0


def test_recommendations(spark):
    tags = {"doc1": ["A", "b"], "doc2": ["a", "c"], "doc3": ["a", "b", "c", "d"], "doc4": ["x"], "doc5": None}
    d = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(tags.items())], "_id string, ord long, tags array<string>")
    a = spark.createDataFrame([("u", "doc1", 1), ("u", "doc1", 2), ("u", "doc2", 3), ("v", "doc3", 4), ("v", "gone", 5), ("v", "gone", 6), ("v", "gone", 7)], "user_id string, document_id string, seq long")
    near = {r["_id"]: r["similarity"] for r in recommend.by_tags(d, "doc1").collect()}
    assert near == {"doc3": 0.5, "doc2": pytest.approx(1 / 3)}
    assert [(r["_id"], r["accesses"]) for r in recommend.popular(d, a, 2).collect()] == [("doc1", 2), ("doc2", 1)]
    assert recommend.explore(d, 10).count() == 5
    h = recommend.hybrid(d, a, "doc1", 5).collect()
    assert len(h) <= 5 and {r["kind"] for r in h} <= {"similar", "popular", "exploration"}
    assert recommend.recommend("popular", d, a).count() == 3 and recommend.recommend("other", d, a).count() == 0
    u = {r["user_id"]: r for r in recommend.user_statistics(d, a).collect()}
    assert u["u"]["unique_documents"] == 2 and u["u"]["favorite_tags"] == "A:1,a:1,b:1,c:1"


def test_distinct_and_moments(spark):
    d = spark.createDataFrame([(x,) for x in "ABCABADEA"], "item string")
    s = one(access.distinct_statistics(d))
    assert (s["total_count"], s["distinct_count"], round(s["duplication_rate"], 4)) == (9, 5, 0.4444)
    m = one(access.moments(spark.createDataFrame([(x,) for x in "ABACABD"], "item string")))
    assert (m["f0"], m["f1_sum"], m["f2"]) == (4, 7, 15)
    assert m["entropy"] == pytest.approx(1.842371, abs=1e-6) and m["gini_coefficient"] == pytest.approx(0.380952, abs=1e-6) and m["avg_frequency"] == 1.75
    skew = one(access.moments(spark.createDataFrame([("a",)] * 40 + [(c,) for c in "bcdefghij"], "item string")))
    assert skew["f2"] == 1609 and skew["gini_coefficient"] == pytest.approx(3.5374, abs=1e-4)
    even = access.distribution(spark.createDataFrame([(c,) for c in "abcdefghij" * 5], "item string"))
    assert one(even)["distribution_type"] == "Muy uniforme" and one(even)["entropy_ratio"] == pytest.approx(1)
    assert one(access.moments(d.limit(0)))["entropy"] == 0 and one(access.moment(d, 2))[0] == 16 + 4 + 1 + 1 + 1


def test_users(spark):
    rows = [("u1", x) for x in "abcab"] + [("u2", x) for x in "aba"] + [("u3", x) for x in "cd"]
    a = spark.createDataFrame([(u, d, i) for i, (u, d) in enumerate(rows)], "user_id string, document_id string, seq long")
    u = {r["user_id"]: (r["total_accesses"], r["distinct_documents"], round(r["revisit_rate"], 4)) for r in access.user_distinct(a).collect()}
    assert u == {"u1": (5, 3, 0.4), "u2": (3, 2, 0.3333), "u3": (2, 2, 0.0)}
    g = one(access.global_distinct(a))
    assert (g["total_users"], g["distinct_documents"], g["total_accesses"], round(g["avg_documents_per_user"], 4)) == (3, 4, 10, 2.3333)
    assert access.top_users(a, 1, "total").first()["user_id"] == "u1"


def test_bloom(spark):
    d = spark.createDataFrame([("doc1",)], "item string")
    assert one(d.select(hashing.bloom_positions(F().col("item"), 10_000, 3)))[0] == [8705, 6758, 6969]
    inside = spark.range(1000).select(F().concat(F().lit("element_"), F().col("id").cast("string")).alias("item"))
    outside = spark.range(1000, 2000).select(F().concat(F().lit("element_"), F().col("id").cast("string")).alias("item"))
    bits = sketches.bloom_filter(inside, 10_000, 5)
    assert sketches.bloom_contains(inside, bits, 10_000, 5).where("not contained").count() == 0
    assert sketches.bloom_contains(outside, bits, 10_000, 5).where("contained").count() <= 30
    assert one(sketches.bloom_statistics(inside, 10_000, 5))["false_positive_rate"] == pytest.approx(0.009431, abs=1e-6)
    assert sketches.optimal_parameters(1000, 0.01) == (9585, 6)


def test_reservoir_is_uniform(spark):
    hits = [0] * 20
    for seed in range(60):
        for r in sketches.reservoir(spark.range(20), 10, "id", seed=str(seed)).collect():
            hits[r["id"]] += 1
    assert sum(hits) == 600 and all(12 <= h <= 48 for h in hits)


def test_dgim():
    for n in (*range(1, 300), 100_000):
        b = dgim.Buckets(10**9)
        if n < 300:
            for _ in range(n):
                b.update(1)
            assert b.count() == dgim.all_ones_estimate(n)
    assert dgim.all_ones_estimate(100_000) == 83_616
    b = dgim.Buckets(5)
    for bit in (1, 1, 1, 0, 0, 0, 0, 0, 0):
        b.update(bit)
    assert b.count() > 0  # buckets expire on ones only
    assert dgim.Buckets(5, b.clock, b.buckets, expire_on_read=True).count() == 0
    with pytest.raises(ValueError):
        dgim.Buckets(0)


def test_dgim_against_exact(spark):
    d = spark.range(400).select(F().lit("k").alias("key"), F().col("id").alias("seq"), (F().col("id") % 3 == 0).cast("int").alias("bit"))
    r = one(dgim.comparison(d, 100))
    assert r["exact"] in (33, 34) and r["error_percentage"] <= 50


class SlowDgim:
    """The same counter by levels: lists of end times for each size, at most two of them."""

    def __init__(self, window):
        self.window, self.clock, self.levels = window, 0, []

    def update(self, bit):
        self.clock += 1
        if bit:
            carry, k = self.clock, 0
            while carry is not None:
                if k == len(self.levels):
                    self.levels.append([])
                self.levels[k].append(carry)
                carry = None
                if len(self.levels[k]) > 2:
                    carry = self.levels[k][1]
                    self.levels[k] = self.levels[k][2:]
                k += 1
            self.levels = [[t for t in x if t > self.clock - self.window] for x in self.levels]

    def count(self):
        sizes = sorted((t, 2**k) for k, x in enumerate(self.levels) for t in x)
        return sum(s for _, s in sizes[1:]) + (sizes[0][1] // 2 if sizes else 0)

    def buckets(self):
        return sum(map(len, self.levels))


def test_dgim_comparison_by_brute_force(spark):
    """Every key's last bit: exact count, estimate, error and buckets."""
    draw = random.Random(5)
    bits = [(f"k{k}", s, int(draw.random() < (0, 0.05, 0.5, 1)[k % 4])) for k in range(8) for s in range(10 + 60 * k)]
    d = spark.createDataFrame(draw.sample(bits, len(bits)), "key string, seq long, bit int")
    got = {r["key"]: r for r in dgim.comparison(d, 40).collect()}
    assert len(got) == 8
    for key, r in got.items():
        own = [b for k, _, b in bits if k == key]
        slow = SlowDgim(40)
        for b in own:
            slow.update(b)
        exact = sum(own[-40:])
        assert (r["exact"], r["estimate"], r["n_buckets"], r["difference"]) == (exact, slow.count(), slow.buckets(), abs(exact - slow.count()))
        assert r["error_percentage"] == pytest.approx(abs(exact - slow.count()) / exact * 100 if exact else 0)


def test_call_monitor_state_and_reset(spark, tmp_path):
    """A named query goes on where it stopped; a reset forgets its state."""
    rows = [(k, i) for k in ("a", "b") for i in range(30 if k == "a" else 9)]
    source = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema("key string, seq long").parquet(source)
    name = f"test-{tmp_path.name}-{random.random()}"
    expected = {}
    for part in (0, 1):
        spark.createDataFrame([r for r in rows if r[1] % 2 == part], "key string, seq long").coalesce(1).write.mode("append").parquet(source)
        out = streams.run_available(streams.call_monitor(stream(), "key", "seq", 7), "update", name)
        last = {r["key"]: r["x"] for r in out.groupBy("key").agg(F().max_by(F().struct("clock", "estimate"), "batch").alias("x")).collect()}
        for k in ("a", "b"):
            slow = expected.setdefault(k, SlowDgim(7))
            for _ in [r for r in rows if r[0] == k and r[1] % 2 == part]:
                slow.update(1)
            assert tuple(last[k]) == (slow.clock, slow.count())
    streams.reset(spark, name)
    again = streams.run_available(streams.call_monitor(stream(), "key", "seq", 7), "update", name)
    assert {r["key"]: r["m"] for r in again.groupBy("key").agg(F().max("clock").alias("m")).collect()} == {"a": 30, "b": 9}
    streams.reset(spark, name)


@pytest.fixture(scope="module")
def chain(spark):
    rows = {"a": {"b": 1.0}, "b": {"a": 0.5, "c": 0.5}, "c": {"c": 1.0}}
    return spark.createDataFrame([(s, t, rows[s].get(t, 0.0)) for s in rows for t in rows], "from_state string, to_state string, prob double")


def test_markov(spark, chain):
    h = {r["state"]: r["steps"] for r in markov.hitting_times(chain, "c").collect()}
    assert h == {"a": pytest.approx(4), "b": pytest.approx(3), "c": 0}
    back = {r["state"]: r["steps"] for r in markov.hitting_times(chain, "a").collect()}
    assert back["c"] == math.inf and back["b"] == math.inf and back["a"] == 0
    pi = {r["state"]: r["probability"] for r in markov.stationary(chain).collect()}
    assert pi["c"] == pytest.approx(1)
    two = {(r["from_state"], r["to_state"]): r["prob"] for r in markov.n_step(chain, 2).collect()}
    assert two["a", "a"] == 0.5 and two["a", "c"] == 0.5 and two["b", "b"] == 0.5
    f = one(markov.chain_flags(chain))
    assert not f["is_irreducible"] and f["is_aperiodic"]
    pairs = spark.createDataFrame([("x", "y"), ("x", "y"), ("x", "x"), (None, "x"), ("y", None)], "from_state string, to_state string")
    m = {(r["from_state"], r["to_state"]): r["prob"] for r in markov.transition_matrix(pairs).collect()}
    assert m == {("x", "x"): pytest.approx(1 / 3), ("x", "y"): pytest.approx(2 / 3), ("y", "x"): 0.5, ("y", "y"): 0.5}
    t = markov.trajectories(chain, "a", 6, 50).collect()
    allowed = {("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")}
    path = {(r["walk_id"], r["step"]): r["state"] for r in t}
    assert len(t) == 300 and all((path[w, s], path[w, s + 1]) in allowed for w, s in path if s < 5)
    assert markov.expected_time(chain, "c") == pytest.approx(7 / 3)
    weights = spark.createDataFrame([("a", 3.0), ("b", 0.5), ("b", 0.5), ("c", -1.0), ("c", None)], "state string, weight double")
    start = markov.initial_distribution(weights)
    assert {r["state"]: r["prob"] for r in start.collect()} == {"a": 0.75, "b": 0.25, "c": 0}
    assert markov.initial_distribution(weights.limit(0)).count() == 0
    first = markov.trajectories(chain, None, 1, 4000, initial=start).groupBy("state").count().collect()
    assert {r["state"]: r["count"] / 4000 for r in first} == {"a": pytest.approx(0.75, abs=0.03), "b": pytest.approx(0.25, abs=0.03)}


def test_pagerank(spark):
    e = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("D", "B"), ("D", "C")], "src string, dst string")
    s = {r["id"]: r["score"] for r in graph.pagerank(e).collect()}
    assert s == {"A": pytest.approx(0.366401, abs=1e-5), "B": pytest.approx(0.209158, abs=1e-5), "C": pytest.approx(0.386942, abs=1e-5), "D": pytest.approx(0.0375, abs=1e-5)}
    sink = spark.createDataFrame([("A", "B"), ("A", "B")], "src string, dst string")  # parallel edges, and a node without edges
    t = {r["id"]: r["score"] for r in graph.pagerank(sink).collect()}
    assert sum(t.values()) == pytest.approx(1)
    st = one(graph.statistics(e, graph.pagerank(e)))
    assert st["num_nodes"] == 4 and st["num_edges"] == 6 and st["avg_in_degree"] == 2 and st["avg_out_degree"] == 1.5
    assert [r["id"] for r in graph.neighbour_recommendations(e, graph.pagerank(e), "D").collect()] == ["C", "B"]
    assert graph.pagerank(e.limit(0)).count() == 0


@pytest.mark.parametrize("edges_a_task", [200_000, 1])
def test_components(spark, edges_a_task, monkeypatch):
    """By union-find in one task, and in rounds."""
    monkeypatch.setattr(graph, "EDGES_A_TASK", edges_a_task)
    pairs = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("900", "901"), ("902", "901"), ("950", "950")]
    c = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "id1 string, id2 string")).collect()}
    assert {c[f"{i:03}"] for i in range(41)} == {"000"} and c["901"] == c["902"] == "900"
    assert graph.components(spark.createDataFrame([], "id1 string, id2 string")).count() == 0


def test_walks(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A")], "src string, dst string")
    starts = spark.createDataFrame([("w", "A")], "walk_id string, node string")
    assert [r["node"] for r in walks.walk(e, starts, 4).orderBy("step").collect()] == ["A", "B", "C", "A", "B"]
    assert one(walks.hitting_time(e, "A", "C", 20))["hitting_time"] == 2
    assert one(walks.cover_time(e, "A", 20))["cover_time"] == 2
    assert one(walks.mixing_time(e, "A", 50, 0.01))["mixing_time"] == 2
    end = spark.createDataFrame([("A", "B")], "src string, dst string")
    assert [r["node"] for r in walks.walk(end, starts, 3).orderBy("step").collect()] == ["A", "B", "B", "B"]
    assert one(walks.hitting_time(end, "B", "A", 5, 100))["hitting_time"] == math.inf


def test_simulations_against_exact_means(spark):
    """Mean hitting time by linear equations, mean cover time of a ring of n nodes n (n - 1) / 2."""
    draw = random.Random(3)
    pairs = sorted({(a, b) for a in range(8) for b in draw.sample(range(8), 3) if a != b} | {(a, (a + 1) % 8) for a in range(8)})
    e = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    p = np.zeros((8, 8))
    for a, b in pairs:
        p[a, b] = 1
    p /= p.sum(1, keepdims=True)
    exact = np.linalg.solve(np.eye(7) - p[:7, :7], np.ones(7))[2]
    r = one(walks.hitting_time(e, "2", "7", 3000))
    assert r["reached"] == 3000 and r["hitting_time"] == pytest.approx(exact, rel=0.1)
    ring = spark.createDataFrame([(str(a), str((a + s) % 6)) for a in range(6) for s in (1, 5)], "src string, dst string")
    c = one(walks.cover_time(ring, None, 3000))
    assert c["covered"] == 3000 and c["cover_time"] == pytest.approx(15, rel=0.1)
    star = spark.createDataFrame([("m", x) for x in "abc"] + [(x, "m") for x in "abc"], "src string, dst string")
    assert one(walks.mixing_time(star, "m", 40, 0.01))["mixing_time"] == 40  # the middle holds half of all visits
    whole = spark.createDataFrame([(a, b) for a in "abcd" for b in "abcd"], "src string, dst string")
    shares = [one(walks.mixing_time(whole, "a", 400, t))["mixing_time"] for t in (2.0, 0.3, 0.05)]
    assert shares[0] == 1 and shares == sorted(shares) and shares[2] < 400  # no walk is 2.0 away
    w = walks.navigation_study(ring, 20, 10)
    paths: dict = {}
    for r in w.collect():
        paths.setdefault(r["walk_id"], set()).add(r["node"])
    m = one(walks.mean_coverage(w, 6))
    assert m["sessions"] == 20 and m["mean_coverage"] == pytest.approx(sum(map(len, paths.values())) / 120)


def test_reports(spark):
    rows = [("report", 100), ("report", 200), ("report", 150), ("memo", 50), ("memo", 75), ("email", 15), ("email", 20), ("presentation", 300)]
    d = spark.createDataFrame(rows, "type string, size long")
    s = {r["key"]: tuple(r)[1:] for r in reports.statistics_by(d, F().col("type"), F().col("size")).collect()}
    assert s["report"] == (3, 450, 150.0, 100, 200) and s["email"] == (2, 35, 17.5, 15, 20)
    got = {r["key"]: r["result"] for r in reports.map_reduce(d, lambda r: [(r["type"], float(r["size"]) / (r["size"] != 50))], lambda k, v: max(v)).collect()}
    assert got == {"report": 200.0, "memo": 75.0, "email": 20.0, "presentation": 300.0}  # the failing record is skipped
    docs = spark.createDataFrame([("x y", ["b", "a", "b"]), (None, None)], "content string, tags array<string>").withColumn("title", F().lit("Some title.")).withColumn("category", F().lit(None).cast("string"))
    pairs = {(r["tag1"], r["tag2"]): r["n"] for r in reports.tag_pairs(docs).collect()}
    assert pairs == {("a", "b"): 2, ("b", "b"): 1}
    assert {r["word"]: r["n"] for r in reports.word_count(docs).collect()} == {"some": 2, "title.": 2}
    assert one(reports.category_statistics(docs))["category"] == "unknown"
    job = one(reports.job_cost(d, d.selectExpr("type as key", "size as value"), "j", 0.5))
    assert (job["input_size"], job["map_output_size"], job["unique_keys"]) == (8, 8, 4) and job["reduce_selectivity"] == 0.5
    assert job["score"] == pytest.approx(30 * 0.9 + 30 * 0.5 + 40 * 16 / 1000)


def test_similarity(spark):
    sets = [("d1", "hello world"), ("d2", "hello word"), ("d3", ""), ("d4", ""), ("d5", "ab"), ("d6", "hello world")]
    d = spark.createDataFrame(sets, "_id string, t string")
    s = similarity.shingled(d, 3, "char", F().col("t"))
    n = {r["id"]: len(r["shingles"]) for r in s.collect()}
    assert n == {"d1": 9, "d2": 8, "d3": 0, "d4": 0, "d5": 1, "d6": 9}
    near = {r["id"]: r["similarity"] for r in similarity.similarity_to(s, "d1", 0.5).collect()}
    assert near == {"d2": pytest.approx(0.7), "d6": 1.0}
    pairs = {(r["id1"], r["id2"]): r["similarity"] for r in similarity.jaccard_pairs(s, 0.5).collect()}
    assert pairs == {("d1", "d2"): pytest.approx(0.7)}
    assert similarity.positions(d, 3, F().col("t")).where("id = 'd5'").count() == 0
    with pytest.raises(ValueError):
        similarity.shingled(d, 3, "other")


def test_minhash_and_lsh(spark):
    assert hashing.minhash_coefficients(3) == [(2746317214, 478163327), (3184935164, 1181241943), (958682847, 2342331444)]
    d = spark.createDataFrame([("abc",)], "s string")
    assert one(d.select(hashing.md5_mod(F().col("s"))))[0] == 3427491640
    assert similarity.Signer(1).signature(["abc"])[0] == 3546287322
    sets = [("a", [f"x{i}" for i in range(100)]), ("b", [f"x{i}" for i in range(50, 150)]), ("c", [f"x{i}" for i in range(100)]), ("e", []), ("f", [f"y{i}" for i in range(30)])]
    s = similarity.signatures(spark.createDataFrame(sets, "id string, shingles array<string>"), 200)
    sim = similarity.minhash_similar_to(s, "a", 200, 0.0).collect()
    assert {r["id"]: r["similarity"] for r in sim}["c"] == 1.0 and abs({r["id"]: r["similarity"] for r in sim}["b"] - 1 / 3) < 0.1
    index = similarity.LshIndex(s, 200, 40)
    assert {r["id"]: r["component"] for r in index.groups(0.9).collect()} == {"a": "a", "c": "a"}
    assert one(index.statistics())["theoretical_threshold"] == pytest.approx((1 / 40) ** (1 / 5))
    with pytest.raises(ValueError):
        similarity.LshIndex(s, 200, 33)


def test_sql_functions(spark):
    names = registry.register(spark)
    assert "minhash_signature" in names
    row = spark.sql("SELECT normalize_text('The Quick fox') AS a, char_shingles('Hello', 3) AS b, jaccard(array('a', 'b'), array('b')) AS c, code_point_bucket('ab', 100) AS d, dgim_count(array(1, 1, 1), 10) AS e, bloom_positions('doc1', 10000, 3) AS f").first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["f"]) == (["quick", "fox"], ["hel", "ell", "llo"], 0.5, 95, 2, [8705, 6758, 6969])


def test_documents_round_trip(spark, tmp_path):
    d = documents.generate(spark, 200)
    assert d.select("_id").distinct().count() == 200 and sorted(map(str, documents.generate(spark, 200).collect())) == sorted(map(str, d.collect()))
    documents.write_json(d, str(tmp_path / "out"))
    again = documents.read_json(spark, str(tmp_path / "out"), multiline=False)
    assert sorted(map(str, again.select(*d.columns).collect())) != [] and again.where("size(retrievalOptimization.searchPath) between 3 and 7 and lastAccessed like '%Z'").count() == 200
    assert again.count() == 200 and again.where("size(tags) = 3 and systemEfficiency.queueLength is not null").count() == 200
    (tmp_path / "a.json").write_text('[{"_id": "1", "title": "t"}, {"_id": "2", "tags": ["x"]}]', encoding="utf-8")
    assert [r["title"] for r in documents.read_json(spark, str(tmp_path / "a.json")).orderBy("_id").collect()] == ["t", None]
    assert documents.from_rows(spark, [{"_id": "1"}]).first()["tags"] is None
