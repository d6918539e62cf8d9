"""The pipeline's near-duplicate stage against all pairs of 5-word shingle sets."""

import random
import tracemalloc

import numpy as np
import pytest

from folioflow.llm import set_links, simhash


def sets(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_sketches_never_exceed_the_difference():
    r = random.Random(4)
    for _ in range(300):
        a = {r.randrange(1 << 62) for _ in range(r.randrange(1, 900))}
        b = {x for x in a if r.random() < 0.9} | {r.randrange(1 << 62) for _ in range(r.randrange(0, 200))}
        x, y = (set_links.sketch(np.array(sorted(s), np.int64)) for s in (a, b))
        assert set_links.differ(x, y) <= len(a ^ b)


@pytest.mark.parametrize("chunk", [1 << 14, 4])
def test_every_pair_of_similarity_four_fifths_links(spark, chunk, monkeypatch):
    """Also where large keys are dealt in parts."""
    monkeypatch.setattr(set_links, "CHUNK", chunk)
    monkeypatch.setattr(set_links, "ONE_IN", 1)
    r = random.Random(3)
    word = lambda: "w" + str(r.randrange(5000))
    passage = [word() for _ in range(50)]
    docs = []
    for k in range(60):
        base = [word() for _ in range(r.choice((6, 12, 30, 120, 400)))] + (passage if k % 3 == 0 else [])
        docs.append(base)
        for _ in range(r.randrange(6)):
            w = list(base)
            for _ in range(r.randrange(1, 2 + len(w) // 40)):
                w[r.randrange(len(w))] = word()
            docs.append(w)
    r.shuffle(docs)
    docs = [" ".join(w) for w in docs]
    s = [sets(t) for t in docs]
    label = list(range(len(docs)))
    pairs = [(i, j) for i in label for j in range(i) if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
    for _ in docs:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    assert len(pairs) > 50
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    assert {x["doc_id"] for x in simhash.deduplicated(d).collect()} == set(label)


def test_pairs_of_a_large_key_are_given_in_parts():
    """One task never holds all pairs of a key, nor large tables of them."""
    n = 3000
    one = np.zeros(n, np.int64)
    fp, alone = np.arange(n, dtype=np.int64), np.ones(n, bool)
    tracemalloc.start()
    try:
        pairs = sum(len(x) for x, _ in set_links._between(fp, one + 100, one, one, fp, alone))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pairs == n * (n - 1) // 2 and peak < 32e6


def test_first_pairs_are_those_that_simhash_links(spark, monkeypatch):
    """The stage verifies the pairs of its SimHash fingerprints, by brute force here, before it looks for others."""
    r = random.Random(8)
    docs = []
    for _ in range(40):
        base = ["w" + str(r.randrange(5000)) for _ in range(r.choice((300, 600)))]
        docs.append(" ".join(base))
        for _ in range(r.randrange(5)):
            w = list(base)
            w[r.randrange(len(w))] = "x"
            docs.append(" ".join(w))
    sim = {}
    for t in docs:
        x = set_links.shingle_set(t)
        ones = [2 * sum(int(h) >> bit & 1 for h in x.view(np.uint64)) > len(x) for bit in range(64)]
        sim[t] = sum(1 << (8 * (bit // 8) + bit % 8) for bit in range(64) if ones[bit])
    names = sorted(sim)
    label = list(range(len(names)))
    pairs = [(i, j) for i in label for j in range(i) if (sim[names[i]] ^ sim[names[j]]).bit_count() <= 3]
    for _ in names:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    seen = []
    verified = set_links.verified
    monkeypatch.setattr(set_links, "verified", lambda pairs, sets, texts: (seen.append((pairs, sets, texts)), verified(pairs, sets, texts))[1])
    simhash.deduplicated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).count()
    pairs, sets, texts = seen[0]
    of = {x["fp"]: names.index(x["text"]) for x in sets.join(texts, "row").collect()}
    given = [(of[x["a"]], of[x["b"]]) for x in pairs.collect()]
    mine = list(range(len(names)))
    for _ in names:
        for i, j in given:
            mine[i] = mine[j] = min(mine[i], mine[j])
    assert len(given) > 20 and mine == label
