"""Registered queries against brute-force versions, or against their SQL, on a small table."""

import hashlib
import html
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from folioflow.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def near(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(map(near, r)) for r in map(tuple, got.select(columns).collect())) == sorted(tuple(map(near, r)) for r in want.fetchall())


def fingerprint(text):
    import xxhash

    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(ids, fps):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash(spark, texts):
    fps = {i: fingerprint(t) for i, t in texts.items()}
    label = linked(sorted(texts), fps)
    rows = queries.op1_simhash(spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fps[i]:016x}", label[i]) for i in texts}


@pytest.mark.parametrize("hot", [1 << 14, 50])
def test_simhash_links_every_distance(spark, hot, monkeypatch):
    """Pairs at all ways to spread up to 3 bits over the halves link; pairs at 4 do not; a large group of near copies stays whole, also where its anchors are split."""
    import random

    from folioflow.llm import simhash
    from folioflow.llm.simhash import classes

    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "ONE_IN", 1 if hot == 50 else 16)

    r = random.Random(5)
    rows, expected = [], {}
    for k in range(300):
        base, flips = r.getrandbits(64), k % 5
        other = base
        for b in r.sample(range(64), flips):
            other ^= 1 << b
        rows += [(2 * k, base), (2 * k + 1, other)]
        expected[2 * k + 1] = 2 * k if flips <= 3 else 2 * k + 1
    centre = r.getrandbits(64)
    group = {centre}
    while len(group) < 1500:
        x = r.choice(list(group)) ^ (1 << r.randrange(64))
        if (x ^ centre).bit_count() <= 9:
            group.add(x)
    rows += [(10_000 + i, x) for i, x in enumerate(sorted(group))]
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in rows]
    d = spark.createDataFrame(signed, "doc_id long, fp long")
    c = {r["doc_id"]: r["component_id"] for r in d.join(classes(d), "fp").collect()}
    assert all(c[i] == e for i, e in expected.items())
    assert {c[10_000 + i] for i in range(1500)} == {10_000}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secret_base_spans(spark, texts):
    for r in queries.op5_secret_scan(spark, SF).collect():
        t = texts[r["doc_id"]] or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        n = Counter(k for _, k, _ in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (n[0], n[1], n[2], hashlib.sha256(text.encode()).hexdigest())
        assert set(text.split(",")) <= set(r["spans"].split(",")) or not text


def test_secret_network_on_held_out_findings():
    import numpy as np

    from folioflow.llm import secrets

    net = secrets.network()
    found = secrets.generated_findings(800, seed=99)
    s = np.array([net.scores(np.stack(list(secrets.windows(t, a, b, run)))).mean() for t, a, b, run, _ in found])
    y = np.array([label for *_, label in found])
    assert (s[y == 1] >= net.threshold).mean() >= 0.95
    assert (s[y == 0] >= net.threshold).mean() <= 0.05


def test_html_extraction(spark):
    pages = {r[0]: r[1] for r in duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall()}
    for r in queries.op6_html_extraction(spark, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_host_suffix_array(spark):
    """Open pages: tokens that 8-token runs of another page of the host cover go, by brute force; a host's runs don't touch others."""
    import random

    from folioflow.llm.html_extract import extract

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    menu, foot = [word() for _ in range(12)], [word() for _ in range(9)]
    body = {k: menu + [word() for _ in range(30)] + (foot if k % 3 else []) for k in range(120)}
    host = {k: "a.org" if k % 10 else f"b{k}.org" for k in body}
    d = spark.createDataFrame([(k, f"http://{host[k]}/{k}", f"<div>{' '.join(w[:20])}</div><p>{' '.join(w[20:])}</p>") for k, w in body.items()], "page_id long, url string, html string").repartition(9)
    seen = defaultdict(set)
    for k, w in body.items():
        for i in range(len(w) - 7):
            seen[host[k], tuple(w[i : i + 8])].add(k)
    for row in extract(d).collect():
        w, k = body[row["page_id"]], row["page_id"]
        gone = {j for i in range(len(w) - 7) if len(seen[host[k], tuple(w[i : i + 8])]) > 1 for j in range(i, i + 8)}
        assert row["text"] == " ".join(x for j, x in enumerate(w) if j not in gone)


def test_token_counts(spark, texts):
    from folioflow.llm.token_counts import VOCABULARY, load_tokenizer

    tok = load_tokenizer(VOCABULARY)
    odd = spark.createDataFrame([(1, "a<|endoftext|>b  <|startoftext|> 's don't"), (2, "é x y \u001cz"), (3, "ΑΣ ΟΔΟΣ İ ǅ 12345 ½ ٣٤"), (4, "w" * 5000), (5, "🙂🙂 éé\n\t")], "doc_id long, text string")
    from folioflow.llm import token_counts

    for rows, source in ((queries.op8_token_counts(spark, SF).collect(), texts), (token_counts.digest(odd).collect(), {r["doc_id"]: r["text"] for r in odd.collect()})):
        for r in rows:
            t = source[r["doc_id"]] or ""
            n = len(tok.encode(t, add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(t.encode()), n > 2048), t[:50]


def test_language_id_on_held_out_rows(spark):
    import zlib

    lang = dict(duckdb.sql(f"select doc_id, lang from '{SF.replace('0.001', '0.01')}/documents.parquet'").fetchall())
    rows = queries.op10_language_id(spark, SF.replace("0.001", "0.01")).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def ppm_bits(corpus, word):
    """Code length of a word and the blank after it by a plain walk down the context tree of a corpus of words."""
    import math

    count = defaultdict(Counter)
    for w in corpus:
        x = b" " + w + b" "
        for i in range(1, len(x)):
            for k in range(6):
                count[x[max(0, i - k) : i].rjust(k, b"\0")][x[i]] += 1

    def bits(context, s):
        c = count[context]
        below = lambda: bits(context[1:], s) if context else 8.0
        if not c:
            return below()
        total, kinds = sum(c.values()), len(c)
        return -math.log2(c[s] / (total + kinds)) if c[s] else -math.log2(kinds / (total + kinds)) + below()

    x = b" " + word + b" "
    return sum(bits(x[max(0, i - 5) : i].rjust(5, b"\0"), x[i]) for i in range(1, len(x)))


def test_ppm_code_lengths():
    """The frozen tables give the code lengths of a plain walk down the context tree."""
    from folioflow.llm.language_id import Model, split

    texts = {"x": ["abracadabra abracadabra", "été à la plage"], "y": ["hello world hello"], "z": ["привет мир"]}
    model = Model(texts)
    for t in ("abra hello été zz мир", "q", "x" * 200 + " abra", ""):
        got = model.lengths([t, t])
        assert got.shape == (2, 3) and (got[0] == got[1]).all()
        for lang, corpus in texts.items():
            want = sum(ppm_bits([w for c in corpus for w in split(c)], w) for w in split(t))
            assert abs(got[0][model.languages.index(lang)] - want) < 1e-3


def test_language_id_query_by_brute_force(spark):
    """The whole query on a small fixture: sample, predictions, und."""
    import zlib

    from folioflow.llm import language_id

    base = {"en": "the house by the water and the old tree", "de": "das haus am wasser und der alte baum", "ru": "дом у воды и старое дерево", "uk": "дім біля води і старе дерево"}
    rows = [(k, f"{base[lang]} {k % 7}", lang) for k, lang in enumerate(sorted(base) * 12)] + [(900, "1234 --", "en"), (901, None, "en"), (902, "старе дерево", None), (None, "the old house", None)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    corpus = defaultdict(set)
    for i, t, lang in rows:
        if t and lang and not held(i):
            corpus[lang].add(t)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for r in language_id.digest(d).collect():
        t = next(t for i, t, _ in rows if i == r["doc_id"])
        assert r["held_out"] == held(r["doc_id"])
        if not t or not any(map(str.isalpha, t)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        want = {lang: sum(ppm_bits([w for c in c_ for w in language_id.split(c)], w) for w in language_id.split(t)) for lang, c_ in corpus.items()}
        assert r["lang_pred"] == min(sorted(want), key=want.get) and 1 / len(base) - 1e-9 <= r["score"] <= 1


def test_many_languages_and_long_texts(spark):
    """All of 71 languages are learned, also one of long texts only; two of one script are told apart."""
    import random

    from folioflow.llm import language_id

    r = random.Random(9)
    scripts = [[chr(x) for x in range(a, a + 20)] for a in (0x61, 0x430, 0x3B1, 0x5D0, 0x4E00, 0xAC00)]
    words = {f"l{k:02}": ["".join(r.choice(scripts[k % 6]) for _ in range(r.randrange(2, 6))) for _ in range(60)] for k in range(71)}
    text = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = [(100 * k + i, text(lang, 30_000 if k == 3 else 40), lang) for k, lang in enumerate(words) for i in range(9)]
    rows += [(10_000 + k, text(lang, 12), None) for k, lang in enumerate(words)]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {got[10_000 + k][0] for k in range(71)} == set(words)
    assert all(got[10_000 + k][0] == lang for k, lang in enumerate(words))


def repeating_docs(seed):
    """Documents that share passages, some word for word twice, and what is to be removed of each by all windows."""
    import random

    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(300))
    shared = [[word() for _ in range(n)] for n in (34, 35, 36, 80)]
    docs = {}
    for k in range(120):
        w = [word() for _ in range(r.randrange(5, 90))]
        for s in shared:
            if r.random() < 0.3:
                at = r.randrange(len(w) + 1)
                w[at:at] = s[: r.randrange(34, len(s) + 1)]
        docs[k] = w
    docs[200] = docs[201] = docs[3]
    windows = Counter(tuple(w[i : i + 35]) for w in docs.values() for i in range(len(w) - 34))
    want = {}
    for k, w in docs.items():
        gone = {j for i in range(len(w) - 34) if windows[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[k] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return {k: " ".join(w) for k, w in docs.items()}, want


def test_substring_dedup_in_batches(spark):
    """Any number of batches gives the same rows, runs are compacted, and shared passages go word for word."""
    from folioflow.llm import substring_dedup

    docs, want = repeating_docs(11)
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for batches in (1, 7):
        assert {x[0]: (x[1], x[2], x[3]) for x in map(tuple, substring_dedup.digest(d, batches).collect())} == want


@pytest.mark.parametrize("seed", [12, 13])
def test_substring_dedup_of_a_later_batch(spark, tmp_path, seed):
    """An index that was saved and loaded judges a later batch alone as all documents at once do; its old runs are not shuffled."""
    from folioflow.llm import substring_dedup

    docs, want = repeating_docs(seed)
    part = lambda ids: spark.createDataFrame([(k, docs[k]) for k in ids], "doc_id long, text string")
    ids = sorted(docs)
    old, new = [k for k in ids if k % 3], [k for k in ids if k % 3 == 0]
    index = substring_dedup.FingerprintIndex(spark, 4)
    for half in (old[::2], old[1::2]):
        index.append(substring_dedup.anchored(part(half)))
    index.save(str(tmp_path / "index"))
    index = substring_dedup.FingerprintIndex.load(spark, str(tmp_path / "index"))
    joined = index._run(index.runs[0]).alias("x").join(index._run(index.runs[1]).alias("y").hint("merge"), "h")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    index.append(substring_dedup.anchored(part(new)))
    assert len(index.runs) == 1 and len(index.found) == 3
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_dedup.without_repeats(part(new), index, 2, part(old)).collect()}
    assert got == {k: want[k] for k in new}


def test_mixing_comes_near_targets(spark):
    rows = queries.op2_source_mixing(spark, SF.replace("0.001", "0.1")).collect()
    source = dict(duckdb.sql(f"select doc_id, source from '{SF.replace('0.001', '0.1')}/documents.parquet'").fetchall())
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in rows)) < 1
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)


def alike(texts):
    """Smallest id of each group of texts linked at 4/5 of their 5-word shingles, by all pairs."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label, ids, changed = {i: i for i in texts}, sorted(texts), True
    pairs = [(i, j) for i in ids for j in ids if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def folded(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def leaks(w, items):
    """Whether a text holds a 13-word window of an item, or items make a twentieth of its words."""
    hit = set()
    for x in items:
        k = min(13, len(x))
        windows = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in windows:
                if k == 13:
                    return True
                hit.update(range(i, i + k))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_stage_drops_long_documents_with_one_window(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"item{k}" for k in range(40))
    filler = [f"filler{k}" for k in range(2000)]
    spark.createDataFrame([(1, item), (2, "two words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = lambda *x: " ".join([*filler[:700], *x, *filler[700:]])
    rows = [(1, text(*item.split()[5:18])), (2, text(*item.split()[5:17])), (3, text("two", "words")), (4, "two words and a few more of them"), (5, None), (6, "")]
    left = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 5, 6]


def test_pipeline(spark):
    """run() against a plain version of all stages."""
    import corpus_pipeline

    docs = duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()
    kept = {r["doc_id"] for r in queries.op9_quality_rules(spark, SF).collect() if r["kept"]}  # held against its SQL above
    left = {i: (t, s) for i, t, s in docs if i in kept}
    label = alike({i: t for i, (t, _) in left.items()})
    left = {i: x for i, x in left.items() if label[i] == i}
    items = [folded(t) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    left = {i: x for i, x in left.items() if not leaks(folded(x[0]), items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(left)
    for i, (t, _) in left.items():
        spans = sorted([(m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6] + [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}", t)] + [m.span() for m in re.finditer("[0-9a-f]{24,}", t)])
        end, parts = 0, []
        for a, b in spans:
            if a >= end:
                parts += [t[end:a], "[SECRET]"]
            end = max(end, b)
        assert got[i]["size"] == len(WORD.findall("".join([*parts, t[end:]])))
    assert sum(r["taken"] for r in got.values()) <= 1.5 * sum(r["size"] for r in got.values())
