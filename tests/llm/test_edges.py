"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest

from folioflow.llm import decontaminate, html_extract, language_id, mixing, quality_rules, secrets, simhash, substring_dedup, token_counts, url_filters

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
PROSE = "The committee met on Tuesday to discuss the budget for the coming year, and after several hours of debate the members agreed on a plan."
ROWS = [
    (1, PROSE, "en", "a", 10), (1, PROSE, "en", "a", 10), (2, None, None, None, None), (None, "no id here at all, but enough words to pass every one of the rules", "en", "b", 3), (3, "", "en", "a", 0),
    (4, " \n\t ", "fr", None, 4), (5, LONG, "en", "c", len(LONG)), (6, PROSE + " Indeed.", "en", "a", 11), (7, ITEM, "en", "b", 60), (None, None, None, None, None), (8, "x", "de", "b", 1), (9, "123 456", "de", "c", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry the names that operators use inside."""
    d = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for name in ("fp", "row", "size", "kept", "_row", "_hit", "th", "findings", "language", "n_tokens", "quality_ledger", "component_id", "taken", "_m", "_w", "finish"):
        d = d.selectExpr("*", f"'x' as `{name}`")
    return d


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, "zeta eta"), (1, ITEM)], "item_id long, text string")


def test_quality_rules(docs, nothing):
    rows = {r["doc_id"]: r for r in quality_rules.digest(docs).collect()}
    assert quality_rules.digest(docs).count() == len(ROWS)
    assert rows[2]["n_words"] == 0 and rows[2]["base_failed"] and not rows[2]["kept"] and rows[1]["kept"]
    assert rows[5]["n_words"] == 120_000
    assert quality_rules.digest(nothing).count() == 0
    judged = quality_rules.apply_policy(quality_rules.ledger(docs))
    assert {r["rule"]: r["rejected"] for r in quality_rules.ablations(judged).collect()}["few_words"] == 6
    assert sum(r["only_this"] for r in quality_rules.ablations(quality_rules.ledger(nothing)).collect()) == 0


def test_simhash(docs, nothing):
    rows = simhash.digest(docs).collect()
    assert len(rows) == len(ROWS)
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {2}
    assert simhash.digest(nothing).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id is null").count() == 1
    assert simhash.deduplicated(nothing).count() == 0


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) <= 1.5 * sum(r["size"] for r in rows)
    assert mixing.mix(nothing).count() == 0
    assert [r["taken"] for r in mixing.mix(docs.where("doc_id = 2")).collect()] == [0]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def test_decontamination(docs, nothing, benchmark):
    rows = {r["doc_id"]: r for r in decontaminate.digest(docs, benchmark).collect()}
    assert rows[7]["n_hit"] == 15 and rows[7]["n_items"] == 2 and rows[7]["contaminated"]
    assert rows[2]["n_words"] == 0 and not rows[2]["contaminated"] and rows[1]["n_hit"] == 0
    assert decontaminate.digest(nothing, benchmark).count() == 0
    assert decontaminate.digest(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.digest(docs, benchmark).count() == len(ROWS)


def test_decontamination_in_blocks(docs, benchmark, monkeypatch):
    whole = sorted(map(str, decontaminate.digest(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_PIECES", 1)
    monkeypatch.setattr(decontaminate, "PIECE", 1)
    assert sorted(map(str, decontaminate.digest(docs, benchmark).collect())) == whole


def test_secrets(docs, nothing, spark):
    assert secrets.digest(docs).count() == len(ROWS)
    assert secrets.digest(nothing).count() == 0
    net = secrets.network()
    d = spark.createDataFrame([(1, 'a token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" end', 3), (2, None, None)], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in secrets.redacted(d, net).collect()}
    assert out[1]["text"] == 'a [SECRET]" end' and out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] is None
    assert secrets.redacted(docs, net).columns == docs.columns


def test_html(spark):
    rows = [(1, "http://h.org/a", "<article><h1>T</h1><p>a &amp; b</article>"), (1, "http://h.org/a", "<article><h1>T</h1><p>a &amp; b</article>"), (2, None, None), (None, "x", ""), (3, "http://h.org/b", "<p>" + "long text " * 50_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'x' as z", "'x' as ph")
    out = html_extract.extract(d).collect()
    assert len(out) == 5 and sorted(r["text"] for r in out)[:2] == ["", ""]
    assert [r["text"] for r in out if r["page_id"] == 1] == ["T a & b"] * 2
    assert max(r["n_chars"] for r in out) == 499_999
    assert html_extract.extract(d.limit(0)).count() == 0


def test_substring_dedup(docs, nothing):
    rows = substring_dedup.digest(docs)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert rows.count() == len(ROWS) and got[2]["n_words"] == 0 and got[1]["n_removed"] == 0
    assert got[5]["n_words"] == 120_000 and got[5]["n_removed"] > 100_000
    assert substring_dedup.digest(nothing).count() == 0


def test_token_counts(docs, nothing):
    rows = {r["doc_id"]: r for r in token_counts.digest(docs).collect()}
    assert rows[2]["n_tokens"] == 0 and rows[2]["n_bytes"] == 0 and rows[5]["over_limit"]
    assert token_counts.digest(docs).count() == len(ROWS) and token_counts.digest(nothing).count() == 0


def test_language_id(docs, nothing):
    rows = {r["doc_id"]: r for r in language_id.digest(docs).collect()}
    assert rows[2]["lang_pred"] == "und" and rows[9]["lang_pred"] == "und" and rows[3]["score"] == 0.0
    assert language_id.digest(docs).count() == len(ROWS) and language_id.digest(nothing).count() == 0
    unlabelled = language_id.digest(docs.withColumn("lang", docs["lang"].substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') as lang"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_url_filters(spark):
    rows = [(1, "https://a.Example.org/en/12?x"), (2, None), (None, "nothing"), (1, "https://a.Example.org/en/12?x"), (3, "http://x.com/de/" + "a" * 50_000), (4, "http://" + "a." * 2000 + "org/"), (5, "http://x.org")]
    d = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "'x' as rule", "'x' as _short")
    out = url_filters.filter_urls(d, url_filters.contract_rules(spark)).collect()
    got = {r["page_id"]: r for r in out}
    assert len(out) == 7 and got[1]["rule"] == "example.org/en/1" and got[1]["verdict"] == "block" and got[1]["host"] == "a.example.org"
    assert got[3]["rule"] == "com/de/" and got[4]["rule"] == "org/" and got[5]["rule"] is None and got[2]["host"] == "" and got[2]["verdict"] == "allow"
    assert url_filters.filter_urls(d.limit(0), url_filters.contract_rules(spark)).count() == 0


def test_pipeline_stages(spark, docs, nothing, benchmark, tmp_path):
    import corpus_pipeline

    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, nothing):
        d = start
        for name, stage in corpus_pipeline.STAGES:
            d.write.mode("overwrite").parquet(str(tmp_path / f"{name}-{start is docs}"))
            d = stage(spark, spark.read.parquet(str(tmp_path / f"{name}-{start is docs}")), str(tmp_path))
            if name != "source mixing":
                assert d.columns == docs.columns, name
        ids = sorted(r["doc_id"] for r in d.collect() if r["doc_id"] is not None)
        assert ids == ([1] if start is docs else [])  # 6 is a near copy of 1, 7 an item of the benchmark
