"""Quality rules as a rule bitmask ledger (DataFrame functions only).

``ledger`` evaluates every rule once per row and stores the failed rules as bits beside the measurements they were
judged on. ``apply_policy`` then needs only a bit mask, so that a new policy version reads the ledger and no text.
``ablations`` aggregates the bits: how many rows each rule rejects, and how many it alone rejects.

Defined results: a null, empty or blank text has no words and fails ``few_words``; a text of any length is measured as
a whole; repeated rows and ties are judged row by row and stay; an empty table gives an empty ledger; other columns are
passed on, and a column named like the ledger's one (``quality_ledger``) is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import SPACE, SPACE_CHARS, words

LEDGER = "quality_ledger"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Bit of each rule; a policy of a version is the mask of the rules that reject.
RULES = {"few_words": 1, "repeated_words": 2, "symbols": 4, "repeated_lines": 8, "word_length": 16, "shouting": 32, "stutter": 64}
POLICIES = {"base": 1 | 2, "v1": 1 | 2 | 4 | 32, "v2": 127}


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """Adds struct column _m. Each step is a column of its own, so that arrays are built once per row."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<bigint>")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumn("_w", words(F.col(text))).withColumn("_l", lines)
    d = d.withColumn("_n", F.size("_w"))
    w, n = F.col("_w"), F.col("_n")
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))
    d = d.withColumn("_h", F.when(n >= WINDOW, hashes).otherwise(none))
    h = F.col("_h")
    # only texts with a repeated window are sorted
    d = d.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_s")
    last = F.size(s) - 1
    twin = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == s[k]["h"])))
    d = d.withColumn("_p", F.when(s.isNotNull(), F.sort_array(F.transform(twin, lambda k: s[k]["i"]))))
    p = F.col("_p")
    # a repeated window covers WINDOW words, or as many as lie before the next repeated one
    cover = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda acc, k: acc + F.when(k == F.size(p) - 1, WINDOW).otherwise(F.least(F.lit(WINDOW), p[F.least(k + 1, F.size(p) - 1)] - p[k])))
    count = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    stutter = F.when(n >= 2, F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: w[i] == w[i - 1]))).otherwise(0)
    measures = {
        "n_words": n, "word_chars": F.length(F.translate(t, SPACE_CHARS, "")), "n_symbols": count(SYMBOLS), "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")), "n_repeat_words": F.when(p.isNull(), 0).otherwise(cover), "n_bangs": count("!"), "n_stutter": stutter,
    }
    # the generator keeps filters on the measurements above it: below, they would repeat the whole work inside lambdas
    m = F.explode(F.array(F.struct(*[v.cast("long").alias(k) for k, v in measures.items()])))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], m.alias("_m"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the struct column ``quality_ledger``: fail_bits and every measurement."""
    own = [c for c in docs.columns if c != LEDGER]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    d = _measured(packed, "_text")
    m = F.col("_m")
    fails = {
        "few_words": m["n_words"] < 10,
        "repeated_words": 100 * m["n_repeat_words"] > 20 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > 3 * m["n_words"],
        "repeated_lines": (m["n_lines"] > 3) & (10 * m["n_dup_lines"] > 3 * m["n_lines"]),
        "word_length": (m["word_chars"] > 25 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"]),
        "shouting": 10 * m["n_bangs"] > 3 * m["n_words"],
        "stutter": 10 * m["n_stutter"] > 4 * m["n_words"],
    }
    bits = F.lit(0)
    for name, bit in RULES.items():
        bits = bits.bitwiseOR(F.when(fails[name], bit).otherwise(0))
    return d.select("_row.*", F.struct(bits.cast("long").alias("fail_bits"), *[m[k].alias(k) for k in d.schema["_m"].dataType.names]).alias(LEDGER))


def apply_policy(judged: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds ``kept`` for a policy version to rows that carry the ledger."""
    return judged.withColumn("kept", F.col(LEDGER)["fail_bits"].bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(judged: DataFrame, policy: str = "v2") -> DataFrame:
    """One row per rule of the policy: rows it rejects, rows only it rejects, rows kept if it were left out."""
    mask = POLICIES[policy]
    bits = F.col(LEDGER)["fail_bits"].bitwiseAND(F.lit(mask))
    names = [k for k, b in RULES.items() if b & mask]
    sums = judged.select(bits.alias("b")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("b") == 0, 1).otherwise(0)).alias("kept"),
        *[F.sum(F.when(F.col("b").bitwiseAND(F.lit(RULES[k])) != 0, 1).otherwise(0)).alias(f"hit_{k}") for k in names],
        *[F.sum(F.when(F.col("b") == RULES[k], 1).otherwise(0)).alias(f"only_{k}") for k in names],
    )
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(F.col(f"hit_{k}"), F.lit(0)).alias("rejected"), F.coalesce(F.col(f"only_{k}"), F.lit(0)).alias("only_this"), (F.coalesce(F.col("kept"), F.lit(0)) + F.coalesce(F.col(f"only_{k}"), F.lit(0))).alias("kept_without")) for k in names])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def digest(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The contract's rows: measurements, base verdict and the policy's verdict."""
    d = apply_policy(ledger(docs.select("doc_id", "text")), policy)
    m = F.col(LEDGER)
    base = m["fail_bits"].bitwiseAND(F.lit(POLICIES["base"])) != 0
    return d.select("doc_id", *[m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base.alias("base_failed"), "kept", m["fail_bits"].alias("fail_bits"))


#: DuckDB twin of ``digest`` under policy v2.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT win.doc_id, unnest(range(i, i + 5)) AS p FROM win JOIN rep ON win.doc_id = rep.doc_id AND win.g = rep.g) GROUP BY doc_id),
stut AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM d) WHERE w[i] = w[i - 1] GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             length(t) - length(replace(t, '!', '')) AS n_bangs, coalesce(stut.n, 0) AS n_stutter
      FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN stut ON stut.doc_id = d.doc_id),
b AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
             + (CASE WHEN n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END)
             + (CASE WHEN 10 * n_bangs > 3 * n_words THEN 32 ELSE 0 END) + (CASE WHEN 10 * n_stutter > 4 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

#: DuckDB twin of ``ablations`` under policy v2.
ABLATION_SQL = SQL[: SQL.rindex("SELECT doc_id, n_words")] + f"""SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS rejected, count(*) FILTER (fail_bits = bit) AS only_this, count(*) FILTER (fail_bits = 0 OR fail_bits = bit) AS kept_without
FROM b, (VALUES {", ".join(f"('{k}', {v}::BIGINT)" for k, v in RULES.items())}) AS r(rule, bit) GROUP BY rule
"""
