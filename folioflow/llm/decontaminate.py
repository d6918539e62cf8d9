"""Benchmark decontamination by a prefix-filtered join of shingles with exact window verification.

Windows are 13 consecutive words of a benchmark item (an item of fewer words is one window). A document that holds a
window holds all its shingles (pairs of words), so one necessary shingle each suffices as prefix: the rarest of the
window, by counts over all documents. Documents probe the prefix table with their own shingles; a hit fixes where the
window would lie, the bounds of text and item are applied to that place, and the words are compared.

The benchmark is cut into pieces of at most ``PIECE`` windows (overlapping, so that no window is lost). Pieces are
broadcast in blocks of about ``BLOCK_PIECES``; a larger benchmark takes several passes over the documents, whose hits
add up row by row.

Defined results: a null or empty text has no words and no hits; items without words have no window; a null item id
counts as an empty string; items of one id count once; repeated documents are judged each; texts are read whole; an
empty benchmark or table gives zero hits or no rows; other columns are passed on by ``with_hits``, and one named
``_hit`` is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import saved

WINDOW = 13
PIECE, BLOCK_PIECES = 2048, 200
HIT = "_hit"

#: Bytes that are not of a word become blanks, A-Z become a-z; all bytes of other scripts are of words.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def pieces(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item and words (joined by blanks) of pieces whose windows together are those of all items."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, text in zip(b["item"], b["text"], strict=True):
                w = tokens(text)
                for a in range(0, max(1, len(w) - window + 1), PIECE):
                    if w:
                        rows.append((item, b" ".join(w[a : a + PIECE + window - 1]).decode()))
            yield pd.DataFrame(rows, columns=["item", "words"])

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInPandas(cut, "item string, words string").distinct()


def _shingles(w: list[bytes]) -> list:
    return list(zip(w, w[1:], strict=False)) if len(w) > 1 else w


class Matcher:
    """Prefix table of one block: shingle -> (piece, place in it, first and last window start that it stands for)."""

    def __init__(self, block: list[tuple[str, list[bytes]]], rarity: dict, window: int = WINDOW):
        self.block, self.window, self.prefix = block, window, {}
        for k, (_, w) in enumerate(block):
            size, s = min(window, len(w)), _shingles(w)
            span = max(1, size - 1)  # shingles of a window
            rank = [(rarity.get(x, 0), i) for i, x in enumerate(s)]
            chosen: dict[int, list[int]] = {}
            for start in range(len(w) - size + 1):
                chosen.setdefault(min(rank[start : start + span])[1], []).append(start)
            for place, starts in chosen.items():
                self.prefix.setdefault(s[place], []).append((k, place, starts[0], starts[-1], size))
        self.singles = any(isinstance(x, bytes) for x in self.prefix)  # items of one word

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words that lie in occurrences, sorted and disjoint, and the items."""
        spans, items, prefix = [], set(), self.prefix
        for probe in (_shingles(w), w) if self.singles and len(w) > 1 else (_shingles(w),):
            for i, x in enumerate(probe):
                if x in prefix:
                    for k, place, first, last, size in prefix[x]:
                        item, p = self.block[k]
                        back, a = i - place, place
                        while a > max(first, -back) and w[back + a - 1] == p[a - 1]:
                            a -= 1
                        b, end = place, min(last + size, len(w) - back)
                        while b < end and w[back + b] == p[b]:
                            b += 1
                        if b - a >= size:
                            items.add(item)
                            spans.append((back + a, back + b))
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _rarity(docs: DataFrame, text: str, wanted: set) -> dict:
    """How often each wanted shingle stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(sorted(wanted, key=repr))})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        ids = shared.value
        for b in batches:
            for t in b["text"]:
                seen.update(filter(None.__ne__, map(ids.get, _shingles(tokens(t)))))
        yield pd.DataFrame({"k": list(seen), "n": list(seen.values())}, dtype="int64")

    counts = docs.select(F.col(text).alias("text")).mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    names = {i: x for x, i in shared.value.items()}
    return {names[r["k"]]: r["n"] for r in counts.collect()}  # at most as many rows as the block has shingles


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with struct ``_hit``: n_words, spans (first, end, first, end, ...) and items."""
    parts = saved(pieces(benchmark, window))
    n_blocks = max(1, -(-parts.count() // BLOCK_PIECES))
    block_of = F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks))
    empty = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"))
    d = docs.withColumn(HIT, empty)
    for k in range(n_blocks):
        rows = parts.where(block_of == k).collect()  # about BLOCK_PIECES pieces of bounded size
        block = [(r["item"], r["words"].encode().split()) for r in sorted(rows)]
        matcher = Matcher(block, _rarity(docs, text, {x for _, w in block for x in _shingles(w)}), window)
        shared = docs.sparkSession.sparkContext.broadcast(matcher)
        d = d.withColumn(HIT, _finder(shared)(F.col(text), F.col(HIT)))
        if k + 1 < n_blocks:
            d = saved(d)
    return d


def _finder(shared):
    @F.pandas_udf("n_words long, spans array<int>, items array<string>")
    def find(columns: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts, before in columns:
            rows = []
            for t, spans, items in zip(texts, before["spans"], before["items"], strict=True):
                w = tokens(t)
                found, names = m.find(w)
                old = list(spans)
                both = merged([*zip(old[::2], old[1::2], strict=True), *found])
                rows.append((len(w), [int(x) for ab in both for x in ab], sorted(names.union(items))))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return find


def _hit_words():
    spans = F.col(HIT)["spans"]
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: x - acc)  # alternating sum of ends and firsts


def contaminated():
    return (_hit_words() > 0) & (20 * _hit_words() >= F.col(HIT)["n_words"])


def holds_window(window: int = WINDOW):
    """Whether a whole window of ``window`` words of the benchmark stands in the text, however long the rest is; or ``contaminated``."""
    spans = F.col(HIT)["spans"]
    places = F.sequence(F.lit(1), F.size(spans) - 1, F.lit(2))  # ends; each start stands before its end
    long = F.when(F.size(spans) > 0, F.exists(places, lambda i: spans[i] - spans[i - 1] >= window)).otherwise(False)
    return long | contaminated()


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    d = with_hits(docs.select("doc_id", "text"), benchmark)
    items = F.col(HIT)["items"]
    return d.select("doc_id", F.col(HIT)["n_words"].alias("n_words"), _hit_words().alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array(items), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


SQL = r"""
WITH f AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents, f),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark, f),
iw AS (SELECT DISTINCT item, k, list_slice(w, s, s + k - 1) AS g FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, s, list_slice(w, s, s + k - 1) AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT doc_id, s, dw.k, item FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
