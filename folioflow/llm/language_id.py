"""Language identification by prediction with partial matching (PPM).

Each language has a tree of byte contexts of orders 0 to ``ORDER`` with escape method C. Texts are lower-cased, in any
script, and cut at white space, digits and ASCII marks; a byte's context are the bytes before it back to the blank before its word. After
training the statistics are frozen: the code length of a word is then a function of the word, summed from tables of
code lengths by gram (context and byte) and of escapes by context, so each worker keeps the code lengths of the words
it has met, and a text's code length in each language is a sum over its words. The shortest wins.

Training reads a bounded sample of each language: the ``TRAIN_DOCS`` different texts of smallest hash (fewer beyond
``TRAIN_BYTES`` in all), each to its first ``TRAIN_CHARS`` characters. All values of lang are learned, up to
``LABELS`` of them; more are refused. Contexts are pruned by their share in the language that has the most of it, so that the
tables take ``MODEL_BYTES`` at most; pruned contexts fall back to shorter ones.

The score is the softmax of code lengths over the root of the text's length, by a temperature that is fitted on a
fifth of the sample and on short pieces of it, with the tables of the other four fifths.

Defined results: null, and texts without a letter, give ``und`` with score 0; the same holds for all rows where
nothing was learned; long texts are scored whole; ties go to the language first in order; repeated rows get the same
result, and count once in training; a null id is not held out; an empty table gives an empty result; of other columns
none is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = 5
TRAIN_DOCS, TRAIN_CHARS, TRAIN_BYTES, LABELS = 300, 4000, 256 << 20, 10_000
MODEL_BYTES = 64 << 20
FOLDS, HELD = 4, 2
#: Words of a worker's cache: up to so many bytes each, so many of them, and so many bytes of code lengths in all.
LONGEST, CACHED, CACHE_BYTES = 64, 500_000, 48 << 20
#: Score so many code lengths (bytes times languages) at once.
CHUNK = 1 << 20
#: Digits and ASCII marks say nothing about the language: they part words like blanks, but for the apostrophe.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() or b == 39 else 32 for b in range(256))
BLANK = 32


def split(text: str) -> list[bytes]:
    """A text's words, lower-cased."""
    return text.lower().encode().translate(_PLAIN).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte of the words and of the blank after each: itself and the ORDER bytes before it, packed; and each word's first place."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(first, sizes)  # in its word
    out = joined[1:].copy()
    for k in range(1, ORDER + 1):  # no context reaches beyond the blank before the word
        there = place + 1 >= k
        out[there] |= joined[1 + np.flatnonzero(there) - k] << (8 * k)
    return out, first


def _low(gram: np.ndarray, order: int) -> np.ndarray:
    """Grams with contexts of a lower order."""
    return gram & ((1 << 8 * (order + 1)) - 1)


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    return at, keys[at] == asked if len(keys) else np.zeros(len(asked), bool)


class Model:
    """Frozen tables of each order: grams, their code lengths by language, contexts, and their escapes by language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.temperature = 1.0
        n_lang, seen = len(self.languages), []
        for lang in self.languages:
            counted = Counter(w for t in samples[lang] for w in split(t))
            words = list(counted)
            g, first = grams(words)
            n = np.repeat(np.fromiter(counted.values(), np.int64, len(words)), np.diff(first, append=len(g)))
            orders = []
            for k in range(ORDER + 1):
                keys, back = np.unique(_low(g, k), return_inverse=True)
                orders.append((keys, np.bincount(back, n, len(keys))))
            seen.append(orders)
        rows = MODEL_BYTES // (8 + 4 * max(1, n_lang)) // 2  # a context has one gram at least
        least = self._least_share(seen, rows)
        self.keys, self.cost, self.contexts, self.escape = [], [], [], []
        for k in range(ORDER + 1):
            kept = []
            for orders in seen:
                keys, n = orders[k]
                kept.append((keys, n))
            union = np.unique(np.concatenate([np.zeros(0, np.int64), *(keys for keys, _ in kept)]))
            names, back = np.unique(union >> 8, return_inverse=True)
            if k > 1:
                share = np.zeros(len(names))
                for keys, n in kept:
                    at = np.searchsorted(names, keys >> 8)
                    np.maximum(share, np.bincount(at, n, len(names)) / max(1, n.sum()), out=share)
                union = union[share[back] >= least]
                names, back = np.unique(union >> 8, return_inverse=True)
            count = np.zeros((len(union), n_lang), np.float32)
            for j, (keys, n) in enumerate(kept):
                at, there = _find(union, keys)
                count[at[there], j] = n[there]
            total, kinds = np.zeros((len(names), n_lang), np.float32), np.zeros((len(names), n_lang), np.float32)
            np.add.at(total, back, count)
            np.add.at(kinds, back, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0).astype(np.float32)
                below = self.cost[k - 1][_find(self.keys[k - 1], _low(union, k - 1))[0]] if k else np.float32(8)
                cost = np.where(count > 0, -np.log2(count / (total + kinds)[back]), escape[back] + below).astype(np.float32)
            for table, x in ((self.keys, union), (self.cost, cost), (self.contexts, names), (self.escape, escape)):
                table.append(x)
        self._fresh()

    @staticmethod
    def _least_share(seen: list, rows: int) -> float:
        """The least share of a context in a language, so that the grams of contexts above it are about ``rows`` at most."""
        shares, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        for orders in seen:
            for keys, n in orders[2:]:
                _, back, kinds = np.unique(keys >> 8, return_inverse=True, return_counts=True)
                shares.append(np.bincount(back, n) / max(1, n.sum()))
                sizes.append(kinds)
        share, size = np.concatenate(shares), np.concatenate(sizes)
        order = np.argsort(-share, kind="stable")
        over = np.searchsorted(np.cumsum(size[order]), rows, "right")
        return 0.0 if over >= len(order) else float(np.nextafter(share[order[over]], 1))

    def _fresh(self) -> None:
        self.place: dict[bytes, int] = {}
        self.known = np.zeros((0, len(self.languages)), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    def word_lengths(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word, and of the blank after it, in each language."""
        out = np.zeros((len(words), len(self.languages)))
        step, i = max(1, CHUNK // max(1, len(self.languages))), 0
        while i < len(words):
            j, size = i, 0
            while j < len(words) and (j == i or size + len(words[j]) < step):
                size += len(words[j]) + 1
                j += 1
            g, first = grams(words[i:j])
            for a in range(0, len(g), step):  # a word may be longer than a step
                part = g[a : a + step]
                cost, on = np.full((len(part), len(self.languages)), 8, np.float32), np.arange(len(part))
                for k in range(ORDER + 1):  # a context is known only if its shorter ones are
                    low = _low(part[on], k)
                    at, there = _find(self.contexts[k], low >> 8)
                    on, low = on[there], low[there]
                    cost[on] += self.escape[k][at[there]]
                    at, there = _find(self.keys[k], low)
                    cost[on[there]] = self.cost[k][at[there]]
                word = np.searchsorted(first, np.arange(a, a + len(part)), "right") - 1
                starts = np.flatnonzero(np.diff(word, prepend=-1))
                out[i + word[starts]] += np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
            i = j
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
                size += len(texts[j])
                j += 1
            out[i:j] = self._some(texts[i:j])
            i = j
        return out

    def _some(self, texts: list[str]) -> np.ndarray:
        """Bits of texts that fit into memory together, or of one text of any length."""
        split_ = [split(t) for t in texts]
        new = set().union(*split_).difference(self.place)
        if len(self.place) + len(new) > min(CACHED, CACHE_BYTES // (4 * max(1, len(self.languages)))):
            self._fresh()
            new = set().union(*split_)
        if len(new) * len(self.languages) * 4 > CACHE_BYTES or max(map(len, new), default=0) > LONGEST:
            return np.stack([self._plain(w) for w in split_])
        if new:
            names = list(new)
            self._add(names, self.word_lengths(names))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split_)), np.int64, sum(map(len, split_)))
        sizes = np.fromiter(map(len, split_), np.int64, len(split_))
        out, first = np.zeros((len(texts), len(self.languages))), np.cumsum(sizes) - sizes
        some = sizes > 0
        if some.any():
            out[some] = np.add.reduceat(self.known[at], first[some], axis=0, dtype=np.float64)
        return out

    def _plain(self, words: list[bytes]) -> np.ndarray:
        """The sum without the cache, for texts of long or very many different words."""
        total, size = np.zeros(len(self.languages)), max(1, CHUNK // 64)
        for i in range(0, len(words), size):
            counted = Counter(words[i : i + size])
            total += np.array(list(counted.values())) @ self.word_lengths(list(counted))
        return total

    def _add(self, names: list[bytes], bits: np.ndarray) -> None:
        n = len(self.place)
        if n + len(names) > len(self.known):
            more = np.zeros((max(1 << 12, len(self.known), len(names)), len(self.languages)), np.float32)
            self.known = np.concatenate([self.known, more])
        self.known[n : n + len(names)] = bits
        self.place.update(zip(names, range(n, n + len(names)), strict=True))

    def shares(self, texts: list[str]) -> np.ndarray:
        """Softmax of the languages for each text."""
        bits = self.lengths(texts)
        root = np.sqrt([max(1, len(t.encode())) for t in texts])[:, None]
        e = np.exp(-np.minimum((bits - bits.min(1, keepdims=True)) / root * self.temperature, 700))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        there = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        if there:
            share = self.shares([texts[i] for i in there])
            for i, b, s in zip(there, share.argmax(1), share.max(1), strict=True):
                lang[i], score[i] = self.languages[b], float(s)
        return lang, score


def calibrated(samples: dict[str, list[str]]) -> Model:
    """The model of all samples, with the temperature that a model of four fifths needs on the last fifth, whole and in pieces."""
    model = Model(samples)
    fit = Model({k: [t for i, t in enumerate(v) if i % 5 or len(v) < 5] for k, v in samples.items()})
    asked = [(t, j) for j, k in enumerate(model.languages) for t in samples[k][::5][:40] if len(samples[k]) >= 5]
    asked += [(t[a : a + size], j) for t, j in asked for a, size in ((0, 20), (len(t) // 2, 60), (len(t) // 3, 200))]
    asked = [(t, j) for t, j in asked if any(map(str.isalpha, t))]
    if asked:
        truth = np.array([j for _, j in asked])
        losses = []
        for t in np.geomspace(0.02, 4, 24):
            fit.temperature = t
            losses.append((-np.log(fit.shares([x for x, _ in asked])[np.arange(len(asked)), truth] + 1e-12).mean(), t))
        model.temperature = float(min(losses)[1])
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def samples_of(docs: DataFrame) -> dict[str, list[str]]:
    """The bounded sample by language: different texts in the order of their hashes."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("lang", F.substring("text", 1, TRAIN_CHARS).alias("text"), F.xxhash64(F.lit(7), "text").alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(LABELS + 1).collect()
    if len(counts) > LABELS:
        raise ValueError(f"more than {LABELS} different values of lang are no languages")
    if not counts:
        return {}
    wanted = max(1, min(TRAIN_DOCS, TRAIN_BYTES // (2 * TRAIN_CHARS * len(counts))))
    # a language's smallest hashes: twice as many different texts as wanted lie below its cut in expectation, and some more
    least = docs.sparkSession.createDataFrame([(r["lang"], int(-(2**63) + min(1.0, (2 * wanted + 50) / max(1, r["n"])) * (2**64 - 4096))) for r in counts], "l string, least long")
    few = rows.join(F.broadcast(least), F.col("lang") == F.col("l")).where(F.col("h") <= F.col("least")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    out: dict[str, list] = {}
    for r in sorted(few.withColumn("place", place).where(F.col("place") <= wanted).collect(), key=lambda r: (r["lang"], r["place"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def train(docs: DataFrame) -> Model:
    """Fit on the bounded sample of labelled rows that are not held out."""
    return calibrated(samples_of(docs))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the struct column ``language``: lang and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            lang, score = shared.value.predict(list(s))
            yield pd.DataFrame({"lang": lang, "score": score})

    return docs.withColumn("language", predict(F.col(text)))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, lang_pred, score."""
    d = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "lang", "text")))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
