"""Token counts by a two-tier lookup on the map side.

The tokenizer's units never cross ASCII white space, so a text's count is the sum over its white-space separated
pre-tokens. Tier one is a broadcast table of frequent pre-tokens and their lengths in tokens (at most ``FREQUENT``
entries, by their counts in a sample of about ``SAMPLE`` texts: it decides how fast a pre-token is counted, not how
many tokens it has); tier two is a cache in each Python worker, kept from task to task with the tokenizer and filled by
encoding what tier one misses, a batch at a time (at most ``CACHED`` entries, then it starts anew). Pre-tokens are
never shuffled: to find the frequent ones, each task sends its own ``PER_TASK`` most counted.

Defined results: null counts as empty text with 0 tokens; special strings inside texts become their special token, as
the library's default has it; long texts are counted whole, and pre-tokens over ``LONGEST`` bytes are encoded without
caching; repeated rows are counted each; an empty table gives an empty result; of other columns none is read.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
FREQUENT, PER_TASK, SAMPLE, CACHED, LONGEST = 16_384, 4096, 20_000, 1_000_000, 64
#: Texts of so many characters are looked up together.
TOGETHER = 1 << 20
LIMIT = 2048


def load_tokenizer(vocabulary: str):
    """The library's tokenizer for a file name of the public tokenizers, or for a path that every machine has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    tok.no_truncation()
    tok.no_padding()
    return tok


class Lengths:
    """Pre-tokens (bytes) and their numbers of tokens: the frequent ones, and those met so far."""

    #: Of this process, by vocabulary: tasks that run in one worker share it.
    _own: dict[str, Lengths] = {}

    def __init__(self, vocabulary: str):
        self.tok, self.known, self.frequent = load_tokenizer(vocabulary), {}, {}

    @classmethod
    def of(cls, vocabulary: str, frequent: dict[bytes, int]) -> Lengths:
        if vocabulary not in cls._own:
            cls._own[vocabulary] = cls(vocabulary)
        own = cls._own[vocabulary]
        if own.frequent is not frequent:
            own.frequent = frequent
            own.known.update(frequent)
        return own

    def _encoded(self, words: list[bytes]) -> list[int]:
        return [len(x.ids) for x in self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def counts(self, texts: list[list[bytes]]) -> list[int]:
        """The sum of each text's pre-tokens."""
        new = set().union(*texts).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHED:
                self.known = dict(self.frequent)
                new = set().union(*texts).difference(self.known)
            names = list(new)
            for i in range(0, len(names), CACHED // 8):  # what one text of very many different words needs at once
                part = names[i : i + CACHED // 8]
                self.known.update(zip(part, self._encoded(part), strict=True))
        look, out = self.known.__getitem__, [sum(map(self.known.__getitem__, w)) for w in texts]
        if len(self.known) > CACHED or max(map(len, new), default=0) > LONGEST:
            self.known = {w: look(w) for w in self.known if len(w) <= LONGEST} if len(self.known) <= CACHED else dict(self.frequent)
        return out


def frequent_pretokens(docs: DataFrame, text: str = "text") -> list[bytes]:
    """Up to FREQUENT pre-tokens with the largest counts in a sample, of the PER_TASK that each task sends."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                if t:
                    seen.update(t.encode().split())
            if len(seen) > CACHED:
                seen = Counter(dict(seen.most_common(CACHED // 8)))
        top = [x for x in seen.most_common(PER_TASK) if len(x[0]) <= LONGEST]
        yield pd.DataFrame({"word": [w for w, _ in top], "n": [n for _, n in top]})

    few = docs.sample(min(1.0, SAMPLE / max(1, docs.count())), seed=7)
    sent = few.select(F.col(text).alias("text")).mapInPandas(count, "word binary, n long")
    top = sent.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT)
    return [bytes(r["word"]) for r in top.collect()]


def with_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """The rows of ``docs`` with the token count of ``text`` as column ``name`` (long)."""
    words = frequent_pretokens(docs, text)
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(words, Lengths.of(vocabulary, {})._encoded(words), strict=True)))

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        look = Lengths.of(vocabulary, table.value)
        for s in texts:
            out, part, size = [], [], 0
            for t in s:
                part.append(t.encode().split() if t else [])
                size += len(t) if t else 0
                if size >= TOGETHER:
                    out += look.counts(part)
                    part, size = [], 0
            yield pd.Series([*out, *look.counts(part)], dtype="int64")

    return docs.withColumn(name, count(F.col(text)))


def digest(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """The contract's rows: doc_id, n_bytes, n_tokens, over_limit."""
    d = with_counts(docs.select("doc_id", "text"), vocabulary=vocabulary)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return d.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens").withColumn("over_limit", F.col("n_tokens") > limit)
