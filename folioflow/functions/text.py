"""Text functions as column expressions: tokens, shingles, set similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of three letters or more (shorter tokens are dropped anyway).
STOP_WORDS = ("que", "ser", "por", "con", "para", "como", "the", "and", "but", "for", "with", "from", "was")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalized_tokens(text: Column) -> Column:
    """Lower-cased word tokens of over two characters that are no stop words."""
    found = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def whitespace_tokens(text: Column, lower: bool = True) -> Column:
    t = text_or_empty(text)
    return F.filter(F.split(F.lower(t) if lower else t, r"\s+"), lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row: inside lambdas an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _characters(text: Column) -> Column:
    """Array of the characters of the lower-cased text: substrings of a long text would each count from its start."""
    return F.filter(F.split(F.lower(text_or_empty(text)), ""), lambda c: c != "")


def char_shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of k characters of the lower-cased text; a shorter text is its own shingle, an empty one has none."""

    def of(c: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - k, F.lit(0))), lambda i: F.concat(*[F.get(c, i + j) for j in range(k)]))
        return F.when(F.size(c) == 0, F.array().cast("array<string>")).when(F.size(c) < k, F.array(F.array_join(c, ""))).otherwise(F.array_distinct(runs))

    return bound(_characters(text), of)


def word_shingles(text: Column, k: int = 2) -> Column:
    """Distinct runs of k words, joined by blanks; fewer words are one shingle."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))

    return bound(whitespace_tokens(text), of)


def positioned_shingles(text: Column, k: int = 3) -> Column:
    """Every run of k characters with its place from 0, repeats included; none for shorter texts."""

    def of(c: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - k, F.lit(0))), lambda i: F.struct(F.concat(*[F.get(c, i + j) for j in range(k)]).alias("shingle"), i.alias("position")))
        return F.when(F.size(c) < k, F.slice(runs, 1, 0)).otherwise(runs)

    return bound(_characters(text), of)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.size(F.array_union(a, b)))


def jaccard_distance(a: Column, b: Column) -> Column:
    return 1.0 - jaccard(a, b)
