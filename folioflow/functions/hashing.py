"""Hash functions that give the same numbers everywhere, as column expressions; MinHash parameters."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

MINHASH_MODULUS = 2**32 - 1
#: Larger than every MinHash value: the signature of an empty set.
MINHASH_EMPTY = 2**32


def code_point_bucket(key: Column, size: int) -> Column:
    """Sum of the code points of a key, modulo the number of buckets."""
    total = F.aggregate(F.filter(F.split(key, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: acc + F.ascii(c))
    return (total % size).cast("long")


def bloom_positions(item: Column, m: int, k: int) -> Column:
    """The k positions of an item in a filter of m bits: SHA-256 of item and number, as a 256-bit number modulo m."""
    if not 0 < m < 2**31:
        raise ValueError("a filter has from 1 to 2**31 - 1 bits")

    def position(i: Column) -> Column:
        digest = F.sha2(F.concat(item, i.cast("string")), 256)
        at = F.lit(0).cast("long")
        for word in range(8):
            at = (at * 2**32 + F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("long")) % m
        return at

    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), position)


def md5_mod(item: Column) -> Column:
    """MD5 as a 128-bit number modulo 2**32 - 1: the sum of its 32-bit words."""
    digest, total = F.md5(item), F.lit(0).cast("long")
    for word in range(4):
        total = total + F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("long")
    return total % MINHASH_MODULUS


def minhash_coefficients(n: int, seed: int = 42) -> list[tuple[int, int]]:
    """(a, b) of n hash functions (a x + b) mod (2**32 - 1), drawn by a generator of its own."""
    draw = random.Random(seed)
    return [(draw.randint(1, MINHASH_MODULUS), draw.randint(0, MINHASH_MODULUS)) for _ in range(n)]


def priority(*parts: Column | str) -> Column:
    """A draw that follows from its parts: their MD5. Ordering by it shuffles alike on every run."""
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def draw(n: Column, *parts: Column | str) -> Column:
    """A number from 0 to n - 1 that follows from the parts."""
    return F.conv(F.substring(priority(*parts), 1, 8), 16, 10).cast("long") % n
