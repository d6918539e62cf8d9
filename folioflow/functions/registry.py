"""Functions callable from SQL; column expressions stay expressions inside macros, Python only where nothing else does."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import STOP_WORDS


def register(spark: SparkSession) -> list[str]:
    """Register the functions for this session and return their names."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    macros = {
        "normalize_text(t STRING) RETURNS ARRAY<STRING>": f"filter(regexp_extract_all(lower(coalesce(t, '')), '[\\\\p{{L}}\\\\p{{N}}_]+', 0), w -> length(w) > 2 AND NOT array_contains(array({stops}), w))",
        "char_shingles(t STRING, k INT) RETURNS ARRAY<STRING>": "CASE WHEN length(coalesce(t, '')) = 0 THEN CAST(array() AS ARRAY<STRING>) WHEN length(t) < k THEN array(lower(t)) ELSE array_distinct(transform(sequence(1, greatest(length(t) - k + 1, 1)), i -> substring(lower(t), i, k))) END",
        "jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(a) = 0 AND size(b) = 0 THEN 1D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END",
        "bloom_positions(item STRING, m INT, k INT) RETURNS ARRAY<BIGINT>": "CASE WHEN k < 1 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(transform(sequence(0, greatest(k, 1) - 1), i -> sha2(concat(item, CAST(i AS STRING)), 256)), d -> aggregate(sequence(1, 57, 8), 0L, (acc, p) -> (acc * 4294967296 + CAST(conv(substring(d, p, 8), 16, 10) AS BIGINT)) % m)) END",
        "code_point_bucket(k STRING, n INT) RETURNS BIGINT": "aggregate(filter(split(k, ''), c -> c != ''), 0L, (acc, c) -> acc + ascii(c)) % n",
    }
    for head, body in macros.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("array<long>")
    def minhash_signature(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from folioflow.operators.similarity import Signer

        signer = Signer(100)
        for shingles in batches:
            yield pd.Series([signer.signature(x if x is not None else []) for x in shingles], dtype=object)

    @F.pandas_udf("long")
    def dgim_count(bits: pd.Series, window: pd.Series) -> pd.Series:
        from folioflow.operators.dgim import Buckets

        out = []
        for b, w in zip(bits, window, strict=True):
            state = Buckets(int(w))
            for bit in b:
                state.update(int(bit))
            out.append(state.count())
        return pd.Series(out, dtype="int64")

    for name, f in (("minhash_signature", minhash_signature), ("dgim_count", dgim_count)):
        spark.udf.register(name, f)
    return [h.split("(")[0] for h in macros] + ["minhash_signature", "dgim_count"]
