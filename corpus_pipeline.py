"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Stage by stage: rows that the quality rules reject go; of each group of near-duplicates one row stays; rows that hold a
13-word window of the benchmark go, whatever its share of their words; secrets are masked in the text; the rest is mixed to the sources' target weights. All but the last return the
columns of ``documents``. SQL can't express the near-duplicates' components nor the network's findings, so there is no
ORACLE_SQL; tests/llm holds run() against a brute-force version.

Defined results are those of the operators: nulls in any column, empty or very long texts, ties, repeated rows, empty
tables and extra columns pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, mixing, quality_rules, secrets, simhash
from folioflow.llm.common import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the current policy keeps."""
    judged = quality_rules.apply_policy(quality_rules.ledger(_packed(docs), "_text"))
    return judged.where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a whole window of the benchmark, and of whose words the benchmark's short items make less than a twentieth."""
    hit = decontaminate.with_hits(_packed(docs), table(spark, sf_dir, "benchmark"), "_text")
    return hit.where(~decontaminate.holds_window()).select("_row.*")


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret in the text masked."""
    return secrets.redacted(docs, secrets.network())


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return mixing.mix(docs)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secret_masking), ("source mixing", mixture)]
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """All columns as one struct, so that no name can clash, beside the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = saved(docs) if k + 1 < len(STAGES) else docs
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
ORACLE: dict[str, str] = {}
