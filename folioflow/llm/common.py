"""What the operators of this subpackage share: reading tables, and the contracts' words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.shared import written as saved

__all__ = ["SPACE", "SPACE_CHARS", "saved", "table", "trimmed", "word_count", "words"]

#: A word of the contracts: the longest run of characters that are not ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, whatever store the folder lies in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Array of the words of a text; none for null or blank text."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{SPACE}+"))


def word_count(text: Column) -> Column:
    """Number of words, without building them: a word starts at the text's start and after each run of white space."""
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.regexp_count(t, F.lit(f"{SPACE}+")) + 1).cast("long")
