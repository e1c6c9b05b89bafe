"""Small helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyspark.operators.scratch import checkpoint_root, discard, shared_dir, written  # noqa: F401  for the operators

#: Fixed by the result contracts: what a word is.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    spaced = F.coalesce(text, F.lit(""))
    for blank in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")
