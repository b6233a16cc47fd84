"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import staged as materialize
from ..plans.staging import worker_path

__all__ = ["crc_rest", "let", "lower_az", "materialize", "table", "worker_path", "words"]

#: ASCII white space that separates words in every contract of this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, whatever the number of its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_rest(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text modulo `modulus`; a null key counts as the text ''."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
