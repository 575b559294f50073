"""Expressions and job helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ship
from quarry.storage import checkpointed, shared_folder, stored

__all__ = ["ascii_lower", "checkpointed", "shared_folder", "stored", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    Pure ASCII text takes ``lower``, which is the faster kernel; any other text
    takes ``translate`` so that letters beyond ASCII keep their case.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; executors get this package before any work on it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
