"""Joins that the rules need, as equi joins and ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import ordered
from quarry.operators.intervals import meet_buckets


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, take: list[str], width: float | None = None) -> DataFrame:
    """``left`` with the ``take`` columns of the last ``right`` row of its key that starts at or before ``at``.

    Both sides are laid in one order and the last right row is carried forward: a
    shuffle and a sort, never a range join.  Right starts must be unique in a key.
    ``width`` splits a key's axis into buckets, so a hot key is many tasks: windows run
    inside (key, bucket), and one row a bucket carries the last right row over its border.
    """
    carried = F.struct(*[F.col(c) for c in take])
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for df, c in ((left, at), (right, start)))
    kind = "long" if whole else "double"  # a double holds whole numbers only up to 2 ** 53
    asks = left.withColumns({"_at": F.col(at).cast(kind), "_side": F.lit(1)})
    gives = right.select(*keys, F.col(start).cast(kind).alias("_at"), carried.alias("_took")).withColumn("_side", F.lit(0))
    both = asks.unionByName(gives, allowMissingColumns=True)
    if width:
        both = both.withColumn("_bucket", F.floor(F.col("_at") / F.lit(width)))
        given = F.col("_side") == 0
        opened = both.groupBy(*keys, "_bucket").agg(F.max_by(F.when(given, F.col("_took")), F.when(given, F.col("_at"))).alias("_open"))
        before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        both = meet_buckets(both, opened.withColumn("_open", F.last("_open", ignorenulls=True).over(before)), keys)
    over = Window.partitionBy(*keys, *(["_bucket"] if width else [])).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_took", ignorenulls=True).over(over)
    both = both.withColumn("_last", F.coalesce(last, F.col("_open")) if width else last)
    return both.filter("_side = 1").select(*left.columns, *[F.col(f"_last.{c}").alias(c) for c in take])


def segments(df: DataFrame, keys: list[str], order: list[str], size: str, bucket: Column | None = None) -> DataFrame:
    """``df`` with ``seg_start`` and ``seg_end``, the place of each row in its key's concatenation; for ``bucket`` see ``ordered``."""
    rows = ordered.summed(df, keys, order, bucket, F.col(size), "seg_end")
    return rows.withColumn("seg_start", F.col("seg_end") - F.col(size))


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], how: str = "left") -> DataFrame:
    """``left`` joined with only the first ``right`` row of each key."""
    first = right.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
    return left.join(first, keys, how)


def by_ordinal(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], how: str = "inner") -> DataFrame:
    """Rows of both sides paired by their position in the key; ``ordinal`` counts from 1."""
    numbered = lambda df, order: df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered(left, left_order).join(numbered(right, right_order), [*keys, "ordinal"], how)


def without_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def with_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_semi")
