"""Half-open interval algebra as window expressions.

Intervals are two long columns within optional keys.  Touching intervals merge, and
intervals that end at or before zero are dropped.  Every operator takes a
``width`` that splits a key's axis into buckets: windows then run inside (key, bucket) and
only one row a bucket carries the running end and the open island over bucket borders, so
a hot key is many tasks.  Results do not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(df: DataFrame, keys: list[str], a: str = "a", b: str = "b", width: int | None = None) -> DataFrame:
    """``keys, a, b``: maximal intervals covered by the input."""
    rows = df.select(*keys, F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("b > 0 AND b > a")
    if width:
        rows = rows.withColumn("_bucket", F.floor(F.col("a") / F.lit(width)))
    over = Window.partitionBy(*keys, *(["_bucket"] if width else [])).orderBy("a", "b")
    rows = _reach(rows, keys, ["a", "b"], "b", width, "_reach")
    reach = F.col("_reach")
    rows = rows.withColumn("_start", F.when(reach.isNull() | (F.col("a") > reach), F.col("a")))
    # a range frame: of equal intervals any may be the one that opened the island
    island = F.max("_start").over(over.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    if width:
        opened = _carry(rows.groupBy(*keys, "_bucket").agg(F.max("_start").alias("_open")), keys, "_open")
        rows = meet_buckets(rows, opened, keys)
        island = F.coalesce(island, F.col("_open"))
    rows = rows.withColumn("_island", island)
    return rows.groupBy(*keys, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")


def _carry(buckets: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each bucket with the greatest ``value`` of the buckets before it."""
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return buckets.withColumn(value, F.max(value).over(before))


def meet_buckets(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what one row for each key and ``_bucket`` carries; null keys meet."""
    on = [rows[k].eqNullSafe(carried[k]) for k in [*keys, "_bucket"]]
    return rows.join(carried, on).drop(*[carried[k] for k in [*keys, "_bucket"]])


def _reach(rows: DataFrame, keys: list[str], order: list[str], value: str, width: int | None, name: str, own: bool = False) -> DataFrame:
    """``rows`` and ``name``: the greatest ``value`` of their key so far in ``order``, that of the row itself only if ``own``.

    With a ``width`` the first column of ``order`` tells the bucket.
    """
    within = [*keys, "_bucket"] if width else keys
    so_far = F.max(value).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    if not width:
        return rows.withColumn(name, so_far)
    kept = rows.columns
    rows = rows.withColumn("_bucket", F.floor(F.col(order[0]) / F.lit(width)))
    carried = _carry(rows.groupBy(*within).agg(F.max(value).alias("_carried")), keys, "_carried")
    return meet_buckets(rows, carried, keys).withColumn(name, F.greatest(so_far, "_carried")).select(*kept, name)


def gaps(df: DataFrame, keys: list[str], a: str = "a", b: str = "b", least: int = 1, width: int | None = None) -> DataFrame:
    """``keys, a, b, gap``: uncovered stretches between covered ones, at least ``least`` long."""
    merged = union(df, keys, a, b, width)
    # islands are disjoint, so the greatest end so far is that of the island before
    found = _reach(merged, keys, ["a", "b"], "b", width, "_from").filter(F.col("a") - F.col("_from") >= least)
    return found.select(*keys, F.col("_from").alias("a"), F.col("a").alias("b"), (F.col("a") - F.col("_from")).alias("gap"))


def complement(df: DataFrame, spans: DataFrame, keys: list[str], a: str = "a", b: str = "b", lo: str = "lo", hi: str = "hi", width: int | None = None) -> DataFrame:
    """``keys, a, b``: what of each ``[lo, hi)`` in ``spans`` is uncovered, head and tail included.

    One row a key in ``spans``; keys without intervals give their whole span.
    """
    bounds = spans.select(*keys, F.col(lo).cast("long").alias("_lo"), F.col(hi).cast("long").alias("_hi"))
    inner = union(df, keys, a, b, width).join(bounds, keys).filter("b > _lo AND a < _hi").select(*keys, "a", "b")
    edges = bounds.select(*keys, F.col("_lo").alias("a"), F.col("_lo").alias("b")).unionByName(bounds.select(*keys, F.col("_hi").alias("a"), F.col("_hi").alias("b")))
    return _reach(inner.unionByName(edges), keys, ["a", "b"], "b", width, "_from").filter("a > _from").select(*keys, F.col("_from").alias("a"), F.col("a").alias("b"))


def covered(df: DataFrame, keys: list[str], a: str = "a", b: str = "b", width: int | None = None) -> DataFrame:
    """``keys, covered, span, ratio``: covered length, first start to last end, and their ratio."""
    merged = union(df, keys, a, b, width)
    total = merged.groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("covered"), (F.max("b") - F.min("a")).alias("span"))
    return total.withColumn("ratio", F.col("covered") / F.col("span"))


def gap_severity(total: Column) -> Column:
    """Severity of uncounted bytes: 256 or more HIGH, some LOW, none INFO."""
    return F.when(total >= 256, "HIGH").when(total > 0, "LOW").otherwise("INFO")


def not_contained(inner: DataFrame, outer: DataFrame, keys: list[str], a: str = "a", b: str = "b", width: int | None = None) -> DataFrame:
    """Rows of ``inner`` that no single interval of ``outer`` contains.

    An interval is contained if, of the outer ones that start at or before it, the
    greatest end reaches its own: one ordered window instead of a range join.
    """
    return _with_reach(inner, outer, keys, a, b, width).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col(b))).drop("_reach")


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], a: str = "a", b: str = "b", width: int | None = None) -> DataFrame:
    """Rows of ``inner`` that some interval of ``outer`` contains."""
    return _with_reach(inner, outer, keys, a, b, width).filter(F.col("_reach") >= F.col(b)).drop("_reach")


def _with_reach(inner: DataFrame, outer: DataFrame, keys: list[str], a: str, b: str, width: int | None) -> DataFrame:
    asks = inner.withColumns({"_end": F.lit(None).cast("long"), "_asks": F.lit(1)})
    gives = outer.select(*keys, F.col(a).alias(a), F.col(b).cast("long").alias("_end")).withColumn("_asks", F.lit(0))
    both = asks.unionByName(gives, allowMissingColumns=True)
    return _reach(both, keys, [a, "_asks"], "_end", width, "_reach", own=True).filter("_asks = 1").drop("_end", "_asks")


def overlaps(df: DataFrame, keys: list[str], a: str = "a", b: str = "b", width: int | None = None) -> DataFrame:
    """Rows that begin before an earlier interval of their key has ended, with ``reach``, that end."""
    return _reach(df, keys, [a, b], b, width, "reach").filter(F.col("reach") > F.col(a))


def runs(df: DataFrame, keys: list[str], position: str, width: int | None = None) -> DataFrame:
    """``keys, a, b, n``: maximal runs of consecutive integer positions, inclusive (gaps and islands)."""
    marked = df.select(*keys, F.col(position).cast("long").alias("_p")).distinct()
    within = [*keys, F.floor(F.col("_p") / F.lit(width)).alias("_bucket")] if width else keys
    marked = marked.withColumn("_g", F.col("_p") - F.row_number().over(Window.partitionBy(*within).orderBy("_p")))
    grouped = [*keys, *([F.floor(F.col("_p") / F.lit(width)).alias("_bucket")] if width else []), "_g"]
    found = marked.groupBy(*grouped).agg(F.min("_p").alias("a"), F.max("_p").alias("b"))
    if not width:
        return found.select(*keys, "a", "b", (F.col("b") - F.col("a") + 1).alias("n"))
    # runs that a bucket's border cut touch as half-open intervals; positions are not negative
    joined = union(found.select(*keys, "a", (F.col("b") + 1).alias("b")), keys, width=width)
    return joined.select(*keys, "a", (F.col("b") - 1).alias("b"), (F.col("b") - F.col("a")).alias("n"))
