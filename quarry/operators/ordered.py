"""Order-dependent columns of keys that may hold any share of the rows.

A ``bucket`` is an expression that never falls along a key's order (its first column
divided by a width, say).  Windows run inside (key, bucket); what has to cross a border is
a few rows a bucket, put in order by themselves.  Without a bucket a key is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _met(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what one row for each key and bucket carries; null keys meet."""
    on = [*keys, "_bucket"]
    renamed = carried.withColumnsRenamed({k: f"_on{i}" for i, k in enumerate(on)})
    return rows.join(renamed, [F.col(k).eqNullSafe(F.col(f"_on{i}")) for i, k in enumerate(on)]).drop(*[f"_on{i}" for i in range(len(on))])


def _within(keys: list[str], order: list[str], bucket: Column | None):
    return Window.partitionBy(*keys, *(["_bucket"] if bucket is not None else [])).orderBy(*order)


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, name: str = "i") -> DataFrame:
    """``df`` with each row's position in its key, from 0."""
    return summed(df, keys, order, bucket, F.lit(1), name).withColumn(name, F.col(name) - 1)


def summed(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its key up to this one."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if bucket is None:
        return df.withColumn(name, F.sum(value).over(upto(_within(keys, order, None))))
    kept = df.columns
    rows = df.withColumns({"_bucket": bucket, "_summed_value": value})
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_summed_value").alias("_bucket_sum")).withColumn("_carried_sum", F.coalesce(F.sum("_bucket_sum").over(before), F.lit(0))).drop("_bucket_sum")
    met = _met(rows, sums, keys)
    own = F.coalesce(F.sum("_summed_value").over(upto(_within(keys, order, bucket))), F.lit(0))
    return met.withColumn(name, own + F.col("_carried_sum")).select(*kept, name)


def shifted(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """``df`` with columns of rows so many places on (negative: back) in its key: ``{name: (column, places)}``; null beyond its ends."""
    plain = {name: F.lead(c, k).over(_within(keys, order, None)) if k > 0 else F.lag(c, -k).over(_within(keys, order, None)) for name, (c, k) in wanted.items()}
    if bucket is None:
        return df.withColumns(plain)
    kept, reach, columns = df.columns, max(abs(k) for _, k in wanted.values()), sorted({c for c, _ in wanted.values()})
    within = _within(keys, order, bucket)
    rows = df.withColumn("_bucket", bucket)
    rows = rows.withColumns({"_r": F.row_number().over(within), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys, "_bucket"))})
    row = F.struct(*[F.col(c).alias(f"_{c}") for c in columns])

    def beyond(edge: Column, last: Column, a: int, b: int, name: str) -> DataFrame:
        """For each bucket the ``reach`` rows after (before) it: those at its neighbours' edges, a few a bucket."""
        over = Window.partitionBy(*keys).orderBy("_bucket", "_r").rowsBetween(a, b)
        edges = rows.filter(edge).select(*keys, "_bucket", "_r", "_n", row.alias("_row"))
        return edges.withColumn(name, F.collect_list("_row").over(over)).filter(last).select(*keys, "_bucket", name)

    ahead = beyond(F.col("_r") <= reach, F.col("_r") == F.least(F.col("_n"), F.lit(reach)), 1, reach, "_ahead")
    behind = beyond(F.col("_r") > F.col("_n") - reach, F.col("_r") == F.greatest(F.lit(1), F.col("_n") - reach + 1), -reach, -1, "_behind")
    out = _met(_met(rows, ahead, keys), behind, keys)

    def column(c: str, k: int) -> Column:
        if k > 0:
            short = F.col("_r") + k - F.col("_n")  # how far beyond the bucket's last row
            return F.when(short <= 0, F.lead(c, k).over(within)).otherwise(F.get("_ahead", F.greatest(short, F.lit(1)) - 1)[f"_{c}"])
        short = F.lit(-k) - F.col("_r") + 1
        return F.when(short <= 0, F.lag(c, -k).over(within)).otherwise(F.get("_behind", F.size("_behind") - F.greatest(short, F.lit(1)))[f"_{c}"])

    return out.withColumns({name: column(c, k) for name, (c, k) in wanted.items()}).select(*kept, *wanted)
