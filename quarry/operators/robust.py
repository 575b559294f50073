"""Robust statistics: exact percentiles, deviations and means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import checkpointed, stored


def median_mad(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    """``keys, median, mad``: the exact median and the median distance from it, of keys of any size.

    Null keys, and values that are null or NaN, take no part; a key without values has null statistics.
    """
    rows = df.dropna(subset=keys)
    middle = stored(percentiles(rows, keys, y, (0.5,)).select(*keys, F.col("p50").alias("median")))
    away = rows.join(middle, keys).withColumn("_d", F.abs(F.col(y) - F.col("median")))
    mad = percentiles(away, keys, "_d", (0.5,)).select(*keys, F.col("p50").alias("mad"))
    return rows.select(*keys).distinct().join(middle, keys, "left").join(mad, keys, "left")


def mad_outliers(df: DataFrame, keys: list[str], y: str, k: float = 3.0) -> DataFrame:
    """Rows further from their key's median than ``k`` scaled deviations (1.4826 MAD)."""
    stats = stored(median_mad(df, keys, y))
    return df.join(stats, keys).filter(F.abs(F.col(y) - F.col("median")) > F.lit(k * 1.4826) * F.col("mad"))


def summary(df: DataFrame, keys: list[str], y: str, shares: tuple[float, ...] = (0.02, 0.2, 0.97, 0.98)) -> DataFrame:
    """Mean, population deviation, extremes and interpolated percentiles of a column."""
    cuts = [F.percentile(y, s).alias(f"p{round(s * 100)}") for s in shares]
    return df.groupBy(*keys).agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.min(y).alias("least"), F.max(y).alias("most"), *cuts)


def percentiles(df: DataFrame, keys: list[str], y: str, shares: tuple[float, ...], bins: int = 1024) -> DataFrame:
    """``keys, n`` and a column a share: exact interpolated percentiles of keys of any size, by radix selection.

    ``percentile`` holds a key's distinct values in one buffer.  Here each wanted rank has a
    range of values that holds it: the range is cut into ``bins``, counted with partial sums
    in every task, and the bin with the rank, from its least to its greatest value, is the
    next range, until one value is left; two or three passes for most data, and never more
    than ``bins`` rows a rank in one task.  Nulls and NaN take no part.
    """
    alias = [f"_k{i}" for i in range(len(keys))]
    rows = stored(df.select(*[F.col(k).alias(a) for k, a in zip(keys, alias)], F.col(y).cast("double").alias("_y")).filter("_y IS NOT NULL AND NOT isnan(_y)"))
    ends = checkpointed(rows.groupBy(*alias).agg(F.count(F.lit(1)).alias("n"), F.min("_y").alias("lo"), F.max("_y").alias("hi")))
    rank = lambda share: F.lit(float(share)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(*[f(rank(s)).cast("long") for s in shares for f in (F.floor, F.ceil)]))
    state = checkpointed(ends.select(*alias, "lo", "hi", F.explode(ranks).alias("rank")).withColumn("left", F.col("rank")))
    same = lambda a, b, more=(): [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*alias, *more]]
    while not (open_ := state.filter("lo < hi")).isEmpty():
        spans = open_.select(*alias, "lo", "hi").distinct()
        met = rows.alias("r").join(spans.alias("s"), [*same("r", "s"), F.col("_y") >= F.col("lo"), F.col("_y") <= F.col("hi")])
        wide, half = F.col("hi") - F.col("lo"), F.col("hi") / 2 - F.col("lo") / 2  # the difference of two doubles may overflow, half of it may vanish
        part = F.when(wide < float("inf"), F.try_divide(F.col("_y") - F.col("lo"), wide)).otherwise(F.try_divide(F.col("_y") / 2 - F.col("lo") / 2, half))
        place = F.least(F.lit(bins - 1), F.floor(part * bins)).alias("bin")
        counted = met.select(*[F.col(f"s.{a}").alias(a) for a in alias], "lo", "hi", "_y", place).groupBy(*alias, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi"))
        upto = Window.partitionBy(*alias, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
        counted = counted.withColumn("upto", F.sum("c").over(upto))
        hit = open_.alias("o").join(counted.alias("c"), [*same("o", "c", ("lo", "hi")), F.col("left") < F.col("upto"), F.col("left") >= F.col("upto") - F.col("c")])
        found = hit.select(*[F.col(f"o.{a}").alias(a) for a in alias], F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "rank", (F.col("left") - F.col("upto") + F.col("c")).alias("left"))
        state = checkpointed(state.filter("lo >= hi").unionByName(found))
    at = state.groupBy(*alias).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))  # two entries a share
    joined = ends.alias("e").join(at.alias("a"), same("e", "a"))

    def value(share: float) -> Column:
        low, high = F.floor(rank(share)).cast("long"), F.ceil(rank(share)).cast("long")
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when(low == high, a).otherwise((high - rank(share)) * a + (rank(share) - low) * b)

    return joined.select(*[F.col(f"e.{a}").alias(k) for k, a in zip(keys, alias)], "n", *[value(s).alias(f"p{round(s * 100)}") for s in shares])


def harmonic_mean(y: str) -> Column:
    """n / sum(1/y) over doubles; the reciprocal of zero is infinite, so a zero makes the mean zero."""
    value = F.col(y).cast("double")
    total = F.sum(F.when(value == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), value)))
    return F.when(total == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.count(y), total))


def low_pick(df: DataFrame, keys: list[str], y: str, share: float = 0.01) -> DataFrame:
    """``keys, n, low``: the value at sorted position max(0, floor(share n) - 1), not interpolated."""
    ranked = df.select(*keys, y).withColumns({"_r": F.row_number().over(Window.partitionBy(*keys).orderBy(y)), "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    at = F.greatest(F.lit(0), F.floor(F.col("n") * F.lit(share)) - 1)
    return ranked.filter(F.col("_r") - 1 == at).select(*keys, "n", F.col(y).alias("low"))


def variation(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    """``keys, power, cv``: mean and coefficient of variation from sums of y and y squared."""
    sums = df.groupBy(*keys).agg(F.count(y).alias("_n"), F.sum(y).alias("_s"), F.sum(F.col(y) * F.col(y)).alias("_q"))
    mean = F.col("_s") / F.col("_n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean))
    return sums.select(*keys, mean.alias("power"), (spread / (mean + F.lit(1e-12))).alias("cv"))


def block_means(df: DataFrame, keys: list[str], rows: int, cols: int, h: str = "h", w: str = "w", x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """``keys, row, col, mean``: a grid's cells averaged in ``rows`` by ``cols`` blocks."""
    cell = df.withColumns({"row": F.floor(F.col(y) * rows / F.col(h)).cast("int"), "col": F.floor(F.col(x) * cols / F.col(w)).cast("int")})
    return cell.groupBy(*keys, "row", "col").agg(F.avg(value).alias("mean"))
