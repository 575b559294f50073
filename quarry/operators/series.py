"""Rules over ordered measurement series.

A series is the rows of a key in the order of ``order``, whose last column must make
the order unique.  Thresholds are per-key aggregates (partial sums, then a join back),
differences and classes are window expressions.  A ``bucket`` (see ``ordered``) splits a
hot key over many tasks; results do not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import ordered


def _over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def steps(df: DataFrame, keys: list[str], order: list[str], y: str, bucket: Column | None = None) -> DataFrame:
    """``df`` with ``i`` (position from 0) and ``step``, the absolute difference to the next value (null at the end)."""
    if bucket is None:
        over = _over(keys, order)
        return df.withColumns({"i": F.row_number().over(over) - 1, "step": F.abs(F.lead(y).over(over) - F.col(y))})
    rows = ordered.shifted(ordered.numbered(df, keys, order, bucket), keys, order, bucket, {"_next": (y, 1)})
    return rows.withColumns({"i": F.col("i").cast("int"), "step": F.abs(F.col("_next") - F.col(y))}).drop("_next")


def jumps(df: DataFrame, keys: list[str], order: list[str], y: str, k: float = 6.0, bucket: Column | None = None) -> DataFrame:
    """``steps`` with ``is_jump``: a step above the key's mean by more than ``k`` population deviations."""
    stepped = steps(df, keys, order, y, bucket)
    bar = stepped.groupBy(*keys).agg((F.avg("step") + F.lit(float(k)) * F.stddev_pop("step")).alias("bar"))
    return stepped.join(bar, keys).withColumn("is_jump", F.coalesce(F.col("step") > F.col("bar"), F.lit(False)))


def flashes(df: DataFrame, keys: list[str], order: list[str], y: str, k: float = 6.0, tolerance: float = 0.45, mode: str = "intended", bucket: Column | None = None) -> DataFrame:
    """Jumps with ``kind``: "flash" if the value comes back at once, else "cut".

    ``intended``: a jump at i is a flash if value i+2 is back at value i within
    ``tolerance`` of the larger of steps i and i+1, which catches a lone spike.  ``literal``: jumps at both i and
    i+1 and value i+1 back at value i-1, the first taking the last value before it;
    a lone spike is then two cuts.
    """
    wanted = {"two_on": (y, 2), "next_jump": ("is_jump", 1), "next": (y, 1), "next_step": ("step", 1), "before": (y, -1)}
    marked = ordered.shifted(jumps(df, keys, order, y, k, bucket), keys, order, bucket, wanted)
    within = F.lit(tolerance) * F.greatest("step", "next_step")
    if mode == "intended":
        back = F.abs(F.col("two_on") - F.col(y)) < within
    else:
        last = marked.groupBy(*keys).agg(F.max_by(y, F.struct(*order)).alias("_last"))
        marked = marked.join(last, keys).withColumn("before", F.when(F.col("i") == 0, F.col("_last")).otherwise(F.col("before"))).drop("_last")
        back = F.coalesce(F.col("next_jump"), F.lit(False)) & (F.abs(F.col("next") - F.col("before")) < within)
    kind = F.when(F.coalesce(back, F.lit(False)), "flash").otherwise("cut")
    return marked.filter("is_jump").withColumn("kind", kind)


def frozen(df: DataFrame, keys: list[str], order: list[str], y: str, below: float = 0.05, least: int = 16, bucket: Column | None = None) -> DataFrame:
    """``keys, a, b, n``: runs of ``least`` or more consecutive steps under ``below``, positions inclusive."""
    from quarry.operators.intervals import runs

    still = steps(df, keys, order, y, bucket).filter(F.col("step") < below)
    return runs(still, keys, "i", None if bucket is None else POSITIONS).filter(F.col("n") >= least)


#: Positions of a key that one task takes where it is split.
POSITIONS = 1 << 20


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """``keys, run, value, start, n``: run-length encoding of a column."""
    marked = ordered.shifted(ordered.numbered(df, keys, order, bucket, "_i"), keys, order, bucket, {"_before": (value, -1)})
    changed = ~F.col(value).eqNullSafe(F.col("_before")) | (F.col("_i") == 0)
    marked = ordered.summed(marked, keys, order, bucket, changed.cast("int"), "run")
    return marked.groupBy(*keys, "run").agg(F.first(value).alias("value"), F.min("_i").cast("long").alias("start"), F.count(F.lit(1)).alias("n"))


def prefix_offsets(df: DataFrame, keys: list[str], order: list[str], size: str) -> Column:
    """The sum of ``size`` over the rows before this one in its key."""
    return F.coalesce(F.sum(size).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str) -> Column:
    return F.max(value).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, 0))
