"""The findings table: what rules emit, and its roll-ups and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities, the gravest first.
SEVERITIES = ("HIGH", "MED", "LOW", "INFO")


def rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for k, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == name, k).otherwise(out)
    return out


def finding(df: DataFrame, rule_id: str, severity, category: str, title, detail=None, locator=None, video: str = "video_id") -> DataFrame:
    """``df`` as findings of one rule; severity, title, detail and locator may be columns."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.col(video).alias("video_id"),
        F.lit(rule_id).alias("rule_id"),
        as_col(severity).alias("severity"),
        F.lit(category).alias("category"),
        as_col(title).alias("title"),
        as_col(detail).cast("string").alias("detail"),
        as_col(locator).cast("string").alias("locator"),
    )


def all_findings(parts: list[DataFrame]) -> DataFrame:
    """All parts with ``seq``, a position by video, severity and rule that does not depend on the plan."""
    joined = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("video_id").orderBy(rank(F.col("severity")), "rule_id", "locator", "title", "detail")
    return joined.withColumn("seq", F.row_number().over(order).cast("long"))


def severity_counts(df: DataFrame, keys: list[str], severity: str = "severity") -> DataFrame:
    """A column a severity with its count, zero if there are none."""
    counted = df.groupBy(*keys).agg(*[F.count_if(F.col(severity) == s).alias(s.lower()) for s in SEVERITIES])
    return counted


def rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts at every level of ``keys``; null stands for all."""
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; a plain rank filter, so Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def compare(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_old, n_new, state``: gone, still or added, each key once however often it occurs."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = count(old, "n_old").join(count(new, "n_new"), keys, "full_outer")
    state = F.when(F.col("n_new").isNull(), "gone").when(F.col("n_old").isNull(), "added").otherwise("still")
    return both.select(*keys, F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"), state.alias("state"))


def residual_high(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col("severity") == "HIGH").alias("residual_high"))


def video_summary(df: DataFrame) -> DataFrame:
    """A row a video: counts by severity, the gravest severity, and its first titles in order."""
    counted = severity_counts(df, ["video_id"])
    first = df.groupBy("video_id").agg(F.min(F.struct("seq", "severity")).alias("_f"), F.slice(F.transform(F.sort_array(F.collect_list(F.struct("seq", "title"))), lambda x: x["title"]), 1, 10).alias("titles"))
    return counted.join(first.select("video_id", F.col("_f.severity").alias("gravest"), "titles"), "video_id")
