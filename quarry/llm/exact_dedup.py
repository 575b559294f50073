"""Exact duplicates by 128-bit content hash, with bytes compared inside each group.

Native: DataFrame functions only.

* Rows are grouped by (hash, text): the hash aggregate compares the bytes of equal
  hashes, so a collision ends in two classes.  Map-side combination turns a group
  that holds a third of all rows into one row per map task before the shuffle.
* The classes, without their texts, are checkpointed once; thin rows of digests
  then meet their class in a shuffle join whose hot keys adaptive execution splits.
* MD5 and SHA-256 together name a class.  Should two texts ever share both, the
  rows concerned take an exact path that joins on the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, checkpointed

Digest = Callable[[Column], Column]


def md5_digest(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def sha256_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    digest: Digest = md5_digest,
    second: Digest = sha256_digest,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the ``keep`` ("largest" or "smallest") id stays.
    Rows repeated with the same id and text count as rows of the group, and each is
    marked kept if its id is (``surviving_rows`` returns such a row once).  A null
    id stays only if its whole group has null ids; ``keep_id`` is then null.  An
    empty table gives an empty result; other columns play no part.
    ``digest`` and ``second`` may be replaced to force collisions in tests.
    """
    texts = _normalised(docs, id_col, text_col)
    classes, collided = _classes(texts, keep, digest, second)
    thin = texts.select("doc_id", digest(F.col("norm")).alias("h"), second(F.col("norm")).alias("h2"), *([F.col("norm")] if collided is not None else []))
    if collided is None:
        joined = thin.join(classes, ["h", "h2"])
    else:
        exact = _by_text(texts, keep, digest, second).join(collided, ["h", "h2"], "left_semi")
        joined = (
            thin.drop("norm").join(collided, ["h", "h2"], "left_anti").join(classes, ["h", "h2"])
            .unionByName(thin.join(collided, ["h", "h2"], "left_semi").join(exact, ["h", "h2", "norm"]).drop("norm"))
        )
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("text_sha256"),
    )


def surviving_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    digest: Digest = md5_digest,
    second: Digest = sha256_digest,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row for each distinct text.

    Rows meet the classes on (digests, id), so copies in a hot group, whose ids
    differ, spread over all tasks.
    """
    texts = _normalised(docs, id_col, text_col)
    classes, collided = _classes(texts, keep, digest, second)
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    by = ["__quarry_h", "__quarry_h2", "__quarry_id"] + (["__quarry_norm"] if collided is not None else [])
    rows = docs.withColumns({"__quarry_norm": norm, "__quarry_id": F.coalesce(F.col(id_col).cast("string"), F.lit(""))})
    rows = rows.withColumns({"__quarry_h": digest(F.col("__quarry_norm")), "__quarry_h2": second(F.col("__quarry_norm"))})
    if collided is None:
        rows = rows.drop("__quarry_norm")
        stays = classes.select(F.col("h").alias("__quarry_h"), F.col("h2").alias("__quarry_h2"), F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("__quarry_id"))
    else:
        stays = _by_text(texts, keep, digest, second).select(
            F.col("h").alias("__quarry_h"), F.col("h2").alias("__quarry_h2"), F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("__quarry_id"), F.col("norm").alias("__quarry_norm")
        )
    return rows.join(stays, by, "left_semi").dropDuplicates(by).select(*[F.col(f"`{c}`") for c in docs.columns])


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))


def _by_text(texts: DataFrame, keep: str, digest: Digest, second: Digest) -> DataFrame:
    """One row per distinct text: its digests, size, the id that stays, and the text."""
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    return (
        texts.withColumn("h", digest(F.col("norm")))
        .groupBy("h", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("keep_id"))
        .withColumn("h2", second(F.col("norm")))
        .withColumn("text_sha256", F.sha2("norm", 256))
    )


def _classes(texts: DataFrame, keep: str, digest: Digest, second: Digest) -> tuple[DataFrame, DataFrame | None]:
    """The thin classes, and the digest pairs that two texts share (None if there are none)."""
    classes = checkpointed(_by_text(texts, keep, digest, second).drop("norm"))
    collided = classes.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "h2")
    return classes, None if collided.isEmpty() else checkpointed(collided)
