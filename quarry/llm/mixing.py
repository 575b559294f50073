"""Mixing sources to target weights by capped water-filling.

Each source's target is ``min(cap, level * weight)``: sources that would pass their
cap (the most epochs allowed) are clamped and their excess goes to the others by
weight until none is above.  The end of that redistribution has a closed form over
the sources in the order of cap / weight, so it is one window over one row a source.

A target of e epochs takes every document floor(e) whole times, and a further time
those first in a seeded order (MD5 of seed and id) until the source's remaining words
are spent; the one document at the cut is taken for the words that remain.

No source is ever sorted whole: words are summed over 4096 ranges of the seeded
order, the range with the cut is found from those sums, and only that range is
ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed
from quarry.operators import ordered

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, 0
#: Hex digits of the seeded order that name a range.
DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size`` to ``source, source_size, weight, target``.

    Sources by code point, null last, take ``weights`` in turn.  Input is one row a
    source; sources without words have target 0.  A share beyond ``epochs`` leaves
    every source at its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "rest": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "budget": F.sum("source_size").over(whole) * F.lit(float(share)),
        }
    )
    # the level if this source is the first that is not clamped
    ranked = ranked.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("rest"))
    ranked = ranked.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # the level falls from the first free source on, and every later source is free too
    level = F.max(F.when(F.col("free"), F.col("level"))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
    keep_source: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``; ``source`` too if it is to be kept.

    Each source's ``taken`` sums to its target, rounded to whole words; no document
    exceeds ``epochs`` times its size.  Null texts have size 0; null is a source of
    its own, the last.  Repeated rows each take part, in an order that only their
    equal values share, so reruns give the same rows.  An empty table gives an empty
    result; other columns play no part.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    thin = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias("u"),
    )
    thin = checkpointed(thin.withColumns({"range": F.substring("u", 1, DIGITS), "key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))}))
    sums = thin.groupBy("key", "source", "range").agg(F.sum("size").alias("words"))
    sums = checkpointed(sums)  # at most 16 ** DIGITS rows a source
    sources = water_fill(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    sources = sources.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    goal = F.floor(F.col("target") + 0.5)
    times = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(goal / F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("times", times).withColumn("more", (goal - F.col("times") * F.col("source_size")).cast("long")).drop("source")
    sources = checkpointed(sources)
    ranges = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    spent = sums.withColumn("upto", F.sum("words").over(ranges)).withColumn("before", F.col("upto") - F.col("words"))
    cut = spent.join(sources, "key").filter((F.col("before") <= F.col("more")) & (F.col("more") < F.col("upto"))).select("key", F.col("range").alias("cut"), "before")
    plan = checkpointed(sources.join(cut, "key", "left"))  # a row a source, apart from the window that found the cuts
    rows = thin if keep_source else thin.drop("source")
    # away from the cut no order is needed, so a hot source's join may be split over many tasks
    plain = rows.join(plan, "key").filter(F.col("cut").isNull() | (F.col("range") != F.col("cut")))
    plain = plain.withColumn("part", F.when(F.col("range") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    # at the cut only its range meets the plan, and only that range is ordered
    edge = rows.join(plan.filter("cut IS NOT NULL").withColumn("range", F.col("cut")), ["key", "range"])
    order = Window.partitionBy("key").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("before")
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("more") - ahead)))
    out = plain.unionByName(edge)
    return out.select("doc_id", *(["source"] if keep_source else []), "size", "source_size", "target", (F.col("times") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` as the mix takes them: a row for each whole repetition and one, cut after its words, for a fraction.

    Columns are those of ``docs``; ``n_chars``, if there, follows a cut text.  Rows
    with no words carry nothing to weigh and are kept once.  Rows of a source that repeat
    an id (or have none) and have one size share what they take together; the words that
    do not divide go to the first of them by a hash of their text, one each, so a source
    meets its target to the word.  An empty table gives an empty result.
    """
    ident, source = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    rows = docs.withColumns({"__quarry_id": ident, "__quarry_source": source, "__quarry_size": n_words(F.col("text"))})
    key = ["__quarry_id", "__quarry_source", "__quarry_size"]
    taken = mix(docs, keep_source=True, **parameters).select(ident.alias(key[0]), source.alias(key[1]), F.col("size").alias(key[2]), "taken")
    taken = taken.groupBy(*key).agg(F.sum("taken").alias("__quarry_all"), F.count(F.lit(1)).alias("__quarry_n"))
    n = F.col("__quarry_n")
    joined = rows.join(taken, key).withColumn("__quarry_each", F.floor(F.col("__quarry_all") / n))
    uneven = checkpointed(taken.filter(F.col("__quarry_all") % n > 0).withColumn("__quarry_rest", F.col("__quarry_all") % n).select(*key, "__quarry_rest"))
    if not uneven.isEmpty():  # few rows, if ids are unique none
        joined = joined.withColumn("__quarry_text", F.xxhash64("text")).join(_one_more(rows, uneven, key), [*key, "__quarry_text"], "left")
        # of rows that are alike as many as are to get a word do
        order = Window.partitionBy(*key, "__quarry_text").orderBy("text")
        alike = joined.filter(F.col("__quarry_more") > 0).withColumn("__quarry_each", F.col("__quarry_each") + F.when(F.row_number().over(order) <= F.col("__quarry_more"), 1).otherwise(0))
        joined = joined.filter(F.coalesce(F.col("__quarry_more"), F.lit(0)) == 0).unionByName(alike)
    each = F.col("__quarry_each")
    whole = F.when(F.col("__quarry_size") > 0, F.floor(each / F.col("__quarry_size"))).otherwise(F.lit(1))
    part = F.when(F.col("__quarry_size") > 0, each - whole * F.col("__quarry_size")).otherwise(F.lit(0))
    copies = F.concat(F.array_repeat(F.col("__quarry_size"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    out = joined.withColumn("__quarry_words", F.explode(copies.cast("array<bigint>")))
    cut = F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("__quarry_words").cast("int"))
    text = F.when(F.col("__quarry_words") < F.col("__quarry_size"), F.regexp_replace(F.concat(cut, F.array_join(words, "")), r"[\x20\x09-\x0D]+$", "")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__quarry_words") < F.col("__quarry_size"), F.length(text)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def _one_more(rows: DataFrame, uneven: DataFrame, key: list[str]) -> DataFrame:
    """``key, __quarry_text, __quarry_more``: how many of the rows of each text get one of the words that do not divide."""
    held = rows.join(uneven.select(*key), key, "left_semi").select(*key, F.xxhash64("text").alias("__quarry_text"))
    counted = held.groupBy(*key, "__quarry_text").agg(F.count(F.lit(1)).alias("_m"))
    placed = ordered.summed(counted, key, ["__quarry_text"], F.shiftright("__quarry_text", 56), F.col("_m"), "_upto").join(uneven, key)
    more = F.greatest(F.lit(0), F.least(F.col("_m"), F.col("__quarry_rest") - (F.col("_upto") - F.col("_m"))))
    return placed.select(*key, "__quarry_text", more.alias("__quarry_more"))
