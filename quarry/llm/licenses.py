"""Licence scan: ordered signature rules over normalised words.

Native: one narrow pass of DataFrame functions, no shuffle.

A text becomes its words with one space between.  Texts with none of the gate's words
meet no rule.  For the others, rules whose keyword is absent are skipped before their
expression runs; the places of a rule are found by marking its matches and reading the
marked words' positions, which is linear in the text.  Detections are then ordered by
start, and one that lies inside a detection of a better tier, or inside a longer or
equal one of its own tier, is suppressed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower
from quarry.llm.license_rules import BASE, GATE, Rule, rules

#: Confidence of a detection by its rule's tier.
CONFIDENCE = (1.0, 1.0, 0.95, 0.8, 0.5)
_FIRST, _LAST = "\x01", "\x02"


def words_of(text: Column) -> Column:
    """The words of a text with a space before, between and after; a single space if it has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    return ascii_lower(F.concat(F.lit(" "), F.trim(spaced), F.lit(" ")))


def _places(words: Column, pattern: Column) -> Column:
    """(start, end) word positions of a pattern's matches, from 0, the end one past the last word."""
    marked = F.regexp_replace(words, F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )")), F.lit(f"{_FIRST}$0{_LAST}"))
    at = F.transform(F.split(F.substring(marked, 2, 2**31 - 1), " "), lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i")))
    starts = F.transform(F.filter(at, lambda x: x["w"].startswith(_FIRST)), lambda x: x["i"])
    ends = F.transform(F.filter(at, lambda x: x["w"].endswith(_LAST)), lambda x: x["i"] + 1)
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.struct(z["a"].alias("start"), z["b"].alias("end")))


def _rule_table(every: list[Rule]) -> Column:
    """The rules as one constant array."""
    return F.from_json(F.lit(json.dumps([r._asdict() for r in every])), F.lit("array<struct<keyword:string,pattern:string,tier:int,label:string>>"))


def _found(words: Column, every: list[Rule]) -> Column:
    """All detections, unordered and not suppressed."""
    live = F.filter(_rule_table(every), lambda r: F.contains(words, r["keyword"]))
    live = F.filter(live, lambda r: F.regexp_like(words, F.concat(F.lit("(?<= )(?:"), r["pattern"], F.lit(")(?= )"))))
    return F.flatten(
        F.transform(live, lambda r: F.transform(_places(words, r["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), r["tier"].alias("tier"), r["label"].alias("label"))))
    )


#: Detections that one round of the suppression takes, so that no array grows one element at a time.
_ROUND = 128


def _suppressed(found: Column, tiers: int) -> Column:
    """Detections that stay.  In order of start, the longest first, one is inside another of tier t if the ends so far in t reach its own."""
    kind = "array<struct<start:bigint,end:bigint,tier:int,label:string>>"
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["tier"].alias("tier"), d["label"].alias("label"))))

    def step(state: Column, d: Column) -> Column:
        end = -d["back"]
        inside = F.exists(F.slice(state["reach"], F.lit(1), d["tier"] + 1), lambda r: r >= end)
        stays = F.array(F.struct(d["start"].alias("start"), end.alias("end"), d["tier"].alias("tier"), d["label"].alias("label")))
        reach = F.transform(state["reach"], lambda r, t: F.when(t == d["tier"], F.greatest(r, end)).otherwise(r))
        return F.struct(reach.alias("reach"), F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], stays)).alias("kept"))

    def a_round(state: Column, n: Column, every: Column) -> Column:
        begun = F.struct(state["reach"].alias("reach"), F.array().cast(kind).alias("kept"))
        done = F.aggregate(F.slice(every, n * _ROUND + 1, F.lit(_ROUND)), begun, step)
        # an array of one, so that the round is worked out once
        return F.element_at(F.transform(F.array(done), lambda d: F.struct(d["reach"].alias("reach"), F.concat(state["rounds"], F.array(d["kept"])).alias("rounds"))), 1)

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), tiers).alias("reach"), F.array().cast(f"array<{kind}>").alias("rounds"))
    rounds = F.sequence(F.lit(0), F.ceil(F.size(found) / _ROUND).cast("int") - 1)
    whole = F.transform(F.array(ordered), lambda every: F.aggregate(rounds, start, lambda s, n: a_round(s, n, every), lambda s: F.flatten(s["rounds"])))
    return F.element_at(whole, 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: list[Rule] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``.

    ``detections`` are the places that stay, ``array<struct<start, end, tier, label>>`` in
    word positions; ``score`` is the best one's confidence.  Base places count whether
    suppressed or not.  Null and empty texts have no words and no detections (null first
    and last word, empty labels, score 0).  Repeated rows are scanned each; an empty
    table gives an empty result; other columns play no part.
    """
    every = rules() if every is None else every
    tiers = len(CONFIDENCE)
    plain = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    w = F.col("words")
    gated = F.lit(False)
    for g in GATE:
        gated = gated | F.contains(w, F.lit(g))
    none = F.array().cast("array<struct<start:bigint,end:bigint,tier:int,label:string>>")
    base_none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    columns = {"n_words": F.when(w == "  ", 0).otherwise(F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit(""))) - 1).cast("long")}
    for k, (phrase, _) in enumerate(BASE):
        columns[f"base{k}"] = F.when(F.contains(w, F.lit(f" {phrase} ")), _places(w, F.lit(phrase))).otherwise(base_none)
    columns["found"] = F.when(gated, _found(w, every)).otherwise(none)
    out = plain.select("doc_id", *[c.alias(n) for n, c in columns.items()])
    places = F.concat(*[F.col(f"base{k}") for k in range(len(BASE))])
    starts = F.transform(places, lambda p: p["start"])
    base_labels = F.array(*[F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)])
    out = out.withColumns({"starts": starts, "base": F.array_compact(base_labels), "detections": F.when(F.size("found") > 0, _suppressed(F.col("found"), tiers)).otherwise(none)})
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.array_min(F.transform("detections", lambda d: d["tier"]))
    score = F.when(F.size("detections") > 0, F.element_at(F.array(*map(F.lit, CONFIDENCE)), best + 1)).otherwise(F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.transform("detections", lambda d: d["label"]))).alias("labels"),
        score.alias("score"),
        "detections",
    )
