"""Language identification with word-first backoff.

A known word scores by its log frequency in each language.  An unseen word falls back
to its character n-grams, longest first: each position takes the longest n-gram
(``ORDERS``) that the model knows, and the word scores by their mean.  A text's score is
the softmax of its mean log-likelihood a word, sharpened by the evidence that the words
give.

Frequencies are smoothed towards those of all languages together: an item met n times
among a language's N has frequency (n + PRIOR * q) / (N + PRIOR), where q is its share of
all languages' items.  What no language has much of is then about equally rare in each,
however few rows a language has.  So that a language of a few rows, which is then little but
the mix of all, does not fit unseen words best, each starts from the log of its share of
the labelled rows, once a text.  Languages without a word take no part.

The model is fitted on labelled rows only, a sample bounded per language
(``ROWS_PER_LANGUAGE``, chosen by a hash of id and text).  Every word and n-gram of the
sample counts; nothing is cut.  The tables of items are counted before they are sent to
the executors; over ``ITEMS`` rows, words meet them in shuffle joins, with the same scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed

ROWS_PER_LANGUAGE, PRIOR, ORDERS = 2_000, 100.0, (4, 3, 2, 1)
#: Rows of the model's tables up to which they are sent to every executor (about 100 bytes each, and 8 a language).
ITEMS = 600_000
UNKNOWN = "und"
_LETTERS, _ASCII = regex.compile(r"\p{L}+").findall, re.compile("[a-z]+").findall
#: Letters of a run that a word may have; longer runs are cut so that no single key is unbounded.
_LONGEST = 64
#: Words of a text, at most, that sharpen its score.
_SHARP = 50
#: Unseen words whose n-grams are remembered before the memory is emptied.
MEMORY = 200_000


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; runs over 64 letters in pieces (scripts without spaces)."""
    text = text.lower()
    runs = _ASCII(text) if text.isascii() else _LETTERS(text)
    if all(len(r) <= _LONGEST for r in runs):
        return runs
    return [r[k : k + _LONGEST] for r in runs for k in range(0, len(r), _LONGEST)]


class Fitted(NamedTuple):
    """A fitted model: its languages in order, and ``kind, item, logs`` (kind word or gram, a log frequency a language; one row ``prior``)."""

    languages: list[str]
    items: DataFrame | None


class Model:
    """Word and n-gram log frequencies in memory, a row an item and a column a language."""

    def __init__(self, languages: list[str], table: pa.Table | None = None):
        """From rows ``kind, item`` and a column of logs a language."""
        self.languages, none = languages, np.zeros((0, len(languages)))
        self.words, self.grams, self.word_logs, self.gram_logs = {}, {}, none, none
        prior = table.filter(pc.equal(table["kind"], "prior")) if table is not None else []
        self.prior = np.array([prior[f"l{k}"][0].as_py() for k in range(len(languages))]) if len(prior) else np.zeros(len(languages))
        for kind in ("word", "gram") if table is not None else ():
            part = table.filter(pc.equal(table["kind"], kind))
            items = {item: k for k, item in enumerate(part["item"].to_pylist())}
            logs = np.column_stack([part[f"l{k}"].to_numpy() for k in range(len(languages))])
            if kind == "word":
                self.words, self.word_logs = items, logs
            else:
                self.grams, self.gram_logs = items, logs
        self._forget()

    def _forget(self) -> None:
        """Start the memory of unseen words anew: their rows follow those of the known words."""
        self.met: dict[str, int] = {}
        self.logs = np.vstack([self.word_logs, np.zeros((1024, len(self.languages)))])

    def unseen(self, word: str) -> np.ndarray:
        """Mean log-likelihoods of an unseen word's n-grams, the longest known one at each position."""
        marked, found, get = f"^{word}$", [], self.grams.get
        for at in range(len(marked)):
            for order in ORDERS:
                row = get(marked[at : at + order]) if at + order <= len(marked) else None
                if row is not None:
                    found.append(row)
                    break
        return self.gram_logs[found].mean(axis=0) if found else np.zeros(len(self.languages))

    def _row(self, word: str) -> int:
        row = self.met.get(word)
        if row is None:
            row = self.met[word] = len(self.words) + len(self.met)
            if row >= len(self.logs):
                self.logs = np.vstack([self.logs, np.zeros((len(self.met), len(self.languages)))])
            self.logs[row] = self.unseen(word)
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if len(self.met) > MEMORY:
            self._forget()
        get, row = self.words.get, self._row
        rows = [r if (r := get(w)) is not None else row(w) for w in words]
        mean = self.logs[rows].mean(axis=0) * min(len(words), _SHARP) + self.prior
        p = np.exp(mean - mean.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of words and n-grams by language, a batch at a time."""
    for batch in batches:
        found: dict[tuple[str, str, str], int] = {}
        for lang, texts in batch.groupby("lang")["text"]:
            words: Counter = Counter()
            for text in texts:
                words.update(words_of(text or ""))
            grams: Counter = Counter()
            for word, n in words.items():
                marked = f"^{word}$"
                for order in ORDERS:
                    for at in range(len(marked) - order + 1):
                        grams[marked[at : at + order]] += n
            found |= {(lang, "word", w): n for w, n in words.items()} | {(lang, "gram", g): n for g, n in grams.items()}
        yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "kind", "item", "n"]).astype({"n": "int64"})


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE) -> Fitted:
    """A model from rows with a non-null language.

    Rows with a null text or id may be chosen like others; repeated rows are chosen
    together and counted each; other columns play no part.  Of a language at least one
    row is chosen.  An empty table, or one without letters, gives a model of no language.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    rows = rows.withColumn("lot", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    shares = rows.groupBy("lang").agg(F.greatest(F.min("lot"), F.lit(float(rows_per_language)) / F.count(F.lit(1))).alias("share"), F.count(F.lit(1)).alias("rows")).collect()  # a row a language
    if not shares:
        return Fitted([], None)
    chosen = rows.filter(F.col("lot") <= _by_language({r["lang"]: r["share"] for r in shares}))
    counts = chosen.select("lang", "text").mapInPandas(_count, "lang string, kind string, item string, n long")
    counts = checkpointed(counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    totals = {(r["kind"], r["lang"]): r["n"] for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}  # two rows a language
    languages = sorted({lang for _, lang in totals})
    if not languages:
        return Fitted([], None)

    def logs(kind: str) -> Column:
        every = float(sum(totals[kind, lang] for lang in languages))
        met = lambda lang: F.coalesce(F.element_at("met", F.lit(lang)), F.lit(0))
        return F.array(*[F.log((met(lang) + F.lit(PRIOR) * F.col("all") / F.lit(every)) / F.lit(totals[kind, lang] + PRIOR)) for lang in languages])

    items = counts.groupBy("kind", "item").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("met"), F.sum("n").alias("all"))
    items = items.select("kind", "item", F.when(F.col("kind") == "word", logs("word")).otherwise(logs("gram")).alias("logs"))
    held_rows = {r["lang"]: r["rows"] for r in shares}
    prior = [math.log(held_rows[lang] / sum(held_rows[x] for x in languages)) for lang in languages]
    items = items.unionByName(labelled.sparkSession.createDataFrame([("prior", "", prior)], "kind string, item string, logs array<double>"))
    return Fitted(languages, checkpointed(items))


def _by_language(share: dict[str, float]) -> Column:
    pairs = [x for lang, s in share.items() for x in (F.lit(lang), F.lit(s))]
    return F.element_at(F.create_map(*pairs), F.col("lang"))


def held(model: Fitted) -> pa.Table | None:
    """The model's rows, which have been counted before, as one Arrow table: kind, item and a column of logs a language."""
    if model.items is None:
        return None
    return model.items.select("kind", "item", *[F.col("logs")[k].alias(f"l{k}") for k in range(len(model.languages))]).toArrow()


def predict(docs: DataFrame, model: Fitted, id_col: str = "doc_id", text_col: str = "text", most_items: int = ITEMS) -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score``.

    ``und`` with score 0 for a null text, one without a letter, or a model of no
    language.  Ties go to the first language by name.  Only the text is an input; null and
    repeated ids are kept, other columns play no part, and an empty table gives an empty
    result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model.items is not None and model.items.count() > most_items:
        return _by_join(plain, model)
    languages, sent = model.languages, docs.sparkSession.sparkContext.broadcast(held(model))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Model(languages, sent.value)
        for batch in batches:
            found = [known.predict(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    return plain.mapInPandas(score, f"doc_id {kind}, lang_pred string, score double")


def _by_join(plain: DataFrame, model: Fitted) -> DataFrame:
    """``predict`` where the model is too large to send.

    A text is named by its SHA-256 and its words are counted before the shuffle; each
    distinct word is looked up once for all texts.
    """
    named = plain.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("row", F.sha2("text", 256))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                yield pd.DataFrame([(row, *k) for k in Counter(words_of(text)).items()], columns=["row", "word", "n"]).astype({"n": "int64"})

    met = checkpointed(named.select("row", "text").dropDuplicates(["row"]).mapInPandas(spread, "row string, word string, n long"))
    words, grams = (model.items.filter(F.col("kind") == k).drop("kind") for k in ("word", "gram"))
    looked = met.select("word").distinct().join(words.withColumnRenamed("item", "word"), "word", "left")
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.length(marked)), lambda k: F.array(*[F.when(k + (o - 1) <= F.length(marked), F.substring(marked, k, F.lit(o))) for o in ORDERS])))
    tried = looked.filter("logs IS NULL").select("word", at.alias("at", "tried")).select("word", "at", F.posexplode("tried").alias("shorter", "item")).join(grams, "item")
    longest = tried.groupBy("word", "at").agg(F.min_by("logs", "shorter").alias("logs"))
    each = range(len(model.languages))
    mean = F.array(*[F.avg(F.col("logs")[k]) for k in each])
    unseen = longest.groupBy("word").agg(mean.alias("guess"))
    none = F.array(*[F.lit(0.0) for _ in each])
    looked = looked.join(unseen, "word", "left").select("word", F.coalesce("logs", "guess", none).alias("logs"))
    n = F.sum("n")
    prior = model.items.filter(F.col("kind") == "prior").first()["logs"]
    sums = met.join(looked, "word").groupBy("row").agg(F.array(*[F.sum(F.col("n") * F.col("logs")[k]) / n * F.least(n, F.lit(_SHARP)) + F.lit(prior[k]) for k in each]).alias("m"))
    best = F.array_max("m")
    sums = sums.select("row", F.element_at(F.array(*map(F.lit, model.languages)), F.array_position("m", best).cast("int")).alias("lang_pred"), (1 / F.aggregate("m", F.lit(0.0), lambda s, x: s + F.exp(x - best))).alias("score"))
    out = named.join(sums, "row", "left")
    return out.select("doc_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))
