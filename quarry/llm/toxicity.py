"""Toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, give each whole word a likelihood letter by letter, from
its start mark to its end mark, each letter after the ``ORDER - 1`` before it.  A word's
count is its number of distinct contexts (the whole word before it), so a passage copied a
thousand times counts once; a letter sequence has the counts of all words that hold it.
For class c, letters h and the letter x after them:

    p_c(x|h) = (max(n_c(hx) - D, 0) + D t_c(h) p(x|h)) / n_c(h)

with t_c(h) the letters seen after h.  The backoff p(x|h) is shared: the same formula over
the counts of both classes together, itself backed off to the letters that follow h's last
letter, counted by the sequences that they continue.  Expressions whose class counts lie
within ``APART`` standard errors of what the shared counts let expect are too rare to
part the classes; both models take p(x|h) for them, so they weigh neither way.

A text's difference is that of its two log-likelihoods divided by its words (and
``NEUTRAL`` more, so that a text of few words needs more of them).  From each word the
median over the text's own words is taken first, up to ``SHIFT`` nats: what a text's
language or subject makes of every word says how the labels are spread, not that the text
is toxic.  A logistic curve, fitted on labelled rows, turns that difference into a score.

Counts cover every labelled row and are distributed aggregates.  The table of letter steps
that part the classes is sent to the executors only up to ``TABLE_ROWS`` rows; beyond that
words meet it in a shuffle join, with the same scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed

ORDER, DISCOUNT, APART, NEUTRAL, SHIFT = 6, 0.75, 3.0, 10, 1.0
#: Rows of the step table up to which it is sent to every executor (under 200 bytes each).
TABLE_ROWS = 500_000
#: Rows of the labels table up to which it is sent to every executor (16 bytes each).
LABEL_ROWS = 2_000_000
#: Labelled rows, about, on which the logistic curve is fitted.
CURVE_ROWS = 20_000
#: Contexts that a task holds before it passes them on; words whose differences it remembers, and their letters at most.
_HELD, _WORDS, _LETTERS = 60_000, 60_000, 64
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall


def words_of(text: str | None) -> list[str]:
    """Runs of letters, marks and numbers, lower-cased."""
    return _WORD((text or "").lower())


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, word, word before), each once for every ``_HELD`` or so that differ."""
    seen: tuple[set, set] = (set(), set())

    def passed(toxic: int) -> pa.RecordBatch:
        words, before = zip(*seen[toxic])
        size = len(seen[toxic])
        seen[toxic].clear()
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(toxic, pa.int32()), size), pa.array(words, pa.string()), pa.array(before, pa.string())], ["toxic", "word", "before"])

    for batch in batches:
        for toxic, text in zip(batch["toxic"], batch["text"]):
            own, toxic = words_of(text.as_py()), toxic.as_py()
            seen[toxic].update(zip(own, ["^", *own]))
            if len(seen[toxic]) > _HELD:
                yield passed(toxic)
    for toxic in (0, 1):
        if seen[toxic]:
            yield passed(toxic)


def word_counts(labelled: DataFrame) -> DataFrame:
    """``word, ordinary, toxic``: distinct contexts of each word over all labelled rows (columns toxic, text).

    The word before is told by its 64-bit hash, which keeps the shuffled rows short.
    """
    met = labelled.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(_contexts, "toxic int, word string, before string")
    met = met.select("toxic", "word", F.xxhash64("before").alias("before")).distinct()
    return met.groupBy("word").agg(F.count_if(F.col("toxic") == 0).alias("ordinary"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def sequences(word: Column, order: int = ORDER) -> Column:
    """Each letter of a marked word with up to ``order - 1`` before it, as one array."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(2), F.length(marked)), lambda k: F.substring(marked, F.greatest(F.lit(1), k - (order - 1)), F.least(k, F.lit(order))))


def step_table(counts: DataFrame, discount: float = DISCOUNT, apart: float = APART) -> DataFrame:
    """``at, step``: for each letter sequence that parts the classes, the difference of the log-likelihoods of its last letter.

    A letter's step needs its own counts, those of the letters before it and the shared
    counts, so the table is built by joins on sequences one letter shorter.
    """
    nodes = counts.select(F.explode(sequences(F.col("word"))).alias("at"), "ordinary", "toxic").groupBy("at").agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t"))
    nodes = checkpointed(nodes.withColumns({"parent": F.expr("substring(at, 1, length(at) - 1)"), "letter": F.expr("right(at, 1)"), "last": F.expr("left(right(at, 2), 1)")}))
    # the shared model's own backoff: letters after the last letter, counted by the sequences that they continue
    bigram = nodes.groupBy("last", "letter").agg(F.count(F.lit(1)).alias("c"))
    after = nodes.groupBy("last").agg(F.count(F.lit(1)).alias("all"))
    shared = bigram.join(after, "last").select("last", "letter", (F.col("c") / F.col("all")).alias("p2"))
    parents = nodes.groupBy("parent").agg(*[f(x).alias(n) for x in ("o", "t") for f, n in ((F.sum, f"n_{x}"), (lambda c: F.count_if(F.col(c) > 0), f"k_{x}"))], F.count(F.lit(1)).alias("k"))
    # what the class counts would be if the classes did not differ here
    part = F.col("n_t") / (F.col("n_o") + F.col("n_t"))
    expected = (F.col("o") + F.col("t")) * part
    steps = nodes.join(parents, "parent").filter(F.abs(F.col("t") - expected) > F.lit(apart) * F.sqrt(expected * (1 - part)))
    steps = steps.filter((F.col("n_o") > 0) & (F.col("n_t") > 0)).join(shared, ["last", "letter"])

    def smoothed(n, total, kinds, below):
        return (F.greatest(n - F.lit(discount), F.lit(0.0)) + F.lit(discount) * kinds * below) / total

    steps = steps.withColumn("p", smoothed(F.col("o") + F.col("t"), F.col("n_o") + F.col("n_t"), F.col("k"), F.col("p2")))
    ordinary, toxic = (smoothed(F.col(x), F.col(f"n_{x}"), F.col(f"k_{x}"), F.col("p")) for x in "ot")
    return steps.select("at", F.log(toxic / ordinary).alias("step"))


class Words(dict):
    """Difference of the log-likelihoods of each whole word; a bounded memory of the words met."""

    def __init__(self, steps: dict[str, float], order: int = ORDER):
        super().__init__()
        self.steps, self.order = steps, order

    def __missing__(self, word: str) -> float:
        marked, get = f"^{word}$", self.steps.get
        value = math.fsum(get(marked[max(0, k - self.order) : k], 0.0) for k in range(2, len(marked) + 1))
        if len(word) <= _LETTERS:
            if len(self) >= _WORDS:
                self.clear()
            self[word] = value
        return value

    def difference(self, text: str | None) -> float:
        """The length-normalised difference of a text, its own median word (up to ``SHIFT``) taken from each."""
        met = Counter(words_of(text))
        if not met:
            return 0.0
        values, times = np.array([self[w] for w in met]), np.fromiter(met.values(), float, len(met))
        middle = min(SHIFT, max(-SHIFT, float(np.median(values))))
        return float(((values - middle) * times).sum() / (times.sum() + NEUTRAL))


def text_differences(docs: DataFrame, table: DataFrame, keep: list[str], table_rows: int = TABLE_ROWS) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``__quarry_x``, the length-normalised difference of the text."""
    # a text that is kept anyway is not sent to the workers twice
    small = table.count() <= table_rows
    own = "text" if small and "text" in keep and dict(docs.dtypes)["text"] == "string" else "__quarry_text"
    plain = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if own == "text" else [F.col("text").cast("string").alias(own)]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "__quarry_text")
    if small:
        pairs = table.toPandas()  # its rows have just been counted
        sent = docs.sparkSession.sparkContext.broadcast(dict(zip(pairs["at"], pairs["step"])))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words(sent.value)
            for batch in batches:  # the columns that are kept pass through as they are
                x = pa.array([words.difference(t.as_py()) for t in batch[own]], pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), x], [*keep, "__quarry_x"])

        return plain.mapInArrow(score, f"{schema}, `__quarry_x` double")
    return _by_join(plain, table, keep)


def _by_join(plain: DataFrame, table: DataFrame, keep: list[str]) -> DataFrame:
    """``text_differences`` where the table is too large to send: words meet it in a shuffle join.

    A text's words are counted before the shuffle, and a text is named by its SHA-256, so
    equal texts are scored once.  A word's steps are added up once for all texts.
    """
    named = plain.withColumn("__quarry_text", F.coalesce("__quarry_text", F.lit(""))).withColumn("__quarry_row", F.sha2("__quarry_text", 256))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["__quarry_row"], batch["__quarry_text"]):
                met = Counter(words_of(text)) or {"": 0}
                yield pd.DataFrame([(row, *k) for k in met.items()], columns=["row", "word", "n"])

    words = named.select("__quarry_row", "__quarry_text").dropDuplicates(["__quarry_row"]).mapInPandas(spread, "row string, word string, n long")
    words = checkpointed(words)
    valued = words.filter("word <> ''").select("word").distinct().select("word", F.explode(sequences(F.col("word"))).alias("at")).join(table, "at").groupBy("word").agg(F.sum("step").alias("value"))
    value = F.coalesce("value", F.lit(0.0))
    middle = F.least(F.lit(SHIFT), F.greatest(F.lit(-SHIFT), F.median(value)))
    x = (F.sum(value * F.col("n")) - middle * F.sum("n")) / (F.sum("n") + NEUTRAL)
    each = words.join(valued, "word", "left").groupBy(F.col("row").alias("__quarry_row")).agg(x.alias("__quarry_x"))
    return named.drop("__quarry_text").join(each, "__quarry_row").select(*[F.col(f"`{c}`") for c in keep], "__quarry_x")


def fit_curve(scored: DataFrame) -> tuple[float, float]:
    """Slope and middle of the logistic curve, from rows (toxic, difference) binned to thousandths.

    The classes weigh alike, and a small penalty keeps the slope finite where they part
    cleanly.  Without both classes the curve puts every text at a score under a half.
    """
    bins = scored.groupBy("toxic", F.round(F.least(F.greatest("__quarry_x", F.lit(-2.0)), F.lit(2.0)), 3).alias("x")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 8002 rows
    x, y, n = (np.array([r[k] for r in bins], float) for k in ("x", "toxic", "n"))
    if len(bins) == 0 or not (y > 0).any() or not (y == 0).any():
        return 1.0, 10.0
    n[y > 0] /= n[y > 0].sum()
    n[y == 0] /= n[y == 0].sum()
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x - b, -50, 50)))
        g = np.array([(n * (p - y) * x).sum() + 2e-6 * a, -(n * (p - y)).sum()])
        w = n * p * (1 - p) + 1e-9
        hessian = np.array([[(w * x * x).sum() + 2e-6, -(w * x).sum()], [-(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hessian + 1e-9 * np.eye(2), g)
        step *= min(1.0, 20 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return (float(a), float(b / a)) if a > 1e-6 and math.isfinite(a + b) else (1.0, 10.0)


def score(docs: DataFrame, labelled: DataFrame, keep: list[str], name: str = "score", table_rows: int = TABLE_ROWS) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``name``, a score (0 to 1, higher: likelier toxic); one row per input row.

    ``labelled`` has ``text`` and ``toxic`` (0 or 1).  Only the text is an input of a
    score.  Null and empty texts are scored as a text without evidence.  Repeated rows are
    scored each; extra columns play no part.  An empty table gives an empty result; labels
    of one class or none give every text a score under a half.
    """
    labelled = labelled.filter(F.col("toxic").isin(0, 1)).select(F.col("toxic").cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))
    table = checkpointed(step_table(checkpointed(word_counts(labelled))))
    some = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < _share(labelled) * (1 << 20))
    slope, middle = fit_curve(text_differences(some, table, ["toxic"], table_rows))
    x = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.lit(slope) * (F.col("__quarry_x") - F.lit(middle))))
    return text_differences(docs, table, keep, table_rows).withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).drop("__quarry_x")


def _share(labelled: DataFrame) -> float:
    n = labelled.count()
    return min(1.0, CURVE_ROWS / n) if n else 1.0


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that ``labels`` marks, as ``text, toxic``; of labels that disagree, toxic holds.

    The labels are sent to every executor if they are few enough, else both sides shuffle.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    marks = checkpointed(marks)
    if marks.count() <= LABEL_ROWS:
        marks = F.broadcast(marks)
    rows = docs.select(F.col(id_col).alias("_id"), "text")
    return rows.join(marks, "_id").select("text", "toxic")
