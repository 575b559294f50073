"""Hard negatives from vantage-point trees over norm-augmented vectors.

Every vector gets one more component that brings it to the largest norm M; an anchor gets
zero there.  Then the squared distance of an anchor q and a row x is |q|^2 + M^2 - 2 qx,
so higher scores are nearer, and the scores that a positive allows are an annulus around
the anchor.

Rows are dealt by label and nearest of at most ``PIVOTS`` pivots into blocks of about
``BLOCK`` rows, written once; rows never move again.  Anchors come in rounds of at most
``ROUND``, sent to the tasks that read the blocks.  There a block becomes a vantage-point
tree: a node splits its rows at the median distance to its vantage point and knows how far
its two halves reach.  The triangle inequality gives each leaf the least
and greatest distance that it can hold, leaves that miss the annulus are left out, and
the others are opened nearest first until the k rows found are nearer than all that is
still closed.  A task keeps k rows an anchor and window over all its trees, and these are
merged.  The tree only decides what is opened: scores are integer products.

The pivots are at most ``PIVOTS`` rows with the smallest hashes, a bounded sample; they
shape the blocks and change no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.llm.topk import quantised, usable

K, BLOCK, LEAF, PIVOTS, ROUND = 5, 4096, 128, 256, 4096
#: Distances are doubles; bounds give way by this share of the scale before anything is left out.
_SLACK = 1e-7
#: Scores must be exact in doubles.
_EXACT = 2**53


class Tree:
    """Leaves of a vantage-point tree over integer vectors, with the halves' reach at each node above them."""

    def __init__(self, vectors: np.ndarray, norm2: float):
        self.vectors, self.norm2 = vectors, norm2
        self.vantage: list[int] = []  # of each inner node
        self.near: list[list[tuple[int, float, float]]] = []  # of each leaf: inner node, least and greatest distance to its vantage point
        self.leaves: list[np.ndarray] = []
        lengths = np.einsum("ij,ij->i", vectors, vectors)
        self.extra = np.sqrt(np.maximum(0.0, norm2 - lengths))
        self._split(np.arange(len(vectors)), [])

    def _away(self, rows: np.ndarray, point: int) -> np.ndarray:
        product = self.vectors[rows] @ self.vectors[point] + self.extra[rows] * self.extra[point]
        return np.sqrt(np.maximum(0.0, 2 * (self.norm2 - product)))

    def _split(self, rows: np.ndarray, above: list[tuple[int, float, float]]) -> None:
        away = self._away(rows, rows[0]) if len(rows) > LEAF else None
        if away is None or away.max() <= away.min():
            self.leaves.append(rows)
            self.near.append(above)
            return
        node, order = len(self.vantage), np.argsort(away, kind="stable")
        self.vantage.append(int(rows[0]))
        half = len(rows) // 2
        for side in (order[:half], order[half:]):
            self._split(rows[side], [*above, (node, float(away[side].min()), float(away[side].max()))])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of each anchor to the rows of each leaf."""
        shape = (len(anchors), len(self.leaves))
        least, most = np.zeros(shape), np.full(shape, np.inf)
        if self.vantage:
            own = np.einsum("ij,ij->i", anchors, anchors)
            d = np.sqrt(np.maximum(0.0, own[:, None] + self.norm2 - 2 * anchors @ self.vectors[self.vantage].T))
            for leaf, above in enumerate(self.near):
                for node, lo, hi in above:
                    np.maximum(least[:, leaf], np.maximum(d[:, node] - hi, lo - d[:, node]), out=least[:, leaf])
                    np.minimum(most[:, leaf], d[:, node] + hi, out=most[:, leaf])
        return least * least, most * most


def _packed(key: tuple, rows: pa.Table) -> pa.Table:
    ids = rows["id"].to_numpy()
    lists = rows["vector"].combine_chunks()
    width = int(np.max(lists.value_lengths().to_numpy(zero_copy_only=False), initial=0))
    vectors = np.zeros((len(ids), width), np.int64)
    for k, v in enumerate(lists):
        vectors[k, : len(v.values)] = v.values.to_numpy()
    order = np.argsort(ids, kind="stable")
    return pa.table({"label": rows["label"][:1], "width": pa.array([width]), "ids": [ids[order].tolist()], "vectors": [vectors[order].tobytes()]}, schema=_BLOCKS)


_BLOCKS = pa.schema([("label", pa.int64()), ("width", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary())])


def _nearest_pivot(pivots: np.ndarray, norm2: float) -> Callable:
    extra = np.sqrt(np.maximum(0.0, norm2 - np.einsum("ij,ij->i", pivots, pivots)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, pivots.shape[1]))
            for k, v in enumerate(batch.column(2)):
                values = v.values.to_numpy()[: pivots.shape[1]]
                x[k, : len(values)] = values
            own = np.sqrt(np.maximum(0.0, norm2 - np.einsum("ij,ij->i", x, x)))
            best = (x @ pivots.T + own[:, None] * extra).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int64))], ["id", "label", "vector", "region"])

    return run


class _Best:
    """The k best (score, id) of each question so far."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def bar(self, question: int) -> int | None:
        found = self.found.get(question, ())
        return found[-1][0] if len(found) == self.k else None

    def add(self, question: int, scores: np.ndarray, ids: np.ndarray) -> None:
        bar = self.bar(question)
        if bar is not None:
            stays = scores <= bar  # scores are negated, so that the best sort first
            scores, ids = scores[stays], ids[stays]
        if len(scores) > self.k:
            first = np.lexsort((ids, scores))[: self.k]
            scores, ids = scores[first], ids[first]
        if len(scores):
            self.found[question] = sorted([*self.found.get(question, ()), *zip(scores.tolist(), ids.tolist())])[: self.k]


def _search(round_, norm2: float, k: int, same: bool) -> Callable:
    """Rows of one label's trees against a round's questions: (anchor, least score, greatest score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels, ids, of, low, high = round_.value
        best = _Best(k)
        asked = np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1) if len(of) else []
        for batch in batches:
            for b in range(batch.num_rows):
                label, width, own, raw = (c[b].as_py() for c in batch.columns)
                own, vectors = np.array(own, np.int64), np.frombuffer(raw, np.int64).reshape(-1, width).astype(np.float64)
                turn = [q for q in asked if (labels[of[q[0]]] == label) == same]
                if not turn or not len(own):
                    continue
                wide = np.zeros((len(vectors), anchors.shape[1]))
                wide[:, :width] = vectors
                tree, who = Tree(wide, norm2), np.array([of[q[0]] for q in turn])
                least, most = tree.bounds(anchors[who])
                for row, questions in enumerate(turn):
                    _ask(tree, own, anchors[who[row]], ids[who[row]], least[row], most[row], questions, low, high, best)
        rows = [(q, i, -s) for q, found in best.found.items() for s, i in found]
        columns = [np.array([r[c] for r in rows], np.int64) for c in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["question", "row", "score"])

    return run


def _ask(tree: Tree, ids: np.ndarray, anchor: np.ndarray, ident: int, least: np.ndarray, most: np.ndarray, questions: np.ndarray, low: np.ndarray, high: np.ndarray, best: _Best) -> None:
    """Leaves nearest first; each question stops by itself, and a leaf is scored once for all of them."""
    whole = float(anchor @ anchor) + tree.norm2
    slack, scored = _SLACK * whole, {}
    order = np.argsort(least, kind="stable")
    for q in questions:
        inner, outer = whole - 2 * high[q] - slack, whole - 2 * low[q] + slack
        for leaf in order:
            bar = best.bar(int(q))
            if least[leaf] > (outer if bar is None else min(outer, whole + 2 * bar + slack)):
                break
            if most[leaf] + slack < inner:
                continue
            if leaf not in scored:
                scored[leaf] = np.rint(tree.vectors[tree.leaves[leaf]] @ anchor).astype(np.int64)
            score, rows = scored[leaf], ids[tree.leaves[leaf]]
            inside = (score >= low[q]) & (score <= high[q]) & (rows != ident)
            best.add(int(q), -score[inside], rows[inside])


def _asked(trees: DataFrame, questions: DataFrame, norm2: int, width: int, k: int, same: bool, at_once: int) -> DataFrame:
    """The k best rows of each question, in rounds of questions.

    ``questions``: ``anchor, id, label, vector, low, high, positive``, each anchor's rows in one round.
    """
    sc, n = trees.sparkSession.sparkContext, questions.select("anchor").distinct().count()
    rounds, out = -(-n // at_once), None
    dealt = questions.withColumn("round", F.pmod(F.xxhash64("anchor"), F.lit(max(1, rounds))))
    for r in range(rounds):
        rows = dealt.filter(F.col("round") == r).toArrow().sort_by([("anchor", "ascending"), ("positive", "ascending"), ("high", "ascending")])
        if not rows.num_rows:
            continue
        names, first, of = np.unique(rows["anchor"].to_numpy(), return_index=True, return_inverse=True)
        vectors = np.zeros((len(names), width))
        for a, v in enumerate(rows["vector"].take(pa.array(first))):
            vectors[a, : len(v.values)] = v.values.to_numpy()
        sent = sc.broadcast((vectors, rows["label"].to_numpy()[first], rows["id"].to_numpy()[first], of, rows["low"].to_numpy(), rows["high"].to_numpy()))
        found = trees.mapInArrow(_search(sent, float(norm2), k, same), "question long, row long, score long")
        # a round's questions by their place in it; names come back from the round itself
        named = trees.sparkSession.createDataFrame(pa.table({"question": np.arange(rows.num_rows), "anchor": rows["anchor"], "id": rows["id"], "positive": rows["positive"], "high": rows["high"]}))
        over = Window.partitionBy("question").orderBy(F.col("score").desc(), "row")
        best = found.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)
        best = stored(best.join(named, "question").drop("question"))
        out = best if out is None else out.unionByName(best)
    return out


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | Column = "label",
    positives: int = K,
    k: int = K,
    margin: tuple[int, int] = (80, 100),
    scale: int = 256,
    block: int = BLOCK,
    at_once: int = ROUND,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its best ``positives`` other rows of its label.  For each, the
    best ``k`` rows of other labels follow whose score is at least ``margin[0]/margin[1]`` of
    the positive's and not above it.  Scores are integer inner products of components
    floor(scale x), higher first, ties to the smaller id.  Rows with a null id, label or
    vector, or with a null or non-finite component, take no part.  Vectors of unequal length
    meet on the dimensions that both have.  Rows that repeat an id are never each other's
    partners; as partners of other rows each takes a place, while an anchor's equal pairs
    (id and score) are answered once, and so are its equal rows.  A positive with a negative
    score has no window.  An empty table gives an empty result; scores beyond 2^53 raise an error.
    """
    spark = rows.sparkSession
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    plain = rows.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull() & label.isNotNull())
    plain = plain.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = plain.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(square), F.lit(0.0)).alias("norm2"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    if facts["norm2"] >= _EXACT:
        raise OverflowError("inner products beyond 2^53")
    norm2, width = facts["norm2"], max(1, facts["width"])
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not facts["n"]:
        return empty
    trees = _blocks(plain.select("id", "label", "vector"), facts["n"], norm2, width, block)
    anchors = plain.filter("asks").select("id", "label", "vector").distinct().select(F.xxhash64("id", "label", "vector").alias("anchor"), "*")
    anchors = stored(anchors)
    far = 2**53
    wide = anchors.withColumns({"low": F.lit(-far), "high": F.lit(far), "positive": F.lit(0).cast("long")})
    found = _asked(trees, wide, norm2, width, positives, True, at_once)
    if found is None:
        return empty
    pairs = found.filter("score >= 0").select("anchor", F.col("row").alias("positive"), F.col("score").alias("high")).distinct()
    part, of = margin
    # both are whole and not negative: the least score that is not below the margin
    asked = anchors.join(pairs, "anchor").withColumn("low", F.expr(f"(high * {part} + {of - 1}) div {of}"))
    negatives = _asked(trees, stored(asked.select("anchor", "id", "label", "vector", "low", "high", "positive")), norm2, width, k, False, at_once)
    if negatives is None:
        return empty
    return negatives.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("row").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score"))


def _blocks(rows: DataFrame, n: int, norm2: float, width: int, block: int) -> DataFrame:
    """``label, width, ids, vectors``: a row for each block of one label and region, of about ``block`` rows."""
    pivots = min(PIVOTS, n // (4 * block))
    if pivots > 1:
        chosen = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(pivots).select("vector").collect()
        at = np.zeros((len(chosen), width))
        for k, r in enumerate(chosen):
            at[k, : len(r["vector"])] = r["vector"]
        rows = rows.mapInArrow(_nearest_pivot(at, norm2), "id long, label long, vector array<long>, region long")
    else:
        rows = rows.withColumn("region", F.lit(0).cast("long"))
    rows = stored(rows.withColumn("vector", F.col("vector").cast("array<int>")))  # their squares are below 2^53
    sizes = rows.groupBy("label", "region").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts"))
    dealt = rows.join(sizes, ["label", "region"]).withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.col("parts")))
    return stored(dealt.groupBy("label", "region", "part").applyInArrow(_packed, "label long, width long, ids array<long>, vectors binary"))
