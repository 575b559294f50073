"""Exact top-k inner products by term-at-a-time accumulation.

Rows are sparse weighted vectors: a dimension is a term, its non-zero components are
the term's postings.  Queries and candidates are dealt into bounded blocks and each
pair of blocks is one group: the task inverts its candidates into postings, and for
each term in turn scatters (query weight x posting weight) into dense score arrays,
one a query.  A partition selects each query's k best; block results are merged by a
second selection on at most k rows a block.

Every candidate is scored by every query.  Blocks hold at most ``QUERY_BLOCK`` and
about ``CANDIDATE_BLOCK`` rows, so a task's memory does not grow with the table; both
sides go to their blocks through a shuffle, their components as the narrowest integers
that hold them all, and nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK, K = 2_048, 16_384, 5
#: Queries of a block that are scored at once; their score arrays are what a task holds besides its rows.
_AT_ONCE = 256


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold only finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector.cast("array<double>"), bad)


def postings(ids: np.ndarray, vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows, weights) of the vectors' non-zero components."""
    lengths = np.array([len(v) for v in vectors], np.int64)
    if not lengths.sum():
        return {}
    rows = np.repeat(np.arange(len(ids)), lengths)
    flat = np.concatenate(vectors)
    terms = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    full = flat != 0
    rows, flat, terms = rows[full], flat[full], terms[full]
    order = np.argsort(terms, kind="stable")
    found, starts = np.unique(terms[order], return_index=True)
    return {int(t): (rows[o], flat[o]) for t, o in zip(found, np.split(order, starts[1:]))}


def accumulate(queries: list[np.ndarray], inverted: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Dense scores, a row a query.  The integer type is the narrowest that cannot overflow."""
    peak = lambda vs: max((int(np.abs(v).max()) for v in vs if len(v)), default=0)
    most = peak(queries) * peak([w for _, w in inverted.values()]) * max(1, len(inverted))
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
    scores = np.zeros((len(queries), n), kind)
    for term, (rows, weights) in inverted.items():
        weights = weights.astype(kind)
        dense = len(rows) == n
        for q, vector in enumerate(queries):
            if term < len(vector) and (w := vector[term]):
                if dense:
                    scores[q] += weights * kind(w) if kind is not object else weights * int(w)
                else:
                    scores[q][rows] += weights * kind(w) if kind is not object else weights * int(w)
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, rows with the query's own id left out."""
    open_ = np.flatnonzero(ids != own)
    if len(open_) > k:
        part = scores[open_]
        bar = np.sort(np.partition(part, len(part) - k)[len(part) - k :])[0]
        open_ = open_[part >= bar]
        if len(open_) > 8 * k:  # many ties at the bar: all above it, and of those at it the smallest ids
            at = open_[scores[open_] == bar]
            open_ = np.concatenate([open_[scores[open_] > bar], at[np.argsort(ids[at], kind="stable")[:k]]])
    return open_[np.lexsort((ids[open_], -scores[open_]))[:k]]


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the k best candidates of each query, all if fewer.

    Candidates are every row but those with the query's own id.  Vectors that are null
    or hold null or non-finite components, and rows with a null id, take no part.
    Vectors of unequal length meet on the dimensions that both have.  A repeated
    candidate row counts as often as it occurs, ties going to the smaller id; of query
    rows that repeat an id, each distinct vector is one query.  An empty table gives an
    empty result.  A score beyond a long raises an overflow error.
    """
    spark = rows.sparkSession
    usable_rows = rows.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    plain = usable_rows.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    peak = F.max(F.array_max(F.transform("vector", lambda x: F.greatest(x, -x))))
    sizes = plain.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.coalesce(peak, F.lit(0)).alias("peak")).first()
    kind = next(k for k, bits in (("smallint", 15), ("int", 31), ("bigint", 64)) if sizes["peak"] < 2**bits)
    plain = plain.withColumn("vector", F.col("vector").cast(f"array<{kind}>"))
    c_blocks, q_blocks = (max(1, -(-sizes["n"] // candidate_block)), max(1, -(-sizes["q"] // query_block)))
    # no block is left to one task while others idle
    c_blocks = max(c_blocks, min(sizes["n"] // 256 + 1, -(-2 * spark.sparkContext.defaultParallelism // q_blocks)))
    ask = plain.filter("asks").select("id", "vector").distinct()
    ask = ask.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    give = plain.withColumn("cb", F.pmod(F.xxhash64("id", "vector"), F.lit(c_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def block(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "query_key", "vec_id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        ids = right["id"].to_numpy(np.int64)
        vectors = [np.asarray(v, np.int64) for v in right["vector"]]
        asked = [np.asarray(v, np.int64) for v in left["vector"]]
        inverted, out, owns, marks = postings(ids, vectors), [], left["id"].tolist(), left["mark"].tolist()
        for first in range(0, len(asked), _AT_ONCE):
            for scores, own, mark in zip(accumulate(asked[first : first + _AT_ONCE], inverted, len(ids)), owns[first:], marks[first:]):
                best = select(scores, ids, own, k)
                out.append(pd.DataFrame({"query_id": own, "query_key": mark, "vec_id": ids[best], "score": scores[best].astype(np.int64)}))
        return pd.concat(out, ignore_index=True)[names]

    ask = ask.withColumn("mark", F.xxhash64("vector"))
    deal = [F.col("qb").cast("long"), F.col("cb").cast("long")]
    met = ask.groupBy(*deal).cogroup(give.select("id", "vector", "qb", "cb").groupBy(*deal)).applyInPandas(block, "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
