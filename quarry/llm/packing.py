"""Packing tokenised documents into fixed-length sequences by bounded-space online best fit.

Two steps, so that texts are read and tokenised once and never shuffled:

1. ``pieces``: each text becomes pieces of at most ``capacity`` tokens (only longer
   documents are cut); a row carries the piece's length and checksum.
2. ``pack``: the thin piece rows are dealt by hash into groups of about
   ``GROUP_SEQUENCES`` sequences, put in a fixed order, and packed one after another.
   A packer keeps at most ``open_bins`` bins, in a bitset keyed by free space: the
   lowest set bit at or above the piece's length is the fullest bin that fits.  When
   a new bin is needed and all are in use, the fullest closes first.  Its state is
   the open bins alone, whatever the number of pieces.

Groups depend only on values and are ordered by them, so a task run again after a
lost executor gives the same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed
from quarry.llm.tokens import WordIds

CAPACITY, OPEN_BINS = 4096, 512
#: Sequences that one packing task makes, about.  A group's loss is its last open bins.
GROUP_SEQUENCES = 50_000


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: a text's ids by the vocabulary file, then ``end_id``, cut at ``capacity``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = WordIds.of(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, raw in enumerate(ids.encode_all(batch.column(1))):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            doc, piece, *rest = np.array(rows, np.int64).reshape(-1, 5).T
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), *map(pa.array, rest)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """At most ``most`` open bins, found by free space through a bitset."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count, self.made = capacity, most, 0, 0
        self.mask = 0  # bit f is set if a bin with f free places is open
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        if len(bins) == 1:
            self.mask ^= 1 << free
        self.count -= 1
        return bins.pop()

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length`` tokens."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.capacity, self.made
            self.made += 1
            if length < free and self.count == self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(at)
            self.mask |= 1 << left
            self.count += 1
        return at, self.capacity - free


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    group_sequences: int = GROUP_SEQUENCES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece of the end id.  Rows repeated with one id give
    their pieces once each.  An empty table gives an empty result.  Other columns play
    no part.  ``sequence_id`` is unique over all groups; offsets are gapless from 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = checkpointed(pieces(docs, vocabulary, end_id, capacity, id_col, text_col))
    tokens = rows.agg(F.sum("length").alias("n")).first()["n"] or 0
    groups = max(1, -(-tokens // (capacity * group_sequences)))
    by = ["doc_id", "piece", "ids_crc32", "length"]
    dealt = rows.repartition(groups, *by).sortWithinPartitions(F.xxhash64(*by), *by)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch["length"].tolist()]
            yield batch.assign(sequence_id=[first + at for at, _ in placed], offset=[offset for _, offset in placed])

    return dealt.mapInPandas(fill, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
