"""Boxes of files that come as byte ranges: no task and no value holds a whole file.

Every range lists the headers that may begin a top box: those at a known type's name, and
whatever follows one of them inside the range.  Which of them the file's chain really
visits is list ranking: pointers to the next header are doubled (next, next but one, fourth
next, ...) while the set of visited headers doubles with them, so the rounds grow with the
logarithm of the chain.  Where a chain enters a range at a name that is not known, those
few bytes are fetched and the chain goes on.  Boxes with content are then fetched by
themselves and parsed where they arrive; media bytes are read once and never move.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions import boxes
from quarry.storage import checkpointed

#: Bytes of a range's successor that it carries along: a header, and what tells where its content begins.
OVERLAP = 64
_KNOWN = re.compile(b"(?=" + b"|".join(sorted(t.encode() for t in boxes.TOP_TYPES)) + b")")
HEADERS = "video_id string, p long, raw binary, size long, header int, uuid binary"
BOXES = schemas.BOXES.replace("box_id long, parent_id long", "parent_start long")

#: (video_id, start, n) rows to the same with ``content``; see ``from_ranges`` and ``sources.files.read_pieces``.
Fetch = Callable[[DataFrame], DataFrame]


def header_at(data: bytes, at: int) -> tuple[bytes, int, int, bytes | None] | None:
    """(type, size, header length, uuid) of a box header; null if its eight bytes are not all there."""
    if at < 0 or at + 8 > len(data):
        return None
    size, raw, header = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
    if size == 1:
        if at + 16 > len(data):
            return raw, -1, 16, None
        size, header = int.from_bytes(data[at + 8 : at + 16], "big"), 16
    uuid = None
    if raw == b"uuid":
        uuid, header = data[at + header : at + header + 16], header + 16
    return raw, min(size, 2**62), header, uuid


def _candidates(range_size: int) -> Callable:
    def rows(video: str, offset: int, data: bytes) -> Iterator[tuple]:
        seen: set[int] = set()
        open_ = [m.start() - 4 for m in _KNOWN.finditer(data)] + ([0] if offset == 0 else [])
        while open_:
            at = open_.pop()
            if at in seen or not 0 <= at < range_size or (found := header_at(data, at)) is None:
                continue
            seen.add(at)
            raw, size, header, uuid = found
            yield video, offset + at, raw, size, header, uuid
            if size >= header:
                open_.append(at + size)

    return rows


def _per_range(ranges: DataFrame, decode: Callable, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, start, data in zip(*(batch.column(k) for k in range(3))):
                if rows := list(decode(video.as_py(), start.as_py(), data.as_py() or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows), made)], schema=made)

    return ranges.mapInArrow(run, schema)


def cut(files: DataFrame, size: int) -> DataFrame:
    """``video_id, offset, content``: ranges of ``size`` bytes with their overlap, of contents that are one value each."""
    starts = F.when(F.octet_length("content") > 0, F.sequence(F.lit(0), F.octet_length("content") - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    part = lambda at: F.struct(at.cast("long").alias("offset"), F.substr("content", at + 1, F.lit(size + OVERLAP)).alias("content"))
    # cut before the explode: its rows would each carry the whole content
    return files.select("video_id", F.explode(F.transform(starts, part)).alias("part")).select("video_id", "part.offset", "part.content")


def from_ranges(ranges: DataFrame, size: int) -> Fetch:
    """Pieces joined together from the ranges that they touch."""

    def fetch(pieces: DataFrame) -> DataFrame:
        touched = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.greatest("n", F.lit(1)) - 1) / size))).alias("range")
        asked = pieces.select("video_id", "start", "n", touched)
        held = ranges.select("video_id", F.floor(F.col("offset") / size).alias("range"), "offset", F.substr("content", F.lit(1), F.lit(size)).alias("content"))
        met = asked.join(held, ["video_id", "range"])
        first = F.greatest(F.lit(0), F.col("start") - F.col("offset"))
        part = F.substr("content", (first + 1).cast("int"), (F.col("start") + F.col("n") - F.col("offset") - first).cast("int"))
        joined = met.select("video_id", "start", "n", F.struct("range", part.alias("part")).alias("part")).groupBy("video_id", "start", "n").agg(F.sort_array(F.collect_list("part")).alias("parts"))
        # parts of a box one after another; a box with content is one value
        return joined.select("video_id", "start", "n", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["part"])).alias("content"))

    return fetch


def top_chain(ranges: DataFrame, lengths: DataFrame, size: int, fetch: Fetch) -> tuple[DataFrame, DataFrame]:
    """(``video_id, start, raw, header, size, uuid`` of the top boxes; anomalies as ``boxes.anomalies`` has them).

    ``ranges``: video_id, offset, content with ``OVERLAP`` bytes of the next range; ``lengths``: video_id, length.
    """
    nodes = checkpointed(_per_range(ranges.select("video_id", "offset", "content"), _candidates(size), HEADERS).dropDuplicates(["video_id", "p"]))
    starts, reached = lengths.select("video_id", "length", F.lit(0).cast("long").alias("p")), None
    while True:
        now = _reached(nodes, starts)
        reached = now if reached is None else reached.unionByName(now)
        starts = checkpointed(now.filter(F.col("p") + 8 <= F.col("length")).join(nodes.select("video_id", "p"), ["video_id", "p"], "left_anti"))
        if starts.isEmpty():
            break
        lost = starts.select("video_id", F.col("p").alias("start"), F.least(F.lit(OVERLAP).cast("long"), F.col("length") - F.col("p")).alias("n"))
        more = _per_range(fetch(lost).select("video_id", "start", "content"), lambda video, start, data: [(video, start, *found)] if (found := header_at(data, 0)) else [], HEADERS)
        nodes = checkpointed(nodes.unionByName(more))
    place = reached.distinct().join(nodes, ["video_id", "p"]).withColumn("rest", F.col("length") - F.col("p"))
    size_ = F.when(F.col("size") == 0, F.col("rest")).otherwise(F.col("size"))
    place = place.withColumns({"declared": F.col("size"), "size": size_})
    fits = (F.col("size") >= F.col("header")) & (F.col("size") <= F.col("rest")) & (F.col("declared") >= 0)
    name = F.concat(F.lit("/"), F.decode("raw", "ISO-8859-1"))
    fault = lambda rows, code, message: rows.select("video_id", name.alias("path"), F.col("p").alias("offset"), F.lit(code).alias("code"), message.alias("message"))
    anomalies = fault(place.filter("declared = 0"), "size_zero", F.lit("extends to the end"))
    anomalies = anomalies.unionByName(fault(place.filter("declared < 0"), "short_header", F.lit("64-bit header past the end")))
    bad = place.filter(~fits & (F.col("declared") >= 0))
    anomalies = anomalies.unionByName(fault(bad, "bad_size", F.concat(F.lit("size "), "size", F.lit(", header "), "header", F.lit(", end "), "length")))
    return place.filter(fits).select("video_id", F.col("p").alias("start"), "raw", "header", "size", "uuid"), anomalies


def _reached(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """``video_id, length, p``: the places that the chains from ``starts`` visit, the last of which may be no known header."""
    now = checkpointed(starts)
    # a box that does not fit ends the chain, and so does one that takes the rest
    jump = nodes.filter(F.col("size") >= F.col("header")).join(starts.select("video_id", "length"), "video_id").select("video_id", "p", (F.col("p") + F.col("size")).alias("q"), "length")
    jump = checkpointed(jump.filter(F.col("q") <= F.col("length")).select("video_id", "p", "q"))
    while True:
        further = now.join(jump, ["video_id", "p"]).select("video_id", "length", F.col("q").alias("p"))
        met = checkpointed(now.unionByName(further).distinct())
        if met.count() == now.count():
            return now
        now = met
        jump = checkpointed(jump.join(jump.select("video_id", F.col("p").alias("q"), F.col("q").alias("r")), ["video_id", "q"]).select("video_id", "p", F.col("r").alias("q")))


def boxes_of_ranges(ranges: DataFrame, lengths: DataFrame, size: int, fetch: Fetch | None = None) -> tuple[DataFrame, DataFrame]:
    """(boxes with ``parent_start``; anomalies) of files in ranges, as ``boxes.parse`` finds them in whole files.

    ``fetch`` brings pieces of files; by default they come from the ranges, a seeking
    reader saves moving those.  A top box with content (moov, moof, meta, ...) is one value
    of at most 2 GB.
    """
    top, anomalies = top_chain(ranges, lengths, size, fetch or from_ranges(ranges, size))
    top = checkpointed(top)
    kind = F.decode("raw", "ISO-8859-1")
    full = kind.isin(*boxes.CONTAINERS, "meta", "stsd", *boxes.VISUAL, *boxes.AUDIO, *boxes.TEXT) | kind.startswith("\xa9")
    plain = top.filter(~full).select("video_id", F.lit(None).cast("long").alias("parent_start"), kind.alias("type"), F.col("raw").alias("type_raw"), "start", "header", "size", F.lit(0).alias("depth"), F.concat(F.lit("/"), kind).alias("path"), "uuid")
    held = (fetch or from_ranges(ranges, size))(top.filter(full).select("video_id", "start", F.col("size").alias("n"))).select("video_id", "start", "content")
    held = checkpointed(held)

    def inside(video: str, start: int, data: bytes) -> Iterator[tuple]:
        tree = boxes.parse(data)
        for b in tree.boxes:
            parent = start + tree.by_ident[b.parent].start if b.parent is not None else None
            yield video, parent, b.type, b.raw, start + b.start, b.header, b.size, b.depth, b.path, b.uuid

    def odd(video: str, start: int, data: bytes) -> Iterator[tuple]:
        tree = boxes.parse(data, start)
        for path, offset, code, message in [*(a for a in tree.anomalies if a[1]), *boxes.stsd_overflow(data, tree)]:
            yield video, path, start + offset, code, message

    return plain.unionByName(_per_range(held, inside, BOXES)), anomalies.unionByName(_per_range(held, odd, schemas.ANOMALIES))
