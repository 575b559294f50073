"""Decoders of box containers: bytes to rows.

Pure functions from a byte buffer to lists of plain rows, and the DataFrame operators
that apply them per file through Arrow batches.  A file that breaks a decoder keeps the
rows decoded before the fault and gets an error row from ``decode_errors``; the job goes on.
"""

from __future__ import annotations

import contextlib
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry import schemas

# Box types by how their content is read.
CONTAINERS = {"moov", "trak", "mdia", "minf", "stbl", "dinf", "edts", "udta", "mvex", "moof", "traf", "mfra", "sinf", "schi", "ipro", "iprp", "ipco", "meco", "strk", "strd", "tref", "gmhd", "wave", "ilst", "----"}
VISUAL = {"avc1", "avc3", "hvc1", "hev1", "mp4v", "encv"}
AUDIO = {"mp4a", "enca", "alac", "Opus", "fLaC", "ac-3", "ec-3"}
TEXT = {"tx3g", "wvtt", "stpp"}
TOP_TYPES = {"ftyp", "moov", "mdat", "free", "skip", "wide", "uuid", "meta", "moof", "mfra", "sidx", "ssix", "styp", "pdin", "emsg", "prft", "udta"}
META_CHILDREN = {b"hdlr", b"keys", b"ilst", b"free", b"mhdr"}
MOST_DEPTH, MOST_BOXES, MOST_ENTRIES = 12, 200_000, 64
#: Decoded rows that go on in one batch.
_ROWS = 4096


@dataclass
class Box:
    ident: int
    parent: int | None
    raw: bytes
    start: int
    header: int
    size: int
    depth: int
    path: str
    uuid: bytes | None = None

    @property
    def type(self) -> str:
        return self.raw.decode("latin-1")

    @property
    def body(self) -> int:
        return self.start + self.header

    @property
    def end(self) -> int:
        return self.start + self.size


@dataclass
class Tree:
    boxes: list[Box] = field(default_factory=list)
    anomalies: list[tuple[str, int, str, str]] = field(default_factory=list)
    _named: dict[int, Box] = field(default_factory=dict)

    @property
    def by_ident(self) -> dict[int, Box]:
        if len(self._named) != len(self.boxes):
            self._named = {b.ident: b for b in self.boxes}
        return self._named

    def children(self, box: Box | None) -> list[Box]:
        ident = box.ident if box else None
        return [b for b in self.boxes if b.parent == ident]

    def under(self, box: Box, kind: str) -> list[Box]:
        """Boxes of a type anywhere below ``box``."""
        return [b for b in self.boxes if b.type == kind and b.start > box.start and b.end <= box.end and b.depth > box.depth]

    def first(self, box: Box, kind: str) -> Box | None:
        return next(iter(self.under(box, kind)), None)


def parse(data: bytes, base: int = 0) -> Tree:
    """All boxes of a buffer, parents before children, levels read with an explicit stack.

    A size of one takes the 64-bit size that follows, zero reaches the segment's end and is
    an anomaly, and a size under its header or past the segment ends that level.  ``base``, the
    buffer's place in its file, shows in messages only.
    """
    tree = Tree()
    levels: list[tuple[int, int, Box | None, str]] = [(0, len(data), None, "")]
    while levels:
        at, end, parent, path = levels.pop()
        depth, inside = (parent.depth + 1 if parent else 0), []
        for _ in range(MOST_BOXES):
            if at + 8 > end:
                break
            size, raw, header = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
            where = f"{path}/{raw.decode('latin-1')}"
            if size == 1:
                if at + 16 > end:
                    tree.anomalies.append((where, at, "short_header", "64-bit header past the end"))
                    break
                size, header = int.from_bytes(data[at + 8 : at + 16], "big"), 16
            elif size == 0:
                size = end - at
                tree.anomalies.append((where, at, "size_zero", "extends to the end"))
            uuid = None
            if raw == b"uuid":
                uuid, header = data[at + header : at + header + 16], header + 16
            if size < header or at + size > end:
                tree.anomalies.append((where, at, "bad_size", f"size {size}, header {header}, end {base + end}"))
                break
            box = Box(len(tree.boxes), parent.ident if parent else None, raw, at, header, size, depth, where, uuid)
            tree.boxes.append(box)
            if depth < MOST_DEPTH and (first := _content(data, box, path)) is not None:
                inside.append((first, box.end, box, where))
            at += size
        else:
            tree.anomalies.append((path, at, "too_many", f"more than {MOST_BOXES} boxes"))
        levels += reversed(inside)
    tree.boxes.sort(key=lambda b: (b.start, b.depth))
    return tree


def _content(data: bytes, box: Box, path: str) -> int | None:
    """Where a box's children begin; null if it has none."""
    kind, body = box.type, box.body
    if kind == "meta":
        # version and flags come first in most files; older ones begin with a child at once
        return body + 4 if data[body + 8 : body + 12] in META_CHILDREN and data[body + 4 : body + 8] not in META_CHILDREN else body
    if kind == "stsd":
        return body + 8
    if kind in CONTAINERS or path.endswith("/ilst") or kind.startswith("\xa9"):
        return body
    skip = None
    if kind in VISUAL:
        skip = 78
    elif kind in AUDIO:
        skip = 28 + {1: 16, 2: 36}.get(int.from_bytes(data[body + 8 : body + 10], "big"), 0)
    elif kind in TEXT:
        skip = 8
    return body + skip if skip is not None and body + skip < box.end else None


def stsd_overflow(data: bytes, tree: Tree) -> list[tuple[str, int, str, str]]:
    """An anomaly for each sample description that declares more than 64 entries."""
    out = []
    for box in (b for b in tree.boxes if b.type == "stsd"):
        n = int.from_bytes(data[box.body + 4 : box.body + 8], "big")
        if n > MOST_ENTRIES:
            out.append((box.path, box.start, "many_entries", f"{n} sample descriptions"))
    return out


def _u32s(data: bytes, at: int, n: int) -> tuple[int, ...]:
    return struct.unpack_from(f">{n}I", data, at)


def sizes_of(data: bytes, box: Box) -> tuple[Iterable[int], int, bool]:
    """Sample sizes of an stsz or stz2 box, how many, and whether the table is cut short.

    One size for all is never written out: a damaged count may be in the billions.
    """
    at = box.body + 4
    if box.end - at < 8:
        raise ValueError("size table without a header")
    if box.type == "stsz":
        fixed, count = _u32s(data, at, 2)
        if fixed:
            return repeat(fixed, count), count, False
        n = min(count, (box.end - at - 8) // 4)
        return _u32s(data, at + 8, n), n, n != count
    width, count = data[at + 3], _u32s(data, at + 4, 1)[0]
    if width not in (4, 8, 16):
        raise ValueError(f"sizes of {width} bits")
    at += 8
    n = min(count, (box.end - at) * 8 // width)
    if width == 4:
        return [data[at + k // 2] >> 4 if k % 2 == 0 else data[at + k // 2] & 15 for k in range(n)], n, n != count
    return (list(data[at : at + n]) if width == 8 else struct.unpack_from(f">{n}H", data, at)), n, n != count


def sample_table(data: bytes, tree: Tree, stbl: Box) -> tuple[list[tuple[int, int]], dict]:
    """(offset, size) of each sample in order, and what the table says of itself."""
    one = {k: tree.first(stbl, k) for k in ("stsz", "stz2", "stsc", "stco", "co64")}
    sizes, total, cut = sizes_of(data, sized) if (sized := one["stsz"] or one["stz2"]) else ([], 0, False)
    chunks: list[int] = []
    if placed := one["stco"] or one["co64"]:
        width = "I" if placed.type == "stco" else "Q"
        n = min(_u32s(data, placed.body + 4, 1)[0], (placed.end - placed.body - 8) // struct.calcsize(width))
        chunks = list(struct.unpack_from(f">{n}{width}", data, placed.body + 8))
    runs: list[tuple[int, int]] = []
    if told := one["stsc"]:
        for k in range(min(_u32s(data, told.body + 4, 1)[0], (told.end - told.body - 8) // 12)):
            first, each, _ = _u32s(data, told.body + 8 + 12 * k, 3)
            if first < 1:
                break
            runs.append((first, each))
    found: list[tuple[int, int]] = []
    last = [*[r[0] for r in runs[1:]], len(chunks) + 1]
    taken, unwritten = iter(sizes), isinstance(sizes, repeat)
    for (first, each), until in zip(runs, last):
        for offset in chunks[first - 1 : min(until, len(chunks) + 1) - 1]:
            for _ in range(each):
                if unwritten and offset > len(data) and found and found[-1][0] + found[-1][1] > len(data):
                    break  # this chunk has left the file, and a sample out of range says so
                if (size := next(taken, None)) is None:
                    break
                found.append((offset, size))
                offset += size
    return found, {"n_sizes": total, "n_samples": len(found), "total_bytes": sum(s for _, s in found), "unreachable_samples": total - len(found), "truncated": cut}


def tracks(data: bytes, tree: Tree) -> Iterator[tuple[int, Box, str, Box | None]]:
    """(number from 1, trak box, handler, stbl box)."""
    for k, trak in enumerate((b for b in tree.boxes if b.type == "trak"), 1):
        handler = tree.first(trak, "hdlr")
        kind = data[handler.body + 8 : handler.body + 12].decode("latin-1") if handler else ""
        yield k, trak, kind, tree.first(trak, "stbl")


def handler_name(data: bytes, box: Box) -> str:
    return data[box.body + 24 : box.end].rstrip(b"\0").decode("utf-8", "replace")


def timing(data: bytes, tree: Tree, trak: Box) -> dict:
    """Duration, zero steps, composition offsets (of 5000 entries at most) and edits of a track."""
    out = {"duration": 0, "samples": 0, "zero_deltas": 0, "ctts_min": None, "ctts_max": None, "edits": 0}
    if box := tree.first(trak, "stts"):
        for k in range(min(_u32s(data, box.body + 4, 1)[0], (box.end - box.body - 8) // 8)):
            n, delta = _u32s(data, box.body + 8 + 8 * k, 2)
            out["duration"] += n * delta
            out["samples"] += n
            out["zero_deltas"] += n if delta == 0 else 0
    if box := tree.first(trak, "ctts"):
        n = min(_u32s(data, box.body + 4, 1)[0], (box.end - box.body - 8) // 8, 5000)
        offsets = [struct.unpack_from(">Ii", data, box.body + 8 + 8 * k)[1] for k in range(n)]
        if offsets:
            out |= {"ctts_min": min(offsets), "ctts_max": max(offsets)}
    if box := tree.first(trak, "elst"):
        out["edits"] = _u32s(data, box.body + 4, 1)[0]
    return out


def ilst_value(kind: int, payload: bytes) -> str:
    """A metadata payload by its data type."""
    kind &= 0xFFFFFF
    if kind in (1, 2):
        return payload.decode("utf-8" if kind == 1 else "utf-16-be", "replace")
    if kind in (21, 22):
        return f"<{'int' if kind == 21 else 'uint'} {int.from_bytes(payload[:4], 'big', signed=kind == 21)}>"
    named = {13: "jpeg", 14: "png", 27: "bmp"}.get(kind)
    if named:
        return f"<{named} {len(payload)}B>"
    return f"<{'binary' if kind == 0 else f'type{kind}'} {len(payload)}B> {payload[:64].hex()}"


def metadata(data: bytes, tree: Tree) -> list[tuple[str, str, str, int, int, int]]:
    """(source, key, value, type, value offset, value length) of every metadata item."""
    out = []
    for ilst in (b for b in tree.boxes if b.type == "ilst"):
        holder = next((b for b in tree.boxes if b.ident == ilst.parent), None)
        names = _mdta_keys(data, tree.first(holder, "keys")) if holder else []
        for item in tree.children(ilst):
            parts = tree.children(item)
            key, ordinal = item.type, int.from_bytes(item.raw, "big")
            source = "itunes"
            if 1 <= ordinal <= len(names):
                key, source = names[ordinal - 1], "mdta"
            elif item.type == "----":
                text = {p.type: data[p.body + 4 : p.end].decode("utf-8", "replace") for p in parts if p.type in ("mean", "name")}
                key, source = ":".join(text[k] for k in ("mean", "name") if k in text), "freeform"
            for part in (p for p in parts if p.type == "data"):
                kind = int.from_bytes(data[part.body : part.body + 4], "big") & 0xFFFFFF
                out.append((source, key, ilst_value(kind, data[part.body + 8 : part.end]), kind, part.body + 8, part.end - part.body - 8))
    for box in tree.boxes:  # text atoms of the older kind: length, language, text
        if box.raw[:1] == b"\xa9" and not box.path.rsplit("/", 1)[0].endswith("/ilst") and not any(c.type == "data" for c in tree.children(box)) and box.size >= box.header + 4:
            n = min(int.from_bytes(data[box.body : box.body + 2], "big"), box.end - box.body - 4)
            out.append(("legacy", box.type, data[box.body + 4 : box.body + 4 + n].decode("utf-8", "replace"), 1, box.body + 4, n))
    return out


def _mdta_keys(data: bytes, box: Box | None) -> list[str]:
    if box is None:
        return []
    out, at = [], box.body + 8
    while at + 8 <= box.end:
        size = int.from_bytes(data[at : at + 4], "big")
        if size < 8 or at + size > box.end:
            break
        out.append(data[at + 8 : at + size].decode("utf-8", "replace"))
        at += size
    return out


#: What malformed bytes raise in a decoder.
FAULTS = (struct.error, IndexError, ValueError, ZeroDivisionError, OverflowError)


def _until_fault(decode: Callable[[str, bytes], Iterable[tuple]], ident: str, data: bytes) -> Iterator[tuple]:
    with contextlib.suppress(*FAULTS):
        yield from decode(ident, data)


def decode_errors(files: DataFrame, decoders: dict[str, Callable[[str, bytes], Iterable[tuple]]], **names: str) -> DataFrame:
    """``video_id, step, error``: a row for each decoder that a file breaks."""

    def rows(video: str, data: bytes) -> Iterator[tuple]:
        for step, decode in decoders.items():
            try:
                for _ in decode(video, data):
                    pass
            except FAULTS as exc:
                yield video, step, f"{type(exc).__name__}: {exc}"

    return per_file(files, rows, "video_id string, step string, error string", **names)


def per_file(files: DataFrame, decode: Callable[[str, bytes], Iterable[tuple]], schema: str, id_col: str = "video_id", content: str = "content", kept: tuple[str, ...] = ()) -> DataFrame:
    """Rows that ``decode`` yields for each file, narrow: files stay in the partitions that read them.

    Rows of several files go on together, ``_ROWS`` at a time, so neither many small files
    nor one with many rows costs a batch a file or a list a file.  Columns ``kept`` of a
    file go along with each of its rows, so that nothing has to be joined to them later.
    """
    types = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    schema = ", ".join([schema, *(f"`{c}` {types[c]}" for c in kept)])
    made = to_arrow_schema(T.StructType.fromDDL(schema))

    def found(batch: pa.RecordBatch, k: int) -> Iterator[tuple]:
        more = tuple(batch[c][k].as_py() for c in kept)
        rows = _until_fault(decode, batch["id"][k].as_py(), batch["data"][k].as_py() or b"")
        return (row + more for row in rows) if kept else rows

    lists = [k for k, field in enumerate(made) if pa.types.is_list(field.type)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for k in range(batch.num_rows) for row in found(batch, k))
        while some := list(_some(every, lists)):
            yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*some), made)], schema=made)

    return files.select(F.col(id_col).alias("id"), F.col(content).cast("binary").alias("data"), *kept).mapInArrow(rows, schema)


def _some(rows: Iterator[tuple], lists: list[int]) -> Iterator[tuple]:
    """The next ``_ROWS`` rows, or fewer where their lists hold as many entries."""
    if not lists:
        yield from islice(rows, _ROWS)
        return
    weight = 0
    for row in rows:
        yield row
        weight += 1 + sum(len(row[k] or ()) for k in lists)
        if weight >= _ROWS:
            return


def box_rows(video: str, data: bytes) -> Iterator[tuple]:
    for b in parse(data).boxes:
        yield video, b.ident, b.parent, b.type, b.raw, b.start, b.header, b.size, b.depth, b.path, b.uuid


def anomaly_rows(video: str, data: bytes) -> Iterator[tuple]:
    tree = parse(data)
    for path, offset, code, message in [*tree.anomalies, *stsd_overflow(data, tree)]:
        yield video, path, offset, code, message


def sample_rows(video: str, data: bytes, tree: Tree | None = None) -> Iterator[tuple]:
    tree = tree or parse(data)
    for k, _, kind, stbl in tracks(data, tree):
        if stbl:
            for n, (offset, size) in enumerate(sample_table(data, tree, stbl)[0]):
                yield video, k, kind, n, offset, size


def run_rows(video: str, data: bytes, tree: Tree | None = None) -> Iterator[tuple]:
    """A row for each stretch of at most ``_ROWS`` samples of a track where one begins as the last one ends; samples without bytes or with a place below zero stand alone."""
    run: list[tuple[int, int]] = []
    head, end = (), None
    for _, k, _, n, offset, size in sample_rows(video, data, tree):
        if run and (k != head[0] or offset != end or size <= 0 or len(run) == _ROWS):
            yield video, *head, run[0][0], end, [{"offset": o, "size": z} for o, z in run]
            run = []
        head = head if run else (k, n)
        run.append((offset, size))
        end = offset + size
        if size <= 0 or offset < 0:
            yield video, *head, offset, end, [{"offset": offset, "size": size}]
            run = []
    if run:
        yield video, *head, run[0][0], end, [{"offset": o, "size": z} for o, z in run]


def track_rows(video: str, data: bytes) -> Iterator[tuple]:
    tree = parse(data)
    for k, _, kind, stbl in tracks(data, tree):
        try:
            told = sample_table(data, tree, stbl)[1] if stbl else {}
            error = None if stbl else "no sample table"
        except (struct.error, IndexError, ZeroDivisionError) as exc:
            told, error = {}, f"{type(exc).__name__}: {exc}"
        yield video, k, kind, told.get("n_sizes"), told.get("n_samples"), told.get("total_bytes"), told.get("unreachable_samples"), told.get("truncated"), error


def metadata_rows(video: str, data: bytes, tree: Tree | None = None) -> Iterator[tuple]:
    for source, key, value, kind, offset, length in metadata(data, tree or parse(data)):
        yield video, source, key, value, kind, offset, length


def boxes(files: DataFrame, **names: str) -> DataFrame:
    return per_file(files, box_rows, schemas.BOXES, **names)


def anomalies(files: DataFrame, **names: str) -> DataFrame:
    return per_file(files, anomaly_rows, schemas.ANOMALIES, **names)


def samples(files: DataFrame, kept: tuple[str, ...] = (), **names: str) -> DataFrame:
    return per_file(files, sample_rows, schemas.SAMPLES, kept=kept, **names)


def sample_runs(files: DataFrame, **names: str) -> DataFrame:
    """Samples that follow each other without a gap as one row with their ``parts``; see ``run_rows``."""
    return per_file(files, run_rows, schemas.SAMPLE_RUNS, **names)


def track_info(files: DataFrame, **names: str) -> DataFrame:
    return per_file(files, track_rows, schemas.TRACKS, **names)


def metadata_items(files: DataFrame, **names: str) -> DataFrame:
    return per_file(files, metadata_rows, schemas.METADATA, **names)


def tree_text(boxes_: DataFrame, lines: int = 400) -> DataFrame:
    """``video_id, start, line``: an indented listing, at most ``lines`` a file."""
    from pyspark.sql import Window

    order = Window.partitionBy("video_id").orderBy("start", "depth")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("type"), F.lit(" @"), F.col("start").cast("string"), F.lit(" "), F.col("size").cast("string"))
    return boxes_.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= lines).select("video_id", "start", line.alias("line"))
