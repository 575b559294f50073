"""One decode of a file's bytes, many thin tables.

Contents are read and parsed once, in the task that reads them; what every rule needs comes
out of that pass as rows of a tagged stream, one struct column a table.  Each table is then
a filter on its tag and its own column, without the contents and without Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry import schemas
from quarry.functions import bitstream, boxes, kernels, rules

#: Padding types.
PADDING = ("free", "skip", "wide")

TABLES = {
    "digests": "video_id string, path string, length long, md5 string, sha1 string, sha256 string",
    "facts": "video_id string, type string, type_hex string, start long, header int, size long, depth int, path string, uuid string, nonzero double, entropy double, marked boolean, named boolean, system_id string, inside array<struct<type:string,start:long>>",
    "anomalies": schemas.ANOMALIES,
    "samples": schemas.SAMPLES,
    "metadata": schemas.METADATA,
    "messages": schemas.SEI,
    "parameters": f"video_id string, {schemas.SPS}",
    "timing": "video_id string, track_no int, handler string, ordinal int, duration long, samples long, zero_deltas long, ctts_min long, ctts_max long, edits long",
    "segments": "video_id string, seg_start long, text string",
    "signatures": "video_id string, code string, offset long, ok boolean",
    "media": "video_id string, start long, text string",
    "faults": "video_id string, step string, error string",
}


def digest_row(video: str, path: str | None, data: bytes) -> tuple:
    return video, path, len(data), *(hashlib.new(kind, data).hexdigest() for kind in ("md5", "sha1", "sha256"))


def fact_rows(video: str, data: bytes, tree: boxes.Tree) -> Iterator[tuple]:
    """A row a box with what rules ask of its bytes, so that no rule meets contents again.

    Padding has its share of non-zero bytes and its entropy, private boxes whether they hold
    a credentials marker (``marked``), top boxes but media whether such a name stands in them
    (``named``), protection headers their system's id, and movie boxes the first place of each
    protection name in them (``inside``), for some stand where no box is parsed.
    """
    for b in tree.boxes:
        nonzero = entropy = marked = system = inside = None
        named = False
        if b.type in PADDING:
            body = data[b.body : b.end]
            nonzero, entropy = kernels.nonzero_ratio(body), kernels.byte_entropy(body)
        if b.type in ("uuid", "jumb"):
            body = data[b.body : b.end]
            marked = any(m.encode() in body for m in rules.C2PA_MARKERS)
        if b.depth == 0 and b.type not in ("mdat", "moof"):
            named = data.find(b"c2pa", b.start, b.end) >= 0 or data.find(b"jumb", b.start, b.end) >= 0
        if b.type == "pssh":
            system = data[b.body + 4 : b.body + 20].hex()
        if b.depth == 0 and b.type == "moov":
            inside = [{"type": name, "start": at} for name in rules.DRM_BOXES if (at := data.find(name.encode(), b.start, b.end)) >= 0]
        yield video, b.type, b.raw.hex(), b.start, b.header, b.size, b.depth, b.path, b.uuid.hex() if b.uuid else None, nonzero, entropy, marked, named, system, inside


def anomaly_rows(video: str, data: bytes, tree: boxes.Tree) -> Iterator[tuple]:
    for path, offset, code, message in [*tree.anomalies, *boxes.stsd_overflow(data, tree)]:
        yield video, path, offset, code, message


def timing_rows(video: str, data: bytes, tree: boxes.Tree) -> Iterator[tuple]:
    seen: dict[str, int] = {}
    for k, trak, kind, _ in boxes.tracks(data, tree):
        seen[kind] = seen.get(kind, 0) + 1
        t = boxes.timing(data, tree, trak)
        yield video, k, kind, seen[kind], t["duration"], t["samples"], t["zero_deltas"], t["ctts_min"], t["ctts_max"], t["edits"]


def segment_rows(video: str, data: bytes, tree: boxes.Tree) -> Iterator[tuple]:
    for b in tree.boxes:
        if b.depth == 0 and b.type != "mdat":
            yield video, b.start, data[b.start : b.end].decode("latin-1")


def media_rows(video: str, data: bytes, tree: boxes.Tree) -> Iterator[tuple]:
    for b in tree.boxes:
        if b.depth == 0 and b.type == "mdat":
            yield video, b.start, data[b.body : b.end].decode("latin-1")


def signature_rows(video: str, data: bytes, tree: boxes.Tree, most: int = 8) -> Iterator[tuple]:
    for b in tree.boxes:
        if b.depth == 0 and b.type != "mdat":
            for code, at, ok in signatures(data[b.start : b.end], most):
                yield video, code, b.start + at, ok


def signatures(data: bytes, most: int = 8) -> list[tuple[str, int, bool]]:
    """(code, offset, valid) of embedded signatures, in order of offset."""
    out = []
    for code, magic, pad in rules.MAGICS:
        at = -1
        for _ in range(most):
            at = data.find(magic, at + 1)
            if at < 0:
                break
            start = at - pad if at >= pad else at
            out.append((code, start, _valid(code, data, start)))
    return sorted(out, key=lambda r: (r[1], r[0]))


def _valid(code: str, data: bytes, start: int) -> bool:
    """Whether what follows a signature has that kind's structure, by code."""
    d = data[start : start + 128]
    u16 = lambda at: int.from_bytes(d[at : at + 2], "little")
    tests = {
        "png": lambda: d[12:16] == b"IHDR",
        "jpeg": lambda: data.find(b"\xff\xd9", start + 2) >= 0,
        "zip": lambda: len(d) >= 30 and u16(8) in (0, 8, 9, 12, 14, 93, 95, 98) and 0 < u16(4) <= 63,
        "zip_empty": lambda: len(d) >= 22 and u16(8) == u16(10),
        "gzip": lambda: len(d) > 9 and d[3] < 32,
        "pdf": lambda: d[:7] == b"%PDF-1.",
        "sqlite": lambda: len(d) >= 100 and int.from_bytes(d[16:18], "big") in (1, *[2**k for k in range(8, 16)]),  # page size; 1 stands for 65536
        "ogg": lambda: len(d) > 5 and d[4] == 0 and d[5] in (0, 2, 4, 6),
        "flac": lambda: len(d) > 4 and d[4] & 127 == 0,
        "elf": lambda: len(d) > 5 and d[4] in (1, 2) and d[5] in (1, 2),
        "7z": lambda: len(d) > 8,
        "rar": lambda: d[6:7] in (b"\0", b"\1"),
    }
    return bool(tests[code]()) if code in tests else True


def _steps(deep: bool) -> dict[str, Callable[[str, bytes, boxes.Tree], Iterable[tuple]]]:
    most = 2**62 if deep else bitstream.MOST_SAMPLES
    found = {
        "facts": fact_rows, "anomalies": anomaly_rows, "samples": boxes.sample_rows, "metadata": boxes.metadata_rows,
        "messages": lambda video, data, tree: bitstream.sei_rows(video, data, most, tree), "parameters": bitstream.sps_rows,
        "timing": timing_rows, "segments": segment_rows, "signatures": signature_rows,
    }
    return found | ({"media": media_rows} if deep else {})


def rows_of(video: str, path: str | None, data: bytes, deep: bool = False) -> Iterator[tuple[str, tuple]]:
    """(table, row) of one file, parsed once; a step that its bytes break keeps the rows before the fault and adds a fault."""
    yield "digests", digest_row(video, path, data)
    try:
        tree = boxes.parse(data)
    except boxes.FAULTS as exc:
        yield "faults", (video, "boxes", f"{type(exc).__name__}: {exc}")
        return
    for name, step in _steps(deep).items():
        try:
            for row in step(video, data, tree):
                yield name, row
        except boxes.FAULTS as exc:
            yield "faults", (video, name, f"{type(exc).__name__}: {exc}")


_ROWS = 4096


def tagged(files: DataFrame, deep: bool = False) -> DataFrame:
    """``table`` and a struct column a table: every thin row of ``files`` (video_id, path, content), one pass over the contents."""
    fields = {name: to_arrow_schema(T.StructType.fromDDL(ddl)) for name, ddl in TABLES.items()}
    schema = pa.schema([("table", pa.string()), *((name, pa.struct(list(f))) for name, f in fields.items())])

    def batch(name: str, rows: list[tuple]) -> pa.RecordBatch:
        made = pa.StructArray.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows), fields[name])], fields=list(fields[name]))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(made if n == name else pa.nulls(len(rows), schema.field(n).type) for n in fields)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (pair for b in batches for k in range(b.num_rows) for pair in rows_of(b["id"][k].as_py(), b["path"][k].as_py(), b["data"][k].as_py() or b"", deep))
        held: dict[str, list[tuple]] = {name: [] for name in fields}
        while some := list(islice(found, _ROWS)):
            for name, row in some:
                held[name].append(row)
            for name, rows in held.items():
                if rows:
                    yield batch(name, rows)
                    held[name] = []

    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")
    columns = ", ".join(f"{name} struct<{', '.join(':'.join(c.strip().split(' ', 1)) for c in _columns(ddl))}>" for name, ddl in TABLES.items())
    return files.select(F.col("video_id").alias("id"), path.alias("path"), F.col("content").cast("binary").alias("data")).mapInArrow(run, f"table string, {columns}")


def _columns(ddl: str) -> list[str]:
    """Columns of a schema text, commas inside brackets apart."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def table(stream: DataFrame, name: str) -> DataFrame:
    return stream.filter(F.col("table") == name).select(f"{name}.*")
