import random
import struct

import pytest
from builders import box, full, movie, stbl, u32
from pyspark.sql import functions as F

from quarry.functions import boxes
from quarry.operators import chains
from quarry.sources import files


def containers():
    rng = random.Random(5)
    table = stbl(list(range(1, 60)), list(range(100, 160)), [(1, 1)])
    tail = struct.pack(">I4s", 0, b"mdat") + bytes(50)
    wide = struct.pack(">I4sQ", 1, b"mdat", 16 + 300) + bytes(rng.randrange(256) for _ in range(300))
    meta = box("meta", bytes(4), full("hdlr", bytes(20)), box("ilst", box("\xa9too", box("data", u32(1, 0), b"enc" * 40)), box("covr", box("data", u32(14, 0), b"png"))))
    return {
        "movie": movie(table, b"free moov ftyp" * 30) + meta + box("zzzz", bytes(70)) + box("\x01\x02ab", b"x") + box("uuid", bytes(range(16)), b"p"),
        "wide": box("ftyp", bytes(8)) + wide + box("free", bytes(90)) + tail,
        "broken": box("ftyp", bytes(200)) + box("moov", box("trak", bytes(3)), u32(3) + b"junk") + u32(4) + b"tail",
        "fragments": b"".join(box("moof", box("mfhd", u32(0, k))) + box("mdat", bytes(rng.randrange(1, 90))) for k in range(150)),
        "short": b"abc", "nearly": box("ftyp", bytes(8)) + u32(1) + b"mdat" + b"\0\0", "none": b"", "past": box("ftyp") + u32(500) + b"free",
    }


def brute(contents):
    found, odd = [], []
    for video, data in contents.items():
        tree = boxes.parse(data)
        found += [(video, tree.by_ident[b.parent].start if b.parent is not None else None, b.type, b.start, b.header, b.size, b.depth, b.path, b.uuid) for b in tree.boxes]
        odd += [(video, path, offset, code, message) for path, offset, code, message in [*tree.anomalies, *boxes.stsd_overflow(data, tree)]]
    key = lambda r: tuple(map(str, r))
    return sorted(found, key=key), sorted(odd, key=key)


def seen(found, odd):
    key = lambda r: tuple(map(str, r))
    rows = found.select("video_id", "parent_start", "type", "start", "header", "size", "depth", "path", "uuid").collect()
    return sorted(((*r[:-1], bytes(r[-1]) if r[-1] is not None else None) for r in rows), key=key), sorted(map(tuple, odd.collect()), key=key)


@pytest.mark.parametrize("size", [100, 1000])
def test_ranges_give_the_boxes_of_whole_files(spark, size):
    made = containers()
    whole = spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in made.items()], "video_id string, length long, content binary")
    ranges = chains.cut(whole, size)
    assert ranges.groupBy("video_id").count().agg(F.max("count")).first()[0] >= 3
    assert seen(*chains.boxes_of_ranges(ranges, whole.select("video_id", "length"), size)) == brute(made)


def test_ranges_of_files_are_sought(spark, tmp_path):
    made = {k: v for k, v in containers().items() if v}
    for k, v in made.items():
        (tmp_path / f"{k}.mp4").write_bytes(v)
    found = files.listing(spark, str(tmp_path)).cache()
    ranges = files.range_contents(found, 100, chains.OVERLAP)
    fetch = lambda pieces: files.read_pieces(pieces.join(found.select("video_id", "path"), "video_id"))
    tops, odd = chains.boxes_of_ranges(ranges, found.select("video_id", "length"), 100, fetch)
    name = {r.video_id: r.path.rsplit("/", 1)[1].removesuffix(".mp4") for r in found.collect()}
    got = seen(tops, odd)
    renamed = [sorted([(name[r[0]], *r[1:]) for r in part], key=lambda r: tuple(map(str, r))) for part in got]
    assert tuple(renamed) == brute(made)


def test_cut_rows_do_not_carry_the_whole_content(spark):
    files = spark.createDataFrame([("a", bytes(range(200))), ("b", b""), ("c", None)], "video_id string, content binary")
    ranges = chains.cut(files, 64)
    got = {(r.video_id, r.offset): bytes(r.content) for r in ranges.collect()}
    assert got == {("a", k): bytes(range(200))[k : k + 64 + chains.OVERLAP] for k in range(0, 200, 64)}
    generate = next(line for line in ranges._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in line)
    assert "content" not in generate.rsplit("), [", 1)[1].split("]")[0]
