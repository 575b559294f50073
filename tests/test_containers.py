import struct

from builders import box, full, movie, sei_unit, sps_1080, stbl, trak, u32

from pyspark.sql import functions as F

from quarry.functions import bitstream, boxes
from quarry.operators import container_rules


def files(spark, **contents):
    rows = [(k, f"/in/{k}.mp4", len(v), bytearray(v)) for k, v in contents.items()]
    return spark.createDataFrame(rows, "video_id string, path string, length long, content binary")


def test_minimal_places():
    data = box("ftyp", bytes(8)) + box("free", bytes(16)) + box("mdat", bytes(32))
    assert [(b.type, b.start, b.size) for b in boxes.parse(data).boxes] == [("ftyp", 0, 16), ("free", 16, 24), ("mdat", 40, 40)]


def test_sizes_one_and_zero_and_uuid():
    wide = struct.pack(">I4sQ", 1, b"mdat", 24) + bytes(8)
    tree = boxes.parse(wide + box("uuid", bytes(range(16)), b"xy") + struct.pack(">I4s", 0, b"mdat") + bytes(5))
    assert [(b.header, b.size) for b in tree.boxes] == [(16, 24), (24, 26), (8, 13)]
    assert tree.boxes[1].uuid == bytes(range(16)) and [a[2] for a in tree.anomalies] == ["size_zero"]


def test_bad_size_stops_the_level_only():
    inner = box("moov", box("trak") + u32(3) + b"junk") + box("mdat", b"x")
    tree = boxes.parse(inner)
    assert [b.type for b in tree.boxes] == ["moov", "trak", "mdat"] and tree.anomalies[0][2] == "bad_size"


def test_depth_limit():
    data = b""
    for _ in range(16):
        data = box("moov", data)
    assert max(b.depth for b in boxes.parse(data).boxes) == boxes.MOST_DEPTH


def test_meta_with_and_without_version():
    hdlr = full("hdlr", bytes(20))
    for data in (box("meta", bytes(4), hdlr), box("meta", hdlr)):
        assert [b.type for b in boxes.parse(data).boxes] == ["meta", "hdlr"]


def table_of(data):
    tree = boxes.parse(data)
    return boxes.sample_table(data, tree, next(b for b in tree.boxes if b.type == "stbl"))


def test_sample_tables():
    sizes, chunks, runs = [5, 6, 7, 8, 9], [100, 200, 300], [(1, 2), (3, 1)]
    expected = [(100, 5), (105, 6), (200, 7), (207, 8), (300, 9)]
    for wide in (False, True):
        assert table_of(movie(stbl(sizes, chunks, runs, wide), b""))[0] == expected
    fixed = box("stbl", full("stsz", u32(4, 3)), full("stsc", u32(1, 1, 3, 1)), full("stco", u32(1, 50)))
    assert table_of(movie(fixed, b""))[0] == [(50, 4), (54, 4), (58, 4)]
    for width, raw in ((4, bytes([0x12, 0x30])), (8, bytes([1, 2, 3])), (16, struct.pack(">3H", 1, 2, 3))):
        small = box("stbl", full("stz2", bytes(3), bytes([width]), u32(3), raw), full("stsc", u32(1, 1, 3, 1)), full("stco", u32(1, 50)))
        assert table_of(movie(small, b""))[0] == [(50, 1), (51, 2), (53, 3)]


def test_unreachable_samples_are_counted():
    found, told = table_of(movie(stbl([1, 2, 3], [10], [(1, 2)]), b""))
    assert len(found) == 2 and told["unreachable_samples"] == 1


def test_metadata_layouts():
    data_box = lambda kind, payload: box("data", u32(kind, 0), payload)
    mdta = box("meta", bytes(4), full("hdlr", bytes(20)), full("keys", u32(1), box("mdta", b"com.x")), box("ilst", box(u32(1), data_box(1, b"value"))))
    tree = boxes.parse(mdta)
    (found,) = boxes.metadata(mdta, tree)
    assert found[:4] == ("mdta", "com.x", "value", 1) and mdta[found[4] : found[4] + found[5]] == b"value"
    itunes = box("meta", bytes(4), full("hdlr", bytes(20)), box("ilst", box("\xa9too", data_box(1, b"enc")), box("covr", data_box(14, b"\x89PNG")), box("----", box("mean", bytes(4), b"m"), box("name", bytes(4), b"n"), data_box(21, u32(7)))))
    assert [(f[0], f[1], f[2]) for f in boxes.metadata(itunes, boxes.parse(itunes))] == [("itunes", "\xa9too", "enc"), ("itunes", "covr", "<png 4B>"), ("freeform", "m:n", "<int 7>")]
    legacy = box("udta", box("\xa9nam", struct.pack(">HH", 4, 0), b"Name"))
    assert [(f[0], f[2]) for f in boxes.metadata(legacy, boxes.parse(legacy))] == [("legacy", "Name")]


def test_sps_and_sei():
    found = bitstream.sps(sps_1080())
    assert (found["width"], found["height"], found["profile_idc"]) == (1920, 1080, 77)
    assert bitstream.sps(b"\x67\x4d") is None
    uuid = bytes(range(16))
    messages = bitstream.sei_messages(sei_unit((5, uuid + b"hello"), (1, b"abc"), (4, uuid + bytes(300))))
    assert [(k, n, u) for k, n, u, _ in messages] == [(5, 21, uuid.hex()), (1, 3, None), (4, 316, uuid.hex())]


def avc_file():
    unit = sei_unit((5, bytes(range(16)) + b"tag"))
    sample = u32(len(unit)) + unit + u32(3) + b"\x65ab"
    sps = sps_1080()
    avcc = box("avcC", bytes([1, 77, 0, 40, 0xFF, 0xE1]), struct.pack(">H", len(sps)), sps, bytes([0]))
    entry = box("avc1", bytes(78), avcc)
    make = lambda at: movie(stbl([len(sample)], [at], [(1, 1)], extra=full("stsd", u32(1), entry)), sample)
    return make(len(make(0)) - len(sample))


def test_nal_units_of_a_file(spark):
    found = files(spark, v=avc_file())
    assert [(r.nal_type, r.n) for r in bitstream.nal_histogram(bitstream.nals(found)).orderBy("nal_type").collect()] == [(5, 1), (6, 1)]
    assert [r.type for r in bitstream.sei(found).collect()] == [5]
    assert bitstream.sequence_parameters(found).first().height == 1080


def test_rules_on_files(spark):
    media = bytes(range(1, 101))
    head = len(movie(stbl([10], [0], [(1, 1)]), b""))
    contents = {
        "gap": movie(stbl([10, 10], [head + 4, head + 4 + 70], [(1, 1)]), media),
        "outside": movie(stbl([4], [0], [(1, 1)]), b""),
        "padded": movie(stbl([10], [head], [(1, 1)]), bytes(10)) + box("free", b"\x07" * 128),
        "tail": movie(stbl([10], [head], [(1, 1)]), bytes(10)) + b"\0\0\0\x02" + b"z" * 46,
        "zip": movie(stbl([10], [head], [(1, 1)]), bytes(10)) + box("free", b"PK\x03\x04" + struct.pack("<HHH", 20, 0, 8) + bytes(40)),
        "url": movie(stbl([10], [head], [(1, 1)]), bytes(10)) + box("udta", b"see https://a.example.com/x?y=1 now"),
        "edits": movie(stbl([10], [head], [(1, 1)]), bytes(10), "vide", box("edts", full("elst", u32(1, 0, 0, 0)))),
        "empty": b"",
    }
    found = {(r.video_id, r.rule_id, r.severity) for r in container_rules.scan(files(spark, **contents)).collect()}
    assert {("gap", "R10", "LOW"), ("outside", "R12", "HIGH"), ("padded", "R8", "HIGH"), ("tail", "R9", "HIGH"), ("tail", "R7", "MED"), ("zip", "R23", "MED"), ("url", "R22", "MED"), ("edits", "R26", "LOW")} <= found
    assert ("gap", "R23", "INFO") in found and not any(v == "url" and rule == "R8" for v, rule, _ in found)


def test_signatures_are_validated_by_code():
    png = b"\x89PNG\r\n\x1a\n" + u32(13) + b"IHDR"
    elf = b"\x7fELF\x02\x01"
    found = container_rules.signatures(b"xx" + png + b"yy" + b"\x7fELF\x09\x09" + elf)
    assert [(c, ok) for c, _, ok in found] == [("png", True), ("elf", False), ("elf", True)]


def test_no_video_track_is_no_error(spark):
    found = files(spark, a=movie(stbl([1], [1], [(1, 1)]), b"x", "soun"), b=box("moov", trak("vide", b"")))
    assert bitstream.sei(found).count() == 0
    assert {r.error for r in boxes.track_info(found).collect()} == {None, "no sample table"}


def test_a_broken_table_is_a_low_finding_and_the_scan_goes_on(spark):
    broken = box("stbl", box("stsz", b"\0\0"), full("stsc", u32(1, 1, 1, 1)), full("stco", u32(1, 50)))
    contents = {"broken": movie(broken, b"x") + box("free", b"\x07" * 128), "fine": movie(stbl([1], [1], [(1, 1)]), b"x")}
    found = {(r.video_id, r.rule_id, r.severity) for r in container_rules.scan(files(spark, **contents)).collect()}
    assert ("broken", "R32", "LOW") in found and ("broken", "R8", "HIGH") in found
    assert not any(v == "fine" and rule == "R32" for v, rule, _ in found)


def test_summary_of_a_video(spark):
    from quarry.operators.findings import video_summary

    found = container_rules.scan(files(spark, a=movie(stbl([1], [1], [(1, 1)]), b"x") + box("free", b"\x07" * 128)))
    (row,) = video_summary(found).collect()
    assert row.gravest == "HIGH" and row.high >= 1 and row.titles[0] in ("data in padding free", "samples outside media boxes")


def test_sqlite_of_any_page_size():
    head = b"SQLite format 3\x00"
    for size, good in ((b"\x00\x01", True), (b"\x01\x00", True), (b"\x10\x00", True), (b"\x00\x03", False)):
        found = [s for s in container_rules.signatures(b"xx" + head + size + bytes(100)) if s[0] == "sqlite"]
        assert found == [("sqlite", 2, good)]


def test_many_rows_of_many_files(spark):
    from quarry.functions import boxes

    files = spark.createDataFrame([(str(k), k) for k in range(60)], "video_id string, n int").selectExpr("video_id", "CAST(repeat('ab', n) AS BINARY) AS content").repartition(2)
    rows = boxes.per_file(files, lambda v, d: ((v, i, d[i : i + 1], [i]) for i in range(len(d) * 100)), "video_id string, i long, c binary, l array<int>")
    assert rows.count() == 100 * sum(2 * k for k in range(60))


def test_scan_with_a_probe_flashes_and_media_bytes(spark):
    import json

    from quarry.sources import files as source

    table = stbl([10], [100], [(1, 1)], extra=full("stts", u32(1, 1, 512)))
    found = files(spark, a=movie(table, b"user_id=abcdef12 "), b=movie(table, b"x"))
    streams = [
        {"index": 0, "codec_type": "video", "width": 640, "height": 360, "nb_frames": "5", "disposition": {"attached_pic": 1}},
        {"index": 1, "codec_type": "data"},
    ]
    probe = source.probes(spark.createDataFrame([("a", json.dumps({"format": {}, "streams": streams, "chapters": [{"id": 1}]})), ("b", "not json")], "video_id string, probe string"))
    kinds = spark.createDataFrame([("a", "flash"), ("a", "cut")], "video_id string, kind string")
    held = []
    rows = {(r.video_id, r.rule_id, r.severity, r.detail) for r in container_rules.scan(found, probe, kinds, deep=True, held=held).collect()}
    assert {("a", "R18", "HIGH", "1"), ("a", "R19", "MED", "0"), ("a", "R19", "LOW", "1"), ("a", "R25", "MED", "5 1"), ("a", "R30", "HIGH", "1"), ("b", "R30", "INFO", "0")} <= rows
    assert not any(v == "b" and rule in ("R18", "R19", "R25") for v, rule, _, _ in rows)
    plain = {(r.video_id, r.rule_id, r.severity, r.detail) for r in container_rules.scan(found).collect()}
    assert plain < rows and all(rule in ("R18", "R19", "R24", "R25", "R30") for _, rule, _, _ in rows - plain)
    assert held and all(t.is_cached for t in held)
    for t in held:
        t.unpersist()


def test_what_a_file_keeps_goes_with_its_rows(spark):
    from builders import movie, stbl

    rows = files(spark, a=movie(stbl([10, 20], [60], [(1, 2)]), bytes(40))).withColumn("base", F.lit(60).cast("long"))
    found = boxes.samples(rows, kept=("base",))
    assert [(r.sample_no, r.size, r.base) for r in found.orderBy("sample_no").collect()] == [(0, 10, 60), (1, 20, 60)]
    assert found._jdf.queryExecution().analyzed().toString().count("Join") == 0


def test_movies_are_made_without_pandas(spark):
    from quarry import queries

    plan = queries.QUERIES["sei_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "MapInPandas" not in plan and "MapInArrow" in plan
    plan = queries.QUERIES["sample_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan


def test_runs_of_samples_cover_as_their_samples(spark):
    from quarry.operators import container_rules

    table = [stbl([10, 20, 0, 7], [60], [(1, 4)]), stbl([10, 500], [60, 70], [(1, 1)]), stbl([5, 5, 5], [10, 63, 68], [(1, 1)]), stbl([8] * 40, [56], [(1, 40)])]
    rows = files(spark, **{f"v{k}": movie(t, bytes(90)) for k, t in enumerate(table)})
    rows = rows.withColumn("length", F.octet_length("content").cast("long"))
    facts, runs = container_rules.box_facts(rows), boxes.sample_runs(rows)
    assert runs.count() < boxes.samples(rows).count()
    shown = lambda samples: sorted(map(str, container_rules.coverage(rows, facts, samples).collect()))
    got = shown(runs)
    assert got == shown(boxes.samples(rows)) and {"R11", "R12"} <= {r for r in ("R10", "R11", "R12") if any(f"'{r}'" in x for x in got)}


def test_rows_with_long_lists_go_on_early():
    rows = iter([("a", [0] * 3000)] * 5)
    assert [len(list(boxes._some(rows, [1]))) for _ in range(3)] == [2, 2, 1]
