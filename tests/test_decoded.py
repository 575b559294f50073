import numpy as np
from builders import box, full, movie, sps_1080, stbl, u32

from quarry import surface
from quarry.functions import boxes
from quarry.operators import container_rules, decoded
from quarry.plans import patches

from test_containers import files
from test_media import FRAMES, code
from test_tiles import stacks


def container(k):
    table = stbl([10], [60], [(1, 1)])
    return movie(table, bytes(10)) + box("free", bytes([k]) * 90) + (box("moov", box("mvhd", b"..tenc..")) if k % 2 else b"") + (b"\0\0\0\x02tail" if k == 3 else b"")


def test_one_python_pass_over_contents(spark):
    rows = files(spark, **{f"v{k}": container(k) for k in range(4)})
    held = []
    found = container_rules.scan(rows, held=held)
    (stream,) = held  # every rule reads what this one pass leaves
    assert stream._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    whole = {(r.video_id, r.rule_id, r.severity, r.detail) for r in found.collect()}
    assert {("v1", "R3", "HIGH", "1"), ("v1", "R4", "MED", "2"), ("v3", "R9", "HIGH", "8")} <= whole and not any(v in ("v0", "v2") and rule in ("R3", "R4") for v, rule, _, _ in whole)
    held.pop().unpersist()
    stored = container_rules.scan(rows)
    plan = stored._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" not in plan and "Relation" in plan
    assert {(r.video_id, r.rule_id, r.severity, r.detail) for r in stored.collect()} == whole


def test_tables_equal_the_single_decoders(spark):
    rows = files(spark, **{f"v{k}": container(k) for k in range(4)})
    stream = decoded.tagged(rows, deep=True).cache()
    show = lambda df: sorted(map(str, df.collect()))
    assert show(decoded.table(stream, "samples")) == show(boxes.samples(rows))
    assert show(decoded.table(stream, "facts")) == show(container_rules.box_facts(rows))
    assert show(decoded.table(stream, "anomalies")) == show(boxes.anomalies(rows)) != []
    assert show(decoded.table(stream, "timing")) == show(container_rules.timing_rows(rows))
    assert decoded.table(stream, "media").count() == 4 and decoded.table(stream, "digests").count() == 4


def test_a_large_jpeg_is_valid():
    data = b"\xff\xd8\xff\xe0" + bytes(400_000) + b"\xff\xd9"
    assert ("jpeg", 0, True) in decoded.signatures(data) and ("jpeg", 0, False) in decoded.signatures(data[:-2])


def test_base64_has_its_own_rule(spark):
    from quarry.functions.rules import fingerprints

    items = spark.createDataFrame([("a", "k", "QWxhZGRpbjpvcGVuIHNlc2FtZQ+/QWxhZGRpbg==", 1, 0), ("b", "k", "0123456789abcdef0123456789abcdef", 1, 0), ("c", "k", None, 1, 0)], "video_id string, key string, value string, dtype int, value_offset long")
    got = {(r.video_id, r.rule_id) for r in container_rules.metadata_rules(items, fingerprints(spark)).collect()}
    assert {("a", "R16"), ("b", "R15")} <= got and not any(v == "c" for v, _ in got)


def test_unreferenced_bytes_feed_the_zero_plan(spark):
    head = len(movie(stbl([10, 10], [0, 0], [(1, 1)]), b""))
    data = movie(stbl([10, 10], [head + 4, head + 44], [(1, 1)]), bytes(100)) + box("free", bytes(20)) + b"\0\0\0\x03xyz."
    stream = decoded.tagged(files(spark, a=data)).cache()
    found = container_rules.unreferenced_bytes(*(decoded.table(stream, n) for n in ("digests", "facts", "samples")))
    end = head + 100
    want = {("padding", end + 8, end + 28), ("trailing", end + 28, end + 36), ("gap", head + 14, head + 44), ("gap", head + 54, head + 100)}
    assert {(r.kind, r.a, r.b) for r in found.collect()} == want
    plan = patches.zero_patches(found, "unreferenced")
    assert plan.count() == 4 and patches.patch_faults(plan, decoded.table(stream, "digests").select("video_id", "length")).count() == 0


def test_scan_with_pictures_and_sound(spark):
    rows = files(spark, v=movie(stbl([1], [1], [(1, 1)]), b"x"), w=movie(stbl([1], [1], [(1, 1)]), b"x"))
    pictures = [("v", k, code()) for k in range(2)] + [("w", k, p) for k, p in enumerate(stacks()["marked"])]
    frames = spark.createDataFrame([(v, i, float(i), p.shape[1], p.shape[0], bytearray(np.ascontiguousarray(p).tobytes())) for v, i, p in pictures], FRAMES)
    kinds = spark.createDataFrame([("v", 1, "flash")], "video_id string, idx long, kind string")
    t = np.arange(44100) / 44100
    audio = spark.createDataFrame([("w", 44100, 0, [float(x) for x in np.sin(2 * np.pi * 18000 * t)])], "video_id string, sr int, chunk_no int, pcm array<float>")
    got = {(r.video_id, r.rule_id, r.severity) for r in container_rules.scan(rows, kinds=kinds, frames=frames, audio=audio).collect()}
    assert {("v", "R31", "HIGH"), ("w", "R31", "INFO"), ("w", "R28", "HIGH"), ("v", "R28", "INFO"), ("w", "R27", "HIGH"), ("v", "R30", "HIGH")} <= got


def test_functions_in_sql(spark):
    surface.register(spark)
    files(spark, a=movie(stbl([5, 6], [100], [(1, 2)]), b"x"), bad=box("moov", full("stsz", u32(1)))).createOrReplaceTempView("contents")
    assert [(r.offset, r.size) for r in spark.sql("SELECT s.offset, s.size FROM contents c, LATERAL samples(c.content) s WHERE c.video_id = 'a' ORDER BY s.sample_no").collect()] == [(100, 5), (105, 6)]
    assert spark.sql("SELECT b.path FROM contents c, LATERAL boxes(c.content) b WHERE c.video_id = 'bad'").count() == 2
    row = spark.sql(f"SELECT byte_entropy(X'00FF') AS e, nonzero_ratio(X'0001') AS z, sps_info(X'{sps_1080().hex()}') AS s, byte_entropy(NULL) AS n").first()
    assert (row.e, row.z, row.s.width, row.s.height, row.n) == (1.0, 0.5, 1920, 1080, None)
