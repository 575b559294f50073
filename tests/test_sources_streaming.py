import json

from pyspark.sql import functions as F

from quarry.operators.container_rules import scan
from quarry.functions import rules, scalar
from quarry.operators import text_rules
from quarry.sources import files
from quarry.streaming import arrivals


def test_targets_expand_once_and_in_order(spark):
    rows = [("/a/x.mp4", False, 1), ("/a/x.mp4", False, 5), ("/a/y_Repaired.mp4", False, 2), ("/a/notes.txt", False, 3), ("/b/notes.txt", True, 4)]
    got = files.targets(spark.createDataFrame(rows, "path string, explicit boolean, seq long")).orderBy("seq").collect()
    assert [(r.path, r.seq) for r in got] == [("/a/x.mp4", 1), ("/b/notes.txt", 4)]


def test_files_and_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mp4").write_bytes(bytes(range(100)))
    (tmp_path / "in" / "a_repaired.mp4").write_bytes(b"no")
    found = files.whole_files(spark, str(tmp_path / "in"))
    assert [(r.length, len(r.video_id)) for r in found.collect()] == [(100, 32)]
    assert [(r.offset, r.length) for r in files.byte_ranges(found, 40).orderBy("offset").collect()] == [(0, 40), (40, 40), (80, 20)]
    files.register_byte_ranges(spark)
    parts = spark.read.format("byte_ranges").option("path", str(tmp_path / "in" / "a.mp4")).option("size", 30).load().orderBy("offset").collect()
    assert b"".join(bytes(p.content) for p in parts) == bytes(range(100))


def test_probe_facts(spark):
    probe = {"format": {"duration": "10.0", "size": "1000000", "bit_rate": "800000"}, "streams": [{"index": 0, "codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "30000/1001", "color_transfer": "smpte2084"}, {"index": 1, "codec_type": "audio", "codec_name": "aac", "bit_rate": "128000"}]}
    rows = spark.createDataFrame([("v", json.dumps(probe)), ("bad", "{")], "video_id string, probe string")
    got = {r.video_id: r for r in files.media_facts(files.probes(rows)).collect()}
    assert got["v"].is_hdr and got["v"].acodec == "aac" and abs(got["v"].fps - 29.97) < 0.01 and got["bad"].vcodec is None


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.safe_name(F.lit("con")).alias("reserved"), scalar.safe_name(F.lit('a/b:c*? ')).alias("marks"), scalar.frame_rate(F.lit("1/0"), 30.0).alias("fallback"),
        scalar.scaled_height(F.lit(854), F.lit(1920), F.lit(1080)).alias("height"), scalar.same_length(F.lit("abcdef"), F.lit(3)).alias("long"),
        scalar.hexdump(F.lit(b"AB\x00"), F.lit(16)).alias("dump"), scalar.image_kind(F.unhex(F.lit("89504e470d0a1a0a00"))).alias("kind"), scalar.human_size(F.lit(1536)).alias("human"),
        scalar.sampling_width(F.lit(4000), F.lit(0.5625), F.lit(800)).alias("w"),
    ).first()
    assert (row.reserved, row.marks, row.fallback, row.height, row.long, row.kind, row.human) == ("_con", "a_b_c__", 30.0, 480, None, "png", "1.5 KB")
    assert row.dump.startswith("00000010  41 42 00") and row.dump.endswith("AB.") and row.w**2 * 0.5625 * 800 <= 350 * 1024 * 1024


def test_platform_ids_use_ascii_boundaries(spark):
    rows = spark.createDataFrame([("þvid:v0300fg1 中vid:v0300fg2 -vid:v0300fg3",)], "t string")
    assert rows.select(F.size(text_rules.matches(F.col("t"), "platform_id"))).first()[0] == 3
    hit = text_rules.rule_hits(spark.createDataFrame([(1, "user_id=abcdef12")], "k int, t string"), ["k"], "t", rules.fingerprints(spark)).first()
    assert (hit.code, hit.samples) == ("account_id", ["user_id=abcdef12"])


def test_arrivals_equal_batch(spark, tmp_path):
    from builders import box

    folder = tmp_path / "drop"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.mp4").write_bytes(box("ftyp", bytes(8)) + box("free", bytes([k]) * 100))
    stream = arrivals.arriving_files(spark, str(folder))
    held = []
    arrivals.scan_arrivals(stream, lambda batch: scan(batch, held=held), str(tmp_path / "out"), str(tmp_path / "state"), held).awaitTermination()
    assert not held
    key = ["rule_id", "severity", "title"]
    streamed = spark.read.parquet(str(tmp_path / "out")).groupBy(*key).count().collect()
    batch = scan(files.whole_files(spark, str(folder))).groupBy(*key).count().collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch))


def test_online_flashes(spark, tmp_path):
    y = [1.0] * 5 + [9.0] + [1.0] * 5 + [9.0] * 4
    for part in range(3):
        rows = [("s", i, v) for i, v in enumerate(y)][part * 5 : part * 5 + 5]
        spark.createDataFrame(rows, "key string, `order` long, y double").coalesce(1).write.mode("append").parquet(str(tmp_path / "series"))
    stream = spark.readStream.schema("key string, `order` long, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "series"))
    q = arrivals.online_flashes(stream, bar=5.0).writeStream.format("memory").queryName("flashes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.order, r.kind) for r in spark.table("flashes").collect()) == [(4, "flash"), (5, "cut"), (10, "cut")]


def test_windowed_counts(spark, tmp_path):
    from support import SF

    stream = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events.parq*").withColumn("ts", F.col("ts").cast("timestamp"))
    q = arrivals.windowed_counts(stream, "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_reports_are_written_and_read_again(spark, tmp_path):
    from builders import box

    rows = spark.createDataFrame([("a", "/in/a.mp4", bytearray(box("ftyp", bytes(8)) + box("free", b"\x07" * 90)))], "video_id string, path string, content binary")
    found = scan(rows.withColumn("length", F.octet_length("content").cast("long")))
    files.write_report(found, str(tmp_path / "report"), "json")
    again = files.prior_findings(spark, str(tmp_path / "report"))
    key = ["video_id", "rule_id", "severity", "title", "detail"]
    assert sorted(map(str, again.select(*key).collect())) == sorted(map(str, found.select(*key).collect())) != []
    assert files.prior_findings(spark, str(tmp_path / "nothing")).count() == 0


def test_tree_text_is_indented(spark):
    from builders import box

    from quarry.functions import boxes

    rows = spark.createDataFrame([("a", bytearray(box("moov", box("udta", box("free", b"")))))], "video_id string, content binary")
    lines = [r.line for r in boxes.tree_text(boxes.boxes(rows)).orderBy("start").collect()]
    assert lines == ["moov @0 24", "  udta @8 16", "    free @16 8"]
    assert boxes.tree_text(boxes.boxes(rows), 2).count() == 2
