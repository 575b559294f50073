import pytest
from pyspark.sql import functions as F

from quarry.operators import findings
from quarry.plans import patches, selection

PATCH = "video_id string, offset long, data binary, zero_len long, kind string, label string"


def test_preview_keeps_length_and_diffs_lie_in_the_plan(spark):
    content = bytes(range(256)) * 8
    files = spark.createDataFrame([("v", bytearray(content))], "video_id string, content binary")
    plan = spark.createDataFrame([("v", 10, bytearray(b"abc"), None, "k", "a"), ("v", 13, None, 20, "k", "b"), ("v", 2040, bytearray(b"12345678"), None, "k", "c")], PATCH)
    after = patches.preview(files, plan)
    raw = bytes(after.first().content)
    assert len(raw) == len(content) and raw[10:13] == b"abc" and raw[13:33] == bytes(20) and raw[-8:] == b"12345678"
    diffs = patches.byte_diff_runs(files, after)
    assert diffs.count() > 0 and patches.unplanned(diffs, plan).count() == 0
    assert patches.unplanned(diffs, plan.filter("offset <> 13")).count() > 0


@pytest.mark.parametrize("offset, fault", [(11, "overlap"), (98, "out_of_range"), (-1, "out_of_range")])
def test_faulty_plans_are_named_and_refused(spark, offset, fault):
    files = spark.createDataFrame([("v", bytearray(100))], "video_id string, content binary")
    plan = spark.createDataFrame([("v", 10, bytearray(b"abc"), None, "k", "a"), ("v", offset, bytearray(b"abc"), None, "k", "b")], PATCH)
    lengths = files.select("video_id", F.octet_length("content").cast("long").alias("length"))
    assert fault in {r.fault for r in patches.patch_faults(plan, lengths).collect()}
    with pytest.raises(ValueError):
        patches.preview(files, plan)


def test_metadata_and_sei_plans(spark):
    items = spark.createDataFrame([("v", "mdta", "k", "vid:v0300abcdef", 1, 50, 15), ("v", "itunes", "title", "x", 1, 90, 1)], "video_id string, source string, key string, value string, dtype int, value_offset long, value_len long")
    (row,) = patches.metadata_patches(items, "blank").collect()
    assert (row.offset, bytes(row.data)) == (50, b" " * 15)
    assert patches.metadata_patches(items, "keep").count() == 0
    units = spark.createDataFrame([("v", 0, 100, 30, 6)], "video_id string, sample_no long, offset long, size long, nal_type int")
    messages = spark.createDataFrame([("v", 0, 100, 5, 20, "ab", bytearray(b""))], "video_id string, sample_no long, offset long, type int, size int, uuid string, payload binary")
    (row,) = patches.sei_patches(messages, units, "user-data").collect()
    assert len(row.data) == 30 and bytes(row.data)[0] == 12
    assert patches.sei_patches(messages, units, "uuid:cd").count() == 0


def test_choice_takes_first_pass_then_least_size(spark):
    trials = [
        ("a", "x", 0, 0, 22, "vmaf", 94.0, 90.0, 10), ("a", "x", 0, 1, 20, "vmaf", 96.0, 90.0, 50), ("a", "x", 0, 2, 18, "vmaf", 97.0, 90.0, 5),
        ("a", "y", 1, 0, 20, "vmaf", 99.0, 80.0, 40), ("a", "z", 2, 0, 20, "ssim", 0.99, 0.0, 50), ("b", "x", 0, 0, 22, "vmaf", 99.0, 0.0, 95), ("c", "x", 0, 0, 22, "none", 99.0, 0.0, 1),
    ]
    frame = spark.createDataFrame(trials, "video_id string, encoder string, ladder_rank int, attempt int, crf int, metric string, mean double, p1 double, projected long")
    sizes = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "video_id string, size long")
    target = spark.createDataFrame([(95.0, 0.98)], "vmaf double, ssim double")
    got = {r.video_id: (r.action, r.reason, r.encoder, r.crf) for r in selection.choose(frame, sizes, target).collect()}
    assert got == {"a": ("slim", None, "x", 20), "b": ("skip", "saves_too_little", "x", 22), "c": ("skip", "nothing_passes", None, None)}


def test_comparison_states(spark):
    old = spark.createDataFrame([("HIGH", "t"), ("HIGH", "t"), ("LOW", "u")], "severity string, title string")
    new = spark.createDataFrame([("HIGH", "t"), ("MED", "w")], "severity string, title string")
    got = {(r.severity, r.title): (r.n_old, r.n_new, r.state) for r in findings.compare(old, new, ["severity", "title"]).collect()}
    assert got == {("HIGH", "t"): (2, 1, "still"), ("LOW", "u"): (1, 0, "gone"), ("MED", "w"): (0, 1, "added")}


def test_differences_go_on_some_values_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(patches, "_TOGETHER", 2)
    old = spark.createDataFrame([(k, "a" * (k + 1)) for k in range(7)], "k long, v string")
    new = spark.createDataFrame([(k, "a" * k + "b") for k in range(7)], "k long, v string")
    assert sorted((r.k, r.a, r.b, r.n) for r in patches.diff_runs(old, new, ["k"], "v").collect()) == [(k, k, k, 1) for k in range(7)]
