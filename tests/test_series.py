import random

from quarry.operators import joins, robust, series


def frame(spark, y):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "k string, i0 long, y double")


def kinds(spark, y, **options):
    return [(r.i, r.kind) for r in series.flashes(frame(spark, y), ["k"], ["i0"], "y", **options).orderBy("i").collect()]


def test_lone_spike_is_a_flash_only_as_intended(spark):
    y = [1.0] * 200 + [9.0] + [1.0] * 199
    assert kinds(spark, y) == [(199, "flash"), (200, "cut")]
    assert kinds(spark, y, mode="literal") == [(199, "cut"), (200, "cut")]


def test_alternation_fires_literally(spark):
    y = [1.0] * 100 + [9.0, 1.0, 9.0] + [1.0] * 100
    assert ("flash") in {k for _, k in kinds(spark, y, mode="literal", k=5.0)}


def test_step_is_a_cut_and_constant_is_silent(spark):
    assert kinds(spark, [1.0] * 100 + [9.0] * 100) == [(99, "cut")]
    assert kinds(spark, [1.0] * 100) == []


def test_six_sigma_needs_a_long_series(spark):
    assert kinds(spark, [1.0] * 37 + [9.0] + [1.0] * 36) == []


def test_frozen_needs_sixteen_steps(spark):
    moving = [float(k % 2) for k in range(10)]
    assert series.frozen(frame(spark, moving + [5.0] * 16 + moving), ["k"], ["i0"], "y").count() == 0
    assert [(r.a, r.b) for r in series.frozen(frame(spark, moving + [5.0] * 17 + moving), ["k"], ["i0"], "y").collect()] == [(10, 25)]


def test_low_pick_is_not_interpolated(spark):
    assert robust.low_pick(frame(spark, range(1, 351)), ["k"], "y").first().low == 3.0
    assert robust.low_pick(frame(spark, [4.0, 2.0]), ["k"], "y").first().low == 2.0


def test_flash_comes_back_within_the_larger_of_two_steps(spark):
    y = [1.0] * 200 + [9.0, 4.4] + [4.4] * 199  # back within 3.4 of 8, over a quarter of it
    assert kinds(spark, y, k=3.0)[0] == (199, "flash")
    y = [1.0] * 200 + [9.0, 4.7] + [4.7] * 199
    assert kinds(spark, y, k=3.0)[0] == (199, "cut")
    assert "flash" in {k for _, k in kinds(spark, [1.0] * 100 + [9.0, 2.0, 9.0] + [1.0] * 100, mode="literal", k=5.0)}


def test_asof_keeps_long_offsets(spark):

    far = 2**53
    left = spark.createDataFrame([("a", far), ("a", far + 1)], "k string, at long")
    right = spark.createDataFrame([("a", far, 1), ("a", far + 1, 2)], "k string, start long, seg int")
    assert {r.at: r.seg for r in joins.asof(left, right, ["k"], "at", "start", ["seg"]).collect()} == {far: 1, far + 1: 2}


def test_asof_does_not_depend_on_buckets(spark):
    rng = random.Random(5)
    left = spark.createDataFrame([(rng.choice(["hot", "hot", "b", None]), rng.randrange(0, 1000)) for _ in range(200)], "k string, at long")
    right = spark.createDataFrame([(k, s, n if n % 7 else None) for k in ("hot", "b", None) for n, s in enumerate(rng.sample(range(50, 1000), 12))], "k string, start long, seg int")
    rows = lambda w: sorted(map(str, joins.asof(left, right, ["k"], "at", "start", ["seg"], width=w).collect()))
    assert len(rows(None)) == 200 and rows(None) == rows(7) == rows(300)


def test_harmonic_mean_of_values_with_a_zero_is_zero(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 4.0), ("b", 2.0), ("b", 6.0), ("c", None)], "k string, y double")
    got = {r.k: r.m for r in rows.groupBy("k").agg(robust.harmonic_mean("y").alias("m")).collect()}
    assert got == {"a": 0.0, "b": 3.0, "c": None}
