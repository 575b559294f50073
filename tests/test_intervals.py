import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import intervals


def brute(rows):
    out = []
    for a, b in sorted((a, b) for a, b in rows if b > 0 and b > a):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def frame(spark, keyed):
    return spark.createDataFrame([(k, a, b) for k, rows in keyed.items() for a, b in rows], "k string, a long, b long")


def test_union_with_and_without_buckets_is_brute_force(spark):
    rng = random.Random(7)
    keyed = {k: [(a, a + rng.choice([0, 1, 3, 9, 40])) for a in (rng.randrange(0, 600) for _ in range(80))] for k in "abc"}
    keyed["fixture"] = [(0, 10), (10, 20), (25, 30), (26, 28), (40, 41)]
    for width in (None, 16, 100):
        got = {k: [] for k in keyed}
        for r in intervals.union(frame(spark, keyed), ["k"], width=width).collect():
            got[r.k].append((r.a, r.b))
        assert {k: sorted(v) for k, v in got.items()} == {k: brute(v) for k, v in keyed.items()}


def test_complement_has_head_and_tail_and_uncovered_keys(spark):
    spans = spark.createDataFrame([("a", 0, 50), ("b", 5, 9)], "k string, lo long, hi long")
    found = intervals.complement(frame(spark, {"a": [(10, 20), (15, 30), (45, 60)]}), spans, ["k"]).collect()
    assert sorted((r.k, r.a, r.b) for r in found) == [("a", 0, 10), ("a", 30, 45), ("b", 5, 9)]


def test_gaps_of_fifteen_and_sixteen(spark):
    found = intervals.gaps(frame(spark, {"a": [(0, 10), (25, 30), (46, 50)]}), ["k"], least=16).collect()
    assert [(r.a, r.b, r.gap) for r in found] == [(30, 46, 16)]


def test_containment_needs_one_interval(spark):
    inner = frame(spark, {"a": [(1, 3), (4, 12), (9, 11), (30, 31)]})
    outer = frame(spark, {"a": [(0, 5), (5, 12), (20, 40)]})
    assert sorted((r.a, r.b) for r in intervals.not_contained(inner, outer, ["k"]).collect()) == [(4, 12)]
    assert sorted((r.a, r.b) for r in intervals.contained(inner, outer, ["k"]).collect()) == [(1, 3), (9, 11), (30, 31)]


def test_results_do_not_depend_on_buckets(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), a, a + rng.choice([1, 4, 30, 200])) for a in (rng.randrange(0, 2000) for _ in range(300))]
    few = [(k, a, a + rng.randrange(1, 60)) for k, a, _ in rows[::2]]
    df, inner = (spark.createDataFrame(x, "k string, a long, b long") for x in (rows, few))
    spans = spark.createDataFrame([("hot", -5, 2500), ("b", 100, 900)], "k string, lo long, hi long")
    for found in (
        lambda w: intervals.gaps(df, ["k"], width=w),
        lambda w: intervals.complement(df, spans, ["k"], width=w),
        lambda w: intervals.contained(inner, df, ["k"], width=w),
        lambda w: intervals.not_contained(inner, df, ["k"], width=w),
        lambda w: intervals.overlaps(df, ["k"], width=w),
    ):
        whole = found(None).select("*")
        expected = sorted(map(str, whole.collect()))
        assert expected
        for width in (16, 500):
            bucketed = found(width)
            assert bucketed.columns == whole.columns and sorted(map(str, bucketed.collect())) == expected


def test_a_hot_key_is_many_tasks(spark):
    df = spark.range(2000).select(F.lit("k").alias("k"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 15).alias("b"))
    late = intervals.overlaps(df, ["k"], width=100)
    spread = late.groupBy(F.spark_partition_id()).count()
    with_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert spread.count() > 1 and late.count() == 1999
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_aqe)


def test_runs(spark):
    rows = spark.createDataFrame([("a", p) for p in (1, 2, 3, 7, 9, 10)], "k string, p long")
    assert sorted((r.a, r.b, r.n) for r in intervals.runs(rows, ["k"], "p").collect()) == [(1, 3, 3), (7, 7, 1), (9, 10, 2)]


def test_empty(spark):
    empty = spark.createDataFrame([], "k string, a long, b long")
    assert intervals.union(empty, ["k"], width=10).count() == intervals.gaps(empty, ["k"]).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=20))
def test_brute_force_itself_covers_the_same_points(rows):
    points = {p for a, b in rows if b > 0 for p in range(a, b)}
    assert points == {p for a, b in brute(rows) for p in range(a, b)}
