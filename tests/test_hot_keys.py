import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import intervals, joins, ordered, robust, series
from quarry.plans import patches

ROWS = "k string, at long, e long, y double, kind string"


def series_rows(spark):
    rng = random.Random(7)
    rows = []
    for k, n in (("hot", 600), ("small", 9), ("one", 1), (None, 40)):
        y = 0.0
        for e in range(n):
            y = rng.choice([y, y, y + rng.gauss(0, 1), rng.gauss(0, 30)])
            rows.append((k, rng.randrange(0, 300), e, None if rng.random() < 0.02 else y, rng.choice("aab")))
    return spark.createDataFrame(rows, ROWS).repartition(4)


def same(a, b):
    show = lambda df: sorted(str([None if v is None else round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(df.columns)).collect())
    assert show(a) == show(b)


@pytest.mark.parametrize("width", [1, 7, 50, 1000])
def test_series_do_not_depend_on_buckets(spark, width):
    df, keys, order = series_rows(spark), ["k"], ["at", "e"]
    bucket = F.floor(F.col("at") / width)
    wanted = {"b2": ("y", 2), "b1": ("kind", 1), "a1": ("y", -1), "a2": ("kind", -2)}
    same(ordered.shifted(df, keys, order, bucket, wanted), ordered.shifted(df, keys, order, None, wanted))
    same(ordered.numbered(df, keys, order, bucket), ordered.numbered(df, keys, order, None))
    same(series.steps(df, keys, order, "y", bucket), series.steps(df, keys, order, "y"))
    same(series.run_lengths(df, keys, order, "kind", bucket), series.run_lengths(df, keys, order, "kind"))
    same(joins.segments(df, keys, order, "e", bucket), joins.segments(df, keys, order, "e"))
    named = df.filter("k IS NOT NULL AND y IS NOT NULL")
    for mode in ("intended", "literal"):
        same(series.flashes(named, keys, order, "y", 1.0, mode=mode, bucket=bucket), series.flashes(named, keys, order, "y", 1.0, mode=mode))
    same(series.frozen(named, keys, order, "y", 0.5, 2, bucket), series.frozen(named, keys, order, "y", 0.5, 2))


def test_runs_across_buckets(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(k, p) for k in "ab" for p in range(400) if rng.random() < 0.8], "k string, p long")
    same(intervals.runs(rows, ["k"], "p", 13), intervals.runs(rows, ["k"], "p"))


@pytest.mark.parametrize("bins", [2, 16, 1024])
def test_percentiles_of_a_hot_key(spark, bins):
    rng = np.random.default_rng(3)
    made = {"hot": rng.normal(0, 1e6, 20_000), "ties": rng.integers(0, 5, 3000).astype(float), "wide": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, 1.0]), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "tiny": np.array([1.0, np.nextafter(1.0, 2), np.nextafter(np.nextafter(1.0, 2), 2)])}
    rows = [(k, float(v)) for k, x in made.items() for v in (x if bins > 2 else x[:500])] + [("hot", None), ("ties", math.nan), (None, 3.0)]
    shares = (0.0, 0.02, 0.2, 0.5, 0.97, 1.0)
    df = spark.createDataFrame(rows, "k string, y double").repartition(5)
    got = {r.k: r for r in robust.percentiles(df, ["k"], "y", shares, bins).collect()}
    want = {r.k: r for r in df.filter("NOT isnan(y)").groupBy("k").agg(F.count("y").alias("n"), *[F.percentile("y", s).alias(f"p{round(s * 100)}") for s in shares]).collect()}
    assert got.keys() == want.keys() == {*made, None}
    for k in want:
        assert got[k].n == want[k].n and [got[k][f"p{round(s * 100)}"] for s in shares] == pytest.approx([want[k][f"p{round(s * 100)}"] for s in shares], rel=1e-12)


def brute_diff(a, b):
    out, start = [], None
    for i in range(max(len(a), len(b)) + 1):
        unlike = i < max(len(a), len(b)) and (i >= min(len(a), len(b)) or a[i] != b[i])
        if unlike and start is None:
            start = i
        if not unlike and start is not None:
            out.append((start, i - 1, i - start))
            start = None
    return out


@pytest.mark.parametrize("block,whole", [(4, 0), (64, 100), (4096, 0), (4096, 1 << 20)])
def test_differences_by_blocks(spark, block, whole):
    rng = random.Random(block)
    pairs = []
    for k in range(40):
        a = "".join(rng.choice("abé語\U0001f600") for _ in range(rng.choice([0, 3, 64, 300])))
        b = "".join(c if rng.random() < rng.choice([0.3, 0.98]) else rng.choice("xyé") for c in a)
        pairs.append((k, a, b + ("tail" if k % 9 == 0 else "")))
    pairs += [(90, "x" * 200, "y" * 200), (91, "same" * 50, "same" * 50), (92, None, "a")]
    old, new = spark.createDataFrame([(k, a) for k, a, _ in pairs], "k long, v string"), spark.createDataFrame([(k, b) for k, _, b in pairs], "k long, v string")
    got = sorted((r.k, r.a, r.b, r.n) for r in patches.diff_runs(old, new, ["k"], "v", block, whole).collect())
    assert got == sorted((k, *run) for k, a, b in pairs if a is not None for run in brute_diff(a, b))
    binary = lambda df: df.filter("v IS NOT NULL").select("k", F.col("v").cast("binary").alias("v"))
    raw = sorted((r.k, r.a, r.b, r.n) for r in patches.diff_runs(binary(old), binary(new), ["k"], "v", block, whole).collect())
    assert raw == sorted((k, *run) for k, a, b in pairs if a is not None for run in brute_diff(a.encode(), b.encode()))


def test_powers_of_vectors_of_any_length(spark):
    from quarry.operators import spectrum

    rng = np.random.default_rng(6)
    vectors = [rng.normal(size=8).tolist(), rng.normal(size=5).tolist(), rng.normal(size=19).tolist(), [], None, [1.0, None, 2.0]]
    got = {r.k: r.power for r in spectrum.powers(spark.createDataFrame(list(enumerate(vectors)), "k int, v array<double>"), ["k"], "v", 8).collect()}
    for k, v in enumerate(vectors):
        if v is None or None in v:
            assert got[k] is None
        else:
            at = np.arange(len(v))
            assert np.allclose(got[k], [abs(sum(np.array(v) * np.exp(-2j * np.pi * b * at / 8))) ** 2 for b in range(5)])


def test_medians_hold_no_key_in_one_buffer(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 90.0), ("b", 5.0), ("c", None)], "k string, y double")
    found = robust.median_mad(rows, ["k"], "y")
    assert {(r.k, r.median, r.mad) for r in found.collect()} == {("a", 3.0, 1.5), ("b", 5.0, 0.0), ("c", None, None)}
    assert "percentile(" not in found._jdf.queryExecution().analyzed().toString()
    assert [r.y for r in robust.mad_outliers(rows, ["k"], "y").collect()] == [90.0]
