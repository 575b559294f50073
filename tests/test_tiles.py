import numpy as np
import pyarrow as pa
import pytest

from quarry.functions import kernels
from quarry.operators import media, tiles

FRAMES = "video_id string, idx long, t double, w int, h int, pix binary"


def frames(spark, **stacks):
    rows = [(v, i, float(i), f.shape[1], f.shape[0], bytearray(np.ascontiguousarray(f).tobytes())) for v, stack in stacks.items() for i, f in enumerate(stack)]
    return spark.createDataFrame(rows, FRAMES).repartition(3)


@pytest.mark.parametrize("size", [7, 16, 64])
@pytest.mark.parametrize("diagonal", [True, False])
def test_components_across_tiles(spark, size, diagonal):
    rng = np.random.default_rng(size)
    masks = {f"p{share}": [(rng.random((45, 61)) < share).astype(np.uint8)] for share in (0.02, 0.35, 0.45, 0.6)}
    masks["snake"] = [np.kron(np.array([[1, 1, 1], [0, 0, 1], [1, 1, 1], [1, 0, 0], [1, 1, 1]], np.uint8), np.ones((9, 20), np.uint8))]
    masks["corner"] = [np.eye(40, dtype=np.uint8)]
    masks["empty"] = [np.zeros((5, 5), np.uint8)]
    found = {v: sorted((r.x, r.y, r.w, r.h, r.n) for r in rows) for v, rows in group(tiles.components(tiles.cut(frames(spark, **masks), size), size, diagonal).collect()).items()}
    assert found == {v: sorted(kernels.components(m[0], diagonal)) for v, m in masks.items() if m[0].any()}


def group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.video_id, []).append(r)
    return out


@pytest.mark.parametrize("size", [13, 20, 64])
def test_local_means_at_tile_borders(spark, size):
    rng = np.random.default_rng(size)
    pictures = {f"{h}x{w}": [rng.integers(0, 256, (h, w)).astype(np.uint8)] for h, w in ((40, 53), (14, 14), (27, 90), (5, 40), (41, 13))}
    got = tiles.dark(tiles.cut(frames(spark, **pictures), size), size=size).collect()
    for v, (picture,) in pictures.items():
        whole = np.zeros(picture.shape, bool)
        for r in (r for r in got if r.video_id == v):
            whole[r.ty * size : r.ty * size + r.th, r.tx * size : r.tx * size + r.tw] = np.frombuffer(r.pix, np.uint8).reshape(r.th, r.tw)
        assert (whole == kernels.binarised(picture)).all(), v


def stacks():
    rng = np.random.default_rng(1)
    block = np.kron(np.indices((7, 12)).sum(0) % 2 * 180 + rng.integers(0, 60, (7, 12)), np.ones((4, 4))).astype(np.uint8)
    marked = rng.integers(0, 256, (21, 110, 130)).astype(np.uint8)
    marked[:, 60:88, 50:98] = block
    flat = np.full((9, 40, 40), 7, np.uint8)
    return {"marked": marked, "noise": rng.integers(0, 256, (12, 60, 70)).astype(np.uint8), "flat": flat, "few": marked[:7]}


def brute_overlay(stack, stride=2):
    """The rule in one piece, over a whole stack."""
    if len(stack) < 8:
        return []
    work = stack[:, ::stride, ::stride].astype(float)
    median = np.median(work, axis=0)
    mad = np.median(np.abs(work - median), axis=0)
    grad = np.hypot(*np.gradient(median))
    mask = (mad < max(1.2, np.percentile(mad, 20))) & (grad > max(1.5, np.percentile(grad, 97)))
    k, out = max(1, 3 // stride), np.zeros(np.add(mask.shape, 2 * max(1, 3 // stride)), bool)
    for dy in range(2 * k + 1):
        for dx in range(2 * k + 1):
            out[dy : dy + mask.shape[0], dx : dx + mask.shape[1]] |= mask
    wide = out[k:-k, k:-k]
    found = []
    for x, y, w, h, n in [c for c in kernels.components(wide, diagonal=False) if c[4] >= int(0.0008 * wide.size)][:12]:
        steep = grad[y : y + h, x : x + w].mean()
        if 0.02 < n / (w * h) < 0.95 and steep > 2.0 and w > 8 and h > 6:
            sx, sy = stack.shape[2] / wide.shape[1], stack.shape[1] / wide.shape[0]
            found.append((int(x * sx), int(y * sy), max(1, round(w * sx)), max(1, round(h * sy)), round(float(steep), 3), round(n / (w * h), 4)))
    return sorted(found)


@pytest.mark.parametrize("size,together", [(17, 4), (64, 64)])
def test_overlay_without_a_stack(spark, size, together, monkeypatch):
    monkeypatch.setattr(tiles, "TOGETHER", together)
    made = stacks()
    rows = tiles.overlay_regions(frames(spark, **made), size)
    got = {v: sorted((r.x, r.y, r.w, r.h, r.grad, r.fill) for r in found) for v, found in group(rows.collect()).items()}
    want = {v: found for v, stack in made.items() if (found := brute_overlay(stack))}
    assert list(want) == ["marked"] and got.keys() == want.keys()
    for a, b in zip(got["marked"], want["marked"]):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 2e-3 and abs(a[5] - b[5]) < 2e-4
    graded = {(r.video_id, r.severity) for r in media.overlay_findings(rows, frames(spark, **made).select("video_id").distinct()).collect()}
    assert graded == {("marked", "HIGH"), ("noise", "INFO"), ("flat", "INFO"), ("few", "INFO")}


@pytest.mark.parametrize("held", [500, 1 << 27])
def test_pixel_stats_are_exact(spark, monkeypatch, held):
    monkeypatch.setattr(tiles, "PARTS", 2)
    monkeypatch.setattr(tiles, "TOGETHER", 3)
    monkeypatch.setattr(tiles, "HELD", held)
    rng = np.random.default_rng(3)
    made = {"odd": rng.integers(0, 256, (25, 20, 30)).astype(np.uint8), "even": rng.integers(0, 4, (40, 20, 30)).astype(np.uint8), "one": rng.integers(0, 256, (1, 5, 5)).astype(np.uint8)}
    for r in tiles.pixel_stats(tiles.cut(frames(spark, **made), 16)).collect():
        part = made[r.video_id][:, r.ty * 16 : r.ty * 16 + r.th, r.tx * 16 : r.tx * 16 + r.tw].astype(float)
        median = np.median(part, axis=0)
        assert (np.frombuffer(r.median, np.float32).reshape(r.th, r.tw) == median).all()
        assert (np.frombuffer(r.mad, np.float32).reshape(r.th, r.tw) == np.median(np.abs(part - median), axis=0)).all()


def test_noise_has_no_region_by_chance(spark, tmp_path):
    from quarry import queries

    spark.createDataFrame([(3984,), (3985,), (10955,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {(r.video_id, r.severity, r.detail) for r in queries.queries()["overlay_findings"](spark, str(tmp_path)).collect()}
    assert got == {("3984", "HIGH", "1"), ("3985", "INFO", "0"), ("10955", "INFO", "0")}


def test_groups_come_whole_and_in_few_batches(spark):
    rows = ((k, bytes(1 << 20)) for k in range(9))
    schema = pa.schema([("k", pa.int64()), ("b", pa.binary())])
    made = [b.num_rows for b in tiles._batches(rows, schema)]
    assert made == [4, 4, 1]
    some = spark.range(5000).selectExpr("id % 7 AS k", "id")
    counts = tiles.each_group(some, ["k"], lambda rows: ((r["k"], 1 + sum(1 for _ in rows)) for r in rows), "k long, n long")
    assert {(r.k, r.n) for r in counts.collect()} == {(k, len(range(k, 5000, 7))) for k in range(7)}


def test_only_asked_columns_are_cut_into_runs(spark):
    from quarry.operators import finders

    masks = tiles.cut(frames(spark, v=[np.eye(20, dtype=np.uint8)]), 8)
    asked = spark.createDataFrame([("v", 0, 3)], "video_id string, idx long, line int")
    found = finders.runs(masks, down=True, size=8, asked=asked).collect()
    assert sorted((r.line, r.start, r.n, r.dark) for r in found) == [(3, 0, 3, False), (3, 3, 1, True), (3, 4, 16, False)]
