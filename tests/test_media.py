import numpy as np
import pytest

from quarry.functions import kernels
from quarry.operators import finders, media, sound, tiles


def test_components_by_contact():
    mask = np.zeros((8, 8), bool)
    mask[1:3, 1:3] = mask[3:5, 3:5] = mask[0, 7] = True
    assert [c[:4] for c in kernels.components(mask)] == [(1, 1, 4, 4), (7, 0, 1, 1)]
    assert len(kernels.components(mask, diagonal=False)) == 3


def finder(size=3):
    pattern = np.full((9, 9), 255)
    pattern[1:8, 1:8] = 0
    pattern[2:7, 2:7] = 255
    pattern[3:6, 3:6] = 0
    return np.kron(pattern, np.ones((size, size)))


def code():
    page = np.full((140, 140), 255.0)
    for y, x in ((5, 5), (5, 100), (100, 5)):
        page[y : y + 27, x : x + 27] = finder()
    return page.astype(np.uint8)


FRAMES = "video_id string, idx long, t double, w int, h int, pix binary"


def frames(spark, pictures):
    return spark.createDataFrame([(v, i, float(i), p.shape[1], p.shape[0], bytearray(p.tobytes())) for v, i, p in pictures], FRAMES)


@pytest.mark.parametrize("size", [29, 64, 256])
def test_finders_as_relations(spark, size):
    rng = np.random.default_rng(2)
    noisy = np.clip(code() + rng.normal(0, 12, (140, 140)), 0, 255).astype(np.uint8)
    pictures = [("v", 0, code()), ("v", 1, noisy), ("v", 2, 255 - code()), ("v", 3, rng.integers(0, 256, (90, 120)).astype(np.uint8)), ("v", 4, np.zeros((30, 30), np.uint8)), ("w", 0, np.rot90(code()).copy())]
    rows = frames(spark, pictures)
    masks = tiles.dark(tiles.cut(rows, size), size=size)
    for inverted in (False, True):
        got = sorted((r.video_id, r.idx, r.y, r.x, round(r.module, 6)) for r in finders.proven(finders.candidates(masks, inverted, size=size), masks, inverted, size).collect())
        assert got == sorted((v, i, y, x, round(m, 6)) for v, i, p in pictures for y, x, m in kernels.finder_points(kernels.binarised(p), inverted=inverted))
    found = finders.finder_frames(rows, size=size).collect()
    assert {(r.video_id, r.idx, r.patterns, r.triples) for r in found} == {("v", 0, 3, 1), ("v", 1, 3, 1), ("w", 0, 3, 1)}
    flashes = spark.createDataFrame([("v", 1)], "video_id string, idx long")
    videos = spark.createDataFrame([("v",), ("w",), ("x",)], "video_id string")
    graded = {(r.video_id, r.severity) for r in media.finder_findings(finders.finder_frames(rows, size=size), flashes, videos).collect()}
    assert graded == {("v", "HIGH"), ("w", "MED"), ("x", "INFO")}


def test_every_run_has_the_same_tolerance():
    line = np.repeat([0, 1, 0, 1, 0, 1, 0], [9, 4, 4, 12, 4, 4, 9]).astype(bool)
    assert len(kernels._patterns(line, 0.55, True)) == 1
    wide = np.repeat([0, 1, 0, 1, 0, 1, 0], [9, 4, 4, 18, 4, 4, 9]).astype(bool)  # the centre off by 0.7 modules
    assert kernels._patterns(wide, 0.55, True) == []


def test_the_strongest_patterns_are_kept():
    points = [(y, float(x), 4.0) for x in range(0, 390, 26) for y in range(0, 6, 3)] + [(y, 900.0, 4.0) for y in range(0, 9, 3)]
    kept = kernels.pattern_clusters(sorted(points))
    assert len(kept) == 12 and kept[0][0] == 900.0


def signals():
    t = np.arange(44100 * 2) / 44100
    rng = np.random.default_rng(4)
    return {"silence": np.zeros_like(t), "tone18k": np.sin(2 * np.pi * 18000 * t), "tone5k": np.sin(2 * np.pi * 5000 * t) + rng.normal(0, 0.01, len(t)), "noise": rng.normal(0, 0.3, 300_000), "short": np.zeros(100)}


def chunked(spark, made, n):
    rows = [(k, 44100, i, [float(v) for v in part]) for k, x in made.items() for i, part in enumerate(np.array_split(x.astype(np.float32), n))]
    return spark.createDataFrame(rows, "video_id string, sr int, chunk_no int, pcm array<float>").repartition(3)


@pytest.mark.parametrize("n", [1, 2, 57])
def test_spectra_do_not_depend_on_chunks(spark, n):
    made = signals()
    spectra = sound.audio_spectra(chunked(spark, made, n)).cache()
    for video, x in made.items():
        whole = kernels.spectrum(x.astype(np.float32).astype(float), 44100)
        rows = [r for r in spectra.collect() if r.video_id == video]
        assert [r.name for r in rows if r.kind == "error"] == ([whole["error"]] if whole["error"] else [])
        assert {r.name: round(r.share, 9) for r in rows if r.kind == "band"} == {k: round(v, 9) for k, v in whole["bands"].items()}
        assert [(r.hertz, round(r.share, 9), round(r.cv, 6)) for r in sorted((r for r in rows if r.kind == "tone"), key=lambda r: -r.share)] == [(h, round(s, 9), round(c, 6)) for h, s, c in whole["tones"]]
    graded = {(r.video_id, r.severity) for r in media.ultrasonic_findings(spectra).collect()}
    assert {("silence", "INFO"), ("tone18k", "HIGH"), ("tone5k", "MED")} <= graded


def test_long_sound_is_thinned_and_bounded(spark):
    x = signals()["noise"]
    chunks = sound.placed(chunked(spark, {"noise": x}, 9), most_seconds=None)
    for most, block in ((20, 4), (1500, 1000)):
        rows = {r.bin: r for r in sound.bin_sums(chunks, 64, 32, most, block).collect()}
        k = np.arange(0, f := 1 + (len(x) - 64) // 32, max(1, f // most))
        power = np.abs(np.fft.rfft(x.astype(np.float32)[k[:, None] * 32 + np.arange(64)] * np.hanning(64), axis=1)) ** 2
        assert {r.n for r in rows.values()} == {len(k)} and len(rows) == 33
        assert np.allclose([rows[b].s for b in range(33)], power.sum(0)) and np.allclose([rows[b].q for b in range(33)], (power**2).sum(0))
    first = sound.placed(chunked(spark, {"noise": x}, 9), most_seconds=2).collect()
    assert sum(len(r.pcm) for r in first) == 88200


def test_luma_and_entropy():
    red = np.zeros((2, 2, 3), np.uint8)
    red[..., 0] = 200
    luma, sat = kernels.luma_saturation(red)
    assert abs(luma - 59.8) < 1e-9 and sat == 1.0
    assert kernels.byte_entropy(bytes(range(256))) == 8.0 and kernels.byte_entropy(b"") == 0.0 and kernels.nonzero_ratio(b"\0\1") == 0.5
