"""Spectra of sound that comes in chunks: no video's samples meet in one place.

Chunks are cut into blocks of ``BLOCK`` hops by their place in the video; a block also takes
the samples after it that its last frames reach into, so it can be worked out alone.  It
gives n, the sum and the sum of squares of each bin's power, which add up over blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.storage import stored

# Frame length, hop, most frames, and what makes a bin a lasting tone.
SIZE, HOP, MOST, SECONDS = 4096, 2048, 1500, 180
LOWEST, STEADY, LEAST_SHARE, TONES = 3000, 0.35, 1e-5, 10
BLOCK = 64


def placed(audio: DataFrame, most_seconds: float | None = SECONDS) -> DataFrame:
    """Chunks with ``at``, their first sample's place, and ``total``, the video's samples; later ones than ``most_seconds`` are left out."""
    n = F.size("pcm").cast("long")
    sizes = audio.select("video_id", "chunk_no", "sr", n.alias("n"))
    before = Window.partitionBy("video_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    sizes = sizes.select("video_id", "chunk_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), F.sum("n").over(Window.partitionBy("video_id")).alias("total"), F.max("sr").over(Window.partitionBy("video_id")).alias("rate"))
    limit = F.least(F.col("total"), F.floor(F.col("rate") * most_seconds)) if most_seconds is not None else F.col("total")
    sizes = sizes.withColumn("total", limit).filter("at < total")
    joined = audio.select("video_id", "chunk_no", "pcm").join(sizes, ["video_id", "chunk_no"])
    return joined.withColumn("pcm", F.when(F.col("at") + F.size("pcm") > F.col("total"), F.slice("pcm", 1, (F.col("total") - F.col("at")).cast("int"))).otherwise(F.col("pcm")))


def bin_sums(chunks: DataFrame, size: int = SIZE, hop: int = HOP, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``video_id, rate, bin, n, s, q``: frames, and sums of power and of its square, a row a bin.

    ``chunks`` as ``placed`` gives them.  At most about ``most`` frames of a video take part,
    every so-manieth from the first; videos under two frame lengths have no rows.
    """
    length = block * hop
    frames = 1 + F.floor((F.col("total") - size) / hop)
    rows = chunks.filter(F.col("total") >= 2 * size).withColumns({"frames": frames, "step": F.greatest(F.lit(1).cast("long"), F.floor(frames / most))})
    end = F.col("at") + F.size("pcm")
    # blocks that hold frames which reach into this chunk
    touched = rows.filter(F.size("pcm") > 0).withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("at") - size + 1) / length)), F.floor((end - 1) / length))))
    first = F.greatest(F.col("at"), F.col("block") * length)
    last = F.least(end, (F.col("block") + 1) * length + size)
    parts = touched.select("video_id", "rate", "frames", "step", "block", first.alias("from"), F.slice("pcm", (first - F.col("at") + 1).cast("int"), F.greatest(F.lit(0), (last - first).cast("int"))).alias("pcm"))
    window = np.hanning(size)

    def sums(key: tuple, rows: pa.Table) -> pa.Table:
        start, count, step = key[1].as_py() * length, rows["frames"][0].as_py(), rows["step"][0].as_py()
        data = np.zeros(length + size)
        for at, pcm in zip(rows["from"].to_pylist(), rows["pcm"]):
            values = pcm.values.to_numpy(zero_copy_only=False)
            data[at - start : at - start + len(values)] = values
        k = np.arange(-(-start // hop), min(count, (start + length) // hop))
        k = k[k % step == 0]
        s = q = np.zeros(size // 2 + 1)
        for a in range(0, len(k), 128):
            power = np.abs(np.fft.rfft(data[(k[a : a + 128] * hop - start)[:, None] + np.arange(size)] * window, axis=1)) ** 2
            s, q = s + power.sum(axis=0), q + (power * power).sum(axis=0)
        return pa.table({"video_id": [key[0].as_py()], "rate": pa.array([rows["rate"][0].as_py()], pa.int32()), "n": pa.array([len(k)], pa.int64()), "s": [s.tolist()], "q": [q.tolist()]})

    done = parts.groupBy("video_id", "block").applyInArrow(sums, "video_id string, rate int, n long, s array<double>, q array<double>")
    each = done.select("video_id", "rate", "n", F.posexplode(F.arrays_zip("s", "q")).alias("bin", "_v"))
    return each.groupBy("video_id", "rate", "bin").agg(F.sum("n").alias("n"), F.sum("_v.s").alias("s"), F.sum("_v.q").alias("q"))


def spectra(sums: DataFrame, size: int = SIZE) -> DataFrame:
    """``video_id, kind, name, hertz, share, cv``: a row a band, and one for each of the ten strongest lasting tones."""
    power = F.col("s") / F.col("n")
    cv = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - power * power)) / (power + F.lit(1e-12))
    bins = sums.filter("n > 0").withColumns({"power": power, "cv": cv, "hertz": F.col("bin") * F.col("rate") / F.lit(float(size))})
    total = bins.groupBy("video_id").agg((F.sum("power") + F.lit(1e-12)).alias("total"))
    bins = bins.join(total, "video_id").withColumn("share", F.col("power") / F.col("total"))
    within = lambda lo, hi: F.sum(F.when((F.col("hertz") >= lo) & (F.col("hertz") < hi), F.col("share")).otherwise(0.0))
    bands = bins.groupBy("video_id").agg(F.array(*[F.struct(F.lit(f"{lo}-{hi}").alias("name"), within(lo, hi).alias("share")) for lo, hi in rules.BANDS]).alias("bands"))
    bands = bands.select("video_id", F.explode("bands").alias("b")).select("video_id", F.lit("band").alias("kind"), "b.name", F.lit(None).cast("double").alias("hertz"), "b.share", F.lit(None).cast("double").alias("cv"))
    lasting = bins.filter((F.col("hertz") > LOWEST) & (F.col("cv") < STEADY) & (F.col("share") >= LEAST_SHARE))
    order = Window.partitionBy("video_id").orderBy(F.col("share").desc(), "bin")  # a row a bin
    tones = lasting.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= TONES)
    return bands.unionByName(tones.select("video_id", F.lit("tone").alias("kind"), F.lit(None).cast("string").alias("name"), "hertz", "share", "cv"))


def audio_spectra(audio: DataFrame, most_seconds: float | None = SECONDS) -> DataFrame:
    """``spectra`` of ``video_id, sr, chunk_no, pcm``; videos too short for two frames have an ``error`` row."""
    chunks = placed(audio, most_seconds)
    short = chunks.filter(F.col("total") < 2 * SIZE).select("video_id").distinct()
    empty = audio.groupBy("video_id").agg(F.sum(F.size("pcm")).alias("n")).filter("n = 0").select("video_id")
    error = short.unionByName(empty).select("video_id", F.lit("error").alias("kind"), F.lit("too short").alias("name"), *[F.lit(None).cast("double").alias(c) for c in ("hertz", "share", "cv")])
    return spectra(stored(bin_sums(chunks))).unionByName(error)

