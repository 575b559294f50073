"""Statistics of frames, and findings over what ``tiles``, ``finders`` and ``sound`` give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import kernels, rules
from quarry.operators.findings import finding


def frame_stats(frames: DataFrame) -> DataFrame:
    """``video_id, idx, t, luma, sat`` of RGB frames; narrow."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [kernels.luma_saturation(np.frombuffer(p, np.uint8).reshape(h, w, 3)) for p, h, w in zip(b["pix"], b["h"], b["w"])]
            yield b[["video_id", "idx", "t"]].assign(luma=[f[0] for f in found], sat=[f[1] for f in found])

    return frames.select("video_id", "idx", "t", "w", "h", "pix").mapInPandas(rows, "video_id string, idx long, t double, luma double, sat double")


def ultrasonic_findings(spectra: DataFrame) -> DataFrame:
    """Energy from 16 kHz on: over 8e-4 HIGH, over 1e-4 LOW, else INFO; a MED finding for lasting tones."""
    high = [f"{a}-{b}" for a, b in rules.BANDS if a >= 16000]
    energy = spectra.filter(F.col("kind") == "band").groupBy("video_id").agg(F.sum(F.when(F.col("name").isin(high), F.col("share")).otherwise(0.0)).alias("e"))
    severity = F.when(F.col("e") > 8e-4, "HIGH").when(F.col("e") > 1e-4, "LOW").otherwise("INFO")
    tones = spectra.filter(F.col("kind") == "tone").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return finding(energy, "R27", severity, "audio", "energy from 16 kHz on", F.col("e")).unionByName(finding(tones, "R27", "MED", "audio", "lasting narrow tones", F.col("n")))


def overlay_findings(regions: DataFrame, videos: DataFrame) -> DataFrame:
    """HIGH for videos with regions, INFO for those without."""
    n = videos.join(regions.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")), "video_id", "left")
    return finding(n, "R28", F.when(F.col("n") > 0, "HIGH").otherwise("INFO"), "picture", "regions that never change", F.coalesce("n", F.lit(0)))


def finder_findings(finders: DataFrame, flash_frames: DataFrame, videos: DataFrame) -> DataFrame:
    """A finder pattern on a flash frame HIGH, elsewhere MED, none INFO."""
    on_flash = finders.join(flash_frames.select("video_id", "idx").distinct().withColumn("flash", F.lit(1)), ["video_id", "idx"], "left")
    n = on_flash.groupBy("video_id").agg(F.count_if(F.expr("flash = 1")).alias("on_flash"), F.count(F.lit(1)).alias("n"))
    n = videos.join(n, "video_id", "left")
    severity = F.when(F.col("on_flash") > 0, "HIGH").when(F.col("n") > 0, "MED").otherwise("INFO")
    return finding(n, "R31", severity, "picture", "finder patterns", F.coalesce("n", F.lit(0)))
