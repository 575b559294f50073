"""Choosing an encoding from measured trials: gate, first pass, least projected size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P1_MARGIN = 10.0


def precheck(width: Column, height: Column, duration: Column, codec: Column, transfer: Column, bpp: Column, allow_hdr: bool = False) -> Column:
    """The first reason to leave a video alone; null if there is none."""
    missing = F.coalesce((width <= 0) | (height <= 0) | (duration <= 0), F.lit(True))
    hdr = F.coalesce(transfer.isin("smpte2084", "arib-std-b67"), F.lit(False)) & F.lit(not allow_hdr)
    tight = (bpp > 0) & (bpp < 0.045) & codec.isin("hevc", "av1", "vp9")
    return F.when(missing, "incomplete").when(codec.isNull() | (codec == ""), "no_video").when(hdr, "hdr").when(tight, "already_tight")


def passes(metric: Column, mean: Column, p1: Column, vmaf: Column, ssim: Column) -> Column:
    """VMAF: the mean at its target and, where it is known, p1 within ten of it.  SSIM: the mean at its target."""
    by_vmaf = (mean >= vmaf) & ((p1 <= 0) | (p1 >= vmaf - P1_MARGIN))
    return F.when(metric == "vmaf", by_vmaf).when(metric == "ssim", mean >= ssim).otherwise(F.lit(False))


def candidates(ladder: DataFrame, available: DataFrame, wanted: str = "auto") -> DataFrame:
    """Encoders to try: the wanted one, else efficient ones but AV1, else any that is available."""
    here = ladder.join(available.select("encoder").distinct(), "encoder", "left_semi")
    if wanted != "auto":
        return ladder.filter(F.col("encoder") == wanted)
    preferred = F.col("efficient") & (F.col("family") != "av1")
    any_preferred = F.max(preferred).over(Window.partitionBy())  # a handful of rows
    return here.withColumn("_any", any_preferred).filter(preferred | ~F.col("_any")).drop("_any")


def next_quality(flag: Column, value: Column, attempt: Column) -> Column:
    """The setting of an attempt (from 0): finer by 2 (crf) or 5 (q) a step, 0 at least."""
    return F.greatest(F.lit(0), value - F.when(flag == "crf", 2).otherwise(5) * attempt)


def first_passes(trials: DataFrame, target: DataFrame) -> DataFrame:
    """The first attempt of each encoder that passes.  ``target`` is one row (vmaf, ssim)."""
    gated = trials.join(F.broadcast(target.limit(1))).filter(passes(F.col("metric"), F.col("mean"), F.col("p1"), F.col("vmaf"), F.col("ssim")))
    order = Window.partitionBy("video_id", "encoder").orderBy("attempt")
    return gated.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "vmaf", "ssim")


def choose(trials: DataFrame, sizes: DataFrame, target: DataFrame, min_savings: float = 0.10) -> DataFrame:
    """``video_id, action, reason, encoder, crf, projected``: one row a video of ``sizes`` (video_id, size).

    Of the passes the least projected size wins, ties to the ladder's order; it is
    skipped where it saves too little or nothing passes.
    """
    best = Window.partitionBy("video_id").orderBy("projected", "ladder_rank")
    won = first_passes(trials, target).withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
    rows = sizes.join(won, "video_id", "left")
    reason = F.when(F.col("encoder").isNull(), "nothing_passes").when(F.col("projected") >= F.col("size") * (1 - min_savings), "saves_too_little")
    return rows.select("video_id", F.when(reason.isNull(), "slim").otherwise("skip").alias("action"), reason.alias("reason"), "encoder", "crf", "projected")


def pooled_quality(windows: DataFrame) -> DataFrame:
    """``video_id, encoder, crf, metric, mean, worst, p1`` over a trial's windows; p1 the least known one, else 0."""
    p1 = F.coalesce(F.min(F.when(F.col("p1") > 0, F.col("p1"))), F.lit(0.0))
    return windows.groupBy("video_id", "encoder", "crf", "metric").agg(F.avg("mean").alias("mean"), F.min("worst").alias("worst"), p1.alias("p1"))


def slim_report(choices: DataFrame, results: DataFrame) -> DataFrame:
    """``video_id, action, reason, encoder, crf, size_before, size_after, saved, ok``: what became of each video.

    ``choices`` as ``choose`` gives them; ``results``: video_id, size_before, size_after, ok of the
    encodings.  A skipped video keeps its size and is ok; one without a result is not.
    """
    from quarry.functions.scalar import saved_percent

    rows = choices.join(results, "video_id", "left")
    skipped = F.col("action") == "skip"
    after = F.when(skipped, F.col("size_before")).otherwise(F.col("size_after"))
    return rows.select("video_id", "action", "reason", "encoder", "crf", "size_before", after.alias("size_after"), saved_percent(F.col("size_before"), after).alias("saved"), (skipped | F.coalesce("ok", F.lit(False))).alias("ok"))


def batch_totals(results: DataFrame) -> DataFrame:
    """Counts and bytes over all videos; a skipped video counts with the size it keeps."""
    after = F.when(F.col("skipped"), F.col("size_before")).otherwise(F.col("size_after"))
    totals = results.agg(
        F.count(F.lit(1)).alias("videos"),
        F.count_if("ok").alias("ok"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if("skipped").alias("skipped"),
        F.sum("size_before").alias("size_before"),
        F.sum(after).alias("size_after"),
    )
    return totals.withColumn("saved", F.col("size_before") - F.col("size_after"))
