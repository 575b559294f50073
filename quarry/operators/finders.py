"""Finder patterns as relations: runs are rows, a pattern is five of them in a row.

Lines are cut into runs tile by tile and joined where a run crosses tiles.  A candidate is
a five-run window across a line whose lengths are as 1:1:3:1:1; it is proven by such a
window among the runs of its column near it, met by an equality join on the column.  Only
proven candidates, a few a picture, are put into clusters and triples.  Masks and
candidates are written once, and only columns that a candidate stands on are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import kernels
from quarry.operators import tiles
from quarry.storage import stored

#: Tolerance of every run in modules across and down, lines between two that are read.
ACROSS, DOWN, EVERY = 0.55, 0.6, 3


def runs(masks: DataFrame, down: bool = False, every: int = 1, size: int = tiles.SIZE, asked: DataFrame | None = None) -> DataFrame:
    """``video_id, idx, line, start, n, dark``: the runs of a mask's rows (columns if ``down``), whole across tiles.

    ``asked`` (video_id, idx, line) names the lines that are wanted; a picture has as many at most as it is wide or high.
    """

    def rows(video, idx, ty, tx, th, tw, pix, wanted=None) -> Iterator[tuple]:
        part = np.frombuffer(pix, np.uint8).reshape(th, tw) > 0
        first, along = (tx * size, ty * size) if down else (ty * size, tx * size)
        wanted = None if wanted is None else set(wanted)
        for k, line in enumerate(part.T if down else part):
            if (first + k) % every == 0 and (wanted is None or first + k in wanted):
                for start, n, value in zip(*(v.tolist() for v in kernels.run_lengths(line))):
                    yield video, idx, first + k, along + start, n, value

    masks = masks.select("video_id", "idx", "ty", "tx", "th", "tw", "pix")
    if asked is not None:
        masks = masks.join(asked.groupBy("video_id", "idx").agg(F.collect_set("line").alias("wanted")), ["video_id", "idx"])
        masks = masks.select("video_id", "idx", "ty", "tx", "th", "tw", "pix", "wanted")
    pieces = tiles.each_row(masks, rows, "video_id string, idx long, line int, start int, n int, dark boolean")
    over = Window.partitionBy("video_id", "idx", "line").orderBy("start")  # a line of a picture
    new = F.coalesce(F.col("dark") != F.lag("dark").over(over), F.lit(True))
    joined = pieces.withColumn("_run", F.sum(new.cast("int")).over(over))
    return joined.groupBy("video_id", "idx", "line", "_run").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.first("dark").alias("dark")).drop("_run")


def _five(over, n: Column, dark: Column, tolerance: float, dark_centre: bool) -> tuple[Column, Column]:
    """(whether a run and the next four are a pattern, its module)."""
    lengths = [F.lead(n, k).over(over) if k else n for k in range(5)]
    module = sum(lengths[1:], lengths[0]) / 7.0
    fits = [F.abs(length - module * want) < F.lit(tolerance) * module for length, want in zip(lengths, (1, 1, 3, 1, 1))]
    found = (dark == F.lit(dark_centre)) & (module >= 1.0)
    for fit in fits:
        found = found & fit
    return F.coalesce(found, F.lit(False)), module


def candidates(masks: DataFrame, inverted: bool = False, every: int = EVERY, size: int = tiles.SIZE) -> DataFrame:
    """``video_id, idx, y, x, module`` of 1:1:3:1:1 windows on every third line; dark centres unless ``inverted``."""
    over = Window.partitionBy("video_id", "idx", "line").orderBy("start")
    found, module = _five(over, F.col("n"), F.col("dark"), ACROSS, not inverted)
    centre = F.col("start") + F.col("n") + F.lead("n", 1).over(over) + F.lead("n", 2).over(over) / 2.0
    rows = runs(masks, every=every, size=size).withColumns({"found": found, "module": module, "x": centre})
    return rows.filter("found").select("video_id", "idx", F.col("line").alias("y"), "x", "module")


def proven(found: DataFrame, masks: DataFrame, inverted: bool = False, size: int = tiles.SIZE) -> DataFrame:
    """Candidates whose column has such a window within four modules above and below; runs are cut there."""
    height = masks.groupBy("video_id", "idx").agg(F.max("h").alias("height"))
    asked = found.withColumn("line", F.rint("x").cast("int")).join(height, ["video_id", "idx"])
    low = F.greatest(F.lit(0), (F.col("y") - 4 * F.col("module")).cast("int"))
    high = F.least(F.col("height"), (F.col("y") + 4 * F.col("module")).cast("int") + 1)
    asked = asked.withColumns({"low": low, "high": high})
    met = asked.join(runs(masks, down=True, size=size, asked=asked), ["video_id", "idx", "line"]).filter((F.col("start") < F.col("high")) & (F.col("start") + F.col("n") > F.col("low")))
    cut = F.least(F.col("start") + F.col("n"), F.col("high")) - F.greatest("start", "low")
    over = Window.partitionBy("video_id", "idx", "y", "x", "module").orderBy("start")
    hit, _ = _five(over, F.col("_n"), F.col("dark"), DOWN, not inverted)
    proof = met.withColumn("_n", cut).withColumn("hit", hit).filter("hit")
    return found.join(proof.select("video_id", "idx", "y", "x", "module").distinct(), ["video_id", "idx", "y", "x", "module"], "left_semi")


def finder_frames(frames: DataFrame, inverted: bool = False, size: int = tiles.SIZE) -> DataFrame:
    """``video_id, idx, patterns, triples`` of grey frames where three patterns stand at a right angle."""
    masks = stored(tiles.dark(tiles.cut(frames, size), size=size))
    good = proven(stored(candidates(masks, inverted, size=size)), masks, inverted, size)

    def triples(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])
        patterns = kernels.pattern_clusters(list(zip(rows["y"], rows["x"], rows["module"])))
        found = kernels.finder_triples(patterns)
        out = [(rows["video_id"].iloc[0], rows["idx"].iloc[0], len(patterns), len(found))] if found else []
        return pd.DataFrame(out, columns=["video_id", "idx", "patterns", "triples"])

    return good.groupBy("video_id", "idx").applyInPandas(triples, "video_id string, idx long, patterns int, triples int")
