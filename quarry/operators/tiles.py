"""Pictures as tiles: work on parts of a picture, and what has to meet across their borders.

A tile is a row: ``video_id, idx`` name its picture, ``ty, tx`` its place in the grid of
``size``, ``h, w`` the whole picture, ``th, tw`` the tile, ``pix`` its values row by row.
Pictures may be cut from frames or arrive as tiles; no operator here puts one together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions import kernels
from quarry.operators import graphs
from quarry.storage import stored

SIZE = 256
KEY = ["video_id", "idx", "ty", "tx"]
TILES = "video_id string, idx long, ty int, tx int, h int, w int, th int, tw int, pix binary"
_HEAD = TILES.removesuffix(", pix binary")
_NAMES = [column.split()[0] for column in _HEAD.split(", ")]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(columns, schema)], schema=schema)


#: Rows of a batch that goes on, and bytes of the values in it.
_ROWS, _BYTES = 1024, 1 << 22


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows put together to batches that are bounded in rows and bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= _ROWS or size >= _BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def each_row(df: DataFrame, f: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``f`` yields for the values of each row; narrow."""
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((row for batch in batches for k in range(batch.num_rows) for row in f(*(c[k].as_py() for c in batch.columns))), made)

    return df.mapInArrow(run, schema)


def each_group(df: DataFrame, keys: list[str], f: Callable[[Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``f`` yields for the rows of each group; a task walks through its sorted groups and holds what ``f`` holds of one."""
    made, key = to_arrow_schema(StructType.fromDDL(schema)), itemgetter(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({n: c[k].as_py() for n, c in zip(batch.schema.names, batch.columns)} for batch in batches for k in range(batch.num_rows))
        return _batches((row for _, some in groupby(rows, key) for row in f(some)), made)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def cut(frames: DataFrame, size: int = SIZE, stride: int = 1) -> DataFrame:
    """Tiles of grey frames (video_id, idx, w, h, pix); ``stride`` keeps every so-manieth line and column."""

    def rows(video, idx, w, h, pix):
        picture = np.frombuffer(pix, np.uint8).reshape(h, w)[::stride, ::stride]
        h, w = picture.shape
        for y in range(0, h, size):
            for x in range(0, w, size):
                part = picture[y : y + size, x : x + size]
                yield video, idx, y // size, x // size, h, w, *part.shape, part.tobytes()

    return each_row(frames.select("video_id", "idx", "w", "h", "pix"), rows, TILES)


def with_halo(tiles: DataFrame, reach: int, f: Callable[[dict, np.ndarray], Iterator[tuple]], schema: str, size: int = SIZE, dtype: str = "uint8", value: str = "pix", mode: str = "reflect", more: str = "") -> DataFrame:
    """Rows that ``f`` yields for each tile (its row but the pixels) and its pixels with ``reach`` more on each side.

    Each tile sends its border strips to its eight neighbours, so what is shuffled is the
    tile and its rim.  Beyond the picture's edge values follow ``mode`` (``edge`` too where
    the picture is no larger than the reach); ``none`` leaves them out.
    """
    if size <= reach:
        raise ValueError("tiles must be larger than their reach")
    kept = f"{_HEAD}, {more}" if more else _HEAD
    names = StructType.fromDDL(kept).names
    sent = f"{kept}, dy int, dx int, part binary, ph int, pw int"
    strip = lambda d: {1: slice(-reach, None), -1: slice(0, reach), 0: slice(None)}[d] if reach else slice(None)

    def send(*values):
        *head, data = values
        row = dict(zip(names, head))
        part = np.frombuffer(data, dtype).reshape(row["th"], row["tw"])
        for dy in (-1, 0, 1) if reach else (0,):
            for dx in (-1, 0, 1) if reach else (0,):
                ty, tx = row["ty"] + dy, row["tx"] + dx
                if 0 <= ty * size < row["h"] and 0 <= tx * size < row["w"]:
                    piece = np.ascontiguousarray(part[strip(dy), strip(dx)])
                    to = row | {"ty": ty, "tx": tx, "th": min(size, row["h"] - ty * size), "tw": min(size, row["w"] - tx * size)}
                    yield *(to[n] if (dy, dx) == (0, 0) or n in _NAMES else None for n in names), -dy, -dx, piece.tobytes(), *piece.shape

    def meet(rows: Iterator[dict]) -> Iterator[tuple]:
        rows = list(rows)
        centre = next((r for r in rows if (r["dy"], r["dx"]) == (0, 0)), None)
        if centre is None:  # no tile stands there
            return
        parts = {(r["dy"], r["dx"]): np.frombuffer(r["part"], dtype).reshape(r["ph"], r["pw"]) for r in rows}
        line = lambda dy: np.concatenate([parts[dy, dx] for dx in (-1, 0, 1) if (dy, dx) in parts], axis=1)
        wide = np.concatenate([line(dy) for dy in (-1, 0, 1) if (dy, 0) in parts], axis=0)
        if mode != "none":
            have = lambda d, axis: parts[d].shape[axis] if d in parts else 0
            lacks = [(reach - have((-1, 0), 0), reach - have((1, 0), 0)), (reach - have((0, -1), 1), reach - have((0, 1), 1))]
            wide = np.pad(wide, lacks, mode=mode if min(centre["h"], centre["w"]) > reach else "edge")
        yield from f({n: centre[n] for n in names}, wide)

    return each_group(each_row(tiles.select(*names, value), send, sent), KEY, meet, schema)


def dark(tiles: DataFrame, window: int = 25, k: float = 0.10, size: int = SIZE) -> DataFrame:
    """Tiles whose ``pix`` is 1 where a pixel is darker than (1 - k) of its local mean, as ``kernels.binarised`` has it for the whole picture.

    A tile with its rim is summed up once in both directions; each local mean is four lookups.
    """
    half = window // 2

    def rows(head, wide):
        p = wide.astype(np.int64)
        sums = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        h, w = head["th"], head["tw"]
        total = sums[window : window + h, window : window + w] - sums[:h, window : window + w] - sums[window : window + h, :w] + sums[:h, :w]
        yield *head.values(), (p[half : half + h, half : half + w] < (1 - k) * total / window**2).astype(np.uint8).tobytes()

    return with_halo(tiles, half, rows, TILES, size)


_EDGE = "array<struct<line:string,at:int,a:int,b:int>>"


def components(masks: DataFrame, size: int = SIZE, diagonal: bool = True) -> DataFrame:
    """``video_id, idx, x, y, w, h, n``: boxes and pixel counts of a mask's connected components, whatever tiles they cross.

    Runs are joined inside each tile; of a component's runs on the tile's rim those that
    touch runs of the next tile are found by an equality join on the border's line and
    block, and the labels that meet are contracted to their least.
    """
    reach = 1 if diagonal else 0

    def rows(video, idx, ty, tx, h, w, th, tw, pix):
        y0, x0 = ty * size, tx * size
        found = kernels.labelled_runs(np.frombuffer(pix, np.uint8).reshape(th, tw), diagonal)
        boxes: dict[int, list] = {}
        for y, a, b, root in found:
            box = boxes.setdefault(root, [a, y, b, y + 1, 0, []])
            box[:5] = [min(box[0], a), min(box[1], y), max(box[2], b), max(box[3], y + 1), box[4] + b - a]
            edges = box[5]
            if y == 0:
                edges.append(("top", y0, x0 + a, x0 + b))
            if y == th - 1:
                edges.append(("bottom", y0 + th, x0 + a, x0 + b))
            if a == 0:
                edges.append(("left", x0, y0 + y, y0 + y + 1))
            if b == tw:
                edges.append(("right", x0 + tw, y0 + y, y0 + y + 1))
        for a, y, b, z, n, edges in boxes.values():
            yield video, idx, x0 + a, y0 + y, x0 + b, y0 + z, n, [dict(zip(("line", "at", "a", "b"), e)) for e in edges]

    schema = f"video_id string, idx long, x0 int, y0 int, x1 int, y1 int, n long, edges {_EDGE}"
    local = stored(each_row(masks.select(*_NAMES, "pix"), rows, schema).withColumn("node", F.monotonically_increasing_id()))
    runs = local.select("video_id", "idx", "node", F.explode("edges").alias("e")).select("video_id", "idx", "node", "e.*")
    # runs of a border line meet in blocks of a tile's length; one that reaches a block's end is in the next one too
    block = F.explode(F.sequence(F.floor((F.col("a") - reach) / size), F.floor((F.col("b") - 1 + reach) / size))).alias("block")
    one = lambda line, node, a, b: runs.filter(F.col("line") == line).select("video_id", "idx", "at", block, F.col("node").alias(node), F.col("a").alias(a), F.col("b").alias(b))
    touch = (F.col("a1") < F.col("b2") + reach) & (F.col("a2") < F.col("b1") + reach)
    meet = lambda upper, lower: one(upper, "a", "a1", "b1").join(one(lower, "b", "a2", "b2"), ["video_id", "idx", "at", "block"]).filter(touch).select("a", "b")
    roots = graphs.connected(meet("bottom", "top").unionByName(meet("right", "left")))
    named = local.drop("edges").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    box = named.groupBy("video_id", "idx", "root").agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("_x"), F.max("y1").alias("_y"), F.sum("n").alias("n"))
    return box.select("video_id", "idx", "x", "y", (F.col("_x") - F.col("x")).alias("w"), (F.col("_y") - F.col("y")).alias("h"), "n")


#: Frames of a tile that a task counts together, bytes of frames that it holds, and tasks whose partial counts one group adds up.
TOGETHER, HELD, PARTS = 64, 1 << 27, 64
STATS = f"{_HEAD}, median binary, mad binary"


def pixel_stats(tiles: DataFrame) -> DataFrame:
    """Tiles with each pixel's exact ``median`` over its video's frames and the ``mad`` from it, as floats.

    A histogram of 256 counts a pixel holds all that any number of frames can say, and
    histograms add up: frames are counted where they are read, up to ``TOGETHER`` at a time,
    partial counts of ``PARTS`` tasks are added, and then once more.  A repeated frame
    number counts as often as it occurs.  ``idx`` of the result is 0.
    """
    sent = f"{_HEAD}, part int, counts binary"
    made = to_arrow_schema(StructType.fromDDL(sent))
    names = made.names[:-2]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        part, size = TaskContext.get().partitionId() // PARTS, 0

        def packed(key: tuple) -> pa.RecordBatch:
            stack = np.stack(held.pop(key)).reshape(-1, key[6] * key[7])
            codes = (np.arange(stack.shape[1], dtype=np.int64) * 256 + stack).ravel()
            return _batch([(*key, part, _sealed(np.bincount(codes, minlength=stack.shape[1] * 256)))], made)

        for batch in batches:
            for k in range(batch.num_rows):
                video, _, *rest, pix = (c[k].as_py() for c in batch.columns)
                key = (video, 0, *rest)
                held.setdefault(key, []).append(np.frombuffer(pix, np.uint8))
                size += len(pix)
                if len(held[key]) == TOGETHER:
                    size -= len(held[key]) * len(pix)
                    yield packed(key)
                if size > HELD:  # many videos side by side
                    yield from map(packed, list(held))
                    size = 0
        yield from map(packed, list(held))

    def added(rows: Iterator[dict]) -> tuple[dict, np.ndarray]:
        head, total = None, None
        for row in rows:
            head = head or {n: row[n] for n in names}
            counts = _opened(row["counts"], row["th"] * row["tw"])
            total = counts if total is None else total + counts
        return head, total

    def add(rows: Iterator[dict]) -> Iterator[tuple]:
        head, total = added(rows)
        yield *head.values(), 0, _sealed(total)

    def finish(rows: Iterator[dict]) -> Iterator[tuple]:
        head, total = added(rows)
        median, mad = kernels.histogram_stats(total.reshape(-1, 256))
        yield *head.values(), median.astype(np.float32).tobytes(), mad.astype(np.float32).tobytes()

    counted = tiles.select(*_NAMES, "pix").mapInArrow(count, sent)
    return each_group(each_group(counted, [*KEY, "part"], add, sent), KEY, finish, STATS)


def _sealed(counts: np.ndarray) -> bytes:
    """Non-zero counts of a tile's histograms: how many, their places, their numbers."""
    at = np.flatnonzero(counts)
    return pa.compress(np.concatenate([[len(at)], np.diff(at, prepend=0), counts.ravel()[at]]).astype(np.int64).tobytes(), "zstd", asbytes=True) + len(at).to_bytes(8, "little")


def _opened(data: bytes, pixels: int) -> np.ndarray:
    n = int.from_bytes(data[-8:], "little")
    values = np.frombuffer(pa.decompress(data[:-8], 8 * (2 * n + 1), "zstd"), np.int64)
    out = np.zeros(pixels * 256, np.int64)
    out[np.cumsum(values[1 : n + 1])] = values[n + 1 :]
    return out


def percentile_of_counts(counts: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """``keys, name``: the interpolated percentile of values that occur ``n`` times each; as few rows a key as it has values."""
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(Window.partitionBy(*keys))})
    rank = F.lit(share) * (F.col("_all") - 1)
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col(value)))
    ends = rows.withColumns({"_lo": F.floor(rank), "_hi": F.ceil(rank), "_r": rank}).groupBy(*keys).agg(at(F.col("_lo")).alias("_a"), at(F.col("_hi")).alias("_b"), F.max(F.col("_r") - F.col("_lo")).alias("_f"))
    return ends.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(name))


#: Fixed values of the overlay rule: least frames; floors of the two thresholds; their percentiles; share of the picture; boxes; fill; gradient; sides.
LEAST_FRAMES, STILL_FLOOR, STEEP_FLOOR, STILL_SHARE, STEEP_SHARE = 8, 1.2, 1.5, 0.20, 0.97
AREA_SHARE, MOST_BOXES, FILL, LEAST_GRADIENT, SIDES = 0.0008, 12, (0.02, 0.95), 2.0, (8, 6)


def overlay_mask(stats: DataFrame, size: int = SIZE, wide: int = 1) -> tuple[DataFrame, DataFrame]:
    """(mask tiles; tiles with ``grad``) of ``pixel_stats``: still and steep pixels, spread ``wide`` pixels.

    Still: MAD below its 20th percentile (1.2 at least); steep: the median's gradient above
    its 97th percentile (1.5 at least).  Both percentiles are over the whole picture, from counts.
    """

    def slopes(head, picture):
        # one-sided differences at the picture's edge, where no rim is
        dy, dx = (np.gradient(picture.astype(np.float64), axis=a) if picture.shape[a] > 1 else np.zeros(picture.shape) for a in (0, 1))
        top, left = int(head["ty"] > 0), int(head["tx"] > 0)
        inner = np.s_[top : top + head["th"], left : left + head["tw"]]
        squares = np.rint(16 * (dx[inner] ** 2 + dy[inner] ** 2)).astype(np.int64)  # whole: medians are halves, differences quarters
        found, n = np.unique(squares, return_counts=True)
        twice, m = np.unique(np.rint(2 * np.frombuffer(head["mad"], np.float32)).astype(np.int64), return_counts=True)
        pairs = lambda v, c: [{"v": int(a), "n": int(b)} for a, b in zip(v, c)]
        yield *head.values(), (np.sqrt(squares) / 4).tobytes(), pairs(found, n), pairs(twice, m)

    counted = "array<struct<v:long,n:long>>"
    schema = f"{_HEAD}, mad binary, grad binary, slopes {counted}, moves {counted}"
    grads = stored(with_halo(stats, 1, slopes, schema, size, "float32", "median", "none", "mad binary"))
    split = lambda c: grads.select("video_id", F.explode(c).alias("e")).groupBy("video_id", F.col("e.v").alias("v")).agg(F.sum("e.n").alias("n"))
    # the root of a percentile's two neighbours, not of the percentile
    steep = percentile_of_counts(split("slopes").withColumn("v", F.sqrt("v") / 4), ["video_id"], "v", STEEP_SHARE, "steep")
    still = percentile_of_counts(split("moves").withColumn("v", F.col("v") / 2), ["video_id"], "v", STILL_SHARE, "still")
    bars = still.join(steep, "video_id").select("video_id", F.greatest("still", F.lit(STILL_FLOOR)).alias("still"), F.greatest("steep", F.lit(STEEP_FLOOR)).alias("steep"))

    def marked(*values):
        *head, mad, grad, still_, steep_ = values
        yield *head, ((np.frombuffer(mad, np.float32) < still_) & (np.frombuffer(grad) > steep_)).astype(np.uint8).tobytes()

    mask = each_row(grads.join(bars, "video_id").select(*_NAMES, "mad", "grad", "still", "steep"), marked, TILES)

    def spread(head, picture):
        padded, h, w = np.pad(picture, wide), *picture.shape
        out = np.zeros((h, w), bool)
        for dy in range(2 * wide + 1):
            for dx in range(2 * wide + 1):
                out |= padded[dy : dy + h, dx : dx + w] > 0
        top, left = (wide if head["ty"] else 0), (wide if head["tx"] else 0)
        yield *head.values(), out[top : top + head["th"], left : left + head["tw"]].astype(np.uint8).tobytes()

    return with_halo(mask, wide, spread, TILES, size, mode="none"), grads.select(*_NAMES, "grad")


def overlay_regions(frames: DataFrame, size: int = SIZE, stride: int = 2) -> DataFrame:
    """``video_id, x, y, w, h, grad, fill, box``: regions that stay the same while their video moves.

    Every ``stride``-th line and column of every frame takes part.  Components of the
    overlay mask (sides touching) of at least 0.08 % of the picture, the 12 largest of a
    video, are regions if they fill 2 to 95 % of their box, if the median's mean gradient
    in it is above 2, and if it is more than 8 wide and 6 high; videos of under 8 frames
    have none.  ``box`` is in the thinned picture, the rest in the frames' own pixels.
    """
    enough = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), F.max("w").alias("fw"), F.max("h").alias("fh")).filter(F.col("frames") >= LEAST_FRAMES)
    stats = pixel_stats(cut(frames.join(enough.select("video_id"), "video_id", "left_semi"), size, stride))
    mask, grads = overlay_mask(stored(stats), size, max(1, 3 // stride))
    grads = stored(grads)
    order = Window.partitionBy("video_id").orderBy(F.col("n").desc(), "y", "x")
    shape = grads.groupBy("video_id").agg(F.max("h").alias("ph"), F.max("w").alias("pw"))
    found = components(mask, size, diagonal=False).drop("idx").join(shape, "video_id").filter(F.col("n") >= F.floor(F.lit(AREA_SHARE) * F.col("ph") * F.col("pw")))
    found = stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MOST_BOXES))
    boxes = found.groupBy("video_id").agg(F.collect_list(F.struct("rank", "x", "y", "w", "h")).alias("boxes"))

    def parts(video, ty, tx, th, tw, grad, boxes_):
        values = np.frombuffer(grad).reshape(th, tw)
        for b in boxes_:
            y, x = b["y"] - ty * size, b["x"] - tx * size
            inside = values[max(0, y) : max(0, y + b["h"]), max(0, x) : max(0, x + b["w"])]
            if inside.size:
                yield video, b["rank"], float(inside.sum())

    sums = each_row(grads.join(boxes, "video_id").select("video_id", "ty", "tx", "th", "tw", "grad", "boxes"), parts, "video_id string, rank int, sum double")
    graded = found.join(sums.groupBy("video_id", "rank").agg(F.sum("sum").alias("sum")), ["video_id", "rank"]).join(enough, "video_id")
    graded = graded.withColumns({"grad": F.col("sum") / (F.col("w") * F.col("h")), "fill": F.col("n") / (F.col("w") * F.col("h"))})
    low, high = FILL
    kept = graded.filter((F.col("fill") > low) & (F.col("fill") < high) & (F.col("grad") > LEAST_GRADIENT) & (F.col("w") > SIDES[0]) & (F.col("h") > SIDES[1]))
    sx, sy = F.col("fw") / F.col("pw"), F.col("fh") / F.col("ph")
    side = lambda n, s: F.greatest(F.lit(1), F.rint(F.col(n) * s).cast("int"))
    return kept.select(
        "video_id", F.floor(F.col("x") * sx).cast("int").alias("x"), F.floor(F.col("y") * sy).cast("int").alias("y"), side("w", sx).alias("w"), side("h", sy).alias("h"),
        F.round("grad", 3).alias("grad"), F.round("fill", 4).alias("fill"), F.array("x", "y", "w", "h").alias("box"),
    )
