"""Streams: files as they arrive, and online series rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources.files import SCANNED, is_fresh, name_glob, video_id

ARRIVAL = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, late: str = "1 day", extensions: tuple[str, ...] = SCANNED) -> DataFrame:
    """A stream of ``video_id, path, length, content`` of the files that ``whole_files`` would read; one seen twice with one time is one arrival."""
    found = spark.readStream.format("binaryFile").schema(ARRIVAL).option("pathGlobFilter", name_glob(extensions)).load(folder).filter(is_fresh(F.col("path")))
    once = found.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["path", "modificationTime"])
    return once.select(video_id(F.col("path")).alias("video_id"), "path", "modificationTime", "length", "content")


def scan_arrivals(files: DataFrame, scan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, held: list[DataFrame] | None = None):
    """Write the findings of each batch below ``out``, a folder a batch, so a batch run again replaces itself.

    Tables that ``scan`` adds to ``held`` are released once a batch is written.
    """

    def each(batch: DataFrame, number: int) -> None:
        try:
            scan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            while held:
                held.pop().unpersist()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_flashes(series: DataFrame, bar: float, tolerance: float = 0.45) -> DataFrame:
    """``key, order, kind`` of a stream of ``key, order, y`` whose rows arrive in order within a key.

    A step above ``bar`` is a flash if the value after it is back within ``tolerance`` of
    the larger of this step and the next, else a cut; the state is a key's last two values.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0, 0.0, 0, 0.0)
        last = [(held[1], held[2]), (held[3], held[4])][: held[0]]
        out = []
        for batch in batches:
            for order, y in batch.sort_values("order")[["order", "y"]].itertuples(index=False):
                last.append((int(order), float(y)))
                if len(last) == 3:
                    (at, first), (_, second), (_, third) = last
                    size = abs(second - first)
                    if size > bar:
                        out.append((key[0], at, "flash" if abs(third - first) < tolerance * max(size, abs(third - second)) else "cut"))
                    last.pop(0)
        (a, x), (b, y) = [*last, (0, 0.0), (0, 0.0)][:2]
        state.update((len(last), a, x, b, y))
        yield pd.DataFrame(out, columns=["key", "order", "kind"])

    return series.groupBy("key").applyInPandasWithState(step, "key string, order long, kind string", "n int, a long, x double, b long, y double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window and type, late rows dropped past the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
