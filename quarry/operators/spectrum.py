"""Spectral statistics of short vectors: a vector is a signal, its spectrum one FFT a batch of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def powers(df: DataFrame, keys: list[str], vector: str, n: int, name: str = "power") -> DataFrame:
    """``keys, name``: squared magnitudes of the DFT bins 0 to n/2 of each vector, an array a row.  Narrow.

    A vector's values count modulo ``n``: longer ones are folded, shorter ones end in zeros.
    Null vectors, and null values in them, give null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys))
            x, known = np.zeros((batch.num_rows, n)), np.ones(batch.num_rows, bool)
            flat = column.flatten()
            if not column.null_count and not flat.null_count and len(flat) == n * batch.num_rows and (np.diff(column.offsets.to_numpy()) == n).all():
                x[:] = flat.to_numpy().reshape(-1, n)
            else:
                for k, v in enumerate(column.to_pylist()):
                    known[k] = v is not None and None not in v
                    if known[k]:
                        np.add.at(x[k], np.arange(len(v)) % n, np.array(v, np.float64))
            found = np.abs(np.fft.rfft(x, axis=1)) ** 2
            offsets = np.concatenate([[0], np.cumsum(np.where(known, found.shape[1], 0))]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[known].ravel()), mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], made], [*batch.schema.names[: len(keys)], name])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(vector).alias("_vector")).mapInArrow(run, f"{schema}, {name} array<double>")


def band_energy(df: DataFrame, keys: list[str], vector: str, n: int, bands: list[tuple[int, int]]) -> DataFrame:
    """``keys, band, share``: each half-open band of bins' share of the power up to bin n/2.  Narrow."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = powers(df, keys, vector, n, "_p").withColumn("_all", add(F.col("_p")))
    each = F.array(*[F.struct(F.lit(f"{lo}-{hi}").alias("band"), add(F.slice("_p", lo + 1, hi - lo)).alias("e")) for lo, hi in bands])
    out = rows.select(*keys, "_all", F.explode(each).alias("b"))
    return out.select(*keys, "b.band", (F.col("b.e") / (F.col("_all") + F.lit(1e-12))).alias("share"))


def strongest_bins(df: DataFrame, keys: list[str], vector: str, n: int, lowest: int, k: int) -> DataFrame:
    """``keys, rank, bin, power``: the ``k`` strongest bins above ``lowest``, ties to the lower bin.  Narrow."""
    rows = powers(df, keys, vector, n, "_p")
    ordered = F.array_sort(F.transform(F.slice("_p", lowest + 2, n // 2 - lowest), lambda p, i: F.struct((-F.round(p, 9)).alias("p"), (i + lowest + 1).alias("bin"))))
    out = rows.select(*keys, F.posexplode(F.slice(ordered, 1, k)).alias("pos", "s"))
    return out.select(*keys, (F.col("pos") + 1).alias("rank"), F.col("s.bin").alias("bin"), (-F.col("s.p")).alias("power"))
