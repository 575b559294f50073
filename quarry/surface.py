"""The engine's functions for SQL: table functions over contents, scalar functions over bytes.

    register(spark)
    spark.sql("SELECT f.path, b.* FROM files f, LATERAL boxes(f.content) b")
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions import bitstream, boxes, kernels
from quarry.operators import decoded


def _table_functions() -> dict[str, tuple[str, Callable[[str, bytes], Iterable[tuple]]]]:
    """Name -> (schema with the file's name, rows of a file)."""
    return {
        "boxes": (schemas.BOXES, boxes.box_rows),
        "samples": (schemas.SAMPLES, boxes.sample_rows),
        "metadata_items": (schemas.METADATA, boxes.metadata_rows),
        "nals": (schemas.NALS, lambda video, data: bitstream.nal_rows(video, data, 2**62)),
        "sei_messages": (schemas.SEI, lambda video, data: bitstream.sei_rows(video, data, 2**62)),
        "signatures": (decoded.TABLES["signatures"], lambda video, data: decoded.signature_rows(video, data, boxes.parse(data))),
    }


def register(spark: SparkSession) -> None:
    """Table functions ``boxes, samples, metadata_items, nals, sei_messages, signatures`` of a content; ``sps_info, byte_entropy, nonzero_ratio``.

    A content that breaks a decoder gives the rows before the fault; null gives none.
    """
    from quarry.session import ship

    ship(spark)
    for name, (schema, rows) in _table_functions().items():
        spark.udtf.register(name, F.udtf(_reader(rows), returnType=schema.removeprefix("video_id string, ")))
    spark.udf.register("sps_info", F.udf(_sps, schemas.SPS))
    for name, of in (("byte_entropy", kernels.byte_entropy), ("nonzero_ratio", kernels.nonzero_ratio)):
        spark.udf.register(name, F.pandas_udf(_of_bytes(of), "double"))


def _reader(rows: Callable[[str, bytes], Iterable[tuple]]) -> type:
    class Reader:
        def eval(self, content: bytes):
            if content is None:
                return
            try:
                for row in rows("", bytes(content)):
                    yield row[1:]
            except boxes.FAULTS:
                return

    return Reader


def _of_bytes(of: Callable[[bytes], float]) -> Callable[[pd.Series], pd.Series]:
    def each(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else of(bytes(b)))

    each.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return each


def _sps(unit: bytes | None) -> tuple | None:
    found = bitstream.sps(bytes(unit)) if unit else None
    return tuple(found[c.split()[0]] for c in schemas.SPS.split(", ")) if found else None
