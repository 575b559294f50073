"""Files as DataFrames: target expansion, whole files, byte ranges, sidecar tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas

# File name extensions of the two kinds of batch.
SCANNED = ("mp4", "mov", "m4v", "3gp", "3g2", "m4a", "m4b", "f4v", "qt", "mj2")
SLIMMED = ("mp4", "mov", "m4v", "mkv", "webm", "avi", "ts")


def video_id(path: Column) -> Column:
    """A file's key: a hash of its whole path, so equal names in two folders stay apart."""
    return F.substring(F.sha2(path, 256), 1, 32)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def targets(paths: DataFrame, extensions: tuple[str, ...] = SCANNED, skip_repaired: bool = True) -> DataFrame:
    """Paths to read, each once: ``paths`` has path, explicit (named by the caller) and seq.

    Found files need a known extension; named ones do not.  Names that contain
    "repaired" are left out unless named.
    """
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    known = F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*extensions)
    fresh = ~name.contains("repaired") if skip_repaired else F.lit(True)
    kept = paths.filter(F.col("explicit") | (known & fresh))
    return kept.groupBy("path").agg(F.min("seq").alias("seq"))


def name_glob(extensions: tuple[str, ...]) -> str:
    """A glob of names with these extensions in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def is_fresh(path: Column) -> Column:
    """Whether a path's name does not contain "repaired"."""
    return ~F.lower(F.regexp_extract(path, r"([^/]+)$", 1)).contains("repaired")


def whole_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = SCANNED, recursive: bool = True) -> DataFrame:
    """``video_id, path, length, content`` of files under ``path``; for files under 2 GB."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", name_glob(extensions)).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.filter(is_fresh(F.col("path"))).select(video_id(F.col("path")).alias("video_id"), "path", "length", "content")


def content_hashes(files: DataFrame) -> DataFrame:
    return files.select("video_id", "path", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def byte_ranges(files: DataFrame, size: int = 8 << 20) -> DataFrame:
    """``video_id, path, offset, length``: ranges of ``size`` bytes that tile each file, for readers that seek."""
    starts = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = files.select("video_id", "path", F.col("length").alias("_n"), F.explode(starts).alias("offset"))
    return rows.select("video_id", "path", "offset", F.least(F.lit(size).cast("long"), F.col("_n") - F.col("offset")).alias("length"))


def read_range(path: str, offset: int, length: int) -> bytes:
    """Bytes of a range, from any store that Arrow's file systems open: local files, HDFS, object stores."""
    from pyarrow.fs import FileSystem

    store, inside = FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    with store.open_input_file(inside) as f:
        return f.read_at(max(0, min(length, f.size() - offset)), offset)


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``video_id, path, length`` of the files under ``path``; Spark lists them, no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select(video_id(F.col("path")).alias("video_id"), "path", "length")


def read_pieces(pieces: DataFrame, start: str = "start", n: str = "n") -> DataFrame:
    """``pieces`` (with path) and ``content``: each task seeks to its pieces and reads no more than those."""

    def read(path: str, at: int, length: int) -> bytes:
        return read_range(path, at, length)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):  # a piece at a time: together they may pass memory
                row = batch.slice(k, 1)
                data = read(*(row.column(c)[0].as_py() for c in ("path", start, n)))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], [*row.schema.names, "content"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in pieces.dtypes)
    return pieces.mapInArrow(run, f"{schema}, content binary")


def range_contents(files: DataFrame, size: int = 8 << 20, overlap: int = 0) -> DataFrame:
    """``video_id, path, offset, length, content``: ``byte_ranges`` dealt out over the cluster and read, with ``overlap`` more bytes."""
    ranges = byte_ranges(files, size).withColumn("_n", F.col("length") + overlap)
    spread = ranges.repartition("video_id", "offset")
    return read_pieces(spread, "offset", "_n").drop("_n")


def register_byte_ranges(spark: SparkSession) -> None:
    """``spark.read.format("byte_ranges").option("path", ...).option("size", ...)``: a seek-based source for large files.

    Each range of a file is a partition of its own.  The driver lists the files; for a
    listing by Spark see ``listing`` and ``range_contents``.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Range(InputPartition):
        def __init__(self, path: str, offset: int, length: int):
            self.path, self.offset, self.length = path, offset, length

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.size = options["path"], int(options.get("size", 8 << 20))

        def partitions(self) -> list[InputPartition]:
            from pyarrow.fs import FileSelector, FileSystem, FileType

            uri = self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}"
            store, inside = FileSystem.from_uri(uri)
            top = store.get_file_info(inside)
            found = [top] if top.type == FileType.File else sorted((f for f in store.get_file_info(FileSelector(inside, recursive=True)) if f.type == FileType.File), key=lambda f: f.path)
            named = lambda f: uri if f is top else f"{uri.removesuffix(inside)}{f.path}"
            return [Range(named(f), at, min(self.size, f.size - at)) for f in found for at in range(0, f.size, self.size)]

        def read(self, partition: Range) -> Iterator[tuple]:
            yield partition.path, partition.offset, read_range(partition.path, partition.offset, partition.length)

    class ByteRanges(DataSource):
        @classmethod
        def name(cls) -> str:
            return "byte_ranges"

        def schema(self) -> str:
            return "path string, offset long, content binary"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    spark.dataSource.register(ByteRanges)


def probes(sidecars: DataFrame, text: str = "probe") -> DataFrame:
    """A probe's JSON text as format, streams and chapters; malformed text gives nulls."""
    return sidecars.withColumn("_p", F.from_json(F.col(text), schemas.PROBE)).select(*[c for c in sidecars.columns if c != text], "_p.format", "_p.streams", "_p.chapters")


def streams(probe: DataFrame) -> DataFrame:
    """A row a stream, with ``ordinal``, its place among those of its kind from 1."""
    from pyspark.sql import Window

    rows = probe.select("video_id", F.explode("streams").alias("s")).select("video_id", "s.*")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("video_id", "codec_type").orderBy("index")))


def media_facts(probe: DataFrame) -> DataFrame:
    """A row a video: size, codec, rate, bits per pixel and HDR of its first video stream, codec of its first audio stream."""
    from quarry.functions.scalar import bits_per_pixel, frame_rate

    rows = streams(probe)
    video = rows.filter("codec_type = 'video' AND ordinal = 1")
    audio = rows.filter("codec_type = 'audio' AND ordinal = 1").select("video_id", F.col("codec_name").alias("acodec"), F.col("bit_rate").try_cast("long").alias("abitrate"))
    fps = frame_rate(F.coalesce("avg_frame_rate", "r_frame_rate"))
    facts = probe.select("video_id", F.col("format.duration").try_cast("double").alias("duration"), F.col("format.size").try_cast("long").alias("size"), F.col("format.bit_rate").try_cast("long").alias("total_rate"))
    picked = video.select("video_id", F.col("codec_name").alias("vcodec"), "width", "height", fps.alias("fps"), F.col("bit_rate").try_cast("long").alias("vbitrate"), "color_transfer", "pix_fmt")
    out = facts.join(picked, "video_id", "left").join(audio, "video_id", "left")
    rate = F.coalesce("vbitrate", "total_rate").cast("double")
    hdr = F.coalesce(F.col("color_transfer").isin("smpte2084", "arib-std-b67"), F.lit(False))
    return out.withColumns({"bpp": F.coalesce(bits_per_pixel(rate, F.col("width"), F.col("height"), F.col("fps")), F.lit(0.0)), "is_hdr": hdr})


def prior_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of an earlier report; an empty table if there is none."""
    try:
        return spark.read.schema(schemas.FINDINGS).json(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], schemas.FINDINGS)
        raise


def write_report(findings: DataFrame, path: str, form: str = "parquet") -> None:
    findings.write.mode("overwrite").partitionBy("severity").format(form).save(path)
