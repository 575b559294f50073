"""Byte patches as a plan: what would change, checked before and after, never applied in place.

A patch row is a video, an offset and either bytes or a length to fill with zeros.
Planned are keep, blank and same-length replacement; inventing identities, stripping
provenance or protection data and re-encoding are out of scope.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.intervals import not_contained, union
from quarry.storage import checkpointed, stored

#: Zero stretches from this length on are planned by length, without bytes.
ZERO_FROM = 1 << 20


def patch_length(data: str = "data", zero_len: str = "zero_len") -> Column:
    return F.coalesce(F.col(zero_len), F.octet_length(F.col(data)).cast("long"))


def metadata_patches(items: DataFrame, mode: str = "keep", value: str | None = None) -> DataFrame:
    """Patches for metadata values that are platform ids (by value) or encoder names (by key or value).

    ``mode``: keep plans nothing, blank fills with spaces, value writes ``value`` padded to
    the same length (left out where it is longer).
    """
    from quarry.functions.rules import PATTERNS, java_bounds

    ident = F.col("value").rlike(java_bounds(PATTERNS["platform_id"]))
    encoder = F.lower("key").rlike("encoder|©too|©too") | F.col("value").rlike("Lavf|Lavc|x264|x265")
    kind = F.when(ident, "platform_id").when(encoder, "encoder")
    rows = items.withColumn("kind", kind).filter(F.col("kind").isNotNull() & (F.col("value_len") > 0))
    if mode == "keep":
        rows = rows.limit(0)
    text = F.rpad(F.lit("" if mode == "blank" else value or ""), F.col("value_len").cast("int"), F.lit(" "))
    rows = rows.filter(F.octet_length(F.lit(value or "")) <= F.col("value_len"))
    return rows.select("video_id", F.col("value_offset").alias("offset"), text.cast("binary").alias("data"), F.lit(None).cast("long").alias("zero_len"), "kind", F.col("key").alias("label"))


def sei_patches(messages: DataFrame, units: DataFrame, policy: str = "keep") -> DataFrame:
    """Same-length filler for SEI units: keep none, user-data (types 4 and 5), all, or uuid:<hex>."""
    if policy == "keep":
        chosen = messages.limit(0)
    elif policy == "all":
        chosen = messages
    elif policy.startswith("uuid:"):
        chosen = messages.filter(F.col("uuid") == policy[5:])
    else:
        chosen = messages.filter(F.col("type").isin(4, 5))
    marked = chosen.select("video_id", "sample_no", "offset").distinct().join(units.select("video_id", "sample_no", "offset", F.col("size").alias("n")), ["video_id", "sample_no", "offset"])
    filler = F.concat(F.lit(b"\x0c"), F.rpad(F.lit(b""), (F.col("n") - 2).cast("int"), F.lit(b"\xff")), F.lit(b"\x80"))
    return marked.filter("n >= 2").select("video_id", "offset", filler.alias("data"), F.lit(None).cast("long").alias("zero_len"), F.lit("sei").alias("kind"), F.lit("filler unit").alias("label"))


def sei_policy(policy: Column, transfer: Column) -> Column:
    """"auto" keeps messages of HDR video (PQ, HLG) and drops user data otherwise."""
    return F.when(policy != "auto", policy).when(transfer.isin("smpte2084", "arib-std-b67"), "keep").otherwise("user-data")


def zero_patches(spans: DataFrame, kind: str, a: str = "a", b: str = "b") -> DataFrame:
    """Zero fill of byte ranges; short ones carry their bytes, long ones a length."""
    n = F.col(b) - F.col(a)
    data = F.when(n < ZERO_FROM, F.rpad(F.lit(b""), n.cast("int"), F.lit(b"\x00")))
    return spans.filter(n > 0).select("video_id", F.col(a).alias("offset"), data.alias("data"), F.when(n >= ZERO_FROM, n).alias("zero_len"), F.lit(kind).alias("kind"), F.lit("zero fill").alias("label"))


def patch_faults(patches: DataFrame, lengths: DataFrame) -> DataFrame:
    """Patches that begin before an earlier one ends, or reach outside their file (``lengths``: video_id, length)."""
    spans = patches.withColumn("_end", F.col("offset") + patch_length())
    over = Window.partitionBy("video_id").orderBy("offset", "_end").rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("_reach", F.max("_end").over(over)).join(lengths, "video_id", "left")
    fault = F.when(F.col("_reach") > F.col("offset"), "overlap").when((F.col("offset") < 0) | (F.col("_end") > F.col("length")) | F.col("length").isNull(), "out_of_range")
    return marked.withColumn("fault", fault).filter("fault IS NOT NULL").select("video_id", "offset", "kind", "label", "fault")


def preview(files: DataFrame, patches: DataFrame) -> DataFrame:
    """``video_id, content``: contents as the plan would leave them, lengths unchanged; for files that fit a row.

    Patches are gathered by file, which bounds a group by the file's own length; a plan
    with a fault raises.
    """
    from pyspark.sql import types as T

    found = patch_faults(patches, files.select("video_id", F.octet_length("content").cast("long").alias("length")))
    if not found.isEmpty():
        raise ValueError("the plan has overlapping or out-of-range patches")
    gathered = patches.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("offset", "data", "zero_len"))).alias("_patches"))
    joined = files.select("video_id", "content").join(gathered, "video_id", "left")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content, plan in zip(batch["content"], batch["_patches"]):
                raw = bytearray(content)
                for p in plan if plan is not None else []:
                    data = bytes(int(p["zero_len"])) if p["zero_len"] == p["zero_len"] and p["zero_len"] is not None else bytes(p["data"])
                    raw[p["offset"] : p["offset"] + len(data)] = data
                out.append(bytes(raw))
            yield batch[["video_id"]].assign(content=out)

    return joined.mapInPandas(apply, T.StructType([T.StructField("video_id", T.StringType()), T.StructField("content", T.BinaryType())]))


def overlaid(content: Column, patch: Column, offset: Column) -> Column:
    """One same-length patch laid over a string or binary value, offset from 0."""
    return F.overlay(content, patch, (offset + 1).cast("int"), F.octet_length(patch))


#: Values of a block whose hashes are compared, and bytes up to which a value is compared in its row.
BLOCK, WHOLE = 4096, 1 << 20


#: Pairs of values that are compared, and whose runs go on, together.
_TOGETHER = 64


def diff_runs(old: DataFrame, new: DataFrame, keys: list[str], value: str, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """``keys, a, b, n``: inclusive runs of positions at which two texts or binary values differ.

    Values of at most ``whole`` bytes meet in a row.  Longer ones are cut into blocks of
    ``block`` characters or bytes; only the blocks' hashes meet at first, and only those
    that are unlike are opened and compared.  Runs that end at a block's border go on in the
    next.  Of unequal lengths the rest counts as differing; a null takes no part.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    text = isinstance(old.schema[value].dataType, T.StringType)
    unit = 4 if text else 1  # characters of one width, so that blocks are found without counting
    kinds = ", ".join(f"`{k}` {old.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, a long, b long"
    made = to_arrow_schema(T.StructType.fromDDL(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, _TOGETHER) for b in batches for k in range(0, b.num_rows, _TOGETHER)):
            at, starts, ends = [], [], []
            for k, (b, o, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_b", "_o", "_n")))):
                o, n = (np.frombuffer(v.encode("utf-32-le") if isinstance(v, str) else v, f"u{unit}") for v in (o, n))
                both, unequal = min(len(o), len(n)), np.ones(max(len(o), len(n)), bool)
                unequal[:both] = o[:both] != n[:both]
                edges = np.flatnonzero(np.diff(np.r_[False, unequal, False].astype(np.int8))) + b * block
                at.append(np.full(len(edges) // 2, k))
                starts.append(edges[::2])
                ends.append(edges[1::2])
            if at:
                named = batch.select(keys).take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*named.columns, pa.array(np.concatenate(starts), pa.int64()), pa.array(np.concatenate(ends), pa.int64())], schema=made)

    some = lambda df, name: df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias(name))
    size = F.octet_length(value)
    lengths = lambda df, name: df.filter(F.col(value).isNotNull()).select(*keys, size.alias(name))
    long = lengths(old, "_o").join(lengths(new, "_n"), keys).filter(F.greatest("_o", "_n") > whole).select(*keys)
    # the exchange that a join of large sides needs; small sides of one file are spread by it too
    short = some(old.filter(size <= whole), "_o").repartition(*keys).join(some(new.filter(size <= whole), "_n").repartition(*keys), keys)
    found = short.select(*keys, F.lit(0).alias("_b"), "_o", "_n").mapInArrow(rows, schema)
    if not (long := checkpointed(long)).isEmpty():
        pairs = _unlike_blocks(old.join(long, keys, "left_semi"), new.join(long, keys, "left_semi"), keys, value, block, unit)
        cut = stored(pairs.mapInArrow(rows, schema))
        border = (F.col("a") % block == 0) | (F.col("b") % block == 0)  # few a block; the others are whole
        found = found.unionByName(union(cut.filter(border), keys, width=64 * block)).unionByName(cut.filter(~border))
    return found.select(*keys, "a", (F.col("b") - 1).alias("b"), (F.col("b") - F.col("a")).alias("n"))


def _unlike_blocks(old: DataFrame, new: DataFrame, keys: list[str], value: str, block: int, unit: int) -> DataFrame:
    """``keys, _b, _o, _n``: the blocks of both sides whose hashes differ."""
    size = block * unit
    side = lambda df: df.select(*keys, (F.encode(value, "UTF-32") if unit > 1 else F.col(value)).alias("_v"))
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length("_v") / size).cast("int") - 1))
    piece = lambda i: F.substr("_v", i * size + 1, F.lit(size))
    prints = lambda df, name: side(df).select(*keys, F.transform(places, lambda i: F.sha2(piece(i), 256)).alias(name))
    both = prints(old, "_o").join(prints(new, "_n"), keys)
    every = F.sequence(F.lit(0), F.greatest(F.size("_o"), F.size("_n")) - 1)
    unlike = both.select(*keys, F.explode(F.filter(every, lambda i: ~F.get("_o", i).eqNullSafe(F.get("_n", i)))).alias("_b"))
    opened = lambda df, name: side(df).join(unlike, keys).select(*keys, "_b", piece(F.col("_b")).alias(name))
    return opened(old, "_o").join(opened(new, "_n"), [*keys, "_b"])


def byte_diff_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """``video_id, a, b, n`` for binary contents of equal length."""
    lengths = lambda df, name: df.select("video_id", F.octet_length("content").alias(name))
    odd = lengths(old, "o").join(lengths(new, "n"), "video_id").filter("o <> n").limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0].video_id}: lengths differ")
    return diff_runs(old, new, ["video_id"], "content")


def unplanned(diffs: DataFrame, patches: DataFrame) -> DataFrame:
    """Differing runs that planned patches, adjacent ones taken together, do not contain."""
    inner = diffs.select("video_id", "a", (F.col("b") + 1).alias("b"), "n")
    outer = patches.select("video_id", F.col("offset").alias("a"), (F.col("offset") + patch_length()).alias("b"))
    return not_contained(inner, union(outer, ["video_id"]), ["video_id"])


def stream_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Streams by (video, kind, ordinal) that are gone, added or changed in codec, size, rate or channels."""
    facts = ["codec_name", "width", "height", "r_frame_rate", "channels"]
    side = lambda df, p: df.select("video_id", "codec_type", "ordinal", *[F.col(c).alias(f"{p}_{c}") for c in facts], F.lit(True).alias(p))
    both = side(old, "old").join(side(new, "new"), ["video_id", "codec_type", "ordinal"], "full_outer")
    same = F.lit(True)
    for c in facts:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    state = F.when(F.col("new").isNull(), "gone").when(F.col("old").isNull(), "added").when(~same, "changed").otherwise("equal")
    return both.select("video_id", "codec_type", "ordinal", state.alias("state")).filter("state <> 'equal'")


def rewrite_report(plan: DataFrame, faults: DataFrame, unplanned_: DataFrame, changes: DataFrame) -> DataFrame:
    """``video_id, part, ok, n, bytes``: what a plan changes by kind of patch, and the verdict of each check.

    Checks: ``patch_faults``, ``unplanned`` and ``stream_changes``; a video of the plan without rows there passes.
    """
    patched = plan.groupBy("video_id", F.concat(F.lit("patch "), "kind").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(patch_length()).cast("long").alias("bytes"))
    videos = plan.select("video_id").distinct()

    def check(name: str, rows: DataFrame) -> DataFrame:
        found = videos.join(rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")), "video_id", "left")
        return found.select("video_id", F.lit(name).alias("part"), F.col("n").isNull().alias("ok"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("long").alias("bytes"))

    checks = check("plan", faults).unionByName(check("bytes", unplanned_)).unionByName(check("streams", changes))
    return patched.select("video_id", "part", F.lit(True).alias("ok"), "n", "bytes").unionByName(checks)


def duration_kept(old: Column, new: Column, encoded: bool = False) -> Column:
    return F.abs(new - old) <= F.lit(0.3 if encoded else 0.05)


def remux_choice(mode: Column, private_boxes: Column, clean: Column) -> Column:
    """Whether a rewrite would be asked for: always, never, or by need and only of clean files."""
    return F.when(mode == "always", True).when(mode == "never", False).otherwise((private_boxes > 0) & clean)


def regions_by_priority(manual: DataFrame, scanned: DataFrame, none: DataFrame) -> DataFrame:
    """Regions a person chose come first; videos in ``none`` have none; the scan's otherwise."""
    chosen = manual.join(none, "video_id", "left_anti")
    rest = scanned.join(manual.select("video_id").unionByName(none.select("video_id")).distinct(), "video_id", "left_anti")
    return chosen.unionByName(rest)


def region_layers(regions: DataFrame, manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Regions (video_id, idx) with ``layer``: the manifest's path, else the first found file by name."""
    listed = manifest.select("video_id", "idx", F.col("path").alias("_listed"))
    first = found.groupBy("video_id", "idx").agg(F.min("path").alias("_found"))
    both = regions.join(listed, ["video_id", "idx"], "left").join(first, ["video_id", "idx"], "left")
    return both.withColumn("layer", F.coalesce("_listed", "_found")).drop("_listed", "_found")
