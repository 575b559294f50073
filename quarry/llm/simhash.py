"""SimHash near-duplicates found through deletion-variant signatures.

Fingerprints link at two or fewer differing bits.  A fingerprint is cut into two
32-bit segments, so of two linked fingerprints one segment differs by at most one
bit.  Each segment is indexed once for every bit position with that bit wiped (a
one-wildcard variant): 64 keys a fingerprint.  An equality join on the keys brings
every linked pair together and each candidate is verified on all 64 bits.

Work is on distinct fingerprints, so exact copies never multiply.  A pair is kept
only under the first key that it shares.  A key with more than ``BUCKET`` distinct
fingerprints is not expanded into pairs: its members take the exact way of
``_ball_links``, where fingerprints at two or fewer bits share a value at one or
fewer bits from both, a key whose members are all linked and at most 65.

Components come from alternating large-star and small-star passes over the edges,
checkpointed each pass; no link or fingerprint goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed

#: Distinct fingerprints under one key up to which their pairs are listed and verified.
BUCKET = 64
#: Words in a shingle, and the seed of its 64-bit hash.
WORDS, SEED = 3, 42
_STEP = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a whole text; zero for null or a text without words."""
    parts = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = list(accumulate(map(len, parts), lambda a, b: a + b + 1))
    spans = zip([0] + [e + 1 for e in ends], islice(ends, words - 1, None))
    hashed = map(xxhash.xxh64_intdigest, (joined[a:b] for a, b in spans), repeat(SEED))
    total, ones = len(parts) - words + 1, np.zeros(64, np.int64)
    while len(block := np.fromiter(islice(hashed, _STEP), np.uint64)):
        bits = np.unpackbits(block.astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = [fingerprint(t) for t in batch.column(1).to_pylist()]
        signed = np.array(fp, np.uint64).view(np.int64) if fp else np.array([], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark_col: str | None = None) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's 64 bits as a signed long), one row per input row; and ``mark``, a column that goes along."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = [F.col(mark_col).cast("string").alias("mark")] if mark_col else []
    schema = f"doc_id {kind}, fp long" + (", mark string" if mark_col else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more).mapInArrow(_fingerprints, schema)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest id reachable over links, the row's own
    included.  Null and empty texts have fingerprint zero and link like any other.
    Repeated rows and ties share a component; rows with a null id take part and get
    the smallest non-null id of their component (null if it has none).  An empty
    table gives an empty result; other columns play no part.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    found = prints.join(_classes(prints, bucket), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(prints: DataFrame, bucket: int) -> DataFrame:
    """``fp, root, component_id``: each fingerprint's component, by its least fingerprint and its smallest id."""
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(checkpointed(links(classes.select("fp"), bucket)))
    named = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row of ``docs``, with all its columns, of each near-duplicate component: one that has the component's smallest id.

    Of several rows with that id in one component, the one with the least fingerprint stays
    (then the least hash of its text); rows that share an id but no component all stay, and
    of equal rows one does.  Rows with a null id cannot be named by a component: they stay,
    once for each distinct text.  An empty table gives an empty result.
    """
    named, nameless = docs.filter(F.col(id_col).isNotNull()), docs.filter(F.col(id_col).isNull())
    rows = named.withColumns({"__quarry_id": F.col(id_col), "__quarry_text": F.md5(F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")))})
    prints = checkpointed(fingerprints(rows, "__quarry_id", text_col, "__quarry_text"))
    least = prints.join(_classes(prints.select("doc_id", "fp"), bucket), "fp").filter("doc_id = component_id")
    stays = least.groupBy("root").agg(F.min(F.struct("fp", "mark", "doc_id")).alias("s")).select(F.col("s.doc_id").alias("__quarry_id"), F.col("s.mark").alias("__quarry_text"))
    key = ["__quarry_id", "__quarry_text"]
    kept = rows.join(stays.distinct(), key, "left_semi").dropDuplicates(key).drop(*key)
    return kept.unionByName(nameless.dropDuplicates([text_col]))


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def _variants(prints: DataFrame) -> DataFrame:
    """(key, fp): position p of 0..63 names the wildcard bit, and with it the segment that keeps its other 31 bits."""
    position = F.col("p")
    segment = F.when(position < 32, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    wiped = segment.bitwiseAND(F.bitwise_not(_bit(F.pmod(position, F.lit(32)))))
    return prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select((position.cast("long") * (1 << 32) + wiped).alias("key"), "fp")


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): every linked pair of distinct fingerprints, up to what connectivity needs within crowded keys."""
    crowd = Window.partitionBy("key")
    met = checkpointed(_variants(prints).withColumn("n", F.count(F.lit(1)).over(crowd)).filter("n > 1"))
    few = met.filter(F.col("n") <= bucket).select("key", "fp")
    x, low = F.col("a").bitwiseXOR(F.col("b")), F.lit(0xFFFFFFFF)
    low_x, high_x = x.bitwiseAND(low), F.shiftrightunsigned(x, 32)
    # the first key that both share: a position of the low segment if that differs by at most one bit, else of the high one
    lowest = lambda v: F.when(v == 0, F.lit(0)).otherwise(F.bit_count(v - 1))  # noqa: E731  of a power of two
    first = F.when(F.bit_count(low_x) <= 1, lowest(low_x)).otherwise(lowest(high_x) + 32)
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .filter((F.col("a") < F.col("b")) & (F.bit_count(x) <= 2) & (F.shiftrightunsigned("key", 32) == first))
        .select("a", "b")
    )
    return pairs.unionByName(_ball_links(met.filter(F.col("n") > bucket).select("fp").distinct()))


def _ball_links(prints: DataFrame) -> DataFrame:
    """Links among members of crowded keys, each to the least print that shares a value at one or fewer bits."""
    values = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.col("fp").bitwiseXOR(_bit(p))))
    near = prints.select("fp", F.explode(values).alias("value"))
    least = near.groupBy("value").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return near.join(least, "value").filter(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``edges``: the least node of its connected component.

    Large-star links each node's greater neighbours to its least neighbour, small-star
    its smaller ones; repeated in turn they end in stars (Kiveris et al., 2014).
    """
    now = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = checkpointed(large)
        to = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(to, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = checkpointed(small.filter("u <> v").distinct())
        if now.count() == after.count() and now.exceptAll(after).isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = after
