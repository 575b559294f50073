"""Phrase collocation mining over compressed position bitmaps, as in SPAM.

Documents are cut into shards of bounded size, each of one language, in the tasks that
read them.  A shard numbers its words in order, with a blank place after every piece, and
holds for each word the bitmap of its places: a packed bit set for words at one place in
``DENSE`` or more, a sorted list of places for the others.  A phrase's bitmap marks where
its last word stands; shifted by one and ANDed with a word's bitmap it becomes that of the
phrase one word longer, and its popcount is how often the shard has it.  No phrase crosses
a blank.  Bit sets are ANDed with each other word by word; since every place has one word
at most, the AND with all listed words is taken at once, by looking up what stands at the
shifted places.  Phrases grow depth first from runs of first words, so a task holds the
bitmaps of one run at a time.

Passes over the shards, popcounts summed over them: words are counted; then pairs of
frequent words, then triples of frequent pairs, both by a hash; then all phrases whose
words, pairs and triples are frequent, by their text.  What a pass finds reaches the next
as a bit filter that may admit too much but never too little, so it only saves work: every
count used comes from the last pass, and is exact.  A filter has ``FILTER_BITS`` bits at
most, whatever the table's size.

What tasks have counted is dealt in buckets of hashes, as many as the words of the table
call for.  A task sends a bucket's hashes or texts in their order as one compressed block,
some three bytes a hash and a fraction of a text, and a bucket is added up in one call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, stored

LEAST, LONGEST, KEPT, HELD_IN = 30, 4, 2000, 80
#: Places in a shard, and the share of them from which a bitmap is a bit set.
SHARD, DENSE = 1 << 19, 64
#: Places of the phrases that are extended together.
RUN = 1 << 17
FILTER_BITS, BITS_A_KEY = 1 << 27, 16
#: Hashes whose counts a task adds up before it sends them.
COMBINED = 3 << 19
#: Bytes of phrases, texts with their counts, that a task adds up before it sends them.
COMBINED_BYTES = 48 << 20
#: Words of the table to a bucket, and the least number of buckets as a power of two.
BUCKET, BUCKET_BITS = 1 << 20, 6
#: Bits of a phrase's hash beyond those that number all words.
SPARE_BITS = 12
_BLANK, _NONE = 0, -1
_CUT = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\t", b"\n" * 9 + b" ")
_SHIFT = 13
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 32)]


class _Numbers(dict):
    """Word -> number from 1 on; a new word gets the next one."""

    def __init__(self):
        super().__init__({b"\n": _BLANK, b"": _NONE})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def word_numbers(text: str | None, numbers: _Numbers) -> np.ndarray:
    """The numbers of a text's words in order, pieces apart and the end marked by blanks."""
    parts = (text or "").encode("utf-8", "replace").lower().translate(_CUT).replace(b"\n", b" \n ").split(b" ")
    found = np.fromiter(map(numbers.__getitem__, parts), np.int32, len(parts))
    return np.append(found[found != _NONE], np.int32(_BLANK))


def _sealed(lang: str, numbers: _Numbers, texts: list[np.ndarray]) -> dict:
    """A shard's row: its words, their hashes and popcounts, and their bitmaps in compressed form."""
    sequence = np.concatenate(texts)
    counts = np.bincount(sequence, minlength=len(numbers) - 1)[1:]
    places = np.argsort(sequence, kind="stable")[len(sequence) - int(counts.sum()) :].astype(np.int32)
    words = [w for w in numbers if w not in (b"\n", b"")]
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8"))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    return {
        "lang": lang, "n": int(counts.sum()), "places": len(sequence),
        "words": pa.compress(b" ".join(words), "zstd", asbytes=True), "size": sum(map(len, words)) + max(0, len(words) - 1),
        "hash": hashes.view(np.int64), "count": counts.astype(np.int64), "bits": pa.compress(np.diff(places, prepend=np.int32(0)).tobytes(), "zstd", asbytes=True),
    }


SHARDS = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("places", pa.int64()), ("words", pa.binary()), ("size", pa.int64()), ("hash", pa.list_(pa.int64())), ("count", pa.list_(pa.int64())), ("bits", pa.binary())])


def _shards(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, list] = {}  # lang -> numbers, texts, places

        def seal(lang: str) -> pa.RecordBatch:
            numbers, texts, _ = open_.pop(lang)
            return pa.RecordBatch.from_pylist([_sealed(lang, numbers, texts)], SHARDS)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                now = open_.setdefault(lang, [_Numbers(), [], 0])
                now[1].append(word_numbers(text.as_py(), now[0]))
                now[2] += len(now[1][-1])
                if sum(o[2] for o in open_.values()) >= most:  # the largest goes, so a task holds one shard's worth in all
                    yield seal(max(open_, key=lambda k: open_[k][2]))
        for lang in list(open_):
            yield seal(lang)

    return run


def joined_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of word hashes."""
    x = first * _ODD[0] + second
    x = (x ^ (x >> _ODD[2])) * _ODD[1]
    return x ^ (x >> _ODD[2])


class Bits:
    """A set of 64-bit hashes as a bit filter of two probes: no false negatives."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.mask = cells, np.uint64(len(cells) * 64 - 1)

    def admits(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for probe in (hashes, hashes ^ (hashes >> np.uint64(_SHIFT))):
            at = probe & self.mask
            found &= (self.cells[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return found


def bit_filter(keys: DataFrame, column: str, most_bits: int = FILTER_BITS) -> np.ndarray:
    """The cells of ``Bits`` over a column of hashes: at most ``most_bits`` / 64 of them reach the driver."""
    n, bits = keys.count(), 1 << 10
    while bits < min(most_bits, n * BITS_A_KEY):
        bits *= 2
    probes = keys.select(F.explode(F.array(F.col(column), F.col(column).bitwiseXOR(F.shiftrightunsigned(column, _SHIFT)))).alias("p")).select(F.col("p").bitwiseAND(bits - 1).alias("p"))
    cells = probes.groupBy(F.shiftright("p", 6).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int"))).alias("mask"))
    found, out = cells.toArrow(), np.zeros(bits // 64, np.int64)
    out[found["cell"].to_numpy()] = found["mask"].to_numpy()
    return out.view(np.uint64)


class Shard:
    """Bitmaps of the admitted words of one shard."""

    def __init__(self, row: dict, words: Bits):
        counts, n = np.asarray(row["count"], np.int64), row["places"]
        places = np.cumsum(np.frombuffer(pa.decompress(row["bits"], 4 * int(counts.sum()), "zstd"), np.int32), dtype=np.int32)
        self.hashes = np.asarray(row["hash"], np.int64).view(np.uint64)
        admitted = words.admits(self.hashes)
        of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        stays = admitted[of]
        self.n, self.words, self.counts = n, np.flatnonzero(admitted).astype(np.int32), counts
        self.places, of = places[stays], of[stays]
        self.starts = np.searchsorted(of, self.words)
        dense = admitted & (counts * DENSE >= n)
        self.dense = {int(w): _packed(self.of(w), n) for w in np.flatnonzero(dense)}
        listed = ~dense[of]
        self.listed, self.listed_words = self.places[listed], of[listed]
        self.stands = np.full(n + 1, _NONE, np.int32)  # the admitted word at a place
        self.stands[self.places] = of

    def of(self, word: int) -> np.ndarray:
        k = int(np.searchsorted(self.words, word))
        return self.places[self.starts[k] : self.starts[k] + self.counts[word]]


def _packed(places: np.ndarray, n: int) -> np.ndarray:
    bits = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")).astype(np.int32)


def _shifted(bits: np.ndarray) -> np.ndarray:
    out = bits << np.uint64(1)
    out[1:] |= bits[:-1] >> np.uint64(63)
    return out


#: Whether phrases, a row of words each, may be frequent, told from their last words.
Admits = Callable[[np.ndarray], np.ndarray]
#: Phrases of one length: their words (a row each), popcounts, and their places one after another.
Grown = tuple[np.ndarray, np.ndarray, np.ndarray]


def _extended(shard: Shard, words: np.ndarray, counts: np.ndarray, places: np.ndarray, admits: Admits) -> Grown:
    """Listed phrases shifted and ANDed with every word at once."""
    of, moved = np.repeat(np.arange(len(words)), counts), places + 1
    found = shard.stands[moved]
    met = found >= 0
    of, found, moved = of[met], found[met], moved[met]
    key = of * np.int64(len(shard.hashes)) + found
    order = np.argsort(key, kind="stable")
    key, moved = key[order], moved[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(key)])
    longer = np.column_stack([words[key[first] // len(shard.hashes)], (key[first] % len(shard.hashes)).astype(np.int32)])
    stays = admits(longer)
    return longer[stays], n[stays], moved[np.repeat(stays, n)]


def _dense_extended(shard: Shard, words: np.ndarray, bits: np.ndarray, admits: Admits) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[Grown]]:
    """A phrase's bit set shifted and ANDed with the bit sets, and tested at the places of the listed words."""
    moved, sets, lists = _shifted(bits), [], []
    one = lambda w: np.append(words, np.int32(w))
    for w, other in shard.dense.items():
        both = moved & other
        n = int(np.bitwise_count(both).sum())
        if n and admits(one(w)[None])[0]:
            if n * DENSE >= shard.n:
                sets.append((one(w), both))
            else:
                lists.append((one(w)[None], np.array([n]), _unpacked(both)))
    cell = shard.listed >> 6
    hit = (moved[cell] >> (shard.listed & 63).astype(np.uint64)) & np.uint64(1) > 0
    found, places = shard.listed_words[hit], shard.listed[hit]  # in the order of words
    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
    n, w = np.diff(np.r_[first, len(found)]), found[first]
    longer = np.column_stack([np.repeat(words[None], len(w), axis=0), w])
    stays = admits(longer)
    lists.append((longer[stays], n[stays], places[np.repeat(stays, n)]))
    return sets, lists


def grow(shard: Shard, longest: int, admits: Admits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, popcounts) of every phrase of up to ``longest`` admitted words that is admitted at each of its lengths, depth first."""

    def listed(words: np.ndarray, counts: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(words):
            return
        yield words, counts
        if words.shape[1] == longest:
            return
        ends = np.cumsum(counts)
        cuts = np.unique(np.searchsorted(ends, np.arange(RUN, int(ends[-1]), RUN)) + 1) if len(ends) else []
        for a, b in zip([0, *cuts], [*cuts, len(words)]):
            if a < b:
                yield from listed(*_extended(shard, words[a:b], counts[a:b], places[(ends[a] - counts[a]) : ends[b - 1]], admits))

    def packed(words: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield words[None], np.array([int(np.bitwise_count(bits).sum())])
        if len(words) < longest:
            sets, lists = _dense_extended(shard, words, bits, admits)
            for s in sets:
                yield from packed(*s)
            for part in lists:
                yield from listed(*part)

    for w, bits in shard.dense.items():
        yield from packed(np.array([w], np.int32), bits)
    rest = shard.words[~np.isin(shard.words, list(shard.dense))]
    yield from listed(rest[:, None], shard.counts[rest], shard.listed)


def _read(batches: Iterator[pa.RecordBatch], words: Bits) -> Iterator[tuple[dict, Shard]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            row = {name: v.values.to_numpy() if isinstance(v, pa.ListScalar) else v.as_py() for name, v in row.items()}
            yield row, Shard(row, words)


def _together(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``rows`` or more, for some phrases come one by one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _summed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    h, n = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in range(2))
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(np.add.reduceat(n, first))], ["h", "n"])


def _combined(batches: Iterator[pa.RecordBatch], most: int = COMBINED, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """``h, n`` added up by ``h`` over up to ``most`` rows: a task's sums are not kept on the heap."""
    held: list[pa.RecordBatch] = []
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for whole in held:
            yield from (whole.slice(k, rows) for k in range(0, whole.num_rows, rows))

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            held = [_summed(held)]
            size = held[0].num_rows
            if 2 * size > most:
                yield from sent()
                held, size = [], 0
    held = [_summed(held)] if size else []
    yield from sent()


def _squeezed(numbers: np.ndarray) -> bytes:
    """64-bit numbers in compressed form, byte by byte of all: the high ones are alike."""
    return pa.compress(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _restored(squeezed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(squeezed, 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(n)


def _parts(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of a bucket starts and ends."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]))


def _hash_blocks(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """``h, n`` in the order of ``h`` as a row for each bucket, the bits of ``h`` from ``shift`` on."""
    for batch in batches:
        h, n = (c.to_numpy() for c in batch.columns)
        bucket = (h.view(np.uint64) >> np.uint64(shift)).astype(np.int32)
        rows = [{"bucket": int(bucket[a]), "size": b - a, "hashes": _squeezed(np.diff(h[a:b], prepend=np.int64(0))), "counts": _squeezed(n[a:b])} for a, b in _parts(bucket)]
        yield pa.RecordBatch.from_pylist(rows, HASH_BLOCKS)


def _frequent_hashes(least: int) -> Callable[[pa.Table], pa.Table]:
    """The hashes of a bucket's blocks whose counts come to ``least`` or more."""

    def run(blocks: pa.Table) -> pa.Table:
        _, sizes, hashes, counts = (c.to_pylist() for c in blocks.columns)
        h, n = np.concatenate([np.cumsum(_restored(*b)) for b in zip(hashes, sizes)]), np.concatenate([_restored(*b) for b in zip(counts, sizes)])
        whole = _summed([pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])])
        return pa.table({"h": whole.column("h").filter(pc.greater_equal(whole.column("n"), least))})

    return run


def _texts_summed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """``phrase, h, n`` added up by ``phrase``."""
    whole = pa.Table.from_batches(batches).group_by("phrase", use_threads=False).aggregate([("h", "min"), ("n", "sum")])
    whole = whole.select(["phrase", "h_min", "n_sum"]).rename_columns(["phrase", "h", "n"])
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in whole.columns], ["phrase", "h", "n"])


def _text_blocks(lang: str, phrases: pa.RecordBatch, shift: int) -> pa.RecordBatch:
    """A language's ``phrase, h, n`` as a row for each bucket, its texts in their order."""
    bucket = pa.array((phrases.column("h").to_numpy().view(np.uint64) >> np.uint64(shift)).astype(np.int32))
    order = pc.sort_indices(pa.table({"bucket": bucket, "phrase": phrases.column("phrase")}), sort_keys=[("bucket", "ascending"), ("phrase", "ascending")])
    bucket, n, texts, rows = bucket.take(order).to_numpy(), phrases.column("n").take(order).to_numpy(), phrases.column("phrase").take(order).to_pylist(), []
    for a, b in _parts(bucket):
        text = "\n".join(texts[a:b]).encode("utf-8")  # no phrase crosses a line
        rows.append({"bucket": int(bucket[a]), "lang": lang, "size": b - a, "bytes": len(text), "phrases": pa.compress(text, "zstd", asbytes=True), "counts": _squeezed(n[a:b])})
    return pa.RecordBatch.from_pylist(rows, TEXT_BLOCKS)


def _combined_texts(found: Iterator[tuple[str, pa.RecordBatch]], shift: int, most: int = COMBINED_BYTES) -> Iterator[pa.RecordBatch]:
    """Blocks of what languages' ``phrase, h, n`` come to, added up over up to ``most`` bytes."""
    held: dict[str, list[pa.RecordBatch]] = {}
    size = 0
    for lang, batch in found:
        held.setdefault(lang, []).append(batch)
        size += batch.nbytes
        if size >= most:
            held = {k: [_texts_summed(each)] for k, each in held.items()}
            size = sum(each[0].nbytes for each in held.values())
            if 2 * size > most:
                yield from (_text_blocks(k, each[0], shift) for k, each in held.items())
                held, size = {}, 0
    yield from (_text_blocks(k, _texts_summed(each), shift) for k, each in held.items())


def _frequent_texts(least: int) -> Callable[[pa.Table], pa.Table]:
    """``lang, phrase, k, f`` of a bucket's phrases that its blocks count ``least`` times or more."""

    def run(blocks: pa.Table) -> pa.Table:
        held: dict[str, list[pa.RecordBatch]] = {}
        for block in blocks.to_pylist():
            texts = pa.array(pa.decompress(block["phrases"], block["bytes"], "zstd", asbytes=True).decode("utf-8").split("\n"), pa.string())
            n = pa.array(_restored(block["counts"], block["size"]))
            held.setdefault(block["lang"], []).append(pa.RecordBatch.from_arrays([texts, n, n], ["phrase", "h", "n"]))
        out = []
        for lang, each in held.items():
            whole = _texts_summed(each)
            whole = whole.filter(pc.greater_equal(whole.column("n"), least))
            k = pc.add(pc.count_substring(whole.column("phrase"), " "), 1).cast(pa.int32())
            out.append(pa.RecordBatch.from_arrays([pa.array([lang] * whole.num_rows, pa.string()), whole.column("phrase"), k, whole.column("n")], ["lang", "phrase", "k", "f"]))
        return pa.Table.from_batches(out)

    return run


def _hashes(shard: Shard, words: np.ndarray, mask: int) -> np.ndarray:
    """A hash of phrases, a row of words each, of as many bits as ``mask``."""
    out = shard.hashes[words[:, 0]]
    for k in range(1, words.shape[1]):
        out = joined_hash(out, shard.hashes[words[:, k]])
    return out & np.uint64(mask)


def _known(shard: Shard, filters: list[Bits], mask: int) -> Admits:
    """Admits phrases whose last words, as many as a filter is for, are in it: ``filters`` are for pairs, triples, ..."""

    def admits(words: np.ndarray) -> np.ndarray:
        out = np.ones(len(words), bool)
        for size, known in enumerate(filters, 2):
            if words.shape[1] >= size and len(words):
                out[out] = known.admits(_hashes(shard, words[out][:, -size:], mask))
        return out

    return admits


HASH_BLOCKS = pa.schema([("bucket", pa.int32()), ("size", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
TEXT_BLOCKS = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("size", pa.int32()), ("bytes", pa.int64()), ("phrases", pa.binary()), ("counts", pa.binary())])


def _hash_counts(sent: list, size: int, mask: int, shift: int) -> Callable:
    """Blocks of hashes and counts of phrases of ``size`` words that the filters ``sent`` so far admit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, *filters = (Bits(f.value) for f in sent)
        for _, shard in _read(batches, words):
            for found, n in grow(shard, size, _known(shard, filters, mask)):
                if found.shape[1] == size:
                    yield pa.RecordBatch.from_arrays([pa.array(_hashes(shard, found, mask).view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return lambda batches: _hash_blocks(_combined(_together(run(batches))), shift)


def _phrase_counts(sent: list, longest: int, mask: int, shift: int) -> Callable:
    """Blocks of texts and counts of the phrases that the filters ``sent`` admit, and of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
        words, *filters = (Bits(f.value) for f in sent)
        for row, shard in _read(batches, words):
            names = pa.array(pa.decompress(row["words"], row["size"], "zstd", asbytes=True).decode("utf-8").split(" "), pa.string())
            yield from ((row["lang"], batch) for batch in _together(texts(shard, names, filters)))

    def texts(shard: Shard, names: pa.Array, filters: list[Bits]) -> Iterator[pa.RecordBatch]:
        for found, n in grow(shard, longest, _known(shard, filters, mask)):
            text = pc.binary_join_element_wise(*[names.take(pa.array(found[:, k])) for k in range(found.shape[1])], " ")
            h = _hashes(shard, found, (1 << 64) - 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([text, pa.array(h), pa.array(n.astype(np.int64))], ["phrase", "h", "n"])

    return lambda batches: _combined_texts(run(batches), shift)


def _part(k: Column, first: bool) -> Column:
    """A phrase's first k words, or what follows them."""
    head = F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)
    return head if first else F.substr("phrase", F.length(head) + 2)


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(``lang, n`` of all words; ``lang, phrase, k, f`` of the phrases of up to ``longest`` words met ``least`` times or more)."""
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    shards = stored(source.mapInArrow(_shards(shard), "lang string, n long, places long, words binary, size long, hash array<long>, count array<long>, bits binary"))
    words = shards.select(F.explode(F.arrays_zip("hash", "count")).alias("w")).select(F.col("w.hash").alias("h"), F.col("w.count").alias("n"))
    words = words.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h")
    sent = [sc.broadcast(bit_filter(checkpointed(words), "h"))]
    total = shards.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mask = (1 << min(64, int(total).bit_length() + SPARE_BITS)) - 1
    bucket_bits = max(BUCKET_BITS, (int(total) // BUCKET).bit_length())
    bitmaps = shards.select("lang", "places", "words", "size", "hash", "count", "bits")
    for size in range(2, longest):
        run = _hash_counts(list(sent), size, mask, mask.bit_length() - bucket_bits)
        counted = bitmaps.select("places", "hash", "count", "bits").mapInArrow(run, "bucket int, size int, hashes binary, counts binary")
        sent.append(sc.broadcast(bit_filter(checkpointed(counted.groupBy("bucket").applyInArrow(_frequent_hashes(least), "h long")), "h")))
    counted = bitmaps.mapInArrow(_phrase_counts(sent, longest, mask, 64 - bucket_bits), "bucket int, lang string, size int, bytes long, phrases binary, counts binary")
    phrases = counted.groupBy("bucket").applyInArrow(_frequent_texts(least), "lang string, phrase string, k int, f long")
    return shards.groupBy("lang").agg(F.sum("n").alias("n")), stored(phrases)


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = LEAST,
    longest: int = LONGEST,
    kept: int = KEPT,
    held_in: int = HELD_IN,
    shard: int = SHARD,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``kept`` strongest phrases of 2 to ``longest`` words.

    A phrase met a times, cut into parts met l and r times, scores floor(2000000 a / (l + r));
    of its cuts the lowest counts, then the earliest.  Phrases that ``held_in`` percent or
    more of the time stand inside one longer candidate are left out.  Null texts count as
    empty and a null language is ``und``; repeated rows count as often as they occur; an
    empty table gives an empty result; other columns play no part.  A language's rank is
    worked out over ranges of the order, so it may hold any share of the rows.
    """
    totals, found = counts(docs, lang_col, text_col, least, longest, shard)
    candidates = found.filter("k > 1")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), _part(F.col("cut"), side == "l").alias("part")) for side in "lr"])).alias("s")
    asked = candidates.select("lang", "phrase", "f", cut).select("lang", "phrase", "f", "cut", sides).select("lang", "phrase", "f", "cut", "s.side", "s.part")
    met = asked.join(found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of")), ["lang", "part"])
    side = lambda k, s: F.max(F.when((F.col("cut") == k) & (F.col("side") == s), F.col("of")))
    parts = met.groupBy("lang", "phrase", "f").agg(*[side(k, s).alias(f"{s}{k}") for k in range(1, longest) for s in "lr"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = lambda k: F.expr(f"(cast(2000000 as decimal(7,0)) * cast(f as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    each = F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)])
    scored = parts.select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.filter(each, lambda x: x.isNotNull())).alias("best"))
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda start: F.array_join(F.slice(F.split("phrase", " "), start, size), " ")))))
    around = candidates.filter("k > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    free = scored.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (wide("around") * 100 < wide("a") * held_in))
    free = free.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    return _first(free, kept).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first(rows: DataFrame, kept: int) -> DataFrame:
    """``rows`` with ``rank`` in their language, the first ``kept``: counted over ranges of the whole order, none of which is a language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    laid = checkpointed(rows.repartitionByRange("lang", *order).withColumn("range", F.spark_partition_id()))
    sizes = laid.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("lang", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead")).filter(F.col("ahead") < kept)  # a row a range
    within = F.row_number().over(Window.partitionBy("lang", "range").orderBy(*order))
    near = laid.join(offsets, ["lang", "range"])
    return near.withColumn("rank", (within + F.col("ahead")).cast("long")).filter(F.col("rank") <= kept).drop("range", "ahead")
