"""Token ids and counts that equal a public tokenizer's, at less than its cost.

Both encoders lean on one property: a tokenizer first splits a text into pre-tokens
and encodes each alone, so what a pre-token gives can be kept and used again.

* ``WholeTokenCounts`` (byte-level BPE): ``prove_whole_tokens`` works out, before any
  text is read, which vocabulary strings are a single pre-token that encodes alone as
  one token.  Pre-tokens of a text found in that set count 1; only the rest is merged,
  by the library's own model, and kept in a bounded memory.
* ``WordIds`` (BPE with word ends): ids of the distinct pieces between plain spaces and
  line feeds, which no pre-token crosses, for some megabytes of text at a time; nothing
  is kept from one to the next.

Vocabulary files are read on the executors from a path parameter, once a process.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries kept in a memory before it is emptied, and characters of an entry that is kept: together they bound its bytes.
MEMORY, LONGEST = 100_000, 64
#: Bytes of the texts whose distinct words are encoded together, and how many of those in one call.
TOGETHER, WORDS = 1 << 23, 20_000
#: Marks that, at a word's end, are one pre-token: all of ASCII but the apostrophe, which may begin one with letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKS = "(?P<marks>[" + re.escape(MARKS) + "]+)$"
#: Characters whose classes and lower-case letters every Unicode version of the libraries shares.
_LOWERED = r"^[\x{00}-\x{12F}\x{131}-\x{24F}]*$"
#: Characters whose letter, number and space classes they share: Latin, Greek, Cyrillic, Hebrew and Arabic letters, Devanagari, Thai, signs, kana, Han, Hangul, full-width forms, pictographs.
CLASSED = (
    (0x0000, 0x024F), (0x0370, 0x03FF), (0x0400, 0x052F), (0x05D0, 0x05EA), (0x0600, 0x06FF), (0x0900, 0x097F), (0x0E01, 0x0E5B), (0x1E00, 0x1FFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20AC),
    (0x2190, 0x23FF), (0x2500, 0x27BF), (0x3000, 0x303F), (0x3041, 0x30FF), (0x3400, 0x4DB5), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFFEE), (0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF),
)
_CLASSED = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in CLASSED) + "]")
#: The byte-level pre-token pattern of the vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: its own if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def lettered(text: str) -> str:
    if text.isascii() and text.isalnum():
        return text
    letters = byte_letters()
    return "".join(letters[b] for b in text.encode("utf-8", "replace"))


def _library(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def _special(vocabulary: str) -> re.Pattern | None:
    with open(vocabulary, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    return re.compile("|".join(map(re.escape, added))) if added else None


def prove_whole_tokens(vocabulary: str) -> frozenset[str]:
    """The strings that are one pre-token and that the vocabulary's merges turn into one token.

    The proof asks the model itself for every vocabulary entry: its bytes must be valid
    UTF-8, the pre-token pattern must take them in one piece, and the model must answer
    with that entry alone.
    """
    tokenizer, back = _library(vocabulary), {c: b for b, c in byte_letters().items()}
    split, proved = regex.compile(PRE_TOKEN), set()
    for entry, ident in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[c] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if _CLASSED.search(text) or (m := split.match(text)) is None or m.end() != len(text):
            continue
        if [t.id for t in tokenizer.model.tokenize(entry)] == [ident]:
            proved.add(text)
    return frozenset(proved)


class WholeTokenCounts:
    """Counts of byte-level BPE tokens; see the module's notes."""

    _made: dict[str, WholeTokenCounts] = {}

    @classmethod
    def of(cls, vocabulary: str) -> WholeTokenCounts:
        if vocabulary not in cls._made:
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def __init__(self, vocabulary: str):
        self.library, self.special = _library(vocabulary), _special(vocabulary)
        self.whole = dict.fromkeys(prove_whole_tokens(vocabulary), 1)
        self.split = regex.compile(PRE_TOKEN).findall
        self.merged: dict[str, int] = {}

    def merge(self, pre_token: str) -> int:
        """Tokens of a pre-token that is no whole token."""
        n = self.merged.get(pre_token)
        if n is None:
            if len(self.merged) >= MEMORY:
                self.merged.clear()
            n = len(self.library.model.tokenize(lettered(pre_token)))
            if len(pre_token) <= LONGEST:
                self.merged[pre_token] = n
        return n

    def count(self, text: str) -> int:
        # special strings and characters that Unicode versions class differently go to the library whole
        if (self.special and self.special.search(text)) or (not text.isascii() and _CLASSED.search(text)):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        whole, merge = self.whole, self.merge
        return sum([whole.get(p) or merge(p) for p in self.split(text)])


class WordIds:
    """Ids of a BPE vocabulary with word ends, as little-endian 32-bit bytes."""

    _made: dict[str, WordIds] = {}

    @classmethod
    def of(cls, vocabulary: str) -> WordIds:
        if vocabulary not in cls._made:
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = _library(vocabulary)
        # the same model over words that are pre-tokens already: no normaliser, no pattern
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[ident for entry, ident in vocab.items() if entry.endswith("</w>")]] = True

    def _wholes(self, chunks: pa.Array) -> pa.Array:
        ids = (self.library.encode(chunk, add_special_tokens=False).ids if chunk else [] for chunk in chunks.to_pylist())
        return pa.array([struct.pack(f"<{len(i)}I", *i) for i in ids], pa.large_binary())

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of runs of settled lower-case letters, each a pre-token of its own whose last id is a word end."""
        parts = []
        for at in range(0, len(words), WORDS):
            now = words.slice(at, WORDS)
            ids = np.array(self.plain.encode_batch_fast([" ".join(now.to_pylist())], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(now) or ends[-1] != 4 * len(ids):  # a vocabulary without some letter
                parts.append(self._wholes(now))
            else:
                parts.append(pa.Array.from_buffers(pa.large_binary(), len(now), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(ids)]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())

    def _chunks(self, chunks: pa.Array) -> pa.Array:
        word = pc.utf8_rtrim(chunks, MARKS)
        settled = pc.and_(pc.utf8_is_alpha(word), pc.match_substring_regex(word, _LOWERED))
        marked = pc.and_(settled, pc.greater(pc.binary_length(chunks), pc.binary_length(word)))
        # the vocabulary lower-cases; marks at the end are one further pre-token
        words = pc.if_else(settled, pc.utf8_lower(word), None).dictionary_encode()
        marks = pc.struct_field(pc.extract_regex(pc.if_else(marked, chunks, None), _MARKS), 0).dictionary_encode()
        tail = pc.coalesce(self._wholes(marks.dictionary).take(marks.indices), pa.scalar(b"", pa.large_binary()))
        met = pc.binary_join_element_wise(self._words(words.dictionary).take(words.indices), tail, pa.scalar(b"", pa.large_binary()))
        odd = pc.if_else(settled, None, chunks).dictionary_encode()
        return pc.coalesce(met, self._wholes(odd.dictionary).take(odd.indices))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text; texts of about ``TOGETHER`` bytes have their distinct words encoded together."""
        texts = texts.cast(pa.large_string()).fill_null("")
        group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // TOGETHER
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for a, b in zip(bounds, bounds[1:] if len(texts) else []):
            parts = pc.split_pattern(pc.replace_substring(texts.slice(a, b - a), "\n", " "), " ")
            chunks = parts.flatten().dictionary_encode()
            found = self._chunks(chunks.dictionary).take(chunks.indices)
            at = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)))
            _, starts, raw = found.buffers()  # values follow each other, so a text's ids are one piece
            ends = np.frombuffer(starts, np.int64)[at].tolist()
            raw = memoryview(raw or b"")
            for x, y in zip(ends, ends[1:]):
                yield bytes(raw[x:y])

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text])))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts equal the library's on whole texts, special strings handled as its default,
    without begin, end, truncation or padding.  Null counts as empty: no bytes, no
    tokens.  Repeated rows are counted each.  Other columns play no part.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = WholeTokenCounts.of(vocabulary)
        for batch in batches:
            yield batch[["doc_id", "n_bytes"]].assign(n_tokens=[counts.count(t or "") for t in batch["text"]])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = plain.mapInPandas(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
