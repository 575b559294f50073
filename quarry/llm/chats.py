"""Chat formatting over a prefix tree: shared opening turns are emitted once.

Each conversation is one path of turns from a root.  Conversations are laid in the order
of their paths (a short digest of each turn, one after another), dealt into ranges of that
order, ties by id, so that neighbours share the longest openings and neither a popular first turn
nor a conversation with a thousand copies meets in one task.  A task walks its range and
merges each path with the one before it: turns already there are nodes that both pass
through, the others become new nodes, which is the tree's depth-first order.

A node's tokens are emitted once a sequence.  Its position ids go on from its parent's, so
siblings share positions; its attention intervals are the stretches of the sequence that
its ancestors hold, besides which a token sees its own node up to itself.  The texts of
assistant turns are under the loss mask.  A sequence closes at ``SEQUENCE`` tokens or
``MEMBERS`` conversations; the next one begins with the ancestors it needs.

The template marks turns by control strings and writes a backslash before each run of
backslashes and control string inside a text, so reading it back is exact.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE, MEMBERS = 8192, 4096
#: What opens and closes a turn of a role; any other role is named between the last three.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
NAMED = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
LEARNED = "assistant"
_CONTROL = "|".join(re.escape(m.strip()) for m in [*(m for pair in MARKS.values() for m in pair), *NAMED])
_INSIDE, _ESCAPED = re.compile(rf"(\\*)({_CONTROL})"), re.compile(rf"\\(\\*(?:{_CONTROL}))")
_TURN = re.compile(
    "|".join(rf"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items())
    + rf"|{re.escape(NAMED[0])}(?P<role>.*?){re.escape(NAMED[1])}(?P<text>.*?){re.escape(NAMED[2])}",
    re.DOTALL,
)

Turn = tuple[str, str]


def escaped(text: str) -> str:
    return _INSIDE.sub(r"\\\1\2", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def pieces(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the text itself, and what stands after it."""
    if role in MARKS:
        return MARKS[role][0], escaped(text), MARKS[role][1]
    return NAMED[0] + escaped(role) + NAMED[1], escaped(text), NAMED[2]


def formatted(turns: list[Turn]) -> str:
    return "".join("".join(pieces(*t)) for t in turns)


def parsed(conversation: str) -> list[Turn]:
    """The turns of a formatted conversation."""
    out = []
    for m in _TURN.finditer(conversation):
        kind = m.lastgroup if m.lastgroup in MARKS else None
        out.append((kind, unescaped(m[kind])) if kind else (unescaped(m["role"]), unescaped(m["text"])))
    return out


class _Coder:
    """A byte-level tokenizer whose special strings are ordinary text; ids decode to the same bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model, self.marks = Tokenizer.from_file(path), {}
        self.model.encode_special_tokens = True

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def mark(self, text: str) -> list[int]:
        if len(text) > 64:  # roles are short; no memory for others
            return self.ids(text)
        if (found := self.marks.get(text)) is None:
            if len(self.marks) > 1000:
                self.marks.clear()
            found = self.marks[text] = self.ids(text)
        return found

    def text(self, ids: list[int]) -> str:
        return self.model.decode(ids, skip_special_tokens=False)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
NODES = "array<struct<parent:int,start:int,end:int,position:int,attends:array<struct<start:int,end:int>>>>"
_NODE = pa.struct([("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("position", pa.int32()), ("attends", pa.list_(_SPAN))])


class _Sequence:
    """One sequence under construction; ``path`` holds the open nodes from the root down."""

    def __init__(self):
        self.ids: list[int] = []
        self.positions: list[int] = []
        self.nodes: list[dict] = []
        self.loss: list[dict] = []
        self.members: list[dict] = []
        self.path: list[tuple[Turn, int]] = []

    def shared(self, turns: list[Turn]) -> int:
        n = 0
        while n < min(len(turns), len(self.path)) and self.path[n][0] == turns[n]:
            n += 1
        return n

    def add(self, ident, turns: list[Turn], coded: list[tuple[list[int], list[int], list[int]]]) -> None:
        """A conversation whose last ``coded`` turns are new here."""
        del self.path[len(turns) - len(coded) :]
        for turn, (before, text, after) in zip(turns[len(self.path) :], coded):
            parent = self.path[-1][1] if self.path else -1
            start, at, attends = len(self.ids), 0, []
            if parent >= 0:
                up = self.nodes[parent]
                at = up["position"] + up["end"] - up["start"]
                attends = [dict(s) for s in up["attends"]]
                if attends and attends[-1]["end"] == up["start"]:
                    attends[-1]["end"] = up["end"]
                else:
                    attends.append({"start": up["start"], "end": up["end"]})
            self.ids += before + text + after
            self.positions += range(at, at + len(self.ids) - start)
            if turn[0] == LEARNED:
                self.loss.append({"start": start + len(before), "end": start + len(before) + len(text)})
            self.nodes.append({"parent": parent, "start": start, "end": len(self.ids), "position": at, "attends": attends})
            self.path.append((turn, len(self.nodes) - 1))
        self.members.append({"conv_id": ident, "node": self.path[-1][1]})


def _sequences(path: str, most: int, members: int, kind: pa.DataType) -> Callable:
    schema = pa.schema([("input_ids", pa.list_(pa.int32())), ("position_ids", pa.list_(pa.int32())), ("nodes", pa.list_(_NODE)), ("loss", pa.list_(_SPAN)), ("members", pa.list_(pa.struct([("conv_id", kind), ("node", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now = _Coder(path), _Sequence()

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"input_ids": now.ids, "position_ids": now.positions, "nodes": now.nodes, "loss": now.loss, "members": now.members}], schema)

        def coded(turns: list[Turn]) -> list[tuple[list[int], list[int], list[int]]]:
            return [(coder.mark(a), coder.ids(t), coder.mark(b)) for a, t, b in (pieces(*turn) for turn in turns)]

        for batch in batches:
            for ident, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                turns = [(r["role"], r["text"]) for r in rows.as_py()]
                there = now.shared(turns)
                new = coded(turns[there:])
                if now.members and (len(now.ids) + sum(map(len, sum(new, ()))) > most or len(now.members) >= members):
                    yield closed()
                    now = _Sequence()
                    new = coded(turns[:there]) + new
                now.add(ident, turns, new)
        if now.members:
            yield closed()

    return run


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turns``: the (role, text) pairs of each conversation by turn, then role, then text; nulls are empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    found = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return found.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_chats(found: DataFrame, tokenizer: str, most: int = SEQUENCE, members: int = MEMBERS) -> DataFrame:
    """``input_ids, position_ids, nodes, loss, members``: a row for each sequence of a prefix tree's nodes.

    Input is ``conversations``' result: one row a conversation, its turns one value.
    ``nodes`` give each node's parent, its tokens, its first position and its attention
    intervals; ``loss`` the tokens of assistant texts; ``members`` each conversation's last
    node.  ``tokenizer`` is a byte-level vocabulary file.  A conversation longer than
    ``most`` tokens is a sequence of its own.  Repeated turns are turns like others; copies
    of a conversation share all their nodes; a null id is a conversation like any other; an
    empty table gives an empty result.
    """
    kind = found.schema["conv_id"].dataType
    path = F.array_join(F.transform("turns", lambda t: F.substring(F.md5(F.concat(t["role"], F.lit("\n"), t["text"])), 1, 12)), "")
    laid = found.select("conv_id", "turns", path.alias("path"))
    laid = laid.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    made = _sequences(tokenizer, most, members, arrow)
    return laid.mapInArrow(made, f"input_ids array<int>, position_ids array<int>, nodes {NODES}, loss array<struct<start:int,end:int>>, members array<struct<conv_id:{kind.simpleString()},node:int>>")


def _read(path: str, kind: pa.DataType) -> Callable:
    schema = pa.schema([("conv_id", kind), ("formatted", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("learned", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(path)
        for batch in batches:
            for k in range(batch.num_rows):
                row, out = batch.slice(k, 1).to_pylist()[0], []
                starts = {s["start"]: s["end"] for s in row["loss"]}
                for m in row["members"]:
                    node = row["nodes"][m["node"]]
                    spans = [*node["attends"], {"start": node["start"], "end": node["end"]}]
                    text = coder.text([i for s in spans for i in row["input_ids"][s["start"] : s["end"]]])
                    learned = [coder.text(row["input_ids"][a : starts[a]]) for s in spans for a in range(s["start"], s["end"]) if a in starts]
                    turns = [{"role": r, "text": t} for r, t in parsed(text)]
                    out.append({"conv_id": m["conv_id"], "formatted": text, "turns": turns, "learned": "".join(map(unescaped, learned))})
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def read_back(sequences: DataFrame, tokenizer: str) -> DataFrame:
    """``conv_id, formatted, turns, learned`` of every member, from the tokens that its last node attends to."""
    kind = sequences.schema["members"].dataType.elementType["conv_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return sequences.mapInArrow(_read(tokenizer, arrow), f"conv_id {kind}, formatted string, turns array<struct<role:string,text:string>>, learned string")
