import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import clashing, documents, prose
from pyspark.sql import functions as F

from quarry.llm import chats, negatives, phrases, queries

CODER = public_tokenizers.path(queries.BYTE_BPE)


def brute_phrases(rows, least, longest=4, kept=2000, held_in=80):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().lower().decode()):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    around = defaultdict(int)
    for (lang, p), v in f.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                around[lang, p[i : i + size]] = max(around[lang, p[i : i + size]], v)
    found = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and 100 * around[lang, p] < held_in * a:
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, each in found.items() for rank, (s, a, p, left, right) in enumerate(sorted(each)[:kept], 1))


def mined(df, **parameters):
    return sorted(map(tuple, phrases.collocations(df, **parameters).collect()))


def test_phrases_are_brute_force(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([3, 40, 300])) + rng.choice([" New York City, ", " new york\ncity ", " É\u00a0x y", "\ta  b\t b a"]) for _ in range(60)]
    texts += [None, "", " ", ".,;", "word", "the the the the the " * 40, "x" * 5000, *["same line of text here"] * 9]
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    frame = clashing(documents(spark, texts, lang=langs).repartition(3), "n", "h", "k", "f", "phrase", "rank", "size", "places")
    want = brute_phrases(zip(langs, texts), 4)
    assert len(want) > 300 and {len(w[2].split(" ")) for w in want} == {2, 3, 4}
    assert mined(frame, least=4) == want
    assert mined(frame, least=4, shard=100) == want  # many shards, most words as bit sets
    assert mined(frame, least=4, kept=7) == brute_phrases(zip(langs, texts), 4, kept=7)
    assert mined(frame.limit(0)) == [] and mined(documents(spark, [None, "", "a b"])) == []


def test_phrases_across_words_of_a_run(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RUN", 7)
    rng = random.Random(8)
    texts = [prose(rng, 200) for _ in range(4)]
    numbers = phrases._Numbers()
    row = phrases._sealed("en", numbers, [phrases.word_numbers(t, numbers) for t in texts])
    shard = phrases.Shard(row, phrases.Bits(np.full(16, 2**64 - 1, np.uint64)))
    names = [w for w in numbers if w not in (b"\n", b"")]
    got = Counter({b" ".join(names[w] for w in p).decode(): int(c) for words, n in phrases.grow(shard, 3, lambda words: np.ones(len(words), bool)) for p, c in zip(words, n)})
    want = Counter()
    for t in texts:
        for piece in re.split("[.,]", t):
            w = piece.split()
            want.update(" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got == want


@pytest.mark.parametrize("most", [50, 10_000])
def test_a_task_adds_up_its_counts(most):
    rng = np.random.default_rng(5)
    batches = [pa.RecordBatch.from_arrays([pa.array(rng.integers(-40, 40, 30)), pa.array(rng.integers(1, 9, 30))], ["h", "n"]) for _ in range(40)]
    want, got, sent = Counter(), Counter(), 0
    for b in batches:
        for h, n in zip(*(c.to_pylist() for c in b.columns)):
            want[h] += n
    for b in phrases._combined(iter(batches), most, 7):
        assert b.num_rows <= 7
        for h, n in zip(*(c.to_pylist() for c in b.columns)):
            got[h] += n
            sent += 1
    assert got == want
    assert sent == len(want) if most > 1200 else len(want) < sent <= 1200
    assert list(phrases._combined(iter([]), most)) == []


def shuffled_bytes(spark):
    """Bytes that the stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_counts_are_sent_in_few_bytes(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(20_000)) for _ in range(4)]
    pairs = {p for t in texts for w in [t.split(" ")] for p in zip(w, w[1:])}
    frame = documents(spark, texts, lang=["en"] * 4).repartition(1).checkpoint()
    before = shuffled_bytes(spark)
    found = phrases.counts(frame)[1]
    assert found.filter("k = 1").count() == 300
    assert len(pairs) > 50_000 and shuffled_bytes(spark) - before < 4 * len(pairs)


@pytest.mark.parametrize("bits", [27, 40, 64])
def test_blocks_of_hashes_lose_nothing(bits):
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 2**64, 30_000, dtype=np.uint64) >> np.uint64(64 - bits)
    want, blocks = Counter(), []
    for _ in range(3):  # three tasks
        h, n = rng.choice(pool, 20_000).view(np.int64), rng.integers(1, 2**40, 20_000)
        for k, v in zip(h.tolist(), n.tolist()):
            want[k] += v
        batch = pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])
        blocks += phrases._hash_blocks(phrases._combined(iter([batch]), rows=3000), bits - 6)
    dealt, got = pa.Table.from_batches(blocks), []
    for bucket in set(dealt["bucket"].to_pylist()):
        found = phrases._frequent_hashes(2**40)(dealt.filter(pa.compute.equal(dealt["bucket"], bucket)))["h"].to_pylist()
        assert all((h & 2**64 - 1) >> (bits - 6) == bucket for h in found)
        got += found
    assert len(set(dealt["bucket"].to_pylist())) == 64 and sorted(got) == sorted(h for h, n in want.items() if n >= 2**40)


@pytest.mark.parametrize("most", [2000, 10_000_000])
def test_blocks_of_phrases_lose_nothing(most):
    rng = random.Random(9)
    words = ["a", "é\u00a0x", "\u2028", "語", "'", "\x00", "x" * 300, "b"]
    found, want = [], Counter()
    for _ in range(300):
        lang = rng.choice(["en", "a\nb", ""])
        texts = list({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(20)})
        n = [rng.randint(1, 9) for _ in texts]
        want.update({(lang, t, t.count(" ") + 1): v for t, v in zip(texts, n)})
        h = [hash((lang, len(t))) for t in texts]  # many texts of one hash stay apart
        found.append((lang, pa.RecordBatch.from_arrays([pa.array(texts), pa.array(h, pa.int64()), pa.array(n, pa.int64())], ["phrase", "h", "n"])))
    dealt, got = pa.Table.from_batches(phrases._combined_texts(iter(found), 58, most)), []
    assert (sum(dealt["size"].to_pylist()) == len(want)) == (most > 2000)
    for bucket in set(dealt["bucket"].to_pylist()):
        got += [tuple(r.values()) for r in phrases._frequent_texts(20)(dealt.filter(pa.compute.equal(dealt["bucket"], bucket))).to_pylist()]
    assert sorted(got) == sorted((*k, v) for k, v in want.items() if v >= 20) and len(got) > 50


def test_bit_filter_never_misses(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**63), 2**63, 500)
    cells = phrases.bit_filter(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h")
    assert phrases.Bits(cells).admits(keys.view(np.uint64)).all()
    assert phrases.Bits(cells).admits(rng.integers(-(2**63), 2**63, 10_000).view(np.uint64)).mean() < 0.1
    small = phrases.bit_filter(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h", most_bits=1024)
    assert len(small) == 16 and phrases.Bits(small).admits(keys.view(np.uint64)).all()


ODD = ["", " ", "\\", "end\\", "\\\\", "</s>", "\\</s>", "\\\\[INST] x", "<<SYS>><</SYS>>", "<</s>", "[ROLE] r [TEXT] t [/ROLE]", "[INST] [/INST]", " </s>", "a\nb", "é語\U0001f600", "<|endoftext|>", "[INST", "<s>" * 3]


def test_template_is_reversible():
    rng = random.Random(4)
    parts = [*ODD, "\\", " ", "[", "]", "<", ">", "/", "s", "INST"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[TEXT]", "a [TEXT] b"]), "".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(1, 5))]
        assert chats.parsed(chats.formatted(turns)) == turns


def chat_rows(rng):
    openings = [[("system", "be brief"), ("user", "hello")], [("user", "hello")], [("system", "be brief"), ("user", "bye"), ("assistant", "ok ok")]]
    rows, want = [], {}
    for c in range(120):
        turns = list(rng.choice(openings)) if c % 3 else []
        turns += [(rng.choice(["user", "assistant", "tool", None]), rng.choice([*ODD, None, prose(rng, 30)])) for _ in range(rng.randrange(0 if turns else 1, 5))]
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
        want[c] = [(r or "", t or "") for r, t in turns]
    long = [("user", prose(rng, 3000)), ("assistant", prose(rng, 3000))]
    rows += [(500, t, *turn) for t, turn in enumerate(long)]
    want[500] = long
    for c in range(600, 640):  # copies of one conversation
        rows += [(c, t, *turn) for t, turn in enumerate(long[:1] + [("assistant", "yes")])]
        want[c] = long[:1] + [("assistant", "yes")]
    return rows, want


CHATS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("most,members", [(chats.SEQUENCE, chats.MEMBERS), (300, 5)])
def test_chats_read_back(spark, most, members):
    rows, want = chat_rows(random.Random(9))
    random.Random(1).shuffle(rows)
    frame = clashing(spark.createDataFrame(rows, CHATS), "turns", "nodes", "path", "members")
    made = chats.format_chats(chats.conversations(frame), CODER, most, members).cache()
    got = {r.conv_id: r for r in chats.read_back(made, CODER).collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    assert all(r.learned == "".join(t for role, t in want[c] if role == "assistant") for c, r in got.items())
    assert all(r.formatted == chats.formatted(want[c]) for c, r in got.items())
    paths, stands = {tuple(t[: k + 1]) for t in want.values() for k in range(len(t))}, 0
    for s in made.collect():
        assert len(s.input_ids) == len(s.position_ids) and len(s.members) <= members
        assert len(s.input_ids) <= most or len({m.node for m in s.members}) == 1
        stands += len(s.nodes)
        for n in s.nodes:
            above, up = [], n
            while up.parent >= 0:
                up = s.nodes[up.parent]
                above.append((up.start, up.end))
            assert sorted(k for a in n.attends for k in range(a.start, a.end)) == sorted(k for a, b in above for k in range(a, b))
            assert s.position_ids[n.start : n.end] == list(range(n.position, n.position + n.end - n.start)) and n.position == sum(b - a for a, b in above)
    parts = made.rdd.getNumPartitions()
    if most == chats.SEQUENCE:  # one sequence a range here, so a node stands once, but for the ranges' first paths
        assert len(paths) <= stands <= len(paths) + 4 * (parts + 4)
    assert chats.format_chats(chats.conversations(frame.limit(0)), CODER).count() == 0


def test_repeated_and_null_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "first"), (None, 0, "assistant", "x"), (1, 0, "user", "a")]
    made = chats.format_chats(chats.conversations(spark.createDataFrame(rows, CHATS)), CODER)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chats.read_back(made, CODER).collect()}
    assert got == {1: [("user", "first"), ("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "x")]}


def test_contract_of_chats(spark, tmp_path):
    rows, want = chat_rows(random.Random(10))
    spark.createDataFrame(rows, CHATS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op12_chat_formatting(spark, str(tmp_path)).collect()}
    want[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(want)
    for c, turns in want.items():
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        learned = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def brute_negatives(rows):
    good = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int), x) for i, v, x in rows if None not in (i, v, x) and all(c is not None and math.isfinite(c) for c in v)]
    dot = lambda a, b: int(a[: len(b)] @ b[: len(a)])
    out = set()
    for q, a, mine in good:
        if q % 100 == 0:
            scored = [(-dot(a, b), i, x) for i, b, x in good if i != q]
            for s, p, _ in sorted(t for t in scored if t[2] == mine)[:5]:
                inside = sorted(t for t in scored if t[2] != mine and -80 * s <= -100 * t[0] <= -100 * s)[:5]
                out |= {(q, p, r, i, -s, -n) for r, (n, i, _) in enumerate(inside, 1)}
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"block": 20, "at_once": 3}])
def test_negatives_are_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 8)
    rng = random.Random(5)
    centre = [[rng.uniform(-1, 1) for _ in range(12)] for _ in range(4)]
    near = lambda x: [c + rng.gauss(0, 0.2) for c in centre[x]][: rng.choice([12, 12, 7])]
    rows = [(i, near(i * 7 % 11 % 4), i * 7 % 11 % 4 if rng.random() < 0.7 else rng.randrange(4)) for i in range(700)]
    rows += [(1000 + i, [0.5] * 12, i % 3) for i in range(120)]  # ties
    rows += [(2000, None, 1), (2100, [None] * 12, 1), (2200, [math.nan] * 12, 1), (2300, [math.inf] * 12, 1), (2400, [], 1), (None, [1.0] * 12, 1), (2500, [0.0] * 12, 1), (2600, [1.0] * 12, None), (2700, [9.0] * 12, 9), (2800, [-1.0] * 12, 2)]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "id", "vector", "anchor", "rank", "low", "high", "part", "region", "score")
    asks = F.col("vec_id") % 100 == 0
    want = brute_negatives(rows)
    assert len(want) > 60
    assert sorted(map(tuple, negatives.hard_negatives(frame, asks, **sizes).collect())) == want
    assert negatives.hard_negatives(frame.limit(0), asks).count() == 0
    twice = spark.createDataFrame(rows[:90] + rows[:5], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, negatives.hard_negatives(twice, asks, **sizes).collect())) == brute_negatives(rows[:90] + rows[:5])


def test_tree_bounds_hold():
    rng = np.random.default_rng(7)
    vectors, anchors = rng.integers(-200, 200, (900, 16)).astype(float), rng.integers(-200, 200, (20, 16)).astype(float)
    norm2 = float((vectors**2).sum(1).max())
    tree = negatives.Tree(vectors, norm2)
    least, most = tree.bounds(anchors)
    assert sorted(np.concatenate(tree.leaves)) == list(range(900)) and len(tree.leaves) > 4
    for leaf, rows in enumerate(tree.leaves):
        d = (anchors**2).sum(1)[:, None] + norm2 - 2 * anchors @ vectors[rows].T
        assert (d.min(1) >= least[:, leaf] - 1e-3).all() and (d.max(1) <= most[:, leaf] + 1e-3).all()


def test_huge_scores_are_refused(spark):
    with pytest.raises(OverflowError):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e9, 1e9], 1)], "vec_id long, embedding array<float>, label int"), F.lit(True))
