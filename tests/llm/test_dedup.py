import hashlib
import random

import xxhash
from helpers import clashing, documents, prose
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, simhash

CASES = [(1, "Same Text"), (5, "same text"), (9, "SAME TEXT"), (2, "École"), (3, "école"), (4, None), (6, ""), (7, "other"), (7, "other"), (8, "x" * 300_000), (10, "X" * 300_000), (None, "nameless"), (None, "Nameless"), (None, "other")]


def lower(t):
    return (t or "").encode().lower().decode()


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted((str(i), str(best[lower(t)]), len(groups[lower(t)]), i == best[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


def rows_of(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_exact_is_brute_force_with_edge_cases(spark):
    docs = clashing(documents(spark, CASES), "h", "norm", "keep_id", "kept", "group_size")
    assert rows_of(exact_dedup.exact_dedup(docs)) == brute_exact(CASES)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_survives_collisions_of_either_digest(spark):
    docs = documents(spark, CASES)
    short = lambda c: F.substring(F.unhex(F.md5(c)), 1, 0)  # noqa: E731  every text collides
    assert rows_of(exact_dedup.exact_dedup(docs, digest=short)) == brute_exact(CASES)
    assert rows_of(exact_dedup.exact_dedup(docs, digest=short, second=short)) == brute_exact(CASES)
    for more in ({}, {"digest": short, "second": short}):
        kept = exact_dedup.surviving_rows(clashing(docs, "h", "h2"), **more)
        assert sorted(lower(r.text) for r in kept.collect()) == sorted({lower(t) for _, t in CASES})
        assert kept.columns[:5] == docs.columns


def test_keep_smallest(spark):
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(documents(spark, CASES), keep="smallest").collect()}
    assert got[9] == 1 and got[10] == 8


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    keys = list(dict.fromkeys(prints))
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    return {k: find(k) for k in keys}


def test_near_is_brute_force(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([1, 2, 3, 4, 8, 200])) for _ in range(60)]
    for t in texts[:20]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts += [t, t.upper(), " ".join(words)]
    texts += [None, "", " \t\n", "École a b c", "a\xa0b c d", "long " * 100_000]
    rows = list(enumerate(texts, 100))
    docs = clashing(documents(spark, [*rows, rows[3], (None, "nameless text")]), "fp", "key", "n", "a", "b", "root")
    prints = {i: brute_print(t) for i, t in rows}
    roots = brute_components(prints.values())
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    for bucket in (64, 1):  # 1: every key takes the exact way for crowded keys
        got = simhash.near_dedup(docs, bucket=bucket).filter("doc_id IS NOT NULL").collect()
        assert len(got) == len(rows) + 1
        for r in got:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", least[roots[prints[r.doc_id]]])
    kept = simhash.near_distinct(docs)
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(set(least.values()))
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def test_near_distinct_keeps_unrelated_texts_of_one_id(spark):
    rng = random.Random(31)
    one, two, three = (prose(rng, 80) for _ in range(3))
    rows = [(1, one), (1, two), (1, one), (2, one), (3, three), (1, two + " and"), (None, three), (None, three)]
    for parts in (1, 3, 7):
        got = sorted((r.doc_id or 0, r.text) for r in simhash.near_distinct(documents(spark, rows).repartition(parts)).collect())
        first = min((brute_print(t) - (1 << 64) * (brute_print(t) >> 63), t) for t in (two, two + " and"))[1]
        linked = bin(brute_print(two) ^ brute_print(two + " and")).count("1") <= 2
        assert got == sorted([(1, one), (3, three), (0, three)] + ([(1, first)] if linked else [(1, two), (1, two + " and")]))
    assert simhash.near_distinct(documents(spark, rows).limit(0)).count() == 0


def test_links_of_crowded_keys_lose_no_connection(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 300:  # a cloud of chains around one value
        f = rng.choice(sorted(prints))
        for _ in range(rng.choice([1, 2, 5])):
            f ^= 1 << rng.randrange(64)
        prints.add(f)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    expected = brute_components(prints)
    sizes = sorted(list(expected.values()).count(r) for r in set(expected.values()))
    for bucket in (2, 64, 1000):
        found = simhash.components(simhash.links(frame, bucket)).groupBy("root").count().collect()
        linked = sorted(r["count"] for r in found)
        assert [1] * (len(sizes) - len(linked)) + linked == sizes


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{1000 + k: 1000 for k in range(50)}}
