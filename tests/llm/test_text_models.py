import json
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
from helpers import clashing, documents, prose

from quarry.llm import langid, packing, tokens, toxicity

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [None, "", " ", "\n\n", "a", "it's we'll DON'T", "naïve café ÉCOLE İstanbul", "中文字符 混合 text", "x" * 5000, "tab\tand\x0bfeed\x1cand\x85nel\xa0nbsp", "<|endoftext|> in <|startoftext|> text", "1234567 3.14 ½ ²", "é combining", "😀 emoji 👩‍👩‍👧", "a  b   c \n d", "word, word. (word) | word;", "ﬁ ligature ǅ Ω ς Σ ΣΑΣ", "‐‑–—’“”…", "​ zero", "ŉ ĳ ſ ß ẞ"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return [*ODD, *(prose(rng, rng.choice([3, 50, 400])) for _ in range(20)), "the quick brown fox " * 6000]


def library(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_token_counts_are_the_librarys(spark, texts):
    got = {r.doc_id: r for r in tokens.token_counts(clashing(documents(spark, texts), "n_tokens", "over_limit"), BYTE).collect()}
    for k, t in enumerate(texts):
        n = len(library(BYTE, t))
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 512), repr(t)[:60]


def test_classes_agree_with_the_librarys():
    split, pre = regex.compile(tokens.PRE_TOKEN).findall, tokens._library(BYTE).pre_tokenizer
    for a, b in tokens.CLASSED:
        for k in range(a, b + 1):
            text = f"a{chr(k)}a 1{chr(k)}1 !{chr(k)}! {chr(k)} {chr(k)}{chr(k)}"
            assert [y - x for _, (x, y) in pre.pre_tokenize_str(text)] == [len(p) for p in split(text)], hex(k)


@pytest.mark.parametrize("text", ["съешь же ещё этих мягких французских булок, да выпей чаю", "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "中文 字符，混合 text 日本語のテキスト 한국어 텍스트", "😀 emoji 🚀🚀 ok", "שלום עולם مرحبا بالعالم नमस्ते สวัสดี", "ｆｕｌｌ　ｗｉｄｔｈ", "x" * 300 + "я" * 300])
def test_shortcut_beyond_latin(text):
    counts = tokens.WholeTokenCounts.of(BYTE)
    assert not tokens._CLASSED.search(text) and counts.count(text) == len(library(BYTE, text))
    assert max(map(len, counts.merged), default=0) <= tokens.LONGEST


def test_whole_tokens_are_proved():
    whole = tokens.prove_whole_tokens(BYTE)
    assert len(whole) > 20_000
    for t in random.Random(2).sample(sorted(whole), 300):
        assert len(library(BYTE, t)) == 1


def test_counts_with_a_full_memory(texts, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 3)
    counts, words = tokens.WholeTokenCounts(BYTE), tokens.WordIds(WORD)
    for t in texts:
        assert counts.count(t or "") == len(library(BYTE, t))
        assert np.frombuffer(words.encode(t or ""), "<u4").tolist() == library(WORD, t)


def test_words_met_once_are_encoded_together(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 700)
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("aeinrstÉß"), rng.integers(1, 12))) + rng.choice(["", ".", ",", "?!", "***", "_<|", "'s", "'", "İ."]) for _ in range(4000)]
    texts = [" ".join(made[k : k + 40]) for k in range(0, 4000, 40)] + [None, "", "\n", " <|endoftext|> a<|endoftext|>b."]
    words, calls = tokens.WordIds(WORD), 0

    class Counted:
        def encode(self, *args, **options):
            nonlocal calls
            calls += 1
            return library_.encode(*args, **options)

    library_, words.library = words.library, Counted()
    found = [np.frombuffer(raw, "<u4").tolist() for raw in words.encode_all(pa.array(texts))]
    assert found == [library(WORD, t) for t in texts]
    assert calls < sum("'" in w or "İ" in w for w in made) + 20  # only what is no word with marks goes to the library by itself
    assert [len(raw) for raw in words.encode_all(pa.array([], pa.string()))] == []


def check_packing(rows, texts, capacity):
    ids = {k: [*library(WORD, t), 1] for k, t in enumerate(texts)}
    seen = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * capacity and len(part) == r.length <= capacity
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seen)


@pytest.mark.parametrize("capacity, open_bins", [(4096, 512), (64, 4), (64, 1)])
def test_packing_is_a_round_trip(spark, texts, capacity, open_bins):
    docs = clashing(documents(spark, texts), "sequence_id", "offset", "piece")
    rows = packing.pack(docs, WORD, capacity=capacity, open_bins=open_bins).collect()
    n = check_packing(rows, texts, capacity)
    again = packing.pack(docs, WORD, capacity=capacity, open_bins=open_bins).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    total = sum(r.length for r in rows)
    assert n <= 2 * -(-total // capacity) + 1
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_bins_close_the_fullest_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 8, 9, 2, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


LANGS = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "zwei wörter über große straßen", "cc": "où être garçon élève français"}


def test_language_by_words_then_grams(spark):
    rng, rows = random.Random(4), []
    for k in range(120):
        lang = rng.choice(list(LANGS))
        rows.append((k, " ".join(rng.choices(LANGS[lang].split(), k=12)), lang))
    docs = documents(spark, [(k, t) for k, t, _ in rows], lang=[lang for *_, lang in rows])
    model = langid.fit(docs)
    probes = ["lorem dolor", "straßenwörter größe", "GARÇONS élèves", None, "", "12 34 !", "über " * 50_000, "日本語" * 50]
    got = langid.predict(clashing(documents(spark, probes), "lang_pred", "score"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got][:7] == ["aa", "bb", "cc", "und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got) and got[3].score == 0
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def brute_languages(labelled, texts):
    """The model written out over plain dictionaries; every labelled row counts."""
    words = lambda t: [r[k : k + 64] for r in regex.findall(r"\p{L}+", (t or "").lower()) for k in range(0, len(r), 64)]
    grams = lambda w: [f"^{w}$"[a : a + o] for o in langid.ORDERS for a in range(len(w) + 3 - o)]
    n = {"word": {}, "gram": {}}
    for text, lang in labelled:
        for w in words(text):
            for kind, item in [("word", w), *(("gram", g) for g in grams(w))]:
                own = n[kind].setdefault(lang, {})
                own[item] = own.get(item, 0) + 1
    languages = sorted(n["word"])
    rows = {lang: sum(x == lang for _, x in labelled) for lang in languages}

    def log(kind, item, lang):
        every = sum(sum(c.values()) for c in n[kind].values())
        q = sum(c.get(item, 0) for c in n[kind].values()) / every
        return math.log((n[kind][lang].get(item, 0) + langid.PRIOR * q) / (sum(n[kind][lang].values()) + langid.PRIOR)) if q else None

    def value(w, lang):
        if (known := log("word", w, lang)) is not None:
            return known
        marked, found = f"^{w}$", []
        for a in range(len(marked)):
            found += [x for o in langid.ORDERS if a + o <= len(marked) and (x := log("gram", marked[a : a + o], lang)) is not None][:1]
        return sum(found) / len(found) if found else 0.0

    out = []
    for t in texts:
        own = words(t)
        if not own or not languages:
            out.append(("und", 0.0))
            continue
        m = [sum(value(w, lang) for w in own) / len(own) * min(len(own), 50) + math.log(rows[lang] / sum(rows.values())) for lang in languages]
        best = m.index(max(m))
        out.append((languages[best], 1 / sum(math.exp(x - m[best]) for x in m)))
    return out


def test_language_is_brute_force(spark):
    rng = random.Random(31)
    labelled = [(" ".join(rng.choices(words.split(), k=rng.choice([1, 5, 9]))), lang) for lang, words in LANGS.items() for _ in range(12)]
    labelled += [("12 34", "no letters"), (None, "null"), ("kala kissa koira", "few"), ("kala meri", "few"), ("x" * 150, "few")]
    texts = [*(t for t, _ in labelled), "kissat merellä", "straßenlorem über", "日本語 lorem", "ÉLÈVES " * 60, "x" * 200, None, "", "!!", "lorem dolor zwei"]
    train = documents(spark, [(None if k % 2 else k, t) for k, (t, _) in enumerate(labelled)], lang=[lang for _, lang in labelled])
    model, want = langid.fit(train), brute_languages(labelled, texts)
    assert model.languages == ["aa", "bb", "cc", "few"]
    for most in (langid.ITEMS, 0):
        got = langid.predict(clashing(documents(spark, texts), "row", "word", "logs", "n"), model, most_items=most).orderBy("doc_id").collect()
        for r, (lang, score) in zip(got, want, strict=True):
            assert r.lang_pred == lang and abs(r.score - score) < 1e-9, texts[r.doc_id]


def test_small_and_empty_languages_are_not_favoured(spark):
    rng = random.Random(32)
    letters = "abcdefghijklmnop"
    made = lambda vowel: "".join(rng.choice(letters) + vowel for _ in range(3))
    large = [" ".join(made(rng.choice("aeo")) for _ in range(8)) for _ in range(1500)]
    rows = [(t, "large") for t in large] + [("tyrymy lyky", "small")] * 3 + [("12 34", "none")] * 2
    docs = documents(spark, [(None, t) for t, _ in rows], lang=[lang for _, lang in rows])
    model = langid.fit(docs)
    assert model.languages == ["large", "small"]
    unknown = [" ".join(made(rng.choice("aeo")) for _ in range(8)) for _ in range(50)]
    got = langid.predict(documents(spark, [*large[:50], *unknown, "lyky tyrymy", "tyrykylyky"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["large"] * 100 + ["small"] * 2
    some = langid.fit(docs, rows_per_language=100)
    assert some.languages == ["large", "small"]
    rows = some.items.filter("kind = 'word'").count()
    assert 0 < rows < model.items.filter("kind = 'word'").count() / 4


def test_a_language_of_few_rows_does_not_take_what_others_know(spark):
    rng = random.Random(33)
    english, french = "the cat and a house of trees in rain with sun".split(), "le chat et une maison des arbres sous la pluie".split()
    rows = [(" ".join(rng.choices(english, k=6)), "en") for _ in range(200)] + [(" ".join(rng.choices(french, k=6)), "fr") for _ in range(200)]
    rows += [("der hund ist sehr gut", "de"), ("ich gehe nach hause", "de"), ("das ist fein", "de")]
    model = langid.fit(documents(spark, [t for t, _ in rows], lang=[lang for _, lang in rows]))
    got = langid.predict(documents(spark, ["the dog", "le chien", "der hund ist sehr gut"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "fr", "de"]


def toxic_rows(rng, n, share=0.3):
    out = []
    for k in range(n):
        words = prose(rng, rng.choice([6, 40, 300])).split()
        toxic = int(rng.random() < share)
        if toxic:
            for _ in range(rng.choice([1, 3])):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest", "wretched", "vilezz" + rng.choice("abcdef")]))
        out.append((k, " ".join(words), toxic))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(random.Random(8), 500)
    docs = documents(spark, [(k, t) for k, t, _ in rows])
    labels = spark.createDataFrame([(k, 1, t) for k, _, t in rows] + [(0, 1, None), (10_000, 0, 1)], "doc_id long, quality int, toxic int")
    train = toxicity.with_labels(docs.filter("doc_id < 350"), labels)
    test = clashing(docs.filter("doc_id >= 350"), "_row", "x", "score", "opening")
    sent = {r.doc_id: r.score for r in toxicity.score(test, train, ["doc_id"]).collect()}
    wrong = [k for k, _, t in rows if k >= 350 and (sent[k] >= 0.7) != (t == 1)]
    assert len(sent) == 150 and len(wrong) <= 5
    joined = {r.doc_id: r.score for r in toxicity.score(test, train, ["doc_id"], table_rows=0).collect()}
    assert all(abs(joined[k] - sent[k]) < 1e-9 for k in sent)
    odd = documents(spark, [None, "", "!!", "vilest " * 50_000, ("alpha " * 99)])
    for more in ({}, {"table_rows": 0}):
        got = {r.doc_id: r.score for r in toxicity.score(odd.unionByName(odd), train, ["doc_id"], **more).collect()}
        assert all(0 <= s <= 1 for s in got.values()) and got[0] < 0.7 and got[3] > 0.9
        assert toxicity.score(odd.limit(0), train, ["doc_id"], **more).count() == 0
    for labelled in (train.limit(0), train.filter("toxic = 0")):
        assert all(r.score < 0.5 for r in toxicity.score(odd, labelled, ["doc_id"]).collect())


def test_contexts_are_whole_words(spark):
    train = spark.createDataFrame([("alphabet vile alphabets vile alphabetic vile assessment assessor", 1)], "text string, toxic int")
    assert {r.word: r.toxic for r in toxicity.word_counts(train).collect()} == {"vile": 3, "alphabet": 1, "alphabets": 1, "alphabetic": 1, "assessment": 1, "assessor": 1}


def brute_differences(labelled, texts):
    """The two Kneser-Ney models written out, over plain dictionaries."""
    order, d = toxicity.ORDER, toxicity.DISCOUNT
    words = lambda t: regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower())
    cuts = lambda w: [f"^{w}$"[: k + 1][-order:] for k in range(1, len(w) + 2)]
    n = [{}, {}]
    for x in (0, 1):
        for _, word in {(a, b) for t, y in labelled if y == x for a, b in zip(["^", *words(t)], words(t))}:
            for g in cuts(word):
                n[x][g] = n[x].get(g, 0) + 1
    every = {g: n[0].get(g, 0) + n[1].get(g, 0) for g in {*n[0], *n[1]}}
    total = lambda c, h: sum(v for g, v in c.items() if g[:-1] == h)
    kinds = lambda c, h: sum(g[:-1] == h for g in c)
    p2 = lambda g: sum(o[-2:] == g[-2:] for o in every) / sum(o[-2] == g[-2] for o in every)

    def smooth(c, g, below):
        return (max(c.get(g, 0) - d, 0) + d * kinds(c, g[:-1]) * below) / total(c, g[:-1])

    def step(g):
        h = g[:-1]
        o, t = total(n[0], h), total(n[1], h)
        if not o or not t or g not in every:
            return 0.0
        expected = every[g] * t / (o + t)
        if abs(n[1].get(g, 0) - expected) <= toxicity.APART * math.sqrt(expected * o / (o + t)):
            return 0.0
        p = smooth(every, g, p2(g))
        return math.log(smooth(n[1], g, p) / smooth(n[0], g, p))

    known, out = {}, []
    for t in texts:
        own = words(t)
        for w in {*own}:
            if w not in known:
                known[w] = sum(map(step, cuts(w)))
        middle = float(np.clip(np.median([known[w] for w in {*own}]), -toxicity.SHIFT, toxicity.SHIFT)) if own else 0.0
        out.append(sum(known[w] - middle for w in own) / (len(own) + toxicity.NEUTRAL))
    return out


def test_toxicity_is_brute_force(spark):
    rng = random.Random(23)
    labelled = [(t, x) for _, t, x in toxic_rows(rng, 60)] + [("vilest assessors assess", 1)] * 30 + [("assessments of alphabets", 0)] * 30
    texts = [t for _, t, _ in toxic_rows(rng, 46)] + [None, "", "vilest", "assessors " * 50 + "vilezzz"]
    table = toxicity.step_table(toxicity.word_counts(spark.createDataFrame(labelled, "text string, toxic int")))
    want, some = brute_differences(labelled, texts), documents(spark, texts)
    assert any(abs(x) > 0.1 for x in want)
    for rows in (toxicity.TABLE_ROWS, 0):
        got = {r.doc_id: r["__quarry_x"] for r in toxicity.text_differences(some, table, ["doc_id"], rows).collect()}
        assert all(abs(got[k] - x) < 1e-9 for k, x in enumerate(want))


def test_scores_depend_on_text_alone(spark):
    rows = toxic_rows(random.Random(9), 200)
    train = spark.createDataFrame([(t, x) for _, t, x in rows], "text string, toxic int")
    docs = documents(spark, [rows[0][1]] * 3, source=["a", None, "b"], lang=["x", "y", None])
    assert len({r.score for r in toxicity.score(docs, train, ["doc_id", "source", "lang"]).collect()}) == 1


def test_vocabulary_files_are_as_the_encoders_assume():
    with open(WORD) as f:
        steps = json.load(f)["normalizer"]["normalizers"]
    assert [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
