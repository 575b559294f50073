import math
import random
import re
import time
from html.parser import HTMLParser
from re import _parser

import numpy as np
import pytest
from helpers import clashing, documents, prose
from pyspark.sql import functions as F

from quarry.llm import html_text, license_rules, licenses, mixing, topk


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_top(rows, k=5):
    good = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            scored = sorted(((-int(a[: len(b)] @ b[: len(a)]), i) for i, b in good if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_is_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) if rng.random() < 0.6 else 0.0 for _ in range(rng.choice([16, 16, 9]))], 0) for i in range(260)]
    rows += [(400 + i, [0.5] * 16, 0) for i in range(90)]  # ties
    rows += [(700, None, 0), (750, [None] * 16, 0), (800, [math.nan] * 16, 0), (801, [math.inf] * 16, 0), (850, [], 0), (None, [1.0] * 16, 0), (900, [0.0] * 16, 0), (950, [1e6] * 16, 0)]
    frame = clashing(vectors(spark, rows), "id", "asks", "qb", "cb", "rank", "score")
    asks = F.col("vec_id") % 50 == 0
    for sizes in ({}, {"query_block": 2, "candidate_block": 40}):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame, asks, **sizes).collect())
        assert got == brute_top(rows)
    assert topk.top_k(frame.limit(0), asks).count() == 0
    assert topk.top_k(vectors(spark, rows[:1]), asks).count() == 0


def brute_labels(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())
    base = [(k, label) for phrase, label in license_rules.BASE for p in [phrase.split()] for k in range(len(words)) if words[k : k + len(p)] == p]
    joined, found = " ".join(words), []
    for rule in license_rules.rules():
        if rule.keyword in joined:
            for m in re.finditer(rf"(?:(?<= )|^)(?:{rule.pattern})(?= |$)", joined):
                start = joined[: m.start()].count(" ")
                found.append((start, start + m[0].count(" ") + 1, rule.tier, rule.label))
    found.sort(key=lambda d: (d[0], -d[1], d[2], d[3]))
    kept = [d for k, d in enumerate(found) if not any(o[2] <= d[2] and o[1] >= d[1] for o in found[:k])]
    return len(words), sorted(s for s, _ in base), sorted({x for _, x in base}), sorted({x for _, x in base} | {d[3] for d in kept})


LICENSED = [
    "Released under the MIT License. And under the MIT license", "Licensed under CC BY-NC 4.0", "under the Apache License, Version 2.0 (the License)", "SPDX-License-Identifier: GPL-3.0-or-later",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-SA 4.0 and cc by nc cc by nc", "BSD 3-Clause License", "nothing", None, "", "...", "É under_the_MIT-license é",
    "under the mit license " * 400, "released into the public domain", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "released under the Expat license", "under the two clause license", "Open RAIL-M License", "Creative Commons Attribution Share Alike 4.0 License", "you may not use this file except in compliance with the License", "mit license under the mit license " * 150, "permission is hereby granted, free of charge, to any person obtaining a copy",
]


def test_license_scan_is_brute_force(spark):
    rng = random.Random(6)
    texts = LICENSED + [prose(rng, 20) + " " + rng.choice(LICENSED[:7]) + " " + prose(rng, 20) for _ in range(10)]
    got = licenses.scan(clashing(documents(spark, texts), "words", "labels", "found", "starts")).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        n, starts, base, labels = brute_labels(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(starts), starts[0] if starts else None, starts[-1] if starts else None), t
        assert (r.base_labels, r.labels) == (",".join(base), ",".join(labels)), t
        assert (r.score > 0) == bool(labels)
    assert licenses.scan(documents(spark, texts).limit(0)).count() == 0


def every_match(pattern):
    """A match for each way through a rule's alternatives and options."""

    def ways(parts):
        out = [""]
        for op, value in parts:
            kind = str(op)
            if kind == "LITERAL":
                add = [chr(value)]
            elif kind == "NOT_LITERAL":
                add = ["x"]
            elif kind == "IN":
                add = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in value]
            elif kind == "BRANCH":
                add = [w for branch in value[1] for w in ways(branch)]
            elif kind == "SUBPATTERN":
                add = ways(value[3])
            else:
                least, most, inner = value
                add = [w * max(least, 1) for w in ways(inner)] + ([""] if least == 0 else [])
            out = [a + b for a in out for b in add]
        return out

    return ways(_parser.parse(pattern))


def test_every_way_through_a_rule_is_reached():
    rules = license_rules.rules()
    assert len(rules) >= 500
    for rule in rules:
        for match in every_match(rule.pattern):
            assert re.fullmatch(rule.pattern, match) and rule.keyword in match, (rule, match)
            assert any(g in match for g in license_rules.GATE), (rule, match)
            assert re.fullmatch(r"[^\x00-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F]+", match), (rule, match)  # words with a space between


SHORT = {
    "GPLv3": "gpl-3", "GNU GPL v3": "gpl-3", "licensed under the GPL version 2": "gpl-2", "AGPL": "agpl", "Apache 2.0 license": "apache-2", "License: Apache-2.0": "apache-2",
    "licensed under apache-2.0": "apache-2", "Licensed under MIT.": "mit", "MIT licensed code": "mit", "licensed under the BSD": "bsd", "unlicense": "unlicense",
    "dual licensed under MIT or Apache 2.0": "apache-2,dual,mit", "LGPL-2.1-or-later": "lgpl-2.1", "runs on Apache 2.4": "", "the gplus page": "", "permit licensing": "",
}


def test_short_names_are_found(spark):
    got = licenses.scan(documents(spark, list(SHORT))).orderBy("doc_id").collect()
    assert dict(zip(SHORT, (r.labels for r in got))) == SHORT
    assert [r.labels for r in got] == [",".join(brute_labels(t)[3]) for t in SHORT]


def test_many_detections_in_one_text(spark):
    text = "under the mit license " * 100_000
    began = time.time()
    row = licenses.scan(documents(spark, [text])).collect()[0]
    assert (row.n_base, row.labels, len(row.detections)) == (100_000, "mit", 100_000)
    assert time.time() - began < 60


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;text<br>next   line.<p>Second &lt;x&gt;.<aside>Side</aside><ul><li>item</li></ul><div class="ad">Buy</div>
<form><p>Email</p></form><section id="comments"><p>Nice!</p></section></article></main><div id="sidebar">Links</div><footer>&copy; x</footer></body></html>"""


def test_page_text():
    assert html_text.main_texts([html_text.blocks(PAGE)]) == ["Title & more\nFirst bold text next line.\nSecond <x>.\nitem"]


def brute_covered(pages, run, least):
    out, where = [], {}
    for n, page in enumerate(pages):
        for k in range(len(page) - run + 1):
            where.setdefault(tuple(page[k : k + run]), set()).add(n)
    for page in pages:
        hit = [False] * len(page)
        for k in range(len(page) - run + 1):
            if len(where[tuple(page[k : k + run])]) >= least:
                hit[k : k + run] = [True] * run
        out.append(hit)
    return out


def test_suffix_array_coverage_is_brute_force():
    rng = random.Random(12)
    shared = rng.choices("abcdefgh", k=14)
    for run, least in ((3, 2), (5, 3), (8, 2)):
        pages = [rng.choices("abcdxyz", k=rng.randrange(0, 40)) + shared[rng.randrange(6) :] + rng.choices("xyz", k=5) for _ in range(7)] + [[], ["a"]]
        assert [h.tolist() for h in html_text.covered(pages, run, least)] == brute_covered(pages, run, least)


def test_boilerplate_of_a_host_goes_and_unique_runs_stay(spark):
    rng = random.Random(13)
    line = "visit our other sites and read the terms of use before you go"
    rows = [(k, f"https://h{k % 2}.example/{k}", f"<html><body><div>{line} {prose(rng, 12)}</div><p>{prose(rng, 30)}</p></body></html>") for k in range(12)]
    rows += [(50, "https://h0.example/a", None), (51, None, ""), (52, "x", "<p>plain"), (53, "x", "<p>" + "long words here " * 30_000), (54, "https://h0.example/b", "<article><p>" + line)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "host", "part", "groups", "text")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(got) == len(rows) and all(line not in got[k].text and "\n" in got[k].text for k in range(12))
    assert (got[50].text, got[51].text, got[52].text, got[54].text) == ("", "", "plain", line)
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(pages.limit(0)).count() == 0


def test_runs_are_counted_over_a_whole_host(spark):
    rng = random.Random(15)
    lines = {n: f"line {n} " + prose(rng, 12) for n in (2, 3, 40)}
    rows = [[f"<body><p>{' '.join(str(rng.random()) for _ in range(12))}</p>"] for _ in range(800)]
    for n, line in lines.items():
        for k, row in enumerate(rng.sample(rows, n)):
            row.append(f"<{'article' if k == 1 else 'div'}>{line} {k}")
    rows = [(k, "https://one.example/", "".join(row)) for k, row in enumerate(rows)]
    whole = html_text.main_texts([html_text.blocks(h) for *_, h in rows])
    assert sum(lines[3] in t for t in whole) == 1 and sum(lines[2] in t for t in whole) == 2
    other = [(k + 1000, "https://two.example/", h) for k, _, h in rows if lines[2] in h]
    pages = spark.createDataFrame(rows + other, "page_id long, url string, html string").repartition(7)
    for more in ({}, {"hit_rows": 0}):
        got = {r.page_id: r.text for r in html_text.extract(pages, **more).collect()}
        assert [got[k] for k in range(len(rows))] == whole
        assert all(lines[2] in got[k] for k, *_ in other)


class Tree(HTMLParser):
    """The elements of a well-formed page as nested lists [name, attributes, children]."""

    def __init__(self, page):
        super().__init__()
        self.open = [["", {}, []]]
        self.feed(page)
        self.close()

    def handle_starttag(self, name, attributes):
        node = [name, dict(attributes), []]
        self.open[-1][2].append(node)
        if name != "br":
            self.open.append(node)

    def handle_endtag(self, name):
        self.open.pop()

    def handle_data(self, text):
        self.open[-1][2].append(text)


CHROME_CLASSES, OTHER_CLASSES = ("ad", "cookie-notice", "site_nav", "related-posts", "sidebar"), ("has-sidebar", "story", "lead-text", "admin")


def brute_roles(page):
    """(role, text) of a page's blocks, by walking its tree."""
    root, found, spot = Tree(page).open[0], [], {}

    def first_article(node, above):
        for child in node[2]:
            if isinstance(child, list) and child[0] not in ("nav", "aside", "footer", "script"):
                if child[0] in ("article", "main"):
                    return [*above, child]
                if hit := first_article(child, [*above, child]):
                    return hit
        return None

    holders = [id(n) for n in first_article(root, []) or []]
    total = lambda n: sum(len(" ".join(c.split())) if isinstance(c, str) else total(c) for c in n[2] if c[0] != "script")

    def walk(node, role, block):
        for child in node[2]:
            if isinstance(child, str):
                spot.setdefault((block[0], id(node) if node[0] not in ("b", "br", "a") else block[1]), [role, []])[1].append(child)
                continue
            name, attributes, _ = child
            if name == "script":
                block[0] += 1
            elif name == "br":
                spot.setdefault((block[0], block[1]), [role, []])[1].append(" ")
            elif name in ("b", "a"):
                walk(child, role, block)
            else:
                inner = role
                if role != html_text.CHROME:
                    if name in ("nav", "aside", "footer") or (attributes.get("class") in CHROME_CLASSES and id(child) not in holders):
                        inner = html_text.CHROME
                    elif name in ("article", "main"):
                        inner = html_text.CONTENT
                block[0], outer = block[0] + 1, block[1]
                block[1] = id(child)
                walk(child, inner, block)
                block[0], block[1] = block[0] + 1, outer

    walk(root, html_text.OPEN, [0, id(root)])
    for role, texts in spot.values():
        if text := " ".join("".join(texts).split()):
            found.append((role, text))
    return found


def random_page(rng, shared):
    def inside(depth):
        out = ""
        for _ in range(rng.randrange(1, 4)):
            kind = rng.random()
            if kind < 0.4 or depth > 3:
                out += f"<p>{prose(rng, rng.choice([2, 9]))} <b>x &amp; y</b>{rng.choice(shared) if rng.random() < 0.5 else ''}<br>end</p>"
            elif kind < 0.5:
                out += rng.choice(["<!-- <p>no -->", "<script>if (a<b) '</p><!--'</script>", "plain &lt;text&gt;"])
            else:
                name = rng.choice(["div", "section", "nav", "aside", "footer", "div", "ul"])
                named = f' class="{rng.choice(CHROME_CLASSES + OTHER_CLASSES)}"' if rng.random() < 0.3 else rng.choice(["", " title=don't", " data-x"])
                out += f"<{name}{named}>{inside(depth + 1)}</{name}>"
        return out

    # an article with text enough that no class around it holds most of a page without one
    return f"<html><body>{inside(0)}<div{rng.choice(['', ' class=sidebar'])}><article><h1>{prose(rng, 4)}</h1>{inside(1)}</article></div>{inside(0)}</body></html>"


def test_extraction_is_brute_force(spark):
    rng = random.Random(41)
    shared = [prose(rng, 12) for _ in range(6)]
    rows = [(k, f"https://{'big' if k % 4 else 'small'}.example/{k}", random_page(rng, shared)) for k in range(200)]
    roles = {k: brute_roles(h) for k, _, h in rows}
    for k, _, h in rows:
        assert html_text.blocks(h) == roles[k], h
    want, off = {}, {}
    for host in (0, 1):
        own = [k for k, *_ in rows if bool(k % 4) == bool(host)]
        streams = [html_text._stream(roles[k]) for k in own]
        hits = brute_covered([s for s, _ in streams], html_text.RUN, html_text.PAGES)
        for k, (stream, span), hit in zip(own, streams, hits):
            want[k] = html_text._kept(roles[k], stream, span, np.array(hit))
            off[k] = html_text._kept(roles[k], stream, span, np.zeros(len(stream), bool))
    assert sum(want[k] != off[k] for k in want) > 50  # the array decides
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 3, 16):
        assert {r.page_id: r.text for r in html_text.extract(pages.repartition(n)).collect()} == want


FAULTY = [
    ('<div class="content has-sidebar"><p>Main text', "Main text"),
    ('<main><p class="alert">Mind the step</p></main>', "Mind the step"),
    ("<script>x='<!--'</script><article><p>Main text here</p></article></body>", "Main text here"),
    ("<article><p title=don't>One</p><p>Two</p></article>", "One\nTwo"),
    ('<article><p title="open>One</p><p>Two</p></article>', "One\nTwo"),
    ("<article><select><p>Text</article>", "Text"),
    ("<article><iframe><p>Text</article>", "Text"),
    ("<article><noscript><p>Text</article>", "Text"),
    ("<article>1 < 2 <3 & 4</article>", "1 < 2 <3 & 4"),
    ('<article>A<section id="comments"><article class="comment">B</article></section>C</article>', "A\nC"),
    ('<article>A</article><section id="comments"><article>B</article></section>', "A"),
    ("<article><svg><svg></svg>x</svg>A<textarea>x</textarea>B<title>C</article>", "A\nB\nC"),
]


@pytest.mark.parametrize("page, text", FAULTY)
def test_faulty_pages(page, text):
    assert html_text.main_texts([html_text.blocks(page)]) == [text]


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<svg>", "<svg><svg></svg>", "<title>", "<", "<p x='>", '<a b="<a>" c=\'', "<div hidden>", "<b><i>", "&", "</", "<!--", "<select>"])
def test_reading_a_page_is_linear(part):
    began = time.time()
    html_text.blocks(part * (5_000_000 // len(part) // 5))
    small = time.time() - began
    html_text.blocks(part * (5_000_000 // len(part)))
    assert time.time() - began - small < max(5.0, 12 * small)


def brute_fill(sizes, weights, budget, cap):
    target, open_ = {s: 0.0 for s in sizes}, set(sizes)
    while open_:
        rest = budget - sum(cap * sizes[s] for s in sizes if s not in open_)
        level = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > cap * sizes[s]}
        for s in open_:
            target[s] = level * weights[s]
        if not over:
            break
        for s in over:
            target[s] = float(cap * sizes[s])
        open_ -= over
    return target


def test_mixing_meets_targets(spark):
    rng = random.Random(14)
    names = ["b", "a", None, "é", "Z", "empty"]
    rows = [(k, prose(rng, rng.choice([1, 5, 90, 700])), rng.choice(names[:5])) for k in range(300)] + [(900, "", "empty"), (901, None, "empty"), (902, "x y", "a"), (902, "x y", "a"), (None, "u v w", "b")]
    docs = documents(spark, [(k, t) for k, t, _ in rows], source=[s for *_, s in rows])
    got = mixing.mix(clashing(docs, "range", "key", "cut", "taken", "weight", "u")).collect()
    assert len(got) == len(rows)
    order = sorted([n for n in names if n is not None]) + [None]
    weights = {n: (5, 2, 1)[k % 3] for k, n in enumerate(order)}
    sizes = {n: sum(len((t or "").encode().split()) for _, t, s in rows if s == n) for n in names}
    target = brute_fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    source = {k: s for k, _, s in rows}
    for n in names:
        mine = [r for r in got if source[r.doc_id] == n]
        assert all(abs(r.target - target[n]) < 1e-6 and r.source_size == sizes[n] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[n]) <= 0.5
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(clashing(docs, "range", "key", "cut", "taken", "weight", "u")).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
    more = docs.unionByName(documents(spark, [(None, f"p{k} q r s t") for k in range(40)] + [(7000, f"{k} v w") for k in range(31)], source=["b"] * 40 + ["a"] * 31))
    mixed = mixing.mixed_rows(clashing(more, "taken", "size", "range"))
    assert mixed.columns == clashing(more, "taken", "size", "range").columns
    words, by_source = {}, {}
    for r in mixed.collect():
        n = len((r.text or "").encode().split())
        words[r.doc_id] = words.get(r.doc_id, 0) + n
        by_source[r.source] = by_source.get(r.source, 0) + n
    again, targets, once = {}, {}, {k for k, *_ in rows if k not in (None, 902)}
    for r in mixing.mix(more, keep_source=True).collect():
        again[r.doc_id] = again.get(r.doc_id, 0) + r.taken
        targets[r.source] = r.target
    assert all(words.get(k, 0) == again[k] for k in once)
    assert words[None] == again[None] and words[7000] == again[7000] and words[902] == again[902]
    assert all(by_source.get(n, 0) == math.floor(targets[n] + 0.5) for n in targets)
    assert mixing.mixed_rows(docs.limit(0)).count() == 0
    six = documents(spark, [(None, f"six words {w} in this text") for w in "abcdef"], source=["x"] * 6)
    assert sum(len(r.text.split()) for r in mixing.mixed_rows(six, share=1.0).collect()) == 36
    alike = documents(spark, [(None, "the same six words each time")] * 5 + [(1, "others " * 9)], source=["x"] * 6)
    taken = sum(len(r.text.split()) for r in mixing.mixed_rows(alike, share=1.3).collect())
    assert taken == math.floor(39 * 1.3 + 0.5)
