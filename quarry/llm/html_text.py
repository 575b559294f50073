"""Main text of web pages: block structure, and a suffix array over each host's pages.

A page is read once into blocks in page order.  A block is the text between block
boundaries, with character references decoded and white space made one space; it has a
role by the elements it stands in: ``content`` (article or main), ``chrome`` (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments) or ``open``, where
structure does not tell.  Tags are read as the HTML standard reads them, in time that is
linear in the page; a comment, script or style that never ends hides the rest, as it does
there, other elements whose text is not shown only up to an end tag of theirs.  Tags are read as the HTML standard reads them, in time that is
linear in the page; a comment, script or style that never ends hides the rest, as it does
there, other elements whose text is not shown only up to an end tag of theirs.

For each host the token streams of its pages, all blocks and roles, are concatenated and
sorted as a suffix array (prefix doubling up to ``RUN`` tokens).  A run of ``RUN`` tokens
or more that occurs in ``PAGES`` distinct pages or more is boilerplate.  Covered tokens
are removed from open blocks and their unique runs kept; chrome goes whole; content
stays, since an article that a host prints twice is still an article.

A host's array is never in one place.  Prefix doubling works on 64-bit prints in place of
ranks, so suffixes of pages in different tasks compare; each task counts the pages of the
suffixes it holds, and the counts of a (host, print) are added up over the whole host,
whatever its size.  Only runs that reach an open block on some page can remove anything,
so these are gathered first and the others not counted, unless they are over ``HIT_ROWS``;
then every run is.  Those on ``PAGES`` pages go back to the pages: sent to every executor
up to ``HIT_ROWS``, by a shuffle join beyond that.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed

RUN, PAGES = 8, 3
#: Prints of runs up to which they are sent to every executor (8 bytes each).
HIT_ROWS = 2_000_000
#: Prints that a task holds before it passes their counts on, and tokens whose prints it remembers.
_HELD, _TOKENS = 400_000, 300_000
CONTENT, OPEN, CHROME = 2, 1, 0

# Element names of the HTML standard by what they mean here.
_SKIPPED = {"template", "noscript", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "button"}
_RAW = {"script", "style", "textarea", "title"}
_CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_CONTENT = {"article", "main"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "picture", "q", "rp", "rt", "ruby", "s", "samp", "small", "source", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_P_ENDS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "div", "table", "pre", "blockquote", "section", "article", "main", "header", "footer", "nav", "aside", "form", "figure", "address", "fieldset", "hr", "details"}
# Words of class and id names.  A name counts when all its words are of these and one is of the first
# two sets; the second set counts outside an article only.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets related recommended"
    " recommendations cookie cookies consent gdpr popup newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies respond pagination pager toolbar".split()
)
_OUTSIDE = frozenset("header masthead footer aside banner notice notices alert alerts modal overlay search skip copyright legal".split())
_PLACES = frozenset("site main top bottom left right primary secondary global inner outer box bar block list links link container wrapper wrap area section panel buttons button form more posts items item message policy thread the".split())
_CHROME_ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu\w*")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|(?=[\s/]|$))""", re.I)
#: A tag: quotes count only as values of attributes.  Possessive, so that it never goes back.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")


def _named(value: str, inside: bool) -> bool:
    """Whether a class or id value has a name that stands for something other than the article."""
    for name in value.split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        strong = any(w in _NAMES or (not inside and w in _OUTSIDE) for w in words)
        if strong and all(w in _NAMES or w in _OUTSIDE or w in _PLACES for w in words):
            return True
    return False


def _kind(name: str, attributes: str, inside: bool) -> str:
    """What an element says of its text: ``content``, ``chrome`` (by element, role or hidden), ``named`` (by class or id) or nothing."""
    found = [(key.lower(), "".join(values).lower()) for key, *values in _ATTRIBUTE.findall(attributes)] if attributes else []
    if any(key == "hidden" or (key == "role" and _CHROME_ROLE.fullmatch(value.strip())) for key, value in found):
        return "chrome"
    if name in _CHROME and not (name == "header" and inside):
        return "chrome"
    if name not in ("body", "html", "main") and any(_named(value, inside) for key, value in found if key in ("class", "id")):
        return "named"
    return "content" if name in _CONTENT else ""


class _Scanner:
    """Finds tags from left to right, each character once or a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.quoted, self.last, self.nested = page, True, {}, {}

    def tag(self, at: int) -> tuple[int, str, str, str] | None:
        """(end, slash, name, attributes) of the tag at ``at``; None if it never ends.

        Once a quote turns out not to close, the page's tags end at their first ``>``.
        """
        if self.quoted:
            if m := _TAG.match(self.page, at):
                return m.end(), m[1], m[2].lower(), m[3]
            self.quoted = False
        end = self.page.find(">", at)
        if end < 0:
            return None
        name = _NAME.match(self.page, at)
        return end + 1, "/" if self.page[at + 1] == "/" else "", name[1].lower(), self.page[name.end() : end]

    def _closing(self, name: str) -> re.Pattern:
        return re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*+>", re.I)

    def after(self, name: str, at: int) -> int | None:
        """Where the element ``name`` that opened before ``at`` has ended; None if no end tag follows."""
        closing = self._closing(name)
        if name not in self.last:
            self.last[name] = max((m.start() for m in closing.finditer(self.page, at) if m[1]), default=-1)
        if at > self.last[name]:
            return None
        depth, first = 1, None
        for m in closing.finditer(self.page, at):
            if m[1]:
                first = first or m.end()
                depth -= 1
                if not depth or name in _RAW or name in self.nested:
                    return m.end()
            elif not m[0].endswith("/>"):
                depth += 1
        self.nested[name] = True  # ends do not balance: from here on the first one counts
        return first


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(role, text) of each non-empty block of a page, in page order.

    An element named as chrome by class or id alone is not believed if it holds the page's
    first article or main, or, on a page without one, most of the text.
    """
    page = page or ""
    scan, at, parts = _Scanner(page), 0, []
    out: list[tuple[int, str]] = []  # (region, text)
    regions: list[list] = [[-1, "", False, False]]  # (region around it, kind, in content, in chrome)
    stack: list[tuple[str, int]] = []  # open elements with a region of their own, and the region outside them
    region, seen_article = 0, False

    def close() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((region, text))
            parts.clear()

    open_ = Counter()
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            parts.append(page[at:])
            break
        if start > at:
            parts.append(page[at:start])
        after = page[start + 1 : start + 3]
        if after[:1] in ("!", "?"):
            comment = page.startswith("<!--", start)
            end = start + 5 if comment and page.startswith(("<!-->",), start) else page.find("-->" if comment else ">", start + (4 if comment else 1))
            at = len(page) if end < 0 else end if comment and page[start : start + 5] == "<!-->" else end + (3 if comment else 1)
            continue
        letter = after[1:] if after[:1] == "/" else after[:1]
        if not (letter.isascii() and letter.isalpha()):  # a sign of its own, or an end tag without a name
            if after[:1] == "/" and letter:
                end = page.find(">", start)
                at = len(page) if end < 0 else end + 1
            else:
                parts.append("<")
                at = start + 1
            continue
        found = scan.tag(start)
        if found is None:  # the page ends inside a tag
            break
        at, slash, name, attributes = found
        if slash:
            if open_[name]:
                close()
                while stack:
                    n, region = stack.pop()
                    open_[n] -= 1
                    if n == name:
                        break
            elif name not in _INLINE:
                close()
            continue
        if name in _RAW or name in _SKIPPED:
            if name not in _INLINE:
                close()
            if not attributes.endswith("/") or name in _RAW:
                end = scan.after(name, at)
                at = end if end is not None else len(page) if name in ("script", "style") else at
            continue
        if name == "br":
            parts.append(" ")
        if name in _INLINE:
            continue
        close()
        if name in _VOID or attributes.endswith("/"):
            continue
        if name in _P_ENDS:  # an open p with a region of its own ends here
            while stack and stack[-1][0] == "p":
                region = stack.pop()[1]
                open_["p"] -= 1
        *_, inside, hidden = regions[region]
        kind = _kind(name, attributes, inside)
        if kind == "content" and not hidden and not seen_article:
            seen_article, outer = True, region
            while outer >= 0:
                if regions[outer][1] == "named":
                    regions[outer][1] = ""
                outer = regions[outer][0]
        if kind or open_[name]:
            stack.append((name, region))
            open_[name] += 1
            if kind:
                regions.append([region, kind, inside or kind == "content", hidden or kind == "chrome"])
                region = len(regions) - 1
    close()
    return _roles(out, regions, seen_article)


def _roles(found: list[tuple[int, str]], regions: list[list], seen_article: bool) -> list[tuple[int, str]]:
    """Blocks with the roles that their regions give them."""
    if not seen_article:
        held = [0] * len(regions)
        for region, text in found:
            held[region] += len(text)
        for k in range(len(regions) - 1, 0, -1):  # a region stands after the one around it
            held[regions[k][0]] += held[k]
        for k in range(1, len(regions)):
            if regions[k][1] == "named" and 2 * held[k] > held[0]:
                regions[k][1] = ""
    roles = [OPEN]
    for outer, kind, *_ in regions[1:]:
        role = roles[outer]
        if role != CHROME and kind:
            role = CONTENT if kind == "content" else CHROME
        roles.append(role)
    return [(roles[region], text) for region, text in found]


def covered(pages: list[list[str]], run: int = RUN, least: int = PAGES) -> list[np.ndarray]:
    """For each page's tokens, which stand in a run of ``run`` or more that ``least`` or more pages share."""
    lengths = np.array([len(p) for p in pages], np.int64)
    total = int(lengths.sum())
    if not total:
        return [np.zeros(0, bool) for _ in pages]
    owner = np.repeat(np.arange(len(pages)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    _, rank = np.unique(np.array([hash(t) for p in pages for t in p], np.int64), return_inverse=True)
    rank, width = rank.astype(np.int64) + 1, 1
    while width < run:  # rank of each suffix by its first `width` tokens, doubled; a page's end is rank 0
        step = min(width, run - width)
        ahead = np.zeros(total, np.int64)
        ahead[: max(0, total - step)] = rank[step:]
        ahead[np.arange(total) + step >= ends] = 0
        _, rank = np.unique(rank * (total + 2) + ahead, return_inverse=True)
        rank, width = rank.astype(np.int64) + 1, width + step
    suffixes = np.lexsort((owner, rank))
    ranks, owners = rank[suffixes], owner[suffixes]
    fresh = np.r_[True, (ranks[1:] != ranks[:-1]) | (owners[1:] != owners[:-1])]
    group = np.cumsum(np.r_[True, ranks[1:] != ranks[:-1]]) - 1
    distinct = np.bincount(group, fresh)  # pages that share each run of tokens
    starts = suffixes[(distinct[group] >= least) & (suffixes + run <= ends[suffixes])]
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + run, -1)
    return np.split(np.cumsum(marks[:-1]) > 0, np.cumsum(lengths)[:-1])


def _stream(found: list[tuple[int, str]]) -> tuple[list[str], list[tuple[int, int]]]:
    """The token stream of a page's blocks, and where in it each block stands."""
    edge = "\n"  # between blocks, so that runs of short blocks count as long
    stream, span = [edge], []
    for _, text in found:
        tokens = text.split(" ")
        span.append((len(stream), len(stream) + len(tokens)))
        stream += [*tokens, edge]
    return stream, span


def _kept(found: list[tuple[int, str]], stream: list[str], span: list[tuple[int, int]], hit: np.ndarray) -> str:
    """A page's main text, given which of its tokens are boilerplate."""
    kept = []
    for (role, text), (a, b) in zip(found, span):
        if role == CONTENT:
            kept.append(text)
        elif role == OPEN and (left := [t for t, h in zip(stream[a:b], hit[a:b]) if not h]):
            kept.append(" ".join(left))
    return "\n".join(kept)


def main_texts(pages: list[list[tuple[int, str]]], run: int = RUN, least: int = PAGES) -> list[str]:
    """The main text of each page of a host that fits one place, given its blocks."""
    laid = [_stream(found) for found in pages]
    return [_kept(found, *at, hit) for found, at, hit in zip(pages, laid, covered([stream for stream, _ in laid], run, least))]


class _TokenPrints(dict):
    """64-bit print of each token, the same in every process."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _TOKENS:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return value


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a ^ (a >> np.uint64(29)), b ^ (b >> np.uint64(32))
    return a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)


def run_prints(stream: list[str], host: str, run: int, known: _TokenPrints) -> np.ndarray:
    """For each place where ``run`` tokens start, the print of the host and these tokens."""
    if len(stream) < run:
        return np.zeros(0, np.int64)
    prints, width = np.array([known[t] for t in stream], np.uint64), 1
    while width < run:
        step = min(width, run - width)
        prints, width = _mixed(prints[:-step], prints[step:]), width + step
    return _mixed(prints, np.array([xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass"))], np.uint64)).view(np.int64)


def _reaching(found: list[tuple[int, str]], span: list[tuple[int, int]], starts: int, run: int) -> np.ndarray:
    """For each place where a run starts, whether it reaches a token of an open block."""
    marks = np.zeros(starts + run, np.int64)
    for (role, _), (a, b) in zip(found, span):
        if role == OPEN:
            marks[a + 1 : b + 1] = 1
    total = np.cumsum(marks)
    return total[run:] > total[:-run]


def _among(prints: np.ndarray, some: np.ndarray) -> np.ndarray:
    """For each print, whether it is one of ``some``, which are in order."""
    return some[np.minimum(np.searchsorted(some, prints), len(some) - 1)] == prints if len(some) else np.zeros(len(prints), bool)


def _open_runs(rows: list[tuple[str, str | None]], run: int, known: _TokenPrints) -> Iterator[np.ndarray]:
    """For each (host, page), the prints of the runs that reach an open block, each once."""
    for host, page in rows:
        found = blocks(page)
        prints = np.zeros(0, np.int64)
        if any(role == OPEN for role, _ in found):
            stream, span = _stream(found)
            if len(prints := run_prints(stream, host, run, known)):
                prints = np.unique(prints[_reaching(found, span, len(prints), run)])
        yield prints


def _rows(batch: pa.RecordBatch) -> list[tuple[str, str | None]]:
    return list(zip(batch["host"].to_pylist(), batch["html"].to_pylist()))


def _added(pages: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``print, pages``: the pages of each print, added up for every ``_HELD`` prints or so."""
    held, size = [], 0

    def added() -> pa.RecordBatch:
        prints, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(counts, pa.int64())], ["print", "pages"])

    for prints in pages:
        if len(prints):
            held.append(prints)
            size += len(prints)
        if size >= _HELD:
            yield added()
            held, size = [], 0
    if held:
        yield added()


def _sent(prints: DataFrame):
    return prints.sparkSession.sparkContext.broadcast(np.sort(prints.toPandas()["print"].to_numpy(np.int64)))


def boilerplate(plain: DataFrame, run: int, least: int, hit_rows: int) -> DataFrame:
    """``print`` of each run that ``least`` pages of a host share and that reaches an open block (columns host, html)."""
    own = plain.select("host", "html")

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _TokenPrints()
        return _added(p for batch in batches for p in _open_runs(_rows(batch), run, known))

    asked = checkpointed(own.mapInArrow(reaching, "print long, pages long").select("print").distinct())
    n = asked.count()
    if not n:
        return asked
    wanted = _sent(asked) if n <= hit_rows else None

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, some = _TokenPrints(), wanted.value if wanted else None

        def each() -> Iterator[np.ndarray]:
            for batch in batches:
                for host, page in _rows(batch):
                    prints = np.unique(run_prints(_stream(blocks(page))[0], host, run, known))
                    yield prints if some is None else prints[_among(prints, some)]

        return _added(each())

    met = own.mapInArrow(counts, "print long, pages long").groupBy("print").agg(F.sum("pages").alias("pages"))
    met = met.filter(F.col("pages") >= least).select("print")
    return checkpointed(met if wanted else met.join(asked, "print"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, least: int = PAGES, hit_rows: int = HIT_ROWS) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    Null and empty pages, and pages without main text, give an empty text.  Pages with a
    null url are one host.  Repeated rows are distinct pages.  An empty table gives an
    empty result; other columns play no part.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    hits = boilerplate(plain, run, least, hit_rows)
    small = hits.count() <= hit_rows
    if small:
        sent = _sent(hits)
    else:  # equal pages of a host have equal runs, so they share a name
        plain = plain.withColumn("name", F.sha2(F.concat_ws("\n", "host", F.coalesce("html", F.lit(""))), 256))

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _TokenPrints()
            for batch in batches:
                for name, prints in zip(batch["name"].to_pylist(), _open_runs(_rows(batch), run, known)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(prints), pa.string()), pa.array(prints, pa.int64())], ["name", "print"])

        own = plain.select("name", "host", "html").mapInArrow(named, "name string, print long").join(hits, "print").groupBy("name").agg(F.collect_set("print").alias("hits"))
        plain = plain.join(own, "name", "left").drop("name")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, everywhere = _TokenPrints(), sent.value if small else None
        for batch in batches:
            out = []
            for k, (host, page) in enumerate(_rows(batch)):
                found = blocks(page)
                if any(role == OPEN for role, _ in found):
                    stream, span = _stream(found)
                    among = everywhere if small else np.sort(np.array(batch["hits"][k].as_py() or [], np.int64))
                    prints = run_prints(stream, host, run, known) if len(among) else among
                    starts = np.flatnonzero(_among(prints, among))
                    marks = np.zeros(len(stream) + 1, np.int64)
                    marks[starts] += 1
                    marks[starts + run] -= 1
                    out.append(_kept(found, stream, span, np.cumsum(marks[:-1]) > 0))
                else:
                    out.append("\n".join(text for role, text in found if role == CONTENT))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return plain.mapInArrow(texts, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
