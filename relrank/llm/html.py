"""Main text of web pages, without what a site repeats on its pages.

Each page is parsed into elements; an element's subtree is hashed over its tags and text, children first. Spark counts on
how many different pages of a host a subtree occurs (copies of one page count once); subtrees on MIN_PAGES pages or more
are the site's template and are deleted. Elements whose tag, class, id or role names a menu, header, footer, sidebar,
notice, advert, form or comment section go as well: whole names always, parts of compound names and forms unless they hold
most of a page's text. Of what is left, the article is taken where the page marks one; what holds all of a page's
articles is never deleted for its name.

Running text (paragraphs, headings, list items and the like) inside a marked article is never taken for a template:
copied articles and passages repeat on a site, too.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relrank.session import materialize

MIN_PAGES = 5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)|<[!?/][^>]*>", re.S)
_TAG_END = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Fixed values of HTML: elements without content, without markup inside, that end a paragraph, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
RUNNING_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr tbody".split())
NO_CONTENT = frozenset(
    "head script style noscript template title nav footer aside form button select option textarea input iframe object "
    "embed svg canvas audio video dialog menu map datalist".split()
)
# Parts of class, id and role names of elements that are no main text.
NO_CONTENT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promoted promotion "
    "banner banners cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside complementary header masthead topbar "
    "footer foot colophon contentinfo comment comments commentlist disqus replies respond reply related recommended "
    "recommendations share sharing social newsletter subscribe subscription subscribebox signup login search searchbox form toolbar "
    "widget widgets pagination pager skip".split()
)
# Words that also stand in names of content ("market-share"): they count as whole names only.
AMBIGUOUS = frozenset("share sharing form search notice notices alert alerts reply respond skip header aside related social".split())
TELLING_PARTS = NO_CONTENT_NAMES - AMBIGUOUS
STATES = frozenset("has no with without not is".split())  # "has-sidebar" is said of what stands beside one
CERTAIN, LIKELY = 1, 2


def _attribute_names(attributes: str) -> list[str]:
    return [n for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").split()]


def _telling(tag: str, names: list[str]) -> tuple[bool, bool]:
    """Whether a whole name tells that an element is no main text, and whether a part of a compound name does."""
    if any(n.lower() in NO_CONTENT_NAMES for n in names):
        return True, False
    if tag in RUNNING_TEXT or tag in INLINE:
        return False, False
    for name in names:
        parts = [x.lower() for x in _PART.findall(name)]
        if len(parts) > 1 and parts[0] not in STATES and not TELLING_PARTS.isdisjoint(parts):
            return False, True
    return False, False


class Element:
    """An open element: where its pieces start, what it is, and a digest over what it held so far."""

    __slots__ = ("tag", "start", "dropped", "article", "in_article", "digest", "n_chars")

    def __init__(self, tag: str, start: int, dropped: int, article: int, in_article: bool) -> None:
        self.tag, self.start, self.dropped, self.article, self.in_article = tag, start, dropped, article, in_article
        self.digest, self.n_chars = xxhash.xxh64(tag), 0


class Tags:
    """Finds the ends of tags. A `>` inside quotes ends no tag, unless the quotes never close."""

    def __init__(self, source: str) -> None:
        self._source, self._dead = source, set()

    def end(self, at: int) -> int:
        """Where the tag's attributes from `at` on end, or -1. No quote is looked at twice in vain."""
        source, i, passed = self._source, at, []
        while match := _TAG_END.search(source, i):
            i = match.start()
            if match[0] == ">":
                return i
            if i in self._dead:
                break
            passed.append(i)
            i = source.find(match[0], i + 1) + 1
            if not i:
                break
        self._dead.update(passed)
        return source.find(">", at)


class Page:
    """Text pieces and tags of a page in order, its subtrees as piece ranges, and the ranges to take and to leave out.

    Time is linear in the page, however deep its elements or odd its quotes.
    """

    def __init__(self, source: str) -> None:
        self.pieces: list[str] = []
        self.is_text: list[bool] = []
        self.subtrees: list[tuple[int, int]] = []
        self.digests: list[int] = []  # of each subtree over tags and text
        self.dropped: list[tuple[int, int, int, int]] = []  # from, to, characters, CERTAIN or LIKELY
        self.articles: dict[int, list[tuple[int, int]]] = {}
        self.n_chars = 0
        self._stack: list[Element] = []
        self._open_tags: dict[str, list[int]] = {}  # places in the stack
        self._open_articles = 0
        self._parse(source)

    def _add(self, piece: str, text: bool) -> None:
        self.pieces.append(piece)
        self.is_text.append(text)
        words = " ".join(piece.split())
        if self._stack and words:
            self._stack[-1].digest.update(words + "\n")
        if text and words:
            self.n_chars += len(words)
            if self._stack:
                self._stack[-1].n_chars += len(words)

    def _close(self, n: int) -> None:
        """Closes all but the n outer elements."""
        while len(self._stack) > n:
            element = self._stack.pop()
            self._open_tags[element.tag].pop()
            self._open_articles -= bool(element.article)
            span = (element.start, len(self.pieces))
            digest = element.digest.intdigest()
            if self._stack:
                self._stack[-1].digest.update(digest.to_bytes(8, "little"))
                self._stack[-1].n_chars += element.n_chars
            self.pieces.append(f"</{element.tag}>")
            self.is_text.append(False)
            if element.dropped:
                self.dropped.append((*span, element.n_chars, element.dropped))
            if element.article:
                self.articles.setdefault(element.article, []).append(span)
            if element.n_chars and element.tag not in INLINE and not (element.in_article and element.tag in RUNNING_TEXT):
                if not element.article and element.tag not in ("html", "body"):
                    self.subtrees.append(span)
                    self.digests.append(digest - (1 << 63))

    def _last(self, tags: tuple[str, ...]) -> int:
        """The innermost open element of these tags, -1 if there is none."""
        return max((self._open_tags[t][-1] for t in tags if self._open_tags.get(t)), default=-1)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in ENDS_PARAGRAPH and self._last(("p",)) >= 0:
            self._close(self._last(("p",)))
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = self._last({"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,)))
            if same > self._last(("ul", "ol", "dl", "table", "menu", "div", "article", "body")):
                self._close(same)
        names = _attribute_names(attributes) if attributes else []
        in_article = self._open_articles > 0
        # An article's own header holds its title.
        whole, part = _telling(tag, [n for n in names if not (in_article and n.lower() == "header")])
        # What a page marks as its article or main part is content whatever else its class says.
        role_main = "role" in attributes.lower() and any(n.lower() == "main" for n in names)
        article = 2 if tag == "article" and not (whole or part) else 1 if tag == "main" or role_main else 0
        dropped = 0
        if tag in NO_CONTENT and tag != "form" or tag == "header" and not in_article:
            dropped = CERTAIN
        elif not article and tag not in ("html", "body"):
            if whole or attributes and _HIDDEN.search(attributes):
                dropped = CERTAIN
            elif part or tag == "form":
                dropped = LIKELY
        start = len(self.pieces)
        self.pieces.append(f"<{tag}>")
        self.is_text.append(False)
        if tag in VOID:
            return
        self._open_tags.setdefault(tag, []).append(len(self._stack))
        self._open_articles += bool(article)
        self._stack.append(Element(tag, start, dropped, article, in_article))

    def _parse(self, source: str) -> None:
        at, n, tags = 0, len(source), Tags(source)
        while at < n:
            match = _TOKEN.search(source, at)
            end = match.start() if match else n
            if end > at:
                self._add(source[at:end], True)
            if not match:
                break
            at = match.end()
            if not match[2]:
                continue
            stop = tags.end(at)
            if stop < 0:
                self._add(source[end:], True)  # a tag that never ends
                break
            tag, attributes, at = match[2].lower(), source[at:stop], stop + 1
            if match[1]:
                place = self._last((tag,))
                if place >= 0:
                    self._close(place)
                elif tag in ("p", "br"):
                    self._add("<br>", False)
                continue
            self._open(tag, attributes)
            if tag in RAW:
                closing = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
                at = closing.start() if closing else n
        self._close(0)

    def context(self) -> int:
        """A digest of the page's text, equal for copies of one page."""
        text = " ".join(p for p, t in zip(self.pieces, self.is_text, strict=True) if t)
        return xxhash.xxh64_intdigest(text) - (1 << 63)

    def _covered(self, spans: Iterable[tuple[int, int]]) -> list[bool]:
        """Which pieces some span covers."""
        depth = [0] * (len(self.pieces) + 1)
        for a, b in spans:
            depth[a] += 1
            depth[b] -= 1
        return [d > 0 for d in accumulate(depth[:-1])]

    def text(self, template: frozenset[int] = frozenset(), marks: bool = True) -> str:
        """The main text: blocks in page order with single spaces. Without `marks` only the template is left out."""
        leave = [s for s, h in zip(self.subtrees, self.digests, strict=True) if h in template]
        taken = [(0, len(self.pieces))]
        if marks:
            spans = self.articles.get(2) or self.articles.get(1) or []
            dropped = [(a, b) for a, b, _, _ in self.dropped]
            if spans:
                out = self._covered(dropped)
                outside = [s for s in spans if not out[s[0]]]
                if not outside:
                    # All articles lie in elements to leave out: what holds an article is none of them.
                    starts = self._covered((a, a + 1) for a, _ in spans)
                    held = list(accumulate(starts, initial=0))
                    dropped = [(a, b) for a, b in dropped if held[b] == held[a]]
                taken = outside or spans
            else:
                # A form or a compound name around most of the page's text is its layout.
                dropped = [(a, b) for a, b, size, sure in self.dropped if sure == CERTAIN or 2 * size <= self.n_chars]
            leave += dropped
        else:
            raw = [(a, b) for a, b, _, _ in self.dropped if self.pieces[a].strip("<>") in RAW or self.pieces[a] == "<head>"]
            leave += raw
        out = []
        for piece, is_text, kept, left in zip(self.pieces, self.is_text, self._covered(taken), self._covered(leave), strict=True):
            if is_text and kept and not left:
                out.append(piece)
            elif not is_text and piece.strip("</>") not in INLINE:
                out.append(" ")
        return " ".join(entities.unescape("".join(out)).split())


def _subtree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct subtrees of each page, under its host."""
    for batch in batches:
        hosts, sources, contexts, found = [], [], [], []
        columns = [batch.column(n).to_pylist() for n in ("host", "source", "html")]
        for host, key, source in zip(*columns, strict=True):
            page = Page(source)
            own = sorted(set(page.digests))
            hosts += [host] * len(own)
            sources += [key] * len(own)
            contexts += [page.context()] * len(own)
            found += own
        yield pa.record_batch({
            "host": pa.array(hosts, pa.string()), "source": pa.array(sources, pa.int64()),
            "context": pa.array(contexts, pa.int64()), "subtree": pa.array(found, pa.int64()),
        })


def _text_rows(names: list[str], template: str, marks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(batch.schema.get_field_index("html")).to_pylist()
            templates = batch.column(template).to_pylist()
            texts = [Page(x or "").text(frozenset(t or ()), marks) for x, t in zip(sources, templates, strict=True)]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*names, "main_text"])

    return run


def host_of(url: str = "url"):
    """Host of a URL in lower case, null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(host, source, context, subtree): the different subtrees with text of every page, written once."""
    rows = pages.select(host_of().alias("host"), "html").where("host is not null and html is not null")
    # Rows of one host and html have the same templates.
    rows = rows.select("host", "html", F.xxhash64("host", "html").alias("source"))
    return materialize(rows.mapInArrow(_subtree_rows, "host string, source long, context long, subtree long"), "page_subtrees")


def site_templates(subtrees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree, n_pages): the subtrees on min_pages pages of a host at least; copies of one page count once."""
    # A menu may be on a third of all pages: contexts are made distinct first, counts are combined before the shuffle.
    counted = subtrees.select("host", "subtree", "context").distinct().groupBy("host", "subtree")
    return counted.agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, marks: bool = True) -> DataFrame:
    """`pages` with a column main_text; null or empty html gives an empty text, a page without host has no template.

    Without `marks` nothing but the counts decides: neither article marks nor tags and names. Other columns are kept,
    html is left out; a column main_text is replaced.
    """
    names = [n for n in pages.columns if n not in ("html", "main_text")]
    subtrees = page_subtrees(pages)
    found = subtrees.join(site_templates(subtrees, min_pages), ["host", "subtree"])
    # At most a page's own subtrees; they grow with the pages, so both sides are shuffled.
    taken = "_" * (max(len(n) for n in pages.columns) + 1)  # longer than any column's name
    mine, theirs, template = f"{taken}a", f"{taken}b", f"{taken}c"
    own = found.groupBy(F.col("source").alias(theirs)).agg(F.collect_set("subtree").alias(template))
    rows = pages.select(*[F.col(f"`{n}`") for n in names], "html").withColumn(mine, F.xxhash64(host_of(), F.col("html")))
    joined = rows.join(own.hint("merge"), F.col(mine) == F.col(theirs), "left").drop(mine, theirs)
    fields = [pages.schema[n] for n in names] + [T.StructField("main_text", T.StringType())]
    return joined.mapInArrow(_text_rows(names, template, marks), T.StructType(fields))
