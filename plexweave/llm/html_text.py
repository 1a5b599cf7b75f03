"""Main text of web pages: page structure where it tells, a host's repeated substrings where it doesn't.

Scripts, styles, comments, menus, headers, footers, sidebars, forms, adverts, notices and reader comments are dropped
by their elements and by the words in class, id and role. Where a page marks its article (article, main), its stream is
the text of that, else of all blocks left. The streams of all pages of a host are laid end to end in a suffix array, in
which runs of words that stand on a share of the host's distinct pages lie side by side; these are boilerplate, and what
is left is the text. Marks guide the search:
within an article a run must stand on far more pages, and a run that makes up most of the article is the text itself,
as copies of one article on a host share it.

Streams come together in parts of a host, about PART pages each by a hash of the page, so no task holds a host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexweave.llm.common import bound_batches, checkpointed
from plexweave.llm.words import hashes, rolling

#: Tokens of a repeated substring at least.
RUN = 8
#: Boilerplate stands on so many distinct pages of its host, and on this share of them at least: outside and inside of marked articles.
LEAST, SHARE = (2, 3), (0.1, 0.5)
#: A run on two pages, and any in a marked article, is taken out only where it leaves at least this share of the words.
LEAVES = 0.5
#: Pages of a part of a host, about.
PART = 256
#: Rows that are broadcast at most.
BROADCAST_ROWS = 200_000

# Fixed values of HTML: elements whose content is no text, elements outside an article, and elements within a line.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video")
OUTSIDE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "datalist", "fieldset")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
MARKED = ("article", "main")
# Words in class, id and role that mark something beside the article.
BESIDE = (
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies",
    "consent", "disqus", "footer", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo",
    "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget", "complementary", "contentinfo", "search",
    "teaser", "teasers", "recommended", "commentlist", "gdpr", "masthead", "pagination", "replies", "reply",
)
# Words that go with these in one name; a name with any other word marks nothing.
PLACES = (
    "area", "articles", "author", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "global", "group", "icon", "icons", "inner",
    "item", "items", "label", "left", "link", "links", "list", "main", "message", "meta", "mobile", "outer", "overlay", "page", "panel", "post", "posts", "primary", "right",
    "row", "secondary", "section", "signup", "site", "slot", "stories", "text", "this", "thread", "title", "top", "unit", "user", "wrap", "wrapper",
)
# Words that name a part of an article as well: on headings, and the first one within articles, they mark nothing.
PARTS = ("header", "banner", "notice", "teaser", "widget")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Elements whose start ends an open paragraph, and elements that end with the next of their kind.
ENDS_P = (
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
)
SIBLINGS = ("li", "td", "th", "tr", "dt", "dd", "option")

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-zA-Z][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[^a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+>", re.IGNORECASE) for tag in RAW}
_BESIDE, _OUTSIDE, _INLINE, _VOID, _MARKED, _PLACES, _PARTS, _ENDS_P, _SIBLINGS = map(frozenset, (BESIDE, OUTSIDE, INLINE, VOID, MARKED, PLACES, PARTS, ENDS_P, SIBLINGS))
#: Elements that may end without a tag of their own.
_MAY_STAY_OPEN = _SIBLINGS | {"p"}


def _is_beside(tag: str, attributes: str, inside: bool) -> bool:
    """Whether a name in class, id or role is made up of a word of BESIDE and others of BESIDE and PLACES; `inside` of an article."""
    means_nothing = _PARTS if tag in HEADINGS else {"header"} if inside else frozenset()
    for m in _NAMES.finditer(attributes):
        for name in "".join(filter(None, m.groups())).lower().split():
            parts = {w for w in _WORDS.split(name) if len(w) > 1}
            if parts & _BESIDE - means_nothing and parts <= _BESIDE | _PLACES:
                return True
    return False


class _Beside:
    """An element beside the article: the one around it, whether an article begins in it, whether its text is dropped."""

    __slots__ = ("tag", "around", "holds", "drops", "first")

    def __init__(self, tag: str, around: _Beside | None):
        self.tag, self.around, self.holds, self.drops, self.first = tag, around, False, True, True


def blocks(page: str | None) -> tuple[list[str], bool]:
    """The blocks of text of a page in order, and whether they are those of marked articles.

    References are decoded and white space in a block is one space; blocks without text are left out. An article within
    an article is a comment or teaser and left out, and so are articles within a main element that has more text outside
    of them. Of an element beside the article that ends only because one around it does, as its own end tag is missing,
    the first block is left out and the rest stays; where the page ends first, all is left out but for an element in
    which an article begins. A form around an article is none. Elements without text (scripts, graphics) may close
    themselves, and without an end tag only scripts, styles and comments reach to the end of the page. Time is linear in
    the page.
    """
    if not page:
        return [], False
    #: open elements as (tag, beside the article, main element, article)
    stack: list[tuple[str, _Beside | None, bool, bool]] = []
    opened: dict[str, int] = {}
    inside = [0, 0]  # of main elements, of articles
    around: _Beside | None = None
    beside: list[_Beside] = []
    found: list[tuple[bool, bool, str, _Beside | None, bool]] = []
    line: list[str] = []
    endless: set[str] = set()

    def end_block() -> None:
        if line:
            text = " ".join(entities.unescape("".join(line)).split())
            line.clear()
            if text:
                first = around is not None and around.first
                if first:
                    around.first = False
                found.append((inside[0] > 0, inside[1] > 0, text, around, first))

    def pop(own: bool, last: bool = False) -> None:
        """Close the innermost element: by its own end or not, as the page's `last` ones."""
        nonlocal around
        tag, mark, main, article = stack.pop()
        opened[tag] -= 1
        inside[0] -= main
        inside[1] -= article
        if mark:
            own = own or tag in _MAY_STAY_OPEN
            mark.drops = not (mark.holds and tag == "form") if own else last and not mark.holds
            around = mark.around

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            line.append(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag, attributes, closing = tag.lower(), m["attributes"], bool(m["close"])
        if tag in _RAW_END:
            if closing or attributes.endswith("/"):
                continue
            end = None if tag in endless else _RAW_END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                break
            else:
                endless.add(tag)
            continue
        is_beside = bool(attributes and not closing and _is_beside(tag, attributes, inside[0] + inside[1] > 0))
        if tag in _INLINE and not is_beside and not (closing and opened.get(tag)):
            continue
        end_block()
        if closing:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop(False, tag in ("body", "html"))
                pop(True)
            continue
        # an open paragraph or list item ends here without a tag of its own
        if stack and (stack[-1][0] == "p" and tag in _ENDS_P or stack[-1][0] == tag and tag in _SIBLINGS):
            pop(True)
        if tag in _VOID or attributes.endswith("/"):
            continue
        if tag in _MAY_STAY_OPEN and not is_beside:
            continue  # nothing hangs on their end
        article = tag == "article"
        # the header of an article holds its title
        outside = tag in _OUTSIDE and not (tag == "header" and inside[0] + inside[1]) or article and inside[1] > 0
        mark = None
        if is_beside and tag not in _MARKED or outside:
            mark = around = _Beside(tag, around)
            beside.append(mark)
        elif tag in _MARKED:
            held = around
            while held and not held.holds:
                held.holds, held = True, held.around
        stack.append((tag, mark, tag == "main", article))
        opened[tag] = opened.get(tag, 0) + 1
        inside[0] += tag == "main"
        inside[1] += article
    end_block()
    while stack:
        pop(False, True)
    for mark in beside:  # outer ones come first
        mark.drops = mark.drops or mark.around is not None and mark.around.drops
    kept = [(main, article, text) for main, article, text, mark, first in found if not (mark and (mark.drops or first))]
    size = lambda within: sum(len(t) for main, article, t in kept if main and article == within)
    teasers = size(False) > size(True)
    articles = [t for main, article, t in kept if (main or article) and not (main and article and teasers)]
    return (articles, True) if articles else ([t for _, _, t in kept], False)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, HTML, becomes the stream of the page."""
    for b in batches:
        texts = [" ".join(blocks(page)[0]) for page in b.column(b.num_columns - 1).to_pylist()]
        yield pa.record_batch([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])


def _windows(text: str) -> tuple[list[bytes], np.ndarray]:
    """The words of a stream and the hash of the RUN words from each of them on."""
    words = text.encode().split(b" ") if text else []
    return words, rolling(hashes(11).of(words), RUN).view(np.int64)


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The rank of the suffix at each place of `tokens` by its first `depth` tokens, a power of two; alike ones are equal.

    Ranks by twice as many tokens follow from pairs of ranks, as in the building of a suffix array by doubling.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, size = len(rank), 1
    while size < depth:
        after = np.zeros(n, np.int64)
        after[: max(n - size, 0)] = rank[size:] + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
        size *= 2
    return rank


def shared_runs(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """page and place of one occurrence of each run of RUN tokens that several of the `pages` have, and how many have it."""
    pages_of = np.repeat(np.arange(len(pages)), [len(p) + 1 for p in pages])
    at = np.concatenate([np.arange(len(p) + 1) for p in pages])
    # the end of each page is a token of its own, so no run that goes beyond it is shared
    known, words = np.unique(np.concatenate(pages), return_inverse=True)
    lengths = np.array([len(p) for p in pages])
    tokens = np.empty(len(at), np.int64)
    inside = at < lengths[pages_of]
    tokens[inside], tokens[~inside] = words, len(known) + np.arange(len(pages))
    rank = suffix_ranks(tokens, RUN)
    order = np.lexsort((pages_of, rank))
    order = order[at[order] + RUN <= lengths[pages_of[order]]]
    if not len(order):
        return order, order, order
    r, p = rank[order], pages_of[order]
    heads = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    distinct = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])].astype(np.int64)
    n = np.add.reduceat(distinct, heads)
    some = order[heads[n > 1]]
    return pages_of[some], at[some], n[n > 1]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, part, page, text) sorted by the first three, (host, win, n): the windows that n > 1 distinct pages of a
    part have; with a null for win, the number of distinct pages of a part."""
    part, last, pages = None, None, []

    def counted() -> pa.RecordBatch:
        page, at, n = shared_runs(pages)
        win = np.array([rolling(pages[p][a : a + RUN], RUN)[0] for p, a in zip(page.tolist(), at.tolist())], np.uint64).view(np.int64)
        arrays = [pa.array(np.full(len(n) + 1, part[0], np.int64)), pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(win)]), pa.array(np.r_[len(pages), n].astype(np.int64))]
        return pa.record_batch(arrays, ["host", "win", "n"])

    for b in batches:
        for host, number, page, text in zip(*(c.to_pylist() for c in b.columns)):
            if (host, number) != part:
                if part:
                    yield counted()
                part, last, pages = (host, number), None, []
            if page != last:
                last = page
                pages.append(hashes(11).of(text.encode().split(b" ") if text else []))
    if part:
        yield counted()


def _without_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (page_id, url, html, pages of the host, windows, their pages), the words that no boilerplate covers."""
    for b in batches:
        texts = []
        for html, pages, known, on in zip(*(b.column(k).to_pylist() for k in range(2, 6))):
            parts, marked = blocks(html)
            text = " ".join(parts)
            words, windows = _windows(text)
            if not known or not len(windows):
                texts.append(text)
                continue
            known, on = np.array(known, np.int64), np.array(on, np.int64)
            order = np.argsort(known)
            known, on = known[order], on[order]
            at = np.minimum(np.searchsorted(known, windows), len(known) - 1)
            n = np.where(known[at] == windows, on[at], 0)

            def left(least: int, n: np.ndarray = n, size: int = len(words)) -> np.ndarray:
                edge = np.zeros(size + 1, np.int64)
                start = np.flatnonzero(n >= max(least, SHARE[marked] * pages))
                np.add.at(edge, start, 1)
                np.add.at(edge, start + RUN, -1)
                return np.cumsum(edge[:size]) == 0

            keep = left(LEAST[marked])
            if keep.sum() < LEAVES * len(words):
                keep = np.ones(len(words), bool) if marked else left(LEAST[marked] + 1)
            texts.append(b" ".join(w for w, k in zip(words, keep.tolist()) if k).decode())
        yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text: the main text of each row of `pages`, blocks joined by one space.

    Null and empty pages, and pages without text, have an empty text. Pages with a null URL, or one without a host,
    form a host of their own. Equal rows are one page and do not repeat each other. Rows that repeat an id stay
    apart. A page that names an article element, but has none with text, is searched as one without. On a host of
    over 2 PART pages, a page counts for a window if another page of its part has the window too. An empty table
    gives an empty result; other columns are not read.
    """
    bound_batches(pages.sparkSession)
    host = F.xxhash64(F.coalesce(F.parse_url(F.when(F.col("url").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^\\s]*$"), F.col("url")), F.lit("HOST")), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.select("page_id", "url", host.alias("host"), "html")
    texts = rows.mapInArrow(_texts, "page_id long, url string, host long, text string")
    large = checkpointed(rows.groupBy("host").count().where(F.col("count") > 2 * PART).select("host", F.ceil(F.col("count") / PART).alias("parts")))
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    page = F.xxhash64("page_id", "url", "text")
    dealt = texts.select("host", page.alias("page"), "text").join(large, "host", "left")
    dealt = dealt.select("host", F.coalesce(F.pmod("page", "parts"), F.lit(0)).cast("int").alias("part"), "page", "text")
    found = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "page").mapInArrow(_repeated, "host long, win long, n long")
    found = checkpointed(found.groupBy("host", "win").agg(F.sum("n").alias("n")))
    sizes = found.where("win is null").select("host", F.col("n").alias("pages"))
    common = found.where("win is not null").join(sizes, "host").where(F.col("n") >= F.greatest(F.lit(min(LEAST)), min(SHARE) * F.col("pages")))
    common = common.groupBy("host", "pages").agg(F.collect_list(F.struct("win", "n")).alias("found"))
    common = checkpointed(common.select("host", "pages", F.col("found.win").alias("known"), F.col("found.n").alias("on")))
    few = (common.agg(F.sum(F.size("known"))).first()[0] or 0) <= BROADCAST_ROWS
    # pages are read again for this, so that no task keeps two Python workers and no text has to be written
    joined = rows.join(F.broadcast(common) if few else common, "host", "left").select("page_id", "url", "html", "pages", "known", "on")
    return joined.mapInArrow(_without_runs, "page_id long, url string, text string")
