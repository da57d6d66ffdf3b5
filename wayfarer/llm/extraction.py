"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once, tag by tag, and becomes a flat list of text blocks (what stands between two block-level tags). Each block
is described by its own number of words and link density, by those of the blocks before and after it that aren't in page furniture,
by what the elements around it are (page furniture, an article, or neither), and by whether the class of a container that holds
it hints at furniture. A decision tree, grown from the blocks of the small labelled pages below, tells article text from the rest;
the article's blocks are joined in page order.

Defined results: null and empty pages, and pages without article text, give an empty text; null and repeated ids pass
through; extra columns are ignored. Pages cut off anywhere, and tags that are never closed, are read to the end.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfarer.llm.common import slices

#: Fixed by HTML: elements that begin a new block, and those whose content is no text of the page.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
NO_TEXT = frozenset("script style noscript template textarea select button iframe svg math object canvas audio video title".split())
FURNITURE = frozenset("nav header footer aside form dialog menu".split())
CONTAINER = frozenset("article main section div ul ol dl table td li details figure blockquote".split()) | FURNITURE
#: Words in class or id that mark page furniture, notices, adverts and reader comments.
_WORDS = (
    r"(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|sidebar|side|widget|menu|nav\w*|topnav|breadcrumbs?|"
    r"header|masthead|footer|foot|copyright|comments?|commentlist|disqus|replies|respond|discussion|share|sharing|social|follow|related|recommend\w*|newsletter|subscri\w+|signup|login|"
    r"search|form|pagination|pager|tags?|toolbar|skip)"
)
MARKS = re.compile(_WORDS)  # as a whole class
HINTS = re.compile(rf"(?:^|[_-]){_WORDS}(?:$|[_-])")  # or a part of a hyphenated one, such as entry-header, which says less
#: An attribute as HTML reads it: its value stands in double or single quotes or in none; a quote that never closes is a plain character.
#: Nothing is tried twice, and after a quote that never closes no other of its kind is left, so a page is read in linear time.
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
_REST = re.compile(rf"(?>[\s/]++|{_ATTRIBUTE.pattern})*+>")  # of a tag, after its name
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, words in links, mark, place) of each text block. Place by the elements around it: 1 furniture, 2 article, 0 neither.
    Mark: 2 if it stands in a container with a class that hints at furniture, 1 if with a part of one that does, else 0. A class says
    nothing where the container holds most of the page's text (half for a part of a class, nine tenths for a whole one)."""
    out: list[tuple[str, int, int, tuple, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, tuple, int]] = []  # open containers, numbers of those that hint, and place
    strength: list[int] = []  # of each container that hints
    links, at, end, articles = 0, 0, len(page), 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, text.count(" ") + 1, len(html.unescape(" ".join(linked)).split()), *(stack[-1][1:] if stack else ((), 0))))
            parts.clear()
            linked.clear()

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            parts.append(page[at:lt])
            if links:
                linked.append(page[at:lt])
        if lt >= end:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        name = _NAME.match(page, lt + 1)
        if name is None:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                stop = page.find(">", lt)
                at = end if stop < 0 else stop + 1
            else:  # a bare sign
                parts.append("<")
                if links:
                    linked.append("<")
                at = lt + 1
            continue
        tag, closing = name[1].lower(), page[lt + 1] == "/"
        rest = _REST.match(page, name.end())
        if rest is None:
            break  # cut off within a tag
        inner, at = page[name.end() : rest.end() - 1], rest.end()
        if tag in NO_TEXT and not closing and not inner.endswith("/"):
            close = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end if close is None else close.end()
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            if tag in CONTAINER:
                if not closing:
                    within, kind = stack[-1][1:] if stack else ((), 0)
                    hint, kind = _kind(tag, inner, kind, articles == 0)
                    if hint < 0:  # an article of its own, whatever it stands in
                        within = ()
                    elif hint:
                        within = (*within, len(strength))
                        strength.append(hint)
                    stack.append((tag, within, kind))
                    articles += tag in ("article", "main")
                else:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
    flush()
    held = [0] * len(strength)
    for _, n, a, within, kind in out:
        if kind != 1:
            for h in within:
                held[h] += n - min(a, n)
    text = sum(n - min(a, n) for _, n, a, _, kind in out if kind != 1)
    says = [k if held[h] < text * (0.5 if k == 1 else 0.9) else 0 for h, k in enumerate(strength)]
    return [(t, n, a, max((says[h] for h in within), default=0), kind) for t, n, a, within, kind in out]


def _kind(tag: str, inner: str, place: int, first: bool) -> tuple[int, int]:
    """What a container that opens hints at (2 by a whole class, 1 by a part of one, -1 nothing around it counts), and the place in it.
    Main and a page's first article (later ones may be comments or teasers) are articles whatever their class and what they stand in."""
    if place == 1 or (tag in FURNITURE and not (tag == "header" and place == 2)):
        return 0, 1
    values = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _ATTRIBUTE.finditer(inner) if m[1].lower() in ("class", "id", "role")]
    if any(name == "role" and value in _ROLES for name, value in values):
        return 0, 1
    if tag == "main" or (tag == "article" and first):
        return -1, 2
    classes = [v for name, value in values if name != "role" for v in value.split() if not (place == 2 and v == "header")]  # an article's own header
    hint = 2 if any(MARKS.fullmatch(v) for v in classes) else int(any(HINTS.search(v) for v in classes))
    return hint, 2 if tag == "article" else place


def describe(found: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """Rows of: words, link density, both of the block before, both of the block after (blocks of furniture aside), mark, place."""
    own = np.array([(n, min(1.0, a / n)) for _, n, a, *_ in found], float).reshape(-1, 2)
    where = np.array([(m, p) for *_, m, p in found], float).reshape(-1, 2)
    rest, edge = np.flatnonzero(where[:, 1] != 1), np.zeros((1, 2))
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[rest], after[rest] = np.vstack([edge, own[rest]])[:-1], np.vstack([own[rest], edge])[1:]
    return np.hstack([own, before, after, where])


#: The labelled pages. ~9 stands for nine words; a block that begins with * is article text.
LABELLED = [
    "<header><p>~3</header><nav><ul><li><a>~1</a><li><a>~2</a></ul></nav><article><h1>*~8</h1><p>*~60<p>*~45<p>*~4<p>*~70</article><aside><p>~20<p><a>~5</a></aside><footer><p>~9</footer>",
    "<nav><a>~2</a> <a>~1</a></nav><div class=ad>~9</div><article><h1>*~12</h1><p>*~90<p>*~30<br>*~3<p>*~1</article><footer>~14 <a>~2</a></footer>",
    "<article><p>*~2</article>", "<article><p>*~1<p>*~6</article><footer>~3</footer>", "<main><h1>*~3</h1><p>*~5</main>", "<main><h1>*~1</h1><p>*~2<aside>~1</aside><div class=comments><p>~2</div></main>",
    "<article><h1>*~1</h1><p>*~55<div class=share-buttons>~1</div><ol class=comment-list><li>~3<li>~12</ol></article><div class=comments><article><p>~55</article></div>",
    "<article><h1>*~7</h1><p>*~40<ul><li>*~4<li>*~9<li>*~2</ul><p>*~33<figure><figcaption>*~8</figure><blockquote>*~25</blockquote></article>",
    "<article><h1>*~6</h1><p>*~30 <a>~12</a><p>*~50<ul><li><a>~4</a><li><a>~6</a><li><a>~1</a></ul></article><div class=related><a>~7</a><p>~12</div>",
    "<article><h1>*~6</h1><p>*~30<p><a>~3</a><p>*~44<div class=ad>~6</div><p>*~2<form><p>~1</form><p><a>~1</a></article>",
    "<main class=content><p>*~3<p>*~80<p>*~12<p>*~45 <a>~2</a><div class=newsletter-box><p>~18<p>~4</div><p>*~36</main>",
    "<main><div class=post><h2>*~5</h2><p>*~70<p>*~20</div><div class=comments><p>~3<p>~40<p>~25</div></main><footer><p>~30</footer>",
    "<div><a>~1</a> <a>~1</a> <a>~2</a></div><div><h1>*~7</h1><p>*~55<p>*~38<p>*~5<p>*~70</div><div><a>~4</a> <a>~5</a></div><div>~8</div>",
    "<div>~2</div><div><a>~1</a></div><div><h1>*~3</h1><p>*~55<p>*~3<p>*~40<p>*~9<p>*~55</div><div>~3</div><div><a>~3</a> ~2</div>",
    "<nav><a>~1</a></nav><div class=single-post><h1>*~1</h1><p>*~51<p>*~4<p>*~51</div><footer>~1</footer>", "<nav><a>~1</a></nav><div><h1>*~2</h1><p>*~60<p>*~20<p>*~4</div><footer>~9</footer>", "<div><h2>*~10</h2><p>*~120<p>*~80</div>",
    "<div class=cookie-notice><p>~25 <a>~2</a></div><div id=page><h1>*~9</h1><p>*~48<p>*~66<p>*~31</div><div class=sidebar><p>~14<p>~30<a>~3</a></div><div class=footer>~16</div>",
    "<div class=menu><a>~1</a> <a>~1</a></div><div><p>*~90<p>*~14<p>*~62</div><div class=comments><p>~20<p>~44<p>~2</div><div class=newsletter><p>~12</div>",
    "<table><tr><td><a>~2</a><br><a>~2</a><td><p>*~75<p>*~50<p>*~6<p>*~44<td><a>~3</a></table><div>~10</div>", "<p>*~200", "<p>*~40<p>*~35", "<p>~2", "<p>~4", "<p>~6<p>~3", "<div>~1</div><div>~5</div><div>~2</div>",
    "<ul><li><a>~6</a><li><a>~8</a><li><a>~5</a></ul><p>~7<p><a>~9</a> ~3<p>~12<div>~2</div>", "<div><a>~4</a> ~3</div><div><a>~7</a> ~9</div><div><a>~5</a> ~11</div><p>~8",
    "<div class=entry-header><h1>*~4</h1></div><p>*~60<p>*~40<div class=post-tags><a>~1</a> <a>~1</a></div><div class=author-bio><p>*~25</div>", "<article><div class=entry-header><h1>*~1</h1></div><p>*~51<p>*~4</article>",
    "<div class=entry-header><h1>*~1</h1></div><div><p>*~33<p>*~58</div><div class=comment-form><p>~7<p>~2</div>", "<p>*~30<p>*~2<p>*~30<div class=share>~3</div><div class=ad-slot><p>~15</div><p>*~48",
    "<header><h1>~3</h1></header><section><h2>*~6</h2><p>*~65<p>*~28</section><section><h2>*~4</h2><p>*~57<p>*~19</section><footer><p>~22<p>~6</footer>",
    "<article><h1>*~7 <a>~1</a></h1><p>*~15 <a>~2</a><p>*~9 <a>~3</a><p>*~30 <a>~8</a><ul><li>*~6 <a>~2</a><li>*~10 <a>~4</a></ul><p>*~2 <a>~1</a><p>*~60 <a>~4</a><p><a>~4</a></article><p>~3 <a>~6</a>",
    "<main><p>*~20 <a>~3</a> ~6<p>*~12 <a>~1</a><p>*~5 <a>~2</a><p>*~70 <a>~6</a><p>*~18 <a>~7</a></main><div>~4 <a>~3</a></div>", "<div><h1>*~6</h1><p>*~40 <a>~3</a><p>*~14 <a>~2</a><p>*~55 <a>~7</a><p>*~20 <a>~5</a><p>*~66</div><div>~3 <a>~3</a></div><div>~2 <a>~1</a></div>",
    "<div class=ad>~1</div><article><h1>*~30</h1><p>*~60</article>", "<div class=share>~1</div><p>*~70<p>*~60<div class=ad>~1</div><p>*~60", "<div class=popup>~2</div><div class=cookies>~1</div><main><p>*~58<p>*~20</main>",
    "<nav><a>~1</a></nav><div class=ad>~10</div><article><h1>*~24</h1><p>*~88</article>", "<div class=banner>~14</div><article><p>*~60<p>*~30</article>", "<div class=alert>~3</div><div class=notice>~18</div><main><p>*~45<p>*~7</main>", "<div class=promo>~5</div><p>*~80<p>*~33",
    "<aside><p>~60<p>~40</aside><form><p>~10<p>~2</form><article><h1>*~5</h1><p>*~15<p>*~8<p>*~20</article><dialog><p>~35</dialog>",
]


@cache
def labelled() -> np.ndarray:
    """The rows of describe() of all labelled pages' blocks, and whether each is article text."""
    rows = []
    for page in LABELLED:
        page = re.sub(r"~(\d+)", lambda m: " ".join(["word"] * int(m[1])), page)
        found = blocks(page)
        rows.append(np.column_stack([describe(found), [t.startswith("*") for t, *_ in found]]))
    return np.concatenate(rows)


@cache
def tree() -> tuple:
    """The decision tree: (feature, limit, at most, above) or a class."""
    def grow(rows: np.ndarray, depth: int) -> tuple | int:
        x, y = rows[:, :-1], rows[:, -1]
        if depth == 0 or y.min() == y.max():
            return int(y.mean() >= 0.5)
        best = None
        for f in range(x.shape[1] - 1, -1, -1):
            for cut in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= cut
                impure = sum(m.sum() * (p := y[m].mean()) * (1 - p) for m in (low, ~low))
                if best is None or impure < best[0] - 1e-9:
                    above = x[~low, f].min()
                    best = (impure, f, (cut + above) / 2, low)
        if best is None:
            return int(y.mean() >= 0.5)
        _, f, cut, low = best
        return f, cut, grow(rows[low], depth - 1), grow(rows[~low], depth - 1)

    return grow(labelled(), 7)


def classify(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)

    def walk(node: tuple | int, rows: np.ndarray) -> None:
        if isinstance(node, int):
            out[rows] = bool(node)
            return
        low = x[rows, node[0]] <= node[1]
        walk(node[2], rows[low])
        walk(node[3], rows[~low])

    walk(tree(), np.arange(len(x)))
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(t for (t, *_), keep in zip(found, classify(describe(found)), strict=True) if keep) if found else ""


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column="html"):
            text = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
