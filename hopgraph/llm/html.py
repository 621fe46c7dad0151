"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element.  A line weighs what it holds in text
outside links; lines of menus, forms, adverts and the like weigh nothing, and if the page
says where its article is, only that counts, each line there as a full paragraph at least.
Weights are summed over windows of lines.  A surge is where the sum rises over a paragraph's
worth, a dive where it falls to nothing; the lines from each surge to its dive are the text.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import map_rows, table

WINDOW = 3
#: Weight over which a window surges.
SURGE = 86

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements whose content is never read as markup, and those that hold no text to read.
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_MUTE = frozenset("head select button template svg object canvas audio video map datalist math".split())
_ASIDE = frozenset("nav footer aside form dialog menu".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot"
    " thead tr ul caption head title noscript iframe".split()
)
#: Elements that end by themselves where the next of their kind, or a block, begins.
_LOOSE = frozenset("p li dt dd tr".split())
_MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner promo cookie cookies consent gdpr notice"
    " alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation"
    " navigational breadcrumb breadcrumbs pagination pager comment comments disqus reply replies respond share sharing"
    " social related recommended recommendations footer contentinfo complementary search widget toolbar masthead".split()
)


#: Before a marked word, these say that the element has such a part or none, not that it is one.
_STATES = frozenset("has with no without".split())
#: Asides whose articles are other people's or other pages'.
_OTHERS = frozenset("comment comments disqus reply replies respond related recommended recommendations".split())


def _marks(attributes: str) -> set[str]:
    """The marked words among the names of class, id and role."""
    if "=" not in attributes:
        return set()
    found = set()
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORD.findall(name)]
            if words and words[0] not in _STATES:
                found.update(w for w in words if w in _MARKED)
    return found


def lines(html: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters outside links, aside, in the article) of every block with text."""
    found: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    plain = [0]
    shut: list[list] = []  # open elements whose text does not count: [name, depth, whether an article in it counts]
    links, article, at = 0, 0, 0

    def text(piece: str) -> None:
        if not piece or (shut and shut[-1][0] in _MUTE):
            return
        piece = unescape(piece)
        parts.append(piece)
        if not links:
            plain[0] += len("".join(piece.split()))

    def end_block() -> None:
        whole = " ".join("".join(parts).split())
        if whole:
            found.append((whole, plain[0], bool(shut), article > 0))
        parts.clear()
        plain[0] = 0

    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            rest = html[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the page's end has cut off
            text(rest[: cut.start()] if cut else rest)
            break
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        closing, name = bool(m[1]), m[2].lower()
        if not closing and name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in _BLOCKS:
            end_block()
        elif name in ("br", "td", "th"):
            parts.append(" ")
        if name == "a":
            links = 0 if closing else 1
        if closing:
            if name in ("article", "main"):
                article = max(0, article - 1)
            for i in range(len(shut) - 1, -1, -1):
                if shut[i][0] == name:
                    shut[i][1] -= 1
                    if shut[i][1] == 0:
                        del shut[i:]
                    break
            continue
        if shut and shut[-1][0] in _LOOSE and (name == shut[-1][0] or shut[-1][0] == "p" and name in _BLOCKS):
            shut.pop()
        marks = set() if name in ("body", "html") else _marks(m[3])
        if name == "main":
            marks &= _OTHERS  # its name may tell what stands beside it
        if name == "main" or name == "article" and not marks and all(x[2] for x in shut):
            shut.clear()
        aside = name in _ASIDE or name == "header" and not article or bool(marks)
        if name in _VOID:
            pass
        elif name in _MUTE or aside:
            others = name in _MUTE - {"head"} or name in ("aside", "footer") or bool(marks & _OTHERS)
            shut.append([name, 1, not others])
        elif shut and shut[-1][0] == name:
            shut[-1][1] += 1
        if name in ("article", "main") and not aside:
            article += 1
        if name == "body":
            shut.clear()
    end_block()
    return found


def surges(weights: np.ndarray) -> list[tuple[int, int]]:
    """Line ranges [surge, dive) of the windowed sums of ``weights``."""
    n = len(weights)
    total = np.concatenate(([0], np.cumsum(weights)))
    window = total[np.minimum(np.arange(n) + WINDOW, n)] - total[:n]
    found, i = [], 0
    while i < n:
        if weights[i] == 0 or window[i] < SURGE:
            i += 1
            continue
        stop = i
        while stop < n and window[stop] > 0:
            stop += 1
        found.append((i, stop))
        i = stop
    return found


def main_text(html: str | None) -> tuple[str, int, int, int]:
    """(text, number of lines, first line, line after the last); -1, -1 if there is no text."""
    page = lines(html or "")
    has_article = any(x[3] and not x[2] for x in page)
    weights = np.zeros(len(page), np.int64)
    for i, (_, plain, aside, inside) in enumerate(page):
        if not aside and (inside or not has_article):
            weights[i] = max(plain, SURGE) if inside else plain
    ranges = surges(weights)
    kept = [
        page[i][0]
        for a, b in ranges
        for i in range(a, b)
        if not page[i][2] and (weights[i] or not has_article)
    ]
    ends = (ranges[0][0], ranges[-1][1]) if ranges else (-1, -1)
    return "\n\n".join(kept), len(page), *ends


def _extract(cols: dict) -> dict:
    got = [main_text(x) for x in cols["html"].to_pylist()]
    text, n_lines, surge, dive = zip(*got)
    return {**{k: cols[k] for k in ("page_id", "url")}, "text": text, "n_chars": [len(t) for t in text], "n_lines": n_lines, "surge": surge, "dive": dive}


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, surge, dive) of every page.

    text joins the kept blocks by two line ends (empty if there are none, as for a null or
    empty page), n_chars counts its code points, surge and dive are the first line kept and
    the line after the last.  Rows with repeated or null ids are pages like any others;
    further columns are not looked at.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    schema = "page_id long, url string, text string, n_chars long, n_lines long, surge long, dive long"
    return map_rows(rows, _extract, schema)


def op6_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
