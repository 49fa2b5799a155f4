"""HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block of text, in page order. A line's weight is its text length
without what stands in links. Sums over sliding windows of `width` lines rise at a surge point and fall at a
dive point; the lines between hold the main text, in every such stretch. Before that, elements that can't hold main text (scripts,
styles, forms, navigation, headers, footers, sidebars, adverts, notices, comments, by tag, role or name)
give no lines; a name doesn't count against what holds more than half of a page's text. Where the page marks its article, its lines are taken whole, unless text outside outweighs it.

Per page: white space inside a line becomes one blank, lines are joined by a newline. Null or empty html, or
html without text, gives an empty text. Broken markup never fails: an unclosed skipped element ends with
the element around it, a stray end tag is passed over.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+)|(<)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template", "noscript"}
_SKIP = {"nav", "header", "footer", "aside", "form", "button", "select", "svg", "math", "object", "audio", "video", "canvas", "menu", "dialog", "figure", "head", "label", "input", "fieldset"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | _SKIP
_CLOSES_P = _BLOCK - {"li", "td", "th", "tr", "dd", "dt", "tbody", "thead", "tfoot"}
_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar", "note"}
# names of which a part tells (cookie-banner, site-footer), and names that tell only as a whole token (legal, but not legal-analysis)
_BAD_PART = re.compile(
    r"(?:^|[_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo|banners?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|foot(?:er)?|masthead|comments?|disqus|"
    r"cookies?|consent|gdpr|popups?|modal|newsletter|subscribe|subscription|share|sharing|social|related|recommend(?:ed|ations?)?|widgets?|pagination|pager)(?:$|[_-])",
    re.I,
)
_BAD_WHOLE = {"side", "header", "site-header", "page-header", "main-header", "top-header", "replies", "reply", "respond", "notice", "notices", "site-notice", "alert", "alerts", "overlay", "promotion", "signup", "login", "toolbar", "tags", "copyright", "legal", "disclaimer", "skip", "skip-link", "search", "search-form", "searchbox"}
_PAIRS = {"li": ("li",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_SPACE = re.compile(r"\s+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _unwanted(tag: str, attrs: str, inside_main: bool) -> tuple[bool, bool]:
    """Whether an element can't hold main text by its tag, role or style, and whether its names speak against it."""
    if tag in _SKIP and not (tag in ("header", "figure") and inside_main):
        return True, False
    if not attrs.strip():
        return False, False
    a = _attributes(attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _ROLE or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True, False
    names = [*a.get("class", "").split(), a.get("id", "").strip()]
    return False, tag not in ("html", "body", "article", "main") and any(_BAD_PART.search(x) or x.lower() in _BAD_WHOLE for x in names)


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, length outside links, whether in the page's article) of every block, in page order.

    What stands in elements whose names speak against them is left out, but not where such an element holds more than
    half of the page's text outside links: then its name says something else.
    """
    out, text, linked = [], [], 0
    stack: list[tuple[str, bool, bool]] = []  # open elements, whether they are skipped, whether by name
    blocks: list[int] = []  # places in the stack of open blocks
    inline: list[dict[str, int]] = [{}]  # open inline elements by name, since each open block
    opened: dict[str, int] = {}  # open blocks by name
    named: list[int] = []  # numbers of the open elements that are left out by name
    weights: list[int] = []  # text outside links in each of them
    skipped = links = mains = 0

    def flush():
        nonlocal linked
        line = _SPACE.sub(" ", "".join(text)).strip()
        if line:
            weight = max(0, len(line) - linked)
            out.append((line, weight, mains > 0, tuple(named)))
            for x in named:
                weights[x] += weight
        text.clear()
        linked = 0

    def close(upto: int):
        nonlocal skipped, links, mains
        while len(stack) > upto:
            tag, skip, name = stack.pop()
            if tag in _BLOCK:
                blocks.pop()
                inline.pop()
                opened[tag] -= 1
            else:
                inline[-1][tag] -= 1
            if (tag in _BLOCK or name) and not skipped:
                flush()
            skipped -= skip
            links -= tag == "a"
            mains -= tag in ("article", "main")
            if name:
                named.pop()

    def close_last(tag: str):
        close(next(d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == tag))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None or m[5] is not None:
            if not skipped:
                piece = _html.unescape(m[0])
                text.append(piece)
                linked += len(piece) if links > 0 else 0
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            # an inline end tag doesn't close the block around it; what an end tag closes is never looked at again
            if (opened if tag in _BLOCK else inline[-1]).get(tag):
                close_last(tag)
            elif tag == "p" and not skipped:
                flush()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in _CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        if pair := _PAIRS.get(tag):
            # the one before it in the same list or row, with what stands open in it
            for d in reversed(blocks[-3:]):
                if stack[d][0] in pair:
                    close(d)
                    break
                if stack[d][0] not in ("p", "td", "th"):
                    break
        if tag in _BLOCK:
            if not skipped:
                flush()
        elif tag == "br" and not skipped:
            text.append(" ")
        if tag in _VOID or m[3].rstrip().endswith("/") and tag not in _BLOCK:
            continue
        skip, name = _unwanted(tag, m[3], mains > 0)
        if (skip or name) and not skipped:
            flush()
        if name:
            named.append(len(weights))
            weights.append(0)
        if tag in _BLOCK:
            blocks.append(len(stack))
            inline.append({})
            opened[tag] = opened.get(tag, 0) + 1
        else:
            inline[-1][tag] = inline[-1].get(tag, 0) + 1
        stack.append((tag, skip, name))
        skipped += skip
        links += tag == "a"
        mains += tag in ("article", "main")
    close(0)
    flush()
    total = sum(x[1] for x in out)
    return [x[:3] for x in out if all(2 * weights[k] > total for k in x[3])]


def _stretches(weight: np.ndarray, width: int, surge: int) -> list[tuple[int, int]]:
    """(first line, one past the last) from each surge to its dive, without lines of no weight at the ends."""
    before = np.concatenate([[0], np.cumsum(weight)])
    sums = before[np.minimum(np.arange(len(weight)) + width, len(weight))] - before[:-1]
    spans, i = [], 0
    while i < len(sums):
        if sums[i] < surge:
            i += 1
            continue
        j = i
        while j < len(sums) and sums[j] > 0:  # the dive: a whole window without text
            j += 1
        full = np.flatnonzero(weight[i:j])
        spans.append((i + int(full[0]), i + int(full[-1]) + 1))
        i = j
    return spans


def main_lines(lines: list[tuple[str, int, bool]], width: int = 3, surge: int = 80) -> list[str]:
    """The lines between surge and dive of the sums over `width` lines, of every stretch.

    A page without a surge is short: all its lines with text outside links stay. If the page marks an article, its
    lines are the main text, unless a stretch outside it weighs more than all of them (articles that are teasers):
    then marks don't count.
    """
    weight = np.array([w for _, w, _ in lines], np.int64)
    marked = np.array([m for _, _, m in lines], bool)
    if marked.any():
        outside = np.where(marked, 0, weight)
        if max((outside[i:j].sum() for i, j in _stretches(outside, width, surge)), default=0) <= weight[marked].sum():
            return [x[0] for x in lines if x[2]]
    spans = _stretches(weight, width, surge)
    if not spans:
        return [x[0] for x in lines if x[1] > 0]
    return [x[0] for i, j in spans for x in lines[i:j]]


def extract(page: str | None) -> str:
    return "\n".join(main_lines(lines_of(page))) if page else ""


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages.

    Every row is a page of its own: null ids stay null, repeated rows give the same text each. Other columns play no
    part. The time is linear in the page, however deep or broken its markup; a page is one value, in one task. An
    empty table gives an empty result.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
