"""Main text of web pages by line-block distribution.

Markup is stripped, with what stands in menus, headers, footers, sidebars, notices, adverts, forms
and comments, and the page becomes lines, one for each block of text. The lengths of the lines are
summed over sliding windows; a surge is where the sum rises over a mark, a dive where it falls
back to nothing. What lies from the first span with a surge to the last one is kept. An article
or main element is a prior, less than the mark: its lines count somewhat more, and lines outside of it
less, where it has most of the page's text; text enough outside makes a surge all the same, and too
little inside makes none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import map_arrow, steps

#: Lines in a window, the weighed characters in it that make a surge, and what a line in an article counts
#: more. A window of any three lines of an article has a surge; none of them has one by its place alone.
WINDOW, SURGE, PRIOR = 3, 40, 14
SCHEMA = "page_id long, url string, text string, n_chars long"

# Elements by their role.
BLOCKS = frozenset("address article aside blockquote body center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe datalist xmp noembed noframes".split())
#: Elements whose text is no text of the page, in a line or not.
CONTROLS = frozenset("select option optgroup button svg math canvas object audio video map".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog search".split())
MAIN = frozenset("article main".split())
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "li", "dd", "dt", "legend", "summary", "figcaption"} | {"li", "dd", "dt"}
#: Words in an element's class, id or role that mark it as something beside the article.
BESIDE = re.compile(
    r"ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|colophon|sidebar\w*|side|aside|widget\w*|related|recommend\w*|share|sharing|social|comments?|commentlist|disqus\w*|respond|replies|reply|notice\w*|cookies?|consent|gdpr|alert|popup|modal|overlay|toolbar|newsletter|subscribe|signup|login|search\w*|form|pagination|pager|copyright|disclaimer|skip|complementary|contentinfo|navigation|hidden|toc",
    re.I,
)
# Words that may stand behind the marking one in a compound, and words that make a compound tell about other elements.
PARTS = frozenset("area bar block body bottom box button buttons container content count group holder icon icons inner item items left line link links list main menu message nav outer panel post posts primary right row secondary section slot text title top unit wrap wrapper".split())
ABOUT = frozenset("no not non without with has have is hide hides show shows".split())
COMMENT = re.compile(r"(?:class|id)\s*=\s*[\"']?[^\"'>]*comment", re.I)
#: A whole tag. Quoted values may hold '>' but not '<', so that an open quote ends with its tag, and a
#: search never goes past the next '<'.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ENDS = {name: re.compile(rf"</{name}\s*(?:>|$)", re.I) for name in RAW}
#: Marking words that stand for something of its own inside an article: its headline, an emphasised paragraph.
OWN = frozenset("header masthead banner alert toc".split())
#: The words that mark an element inside a line: fewer, as a class there mostly tells of a style.
INLINE = re.compile(r"ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|share|sharing|social|comments?|hidden|skip", re.I)
LISTS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",)}


def marking(token: str) -> str:
    """The word by which a class, id or role marks its element, or nothing.

    The token is such a word, or a compound of one: site-footer, widget-area. One that tells what
    the element has or lacks, as no-sidebar or has-menu, marks nothing, nor does a word in front
    of others, as in social-science.
    """
    words = [w for w in re.split("[-_]+", token.lower()) if w]
    if ABOUT.intersection(words):
        return ""
    while words and not BESIDE.fullmatch(words[-1]) and (words[-1] in PARTS or words[-1].isdigit()):
        words.pop()
    return words[-1] if words and BESIDE.fullmatch(words[-1]) else ""


def beside(name: str, attributes: str, inside: bool = False, inline: bool = False) -> bool:
    """Whether an element is something beside the article, by its name, class, id, role or style.

    Inside an article, what is called by a word of OWN is the article's own; an article that is
    called a comment is one.
    """
    if name in BOILERPLATE:
        return not (inside and name == "header")
    if not attributes or name in ("html", "body", "main"):
        return False
    if name == "article":
        return bool(COMMENT.search(attributes))
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if HIDDEN.search(value) if key == "style" else any((word := marking(x)) and not (inside and word in OWN) and not (inline and not INLINE.fullmatch(word)) for x in value.split()):
            return True
    return False


def tags(html: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before it, whether it is an end tag, name, attributes) of each tag, at last of none.

    Comments, declarations and the contents of RAW elements are left out. Linear in the page,
    however broken it is: each search starts where the last one ended, or ends at the next '<'.
    """
    at = text_from = 0
    missing: set[str] = set()  # RAW elements with no end tag in the rest of the page
    parts: list[str] = []
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at) or html.startswith("<![CDATA[", at):
            end = html.find("-->" if html[at + 2] == "-" else "]]>", at + 4)
            parts.append(html[text_from:at])
            at = text_from = len(html) if end < 0 else end + 3
        elif html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at)
            parts.append(html[text_from:at])
            at = text_from = len(html) if end < 0 else end + 1
        elif (m := TAG.match(html, at)) or (m := NAME.match(html, at)):
            parts.append(html[text_from:at])
            name, attributes = m[2].lower(), m[3] if m.re is TAG else ""
            if m.re is TAG:
                at = m.end()
            else:  # a quote is left open: the tag ends at its first '>', or before the next tag
                following = html.find("<", at + 1)
                following = len(html) if following < 0 else following
                end = html.find(">", at, following)
                attributes = html[m.end() : following if end < 0 else end]
                at = following if end < 0 else end + 1
            text_from = at
            if name in RAW:
                if not m[1] and not attributes.endswith("/") and name not in missing:
                    end_tag = ENDS[name].search(html, at)
                    if end_tag:
                        at = text_from = end_tag.end()
                    else:
                        missing.add(name)
                        if name in ("script", "style", "xmp"):
                            at = text_from = len(html)
                continue
            yield "".join(parts), bool(m[1]), name, attributes
            parts.clear()
        else:
            at += 1
    parts.append(html[text_from:])
    yield "".join(parts), False, "", ""


def page_lines(html: str) -> list[tuple[str, bool, bool]]:
    """(text, stands beside the article, stands in an article or main element) of each block, in page order.

    What a control or a hidden or marked element in a line holds is no text of that line. A form
    that holds an article, a main element or a menu is the page's frame and marks nothing. An
    article or main element under other marks is set free of them if no more text stands free on
    the page; of several, those under the fewest marks are.
    """
    lines: list[tuple[str, list, list, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, list | None, bool]] = []  # open elements: name, the mark of one that is beside the article, whether it is off inside a line
    opened: dict[str, int] = {}  # how many of each name are open
    items: list[tuple[str, int]] = []  # open lists and their items, with their place in the stack
    marks: list[list] = []  # the open marks; one that is emptied doesn't count
    mains: list[int] = []  # of each open article or main element, how many marks are around it
    blocks: list[int] = []  # places of open block elements
    off = 0  # open elements that are off inside a line

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            at = mains[-1] if mains else 0
            lines.append((text, marks[:at], marks[at:], bool(mains)))

    def close(upto: int) -> None:
        nonlocal off
        while len(stack) > upto:
            name, was, inline = stack.pop()
            opened[name] -= 1
            off -= inline
            if was is not None:
                marks.pop()
            if name in MAIN:
                mains.pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if items and items[-1][1] == len(stack):
                items.pop()

    for text, ends, name, attributes in tags(html):
        if text and not off:
            parts.append(text)
        if not name:
            break
        if name in BLOCKS:
            flush()
        if ends:
            if opened.get(name):
                floor = blocks[-1] if blocks and name not in BLOCKS else 0  # a text-level element doesn't end its block
                for i in range(len(stack) - 1, floor - 1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in CLOSES_P and opened.get("p"):
            close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"))
        if name in LISTS:
            for own, i in reversed(items):
                if own in LISTS[name]:
                    break
                if own in LISTS and LISTS[own] == LISTS[name]:
                    close(i)
                    break
        inline = name in CONTROLS or (name not in BLOCKS and bool(attributes) and beside(name, attributes, bool(mains), True))
        was = [name] if name in BLOCKS and beside(name, attributes, bool(mains)) else None
        if marks and (name == "nav" or (name in MAIN and was is None)):
            for mark in marks:
                if mark == ["form"]:
                    mark.clear()
        if name in MAIN:
            mains.append(len(marks))
        if was is not None:
            marks.append(was)
        if name in BLOCKS:
            blocks.append(len(stack))
        if name in LISTS or name in ("ul", "ol", "menu", "dl"):
            items.append((name, len(stack)))
        stack.append((name, was, inline))
        opened[name] = opened.get(name, 0) + 1
        off += inline
    flush()
    told = [(text, sum(map(bool, around)), any(own), main) for text, around, own, main in lines]
    bound = [(n, len(text)) for text, n, own, main in told if main and not own]
    least = min(bound, default=(0, 0))[0]
    free = sum(len(text) for text, n, own, _ in told if not n and not own)
    if least and free >= sum(size for n, size in bound if n == least):
        least = 0
    # Where a bound article is set free, what stands free around it isn't in an article and is left to the weights.
    return [(text, own or n > (least if main else 0), main) for text, n, own, main in told]


def windows(sizes: list[int]) -> np.ndarray:
    """The sum of each line and those after it in its window."""
    return np.convolve(np.array(sizes, dtype=np.int64), np.ones(WINDOW, np.int64))[WINDOW - 1 :] if sizes else np.zeros(0, np.int64)


def weights(lines: list[tuple[str, bool, bool]]) -> list[int]:
    """What each line counts in the distribution: its length, and a prior by its place that is less than the mark.

    A line of an article counts PRIOR more. Where articles have most of the page's text, a line outside of
    them counts by what it has beyond the mark, and only where a window of such lines has a surge of its own.
    """
    inside = sum(len(text) for text, skip, main in lines if main and not skip)
    outside = sum(len(text) for text, skip, main in lines if not main and not skip)
    if inside < outside:
        return [0 if skip else len(text) + (PRIOR if main else 0) for text, skip, main in lines]
    beyond = [0 if skip or main else max(0, len(text) - SURGE + 1) for text, skip, main in lines]
    surge = windows(beyond) >= SURGE
    counts = [bool(surge[max(0, i - WINDOW + 1) : i + 1].any()) for i in range(len(lines))]
    return [0 if skip else len(text) + PRIOR if main else own * here for (text, skip, main), own, here in zip(lines, beyond, counts, strict=True)]


def spans(sizes: list[int]) -> list[tuple[int, int, bool]]:
    """(surge, dive, whether the mark is reached) of each stretch of lines with text: it begins where a
    line counts something, and ends where a window of lines holds nothing."""
    sums, out, i = windows(sizes), [], 0
    while i < len(sizes):
        if sizes[i]:
            end = i
            while end < len(sizes) and sums[end] > 0:
                end += 1
            out.append((i, end, bool(sums[i:end].max() >= SURGE)))
            i = end
        i += 1
    return out


def main_text(html: str) -> str:
    """The lines that count from the first span with a surge to the last one, joined by line feeds; of all spans if none has one.

    Where there is an article, lines beside it take no place in the windows, so that an advert in its midst is no dive;
    elsewhere they are the borders that there are. Of the spans with a surge those that hold a line of
    an article are taken, if any does.
    """
    lines = page_lines(html)
    if any(main and not skip for _, skip, main in lines):
        lines = [line for line in lines if not line[1]]
    sizes = weights(lines)
    found = spans(sizes)
    kept = [x for x in found if x[2]] or found
    kept = [x for x in kept if any(main for _, _, main in lines[x[0] : x[1]])] or kept
    if not kept:
        return ""
    return "\n".join(text for (text, _, _), size in zip(lines[kept[0][0] : kept[-1][1]], sizes[kept[0][0] : kept[-1][1]], strict=True) if size)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "html"):
        texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
        yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page's whole html.

    One row out for each row in: page_id, url, text, n_chars (code points). A null or empty html,
    and a page without text, give an empty text. Text in an article or main element counts first;
    text outside of it only where it is the larger part. Lines beside the article are left out
    everywhere. Null ids and urls are carried along, repeated rows stay, other columns are left
    out. An empty table gives an empty result. No shuffle; batches are bounded, a longer page is
    held whole, in time linear in its length.
    """
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_arrow(rows, _run, SCHEMA)
