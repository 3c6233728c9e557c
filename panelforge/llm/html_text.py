"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block elements that lead to it. Text length, punctuation and
link text are summed per path, smoothed over neighbouring blocks, and fused with the path's share of the page's text to
one figure per path; paths over a threshold hold the content. Elements that the markup itself names as page furniture (navigation, adverts, forms, reader
comments) count as zero. The lowest element that holds all blocks of the content paths, whatever its name, gives its
short blocks (headings, list items, table cells, one-word paragraphs) too, all but furniture.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, lean

# Names of elements in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("head title nav footer header aside form fieldset menu dialog button select option label search".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
# Pieces of compound names such as site-header or comment-list. A name with one of KEEPS is none of furniture.
KEEPS = frozenset("article content entry has have no not post story text with without".split())
PARTS = frozenset("area bar block body box container holder inner item items links list panel section slot thread unit wrap wrapper zone".split())
ALONE = frozenset("related respond share skip social".split())  # too common as a last piece
HOLDERS = frozenset("article body center details div html main section".split())  # the others belong to the text itself
NEVER_NAMED = frozenset("html body main article".split())  # their classes speak of the page, not of furniture

NAME = re.compile(r"(/?)([A-Za-z][\w:-]*)")
SIGN = re.compile(r"[>\"']")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"(?<![^\s=\"'/>])([^\s=\"'/>]++)\s*+=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAMING = frozenset(("class", "id", "role"))
PIECE = re.compile("[a-z0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，؟]")
CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


def names_furniture(token: str) -> bool:
    """Whether a class, id or role (in lower case) says that its element is furniture: as a whole, or by its pieces."""
    if token in FURNITURE_NAMES:
        return True
    pieces = PIECE.findall(token)
    if len(pieces) < 2 or not KEEPS.isdisjoint(pieces):
        return False
    first, last = pieces[0], pieces[-1]
    return (last in FURNITURE_NAMES and last not in ALONE) or (first in FURNITURE_NAMES and (last in PARTS or last.isdigit()))


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each piece of markup, in order; name is empty for what has no text.

    The time is linear in the page: what was once searched in vain is not searched again. A tag ends at the first `>`
    outside quotes. An unclosed quote is none, so its tag ends at the next `>`; from the first tag on whose quotes leave
    no `>` at all, tags end at their next `>`. A `<` without a name or an end is text, an unclosed comment or raw element
    runs to the end of the page.
    """
    n, gone, quotes = len(page), {}, True

    def find(sign: str, start: int) -> int:
        if start >= gone.get(sign, n + 1):
            return -1
        at = page.find(sign, start)
        if at < 0:
            gone[sign] = start
        return at

    def end_of(start: int) -> int:
        nonlocal quotes
        at = start
        while quotes:
            m = SIGN.search(page, at)
            if m is None:
                quotes = False
            elif m[0] == ">":
                return m.end()
            else:
                closed = find(m[0], m.end())
                if closed < 0:
                    return find(">", m.end()) + 1
                at = closed + 1
        return find(">", start) + 1

    at = 0
    while (start := find("<", at)) >= 0:
        m, closing, name, rest = NAME.match(page, start + 1), False, "", ""
        if page.startswith("<!--", start):
            end = find("-->", start + 4) + 3
            end = end if end > 2 else n
        elif m is None:
            end = find(">", start + 2) + 1 if page[start + 1 : start + 2] in ("!", "?") else 0
        elif not m[1] and (raw := m[2].lower()) in RAW:
            end = find(">", m.end()) + 1
            if end and page[end - 2] != "/":
                over = RAW_END[raw].search(page, end) if end < gone.get(raw, n + 1) else None
                if over is None:
                    gone[raw] = min(end, gone.get(raw, end))
                end = over.end() if over else n
        else:
            end = end_of(m.end())
            closing, name, rest = bool(m[1]), m[2].lower(), page[m.end() : max(end - 1, m.end())]
        if end:
            yield start, end, closing, name, rest
        at = end or start + 1


@dataclass
class Block:
    """A block with text: the number of its tag path, whether it is furniture, characters in links, its deepest holder."""

    path: int
    furniture: bool
    text: str
    link: int
    holder: int


@dataclass
class Page:
    """Blocks in page order; and the tree of holders: holders are numbered as they open, -1 is the page itself.

    A holder spans the numbers from its own to `last`, so what lies in it is known without lists of ancestors, and memory
    stays linear however deep the page is.
    """

    blocks: list[Block] = field(default_factory=list)
    above: dict[int, int] = field(default_factory=dict)
    last: dict[int, int] = field(default_factory=dict)


def blocks(page: str) -> Page:
    """The blocks of a page that have text, with their tag paths from the root, and their holders.

    Holders are the elements around a block that are not part of the text itself.
    """
    found, paths, opened = Page(), {}, Counter()
    stack: list[tuple[str, bool, int, int, int]] = []  # name, furniture, path, number, deepest holder
    text, link, in_link, number = [], 0, 0, 0

    def end() -> None:
        nonlocal link
        said = " ".join(html.unescape("".join(text)).split())
        if said:
            _, furniture, path, _, holder = stack[-1] if stack else ("", False, -1, -1, -1)
            found.blocks.append(Block(path, furniture, said, min(link, len(said)), holder))
        text.clear()
        link = 0

    def leave(name: str, limits: tuple[str, ...] = ()) -> None:
        if not opened[name]:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                close(k)
                return
            if stack[k][0] in limits:
                return

    def close(k: int) -> None:
        for tag, _, _, n, _ in stack[k:]:
            opened[tag] -= 1
            found.last[n] = number
        del stack[k:]

    at = 0
    for begins, ends, closing, tag, rest in tags(page):
        if begins > at:
            text.append(page[at:begins])
            link += in_link * (begins - at)
        at = ends
        if tag == "a":
            in_link = int(not closing)
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS or tag in FURNITURE:
            end()
            if closing:
                leave(tag)
            elif tag not in VOID:
                if tag in CLOSES:
                    leave(tag, CLOSES[tag])
                elif tag in BLOCKS:
                    leave("p", ("article", "div", "section", "td", "li", "body"))
                words = {w for name, *x in ATTRIBUTE.findall(rest) if name.lower() in NAMING for w in "".join(x).lower().split()}
                number += 1
                _, inside, path, _, holder = stack[-1] if stack else ("", False, -1, -1, -1)
                named = tag in FURNITURE or (tag not in NEVER_NAMED and any(map(names_furniture, words)))
                if tag in HOLDERS:
                    found.above[number], holder = holder, number
                stack.append((tag, inside or named, paths.setdefault((path, tag), len(paths)), number, holder))
                opened[tag] += 1
    text.append(page[at:])
    end()
    close(0)
    return found


def path_ratios(parts: list[Block]) -> dict[int, float]:
    """The fused ratio of each tag path: mean text length outside links, smoothed over neighbouring blocks, raised by
    punctuation and lowered by the root of the path's share of all such text.

    Furniture counts as zero, and links lower a block by their share.
    """
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for k, x in enumerate(parts):
        near = [len(y.text) - y.link for y in parts[max(0, k - 1) : k + 2] if not y.furniture]
        s = sums[x.path]
        s[0] += 0 if x.furniture else (sum(near) / max(len(near), 1) + len(x.text) - x.link) / 2 * (1 - x.link / len(x.text))
        s[1] += len(PUNCTUATION.findall(x.text))
        s[2] += 1
        s[3] += 0 if x.furniture else len(x.text) - x.link
    whole = max(sum(s[3] for s in sums.values()), 1)
    return {path: length / n * (1 + min(1.0, 20 * marks / n / max(length / n, 1))) * math.sqrt(own / whole) for path, (length, marks, n, own) in sums.items()}


def content(page: str | None, threshold: float = 0.5) -> str:
    """The kept blocks of a page, one to a line; empty if there are none."""
    if not page:
        return ""
    cut = blocks(page)
    ratio = path_ratios(cut.blocks)
    most = max(ratio.values(), default=0)
    kept = {path for path, x in ratio.items() if x > 0 and x >= threshold * most}
    holders = [x.holder for x in cut.blocks if not x.furniture and x.path in kept]
    if not holders:
        return ""
    shared, high = min(holders), max(holders)
    while shared >= 0 and cut.last[shared] < high:  # the lowest holder of all of them
        shared = cut.above[shared]
    top = cut.last[shared] if shared >= 0 else float("inf")
    return "\n".join(x.text for x in cut.blocks if not x.furniture and shared <= x.holder <= top)


def extracted(pages: DataFrame, html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """`pages` with text (the main text, empty if none) and n_chars (its code points) in place of the HTML column.

    A null page is empty, an empty table gives no rows. Unclosed elements end where HTML lets them; an unclosed comment or script runs to the end of
    the page. Nothing is cut off, repeated rows are handled one by one, other columns are carried along.
    """

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: content(page, threshold))

    bounded_batches(pages.sparkSession)
    said = F.pandas_udf(lean(read, "html_text"), "string")
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    return pages.select(*rest, said(F.coalesce(F.col(html_col).cast("string"), F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
