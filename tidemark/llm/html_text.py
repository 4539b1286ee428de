"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element makes a line. A line weighs as much text as it has outside of
links; weights are summed over sliding windows of lines. Where the sum surges over a threshold text begins, where
it dives below text ends, and the lines between are the page's text: a lone line of links between paragraphs
stays, a block of such lines is a dive. What markup says only lowers weights: lines in menus, headers, footers,
sidebars, notices, adverts, forms and comments, and lines outside of a page's article, weigh a fraction, and a
line with a lowered weight is no text even where its neighbours hold the sum up.

Names that good prose has too (``related``, ``social``, ``form`` as a class) lower a weight only if what they
hold looks like a list: mostly links, or short lines.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: Lines in a window.
WINDOW = 5
#: Characters in a window that make a surge, or that part of the page's largest window if it is less.
SURGE, PART = 20, 0.1
#: What a line's weight is lowered to.
LOWERED = 0.05
#: A doubtful element is a list if that part of its text is in links, or its lines are shorter on average.
LINKED, PROSE = 0.5, 40

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attr>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<cut>script|style)\b[^>]*>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Elements whose content is no text; without an end tag the first two take the rest of the page, others nothing.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg iframe object select textarea title".split()}
VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input button".split())
DROPPED = frozenset("nav footer aside form menu dialog button fieldset legend".split())
DOUBTFUL_TAGS = frozenset({"address"})
#: A class name with one of these tells about a layout ("has-sidebar").
LAYOUT = frozenset("has with without no".split())
WORDS = frozenset(
    "nav navigation navbar menu masthead footer sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion"
    " cookie cookies consent comments disqus respond comment breadcrumb breadcrumbs newsletter subscribe subscription signup login widget popup modal overlay"
    " pagination pager toolbar adbox adslot adunit adbanner commentlist topbar bottombar rail paywall".split()
)
DOUBTFUL = frozenset(
    "header aside banner notice notices alert reply replies share sharing social related recommended recommendations skip search form responses disclaimer copyright trending popular teaser teasers".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
CLEAN, DOUBT, BAD = 0, 1, 2


def _standing(tag: str, attr: str, in_article: bool) -> int:
    """Whether an element is no text, may be none, or is like its parent."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return BAD
    found = DOUBT if tag in DOUBTFUL_TAGS else CLEAN
    if not attr or ("=" not in attr and "hidden" not in attr):
        return found
    for name, *values in ATTR.findall(attr):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and UNSEEN.search(value)):
            return BAD
        if name == "role" and value in ROLES:
            return BAD
        if name in ("class", "id") and tag not in ("html", "body", "main", "article"):  # their own classes tell about layout
            for one in value.split():
                parts = set(re.split(r"[^a-z0-9]+", one))
                if parts & LAYOUT:
                    continue
                if parts & WORDS:
                    return BAD
                if parts & (DOUBTFUL - {"header"} if in_article else DOUBTFUL):
                    found = DOUBT
    return found


def lines(page: str) -> list[tuple[str, int, bool, bool, int]]:
    """(text, characters in links, in an article, in what is no text, doubtful element or 0) of each line with text.

    Linear in the page: end tags without an open element are told by counts, and the end of an element whose content
    is no text is looked for once if it is missing.
    """
    out: list[tuple[str, int, bool, bool, int]] = []
    parts: list[str] = []
    linked = 0
    link = False
    open_: list[tuple[str, bool, bool, int]] = []  # tag, in an article, no text, doubtful element
    depth: Counter = Counter()
    endless: set[str] = set()
    doubts = 0

    def close() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                top = open_[-1] if open_ else ("", False, False, 0)
                out.append((text, linked, *top[1:]))
            parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if link:
            linked += len(text.strip())

    def pop() -> str:
        tag = open_.pop()[0]
        depth[tag] -= 1
        return tag

    at = 0
    while found := TOKEN.search(page, at):
        if found.start() > at:
            take(page[at : found.start()])
        at = found.end()
        tag = (found["tag"] or found["cut"] or "").lower()
        if not tag:
            continue
        if tag in RAW and not found["end"]:
            if tag not in endless and (end := RAW[tag].search(page, at)):
                at = end.end()
                if tag != "svg":
                    close()
                continue
            if tag in ("script", "style"):
                at = len(page)
                break
            endless.add(tag)
            continue
        if tag == "a":
            link = not found["end"]
        if tag in INLINE and tag not in DROPPED:
            continue
        close()
        link = False
        if tag in VOID:
            continue
        if found["end"]:
            if depth[tag]:
                while pop() != tag:
                    pass
            continue
        while open_ and (open_[-1][0] == "p" or (open_[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"))):
            pop()
        _, inside, bad, doubt = open_[-1] if open_ else ("", False, False, 0)
        inside = inside or tag in ("article", "main")
        if not found["attr"].rstrip().endswith("/") or tag in ("p", "div", "article", "main", "section"):
            standing = _standing(tag, found["attr"], inside)
            if standing == DOUBT and not doubt:
                doubts += 1
                doubt = doubts
            open_.append((tag, inside, bad or standing == BAD, doubt))
            depth[tag] += 1
    if at < len(page):
        take(page[at:])
    close()
    return out


def weights_of(found: list[tuple[str, int, bool, bool, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Each line's characters outside of links, lowered where markup says so, and which are lowered."""
    size = np.array([len(f[0]) for f in found], float)
    links, inside, bad, doubt = (np.array([f[k] for f in found]) for k in range(1, 5))
    n = int(doubt.max()) + 1
    total, linked, count = np.bincount(doubt, size, n), np.bincount(doubt, links, n), np.bincount(doubt, minlength=n)
    listed = (linked > LINKED * total) | (total < PROSE * count)
    listed[0] = False
    low = bad | listed[doubt]
    if (size * (inside & ~low)).any():
        low = low | ~inside
    return np.maximum(0, size - links) * np.where(low, LOWERED, 1.0), low


def stretches(weights: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Lines from each surge of the window sums to the dive after it, less those without weight at its ends."""
    sums = np.convolve(weights, np.ones(window))[window // 2 : window // 2 + len(weights)]
    over = (sums >= min(SURGE, PART * sums.max())) & (sums > 0)
    edge = np.diff(np.r_[0, over.astype(np.int8), 0])
    out = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        heavy = np.flatnonzero(weights[a:b] > 0)
        if len(heavy):
            out.append((a + int(heavy[0]), a + int(heavy[-1]) + 1))
    return out


def main_text(page: str | None, window: int = WINDOW) -> str:
    found = lines(page or "")
    if not found:
        return ""
    weights, low = weights_of(found)
    return " ".join(found[i][0] for a, b in stretches(weights, window) for i in range(a, b) if not low[i])


def extract(pages: DataFrame, *keep: Column) -> DataFrame:
    """The kept columns, text and n_chars (code points) of every row; ``pages`` has a column html.

    Null and empty pages and pages without text give an empty text. Pages are taken whole, one by one and in time
    that is linear in their length, whatever their markup; so very long pages, ties and repeated rows make no
    difference. Other columns are ignored, whatever their names; no rows give none.
    """
    rows = pages.select(*keep, F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "text", "n_chars"])

    named = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{named}text string, n_chars long")
