"""Main text of web pages by line-block distribution: strip markup into lines, sum text lengths over sliding windows, keep
what lies between surge and dive."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, quoted, unpacked

# Lines in a window, the text a window needs for a surge, the share of link text from which a line counts nothing, what a
# line in a marked article counts more, and the part of the best stretch's text that another needs.
WINDOW, SURGE, LINKED, MARKED, PART = 3, 80, 0.5, 4, 0.1

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|title|xmp|object)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button menu dialog head fieldset input option".split())
MAIN = frozenset("article main".split())
CONTAINERS = frozenset("div section td blockquote center".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form alert menu menubar toolbar".split())
# Words of a class or id that name what is not the article.
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BOILERPLATE = frozenset(
    """ad ads adv advert adverts advertisement advertising adslot promo promotion sponsor sponsored sidebar sidebars rail menu nav
    navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr popup modal overlay newsletter
    subscribe subscription signup login related recommended recommendations teaser teasers toolbar pagination pager comment
    comments commentlist respond reply replies disqus feedback skip hidden""".split()
)
# Words that may also name a part of the article: there the text's length and links decide.
DOUBTFUL = frozenset("banner header notice notices notification social share sharing widget widgets search discussion reactions copyright legal alert form".split())
# Those that also leave out an element with an article in it.
BESIDE = frozenset("comment comments commentlist replies related recommended recommendations teaser teasers sidebar promo feedback".split())
MODIFIERS = frozenset("has with no not without is".split())
# Containers whose class or id may hold such words without being boilerplate themselves.
WHOLE_PAGE = frozenset("html body article main".split())
KEPT, DOUBTED, LEFT_OUT = 0, 1, 2


def _judged(tag: str, attrs: str, inside: bool, holds_main: bool) -> int:
    """Whether an element is left out, or its lines are in doubt; inside: it is in an article; holds_main: it has one in it."""
    if tag in DROPPED:
        return LEFT_OUT
    if tag == "header":
        return KEPT if inside else LEFT_OUT
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return KEPT
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)}
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true":
        return LEFT_OUT
    if re.search(r"display\s*:\s*none", found.get("style", "")) or re.search(r"\shidden(?:\s|>|$)", ATTRIBUTE.sub(" ", attrs)):
        return LEFT_OUT
    if tag in WHOLE_PAGE and not any("comment" in found.get(k, "").lower() for k in ("class", "id")):
        return KEPT
    names = set()
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w.lower() for w in WORDS.findall(token)]
        # has-sidebar and the like say something about a container, not that it is one.
        names.update(words if words and words[0] not in MODIFIERS else ())
    if names & (BESIDE if holds_main else BOILERPLATE):
        return LEFT_OUT
    return DOUBTED if names & DOUBTFUL and not holds_main else KEPT


class _Line:
    __slots__ = ("pieces", "linked", "gap", "main", "doubted", "parent")

    def __init__(self, gap: bool, main: int, doubted: bool = False, parent: int = 0) -> None:
        self.pieces: list[str] = []
        self.linked, self.gap, self.main, self.doubted, self.parent = 0, gap, main, doubted, parent


def _ends(marks: list[re.Match]) -> dict[int, int]:
    """Index of each start tag -> index of the end tag that closes it."""
    waiting: dict[str, list[int]] = {}
    found = {}
    for i, m in enumerate(marks):
        if m["tag"]:
            tag = m["tag"].lower()
            if not m["close"]:
                if tag not in VOID:
                    waiting.setdefault(tag, []).append(i)
            elif waiting.get(tag):
                found[waiting[tag].pop()] = i
    return found


def page_lines(page: str) -> list[_Line]:
    """The page's lines, one for each block, in order. Elements that are left out leave a gap line; main is the number of the
    marked article that the line is in, 0 outside; doubted lines are in an element whose name may be that of boilerplate;
    parent is the container around them."""
    marks = list(MARKUP.finditer(page))
    ends = _ends(marks)
    mains = [i for i, m in enumerate(marks) if m["tag"] and not m["close"] and m["tag"].lower() in MAIN]
    lines, line = [], _Line(False, 0)
    inside: list[int] = []  # where the open articles end
    doubt = -1  # where the outermost doubtful element ends
    containers: list[tuple[int, int]] = []  # number and end of the open containers
    links = 0
    articles = 0
    at, i = 0, 0

    def cut(gap: bool = False) -> None:
        nonlocal line
        if line.pieces:
            lines.append(line)
        if gap:
            lines.append(_Line(True, 0))
        line = _Line(False, articles if inside else 0, i < doubt, containers[-1][0] if containers else 0)

    while i <= len(marks):
        stop = marks[i].start() if i < len(marks) else len(page)
        piece = page[at:stop]
        if piece:
            piece = html.unescape(piece)
            line.pieces.append(piece)
            if links:
                line.linked += len(piece.strip())
        if i == len(marks):
            break
        m = marks[i]
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag and not m["close"]:
            nearest = bisect_right(mains, i)
            holds_main = nearest < len(mains) and mains[nearest] < ends.get(i, len(marks))
            judged = _judged(tag, m["attrs"], bool(inside), holds_main)
            if judged == LEFT_OUT:
                last = ends.get(i)
                cut(gap=True)
                if last is None and tag not in VOID:
                    # Never closed: it is taken to end before the next block.
                    last = next((j - 1 for j in range(i + 1, len(marks)) if marks[j]["tag"] and marks[j]["tag"].lower() not in INLINE), len(marks) - 1)
                    at = marks[last + 1].start() if last + 1 < len(marks) else len(page)
                elif last is not None:
                    at = marks[last].end()
                i = (last if last is not None else i) + 1
                continue
            if tag in CONTAINERS and i in ends:
                containers.append((i + 1, ends[i]))
            if judged == DOUBTED and tag not in INLINE:
                doubt = max(doubt, ends.get(i, i + 1))
            if tag == "a":
                links += 1
            elif tag == "br":
                line.pieces.append(" ")
            elif tag not in INLINE:
                if tag in MAIN or 'role="main"' in m["attrs"] or "articleBody" in m["attrs"]:
                    if not inside:
                        articles += 1
                    inside.append(ends.get(i, len(marks)))
                cut()
        elif tag:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE:
                while inside and inside[-1] <= i:
                    inside.pop()
                while containers and containers[-1][1] <= i:
                    containers.pop()
                cut()
        i += 1
    cut()
    return lines


def main_text(page: str | None) -> str:
    rows = []
    for line in page_lines(page or ""):
        text = " ".join("".join(line.pieces).split())
        if text or line.gap:
            rows.append((text, line))
    weight = np.array([_weight(text, line) for text, line in rows], np.int64)
    keep = _between(weight, np.array([x.gap for _, x in rows], bool), np.array([x.main for _, x in rows], np.int64), np.array([x.parent for _, x in rows], np.int64))
    # Within the bounds all lines stay, but short ones whose element's name speaks against them.
    return "\n\n".join(t for (t, x), w, k in zip(rows, weight, keep) if k and t and not x.gap and (w or not x.doubted))


def _weight(text: str, line: _Line) -> int:
    """Length of the text; nothing for gaps, link lists and short lines in doubt, more in a marked article."""
    if line.gap or line.linked > LINKED * len(text) or line.doubted and len(text) < SURGE:
        return 0
    return len(text) * (MARKED if line.main else 1)


def _between(weight: np.ndarray, gap: np.ndarray, main: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The lines between surge and dive. A window is a line and the next ones up to a gap or the edge of a marked article; text
    surges where a window with text begins and dives where no window has any. A stretch counts if one of its windows passes
    SURGE, or half the mean window where a page is short, and its text is PART of the best stretch's at least. Stretches of
    one marked article are one, and so are those of the container around the best stretch; beside marked articles, what is
    not marked needs more text than they have."""
    n = len(weight)
    if not weight.any():
        return np.zeros(n, bool)
    # Lines that windows do not reach over: parts between gaps and edges of articles.
    part = np.cumsum(np.concatenate(([True], gap[1:] | gap[:-1] | (main[1:] != main[:-1]))))
    windows = weight.copy()
    for step in range(1, WINDOW):
        windows[:-step] += np.where(part[step:] == part[:-step], weight[step:], 0)
    # Back and forth: a line is between surge and dive if a window with text begins at most WINDOW - 1 lines before it and
    # another one at it or after it, in the same part.
    text = np.flatnonzero(weight)
    fresh = np.concatenate(([True], (part[text[1:]] != part[text[:-1]]) | (np.diff(text) > WINDOW)))
    first, last = text[fresh], text[np.append(np.flatnonzero(fresh)[1:] - 1, len(text) - 1)]
    least = min(SURGE, 0.5 * float(windows[windows > 0].mean()))
    highest = np.array([windows[a : b + 1].max() for a, b in zip(first.tolist(), last.tolist())])
    own = np.array([weight[a : b + 1].sum() for a, b in zip(first.tolist(), last.tolist())], np.int64)
    # Together by marked article and by the container of the best stretch; others each on their own.
    group = np.where(main[first] > 0, -main[first], np.arange(len(first)))
    around = parent[first[own.argmax()]]
    if around and not main[first].any():
        group[parent[first] == around] = len(first)
    names, which = np.unique(group, return_inverse=True)
    total = np.bincount(which, weights=own)
    surges = np.zeros(len(names), bool)
    np.logical_or.at(surges, which, highest >= least)
    marked = names < 0
    best = total[marked].max() if marked.any() else 0
    if marked.any() and best >= total[~marked].max(initial=0):
        chosen = marked & (total >= PART * best)
    else:
        chosen = surges & (total >= PART * total.max())
    keep = np.zeros(n, bool)
    for a, b, g in zip(first.tolist(), last.tolist(), which.tolist()):
        keep[a : b + 1] = chosen[g]
    return keep


def extract_main_text(pages: DataFrame, *, page: str = "html") -> DataFrame:
    """Every row with text, its main text, and n_chars, the code points of it.

    Markup is stripped into lines, one for each block; menus, footers, sidebars, forms, scripts and styles, and elements
    named as adverts, notices or comments, are gaps. Sums of text over windows of lines show on every page where text
    surges and where it dives; what lies between is kept whole, short lines and paragraphs of links included. Marks of an
    article only add weight to its lines: all marked articles with a part of the longest one's text stay, and text outside
    them stays only if it outweighs them. Character references are decoded, white space in a block becomes one space, and
    blocks are joined by an empty line.

    Null and empty pages and pages without text give an empty text; broken markup never fails; repeated rows are
    extracted each; an empty table gives an empty result; columns named text or n_chars are replaced.
    """

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    names = pages.columns
    rows = pages.select(packed(pages), extracted(quoted(page)).alias("_text"))
    return unpacked(rows, names, {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")})
