"""Main text of a web page by the distribution of text over lines.

Markup is stripped to lines, one per block. What is never article text (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, comments of readers) is stripped with its element and leaves WINDOW empty lines. Each line weighs its
characters outside links; weights are summed over WINDOW lines. Text surges where that sum passes a threshold and dives where
it falls to zero. Lines inside an article or main element carry a bonus above the threshold, so such a page is cut at the
borders of that element. Elsewhere stripped parts and containers divide one article, so all stretches are joined: the text
between the first surge and the last dive is kept whole, links and all, and with it the text that the lowest container common
to their heavy lines holds before and after. Lines of links alone outside of that are no text.

Defined cases: a null or empty page, or one without text, gives the empty string; elements left open end with the element around
them or the page; a cut-off tag at the end of a page is dropped; white space within a block is one space; repeated rows are
extracted alike; other columns are not read.
"""

from __future__ import annotations

import heapq
import html
import re

from pyspark.sql import DataFrame

from busloom.llm.common import SPACE, over_texts

WINDOW, SURGE = 3, 80
BONUS = 10_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title|math|object|select|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.I | re.S,
)
BLOCKS = set("address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()) - {"br"}
#: Elements whose content belongs to what stands around them.
FLOW = set("ul ol dl table figure blockquote details center".split())
NESTED = set("html head body div section article main aside nav header footer form ul ol menu dl table figure blockquote fieldset dialog details button center".split())
CONTAINERS = NESTED - FLOW
DROPPED = set("head nav header footer aside form menu dialog button fieldset".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar".split())
#: Words of a class or id that mark what is not article text.
MARKS = set(
    "ad ads adbox adslot adunit advert adverts advertisement advertising banner sponsor sponsored sponsors promo promoted promotion sidebar sidenav rail menu nav navbar navigation topnav "
    "breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login popup modal overlay toolbar pager pagination copyright legal disclaimer widget widgets search form cookie cookies consent gdpr notice notices notification alert skip".split()
)
COMMENTS = {"comment", "comments", "reply", "replies"}
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BLANK = re.compile(rf"[{SPACE}]+")


def dropped(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            found = MARKS.intersection(w.lower() for w in WORDS.findall(value))
            if found and (tag != "article" or found & COMMENTS):
                return True
        elif name == "role" and value.lower() in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


VOID = set("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 pre".split())


def lines_of(page: str) -> tuple[list[tuple[str, int, int, int]], dict[int, int]]:
    """(text, characters outside links, container, innermost article or main or 0) per block, stripped parts as empty lines; and
    the container around each container, whose number is always smaller."""
    lines: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, container, article, whether it is dropped
    here: list[str] = []
    in_link, linked, number = False, 0, 0
    around: dict[int, int] = {}

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][3]:
            here.append(text := html.unescape(raw))
            linked += len(text) * in_link

    def end_line() -> None:
        nonlocal linked
        if here and (text := BLANK.sub(" ", "".join(here)).strip(SPACE)):
            lines.append((text, 0 if text[0] in "©®" else max(0, len(text) - linked), *stack[-1][1:3]))
        here.clear()
        linked = 0

    def pop() -> str:
        tag, _, _, gone = stack.pop()
        if gone and not stack[-1][3]:
            lines.extend([GAP] * WINDOW)
        return tag

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m[3] is None:  # a comment, declaration or raw element
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag == "br":
            add(" ")
        elif tag == "a":
            in_link = not closing
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCKS:
            end_line()
            in_link = False
        if closing:
            if any(x[0] == tag for x in stack[1:]) and (tag in BLOCKS or stack[-1][0] == tag):
                while pop() != tag:
                    pass
            continue
        if tag not in BLOCKS:
            if stack[-1][0] == tag or not stack[-1][3] and tag != "a" and m[4] and dropped(tag, m[4]):
                stack.append((tag, *stack[-1][1:3], True))
            continue
        if tag == "hr":
            continue
        while stack[-1][0] in LEAVES or tag in ("li", "dt", "dd") and stack[-1][0] in ("li", "dt", "dd") or stack[-1][0] and stack[-1][0] not in BLOCKS:
            pop()
        if tag in ("article", "main", "body"):
            while stack[-1][0] in ("head", "nav", "header") and stack[-1][3]:  # left open
                pop()
        number += 1
        gone = stack[-1][3] or dropped(tag, m[4] or "")
        article = number if tag in ("article", "main") and not gone else stack[-1][2]
        if tag in CONTAINERS:
            around[number] = stack[-1][1]
        stack.append((tag, number if tag in CONTAINERS else stack[-1][1], article, gone))
    add(page[at:])
    end_line()
    return lines, around


GAP = ("", 0, 0, 0)


def stretches(weights: list[int], threshold: float) -> list[tuple[int, int]]:
    """[surge, dive): from where the sum of WINDOW lines passes the threshold to where it falls to zero."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    out, start = [], None
    for i, s in enumerate(sums):
        if start is None and s >= threshold:
            start = i
            while start and weights[start - 1]:  # the sum looks ahead: lines that led up to the surge
                start -= 1
        elif start is not None and s == 0:
            out.append((start, i))
            start = None
    return out + ([(start, len(sums))] if start is not None else [])


def common_container(of: set[int], around: dict[int, int]) -> int:
    """The lowest container that holds all of these."""
    seen, left = set(of), [-c for c in of]
    heapq.heapify(left)
    while len(left) > 1:
        if (outer := around[-heapq.heappop(left)]) not in seen:
            seen.add(outer)
            heapq.heappush(left, -outer)
    return -left[0]


def main_text(page: str) -> str:
    lines, around = lines_of(page)
    weights = [n + BONUS if article and text else n for text, n, _, article in lines]
    if not any(weights):
        return ""
    found = stretches(weights, min(SURGE, max(sum(weights[i : i + WINDOW]) for i in range(len(weights)))))
    start, stop = max(found, key=lambda x: sum(weights[x[0] : x[1]]))
    # the container that holds most of the heaviest stretch
    held: dict[tuple[int, int], int] = {}
    for i in range(start, stop):
        if lines[i][0]:
            kind = (1, lines[i][3]) if lines[i][3] else (0, lines[i][2])
            held[kind] = held.get(kind, 0) + weights[i]
    marked, best = max(held, key=lambda k: (held[k], k))
    if marked:
        return "\n".join(x[0] for x in lines if x[0] and x[3] == best)
    heavy = {lines[i][2] for a, b in found for i in range(a, b) if weights[i] >= min(SURGE, max(weights[a:b]))}
    inside = {common_container(heavy, around)}
    for c in around:  # from the outer ones in
        if around[c] in inside:
            inside.add(c)
    own = [i for i, w in enumerate(weights) if w and (found[0][0] <= i < found[-1][1] or lines[i][2] in inside)]
    return "\n".join(x[0] for x in lines[own[0] : own[-1] + 1] if x[0])


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """The carried columns, text and n_chars, for every row."""

    def run(texts):
        out = [main_text(x) for x in texts]
        return {"text": out, "n_chars": list(map(len, out))}

    return over_texts(pages, run, "text string, n_chars long", carry, page)
