"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block of running text: block elements and line breaks end a line,
inline elements do not.  Elements that never hold article text (scripts, styles, navigation, forms,
asides and the like, and containers whose class, id or role names such a part) give empty lines.  The
lengths of lines weigh them: link text does not count, and where a page marks its articles, a line beside them has
``SURGE`` characters less, and at least none, while their own lines count whole.  The weights are summed over windows
of ``WINDOW`` lines.  The text starts at the surge, where the sums rise from nothing, and ends at the dive, where they fall
back to nothing; a run between the two is kept if its largest sum reaches the page's threshold: ``SURGE`` characters, or
``PART`` of the page's largest sum where articles are marked.  Lines without weight stay inside a run, but on pages with
marked articles those beside them go; removed parts are no distance between the first surge and the last dive.

Defined cases: null or empty html gives empty text; markup that is cut off or not closed ends with the
page or with its parent; a page without a surge gives all of its remaining lines; long pages are read
whole; repeated rows and other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
PART = 0.02

#: Elements whose content is no text of the page.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "title", "textarea", "head")
#: Elements that hold other parts than the article.
SIDE = frozenset("nav footer aside form menu dialog button select fieldset audio video canvas".split())
#: Elements that are parts of a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(("article", "main"))
#: Names in class, id or role of a part other than the article: all parts of such a name are among these or ``BESIDE``.
SIDE_WORDS = re.compile(
    r"nav|navbar|navigation|menu|breadcrumbs?|ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|sidebar|side|aside|widgets?|footer|masthead|comments?|commentlist|respond|disqus|replies|related|recommend(?:ed|ations)?|share|sharing|social|newsletter|subscribe|subscription|signup|login|search|pagination|pager|toolbar|contentinfo|complementary|topbar|copyright"
)
BESIDE = re.compile(r"site|page|global|main|primary|secondary|top|bottom|left|right|post|posts|article|articles|story|stories|blog|list|box|bar|block|area|section|wrapper|wrap|container|inner|outer|panel|group|row|item|items|link|links|button|buttons|icons?|form|slot|unit|media|thread|policy|body|content|header|title|fixed|sticky|mobile|desktop|[0-9]+")
#: Names that only begin like a side part: the layout has it, or lacks it.
LAYOUT = re.compile(r"(?:no|has|with|without|is|not|content|main)[-_]", re.IGNORECASE)
HEADERS = frozenset("header site-header page-header site_header page_header main-header top-header".split())
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements that are spared only for an article in them, however much text they hold.
STRICT = SIDE - {"form", "fieldset", "dialog"}
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|$)""", re.DOTALL)
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in RAW}


def _names_side(name: str) -> bool:
    """Whether a name as a whole means a part other than the article."""
    if LAYOUT.match(name):
        return False
    parts = [p for p in re.split(r"[-_]+", name.lower()) if p]
    return any(SIDE_WORDS.fullmatch(p) for p in parts) and all(SIDE_WORDS.fullmatch(p) or BESIDE.fullmatch(p) for p in parts)


def _is_side(tag: str, attributes: str, inside: bool) -> bool:
    if tag in SIDE or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    values = {}
    for name, *value in ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), "".join(value))
    names = [n for key in ("class", "id", "role") for n in values.get(key, "").split()]
    if tag in CONTAINERS:
        if any("comment" in n.lower() and _names_side(n) for n in names):
            return True
    elif any(_names_side(n) or n.lower() in HEADERS and not inside for n in names):
        return True
    hidden = "hidden" in values and values["hidden"].lower() != "until-found"
    return hidden or "hidden" in values.get("class", "").split() or values.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", values.get("style", ""), re.IGNORECASE))


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """Lines of a page: text, its length without link text, and the number of its article container (0: none).

    A side part is read after all if it holds the page's article or, where no article is marked, most of its text.
    """
    spared: set[int] = set()
    while True:
        lines, parts, total = _parsed(page, spared)
        marked = any(c for t, _, c in lines if t)
        more = {at for at, (strict, main, article, size) in parts.items() if main or not marked and (article or not strict and 2 * size > total)}
        if not more:
            return lines
        spared |= more


def _parsed(page: str, spared: set[int]) -> tuple[list[tuple[str, int, int]], dict[int, list], int]:
    """Lines; for each outermost side part, by its place, whether its element is strict, holds a main, an article, and its size; size of all text."""
    parts: dict[int, list] = {}
    part: list = []  # the side part that is open
    total = 0
    lines: list[tuple[str, int, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, whether it begins a side part, whether a container
    side = container = made = links = linked = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            lines.append((joined, max(0, len(joined) - linked), container))
        text.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked, total
        size = len("".join(raw.split()))
        total += size
        if side:
            part[3] += size
        elif raw:
            piece = entities.unescape(raw)
            text.append(piece)
            if links:
                linked += len(" ".join(piece.split()))

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:-3].replace("&", "&amp;"))
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE and not any(t == tag and s for t, s, _ in stack[-1:]):
                continue
            flush()
            if any(t == tag for t, _, _ in stack):
                while stack:
                    t, began, held = stack.pop()
                    side -= began
                    if held:
                        container = 0
                    if began and not side:
                        lines.extend([("", 0, container)] * WINDOW)
                    if t == tag:
                        break
            continue
        if tag in RAW:
            if tag == "head":
                continue
            if tag not in INLINE:
                flush() if tag == "title" else None
            closing = RAW_END[tag].search(page, at)
            at = closing.end() if closing else end
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            if tag in VOID or not (tag == "span" and m.start() not in spared and _is_side(tag, m[3], bool(container))):
                continue
            if not side:
                part = parts[m.start()] = [False, False, False, 0]
            stack.append((tag, True, False))
            side += 1
            continue
        flush()
        if tag in VOID or m[3].endswith("/") and tag not in ("p", "div"):
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            # These may be left open; the next of their kind closes them.
            if stack and stack[-1][0] == tag:
                side -= stack.pop()[1]
            if not _is_side(tag, m[3], bool(container)):
                continue
        began = m.start() not in spared and _is_side(tag, m[3], bool(container))
        if began and not side:
            part = parts[m.start()] = [tag in STRICT, False, False, 0]
        if side and tag in CONTAINERS and not _is_side(tag, m[3], True):
            part[1 if tag == "main" else 2] = True
        held = tag in CONTAINERS and not side and not began and not container
        if held:
            made += 1
            container = made
        side += began
        stack.append((tag, began, held))
        links = 0
    flush()
    return lines, parts, total


def _runs(lengths: list[int], surge: float) -> list[tuple[int, int]]:
    """(surge, dive) of the runs of lines whose window sums rise to ``surge`` characters."""
    n = len(lengths)
    # sums[i]: text of the window of lines that begins at line i
    run = [0]
    for x in lengths:
        run.append(run[-1] + x)
    sums = [run[min(n, i + WINDOW)] - run[i] for i in range(n)]
    found = []
    i = 0
    while i < n:
        dive = i
        while dive < n and sums[dive]:
            dive += 1
        if dive > i and max(sums[i:dive]) >= surge:
            found.append((i, dive))
        i = max(dive, i + 1)
    return found


def main_lines(lines: list[tuple[str, int, int]]) -> list[str]:
    """Lines between the surge and dive points of the distribution."""
    if any(c for t, _, c in lines if t):
        weights = [len(t) if c else max(0, n - SURGE) for t, n, c in lines]
        peak = max(sum(weights[i : i + WINDOW]) for i in range(len(weights)))
        return [lines[i][0] for a, b in _runs(weights, max(1, PART * peak)) for i in range(a, b) if lines[i][0] and weights[i]]
    found = _runs([n for _, n, _ in lines], SURGE)
    if not found:
        return [t for t, _, _ in lines if t]
    # Removed side parts are no distance between the first surge and the last dive.
    body = [x for x in lines[found[0][0] : found[-1][1]] if x[0]]
    return [t for a, b in _runs([n for _, n, _ in body], SURGE) for t, _, _ in body[a:b]]


def main_text(page: str | None) -> str:
    return " ".join(main_lines(page_lines(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    found = pages.select("page_id", "url", run(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
