"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element, in page order; character references are
decoded and white space inside a line becomes one space.  Navigation, header, footer, aside, form,
script, style and elements with a class, id or role that names such a part are set aside, but for a
wrapper: a form, a header or a named element which holds the page's marked article or most of its
text, with no marked article outside.  Set-aside lines between two containers count as empty, and so
does the text of links outside an article for the measure (not for the output).  Over sliding windows
of WINDOW lines the text lengths are summed: a surge point is where a window's sum rises from nothing
beyond SURGE, a dive point where it falls back to nothing.  The lines between a surge and its dive are
a stretch.  Stretches of at least SHARE of the longest are strong; all text from the first strong one
to the last is kept.  An article or main element (or such a role) begins and ends a stretch and its
text counts MARKED times; it decides nothing else.  A page's only h1 stays if it is the stretch before
the first strong one.

A null or empty page gives an empty text; so does a page without text.  Unclosed elements end with
their parent; a page that ends early is read as far as it goes.  Pages are independent: a null or
repeated page_id gives a row for each page; other columns don't matter; an empty table gives an empty
table; of equally long stretches all are strong.  A page is held once, with its lines, by one task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

WINDOW, SURGE, SHARE, MARKED = 3, 80, 0.3, 3

TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)"
    r"|(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))",
    re.DOTALL | re.IGNORECASE,
)
#: Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup: what stands there up to the closing tag goes.  The first two may stay open to the end of the page.
RAW = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE) for tag in ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")}
WRAPPERS = frozenset("form header fieldset".split())
#: Elements of one line, or of inline text; what holds them is the container of the line.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre center caption summary figcaption".split())
ASIDE = frozenset("nav header footer aside form head menu button dialog fieldset title".split())
#: Inline elements whose content is no text of the line that they stand in.
MUTE = frozenset("select template noscript svg math canvas textarea iframe".split())
CLOSED_BY_BLOCK = frozenset(["p"])
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
#: Names that don't set a single line of a marked article aside: they tell what it is about as well.
SOFT = frozenset("legal alert disclaimer copyright header search login related".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
PARTS = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary|sub|mobile|post|entry|article|user|gdpr|privacy)[-_])*(?:ads?|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|side-?bar\w*|footer\w*|masthead|site-?header|page-?header|header|cookie\w*|consent|notice\w*|popup|modal|newsletter|subscribe|signup|"
    r"share\w*|social\w*|comments?|comment-?\w*|replies|respond|disqus\w*|related\w*|recommend\w*|widget\w*|complementary|contentinfo|navigation|search\w*|login|pagination|pager|toolbar|skip-?link|copyright|disclaimer|legal|alert)"
    r"(?:[-_]?(?:\d+|list|box|bar|links?|menu|area|block|section|slot|unit|items?|inner|left|right|top|bottom|form|banner|wrapper|container|notice|consent|popup|modal|overlay|message|policy))*",
    re.IGNORECASE,
)
MAIN = re.compile(r"role\s*=\s*[\"']?(?:main|article)\b|itemprop\s*=\s*[\"']?articleBody\b", re.IGNORECASE)
SPACE = re.compile(r"\s+")


def named_part(rest: str, line: bool = False) -> bool:
    """Whether a whole word of class, id, role or label names a part that is set aside."""
    words = (word.lower() for names in NAMES.findall(rest) for word in names.strip("\"'").split())
    return any(PARTS.fullmatch(word) and not (line and word in SOFT) for word in words)


def lines(page: str) -> list[tuple[str, int, bool, int, int, bool]]:
    """(text, characters in links, set aside, number of the outermost article or 0, number of the container, h1) of each block, in page order."""
    out: list[tuple] = []
    endless: set[str] = set()
    wrappers: set[int] = set()
    # (name, number, set aside, article)
    stack: list[tuple[str, int, bool, bool]] = []
    piece: list[str] = []
    linked: list[str] = []
    off: list[int] = []
    main: list[int] = []
    # (number, whether a block inside ends it)
    mute: list[tuple[int, bool]] = []
    links = number = at = 0

    def close_line() -> None:
        text = SPACE.sub(" ", html.unescape("".join(piece))).strip()
        piece.clear()
        if text:
            link = len(SPACE.sub(" ", html.unescape("".join(linked))).strip())
            inside = next((n for name, n, *_ in reversed(stack) if name in BLOCKS and name not in LEAVES), 0)
            out.append((text, link, tuple(off), main[0] if main else 0, inside, any(s[0] == "h1" for s in stack)))
        linked.clear()

    def pop() -> None:
        nonlocal links
        name, n, was_off, was_main = stack.pop()
        if mute and mute[-1][0] == n:
            mute.pop()
        if was_off:
            off.pop()
        if was_main:
            main.pop()
        links -= name == "a"

    while m := TOKEN.search(page, at):
        if m.start() > at and not mute:
            piece.append(page[at : m.start()])
            if links:
                linked.append(page[at : m.start()])
        at = m.end()
        if m["data"]:
            piece.append(html.escape(m["data"]))
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            close_line()
            mute[:] = [x for x in mute if not x[1]]
        if m["close"]:
            if any(s[0] == tag for s in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or m["rest"].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW and tag not in endless:
            if end := RAW[tag].search(page, at):
                at = end.end()
                continue
            endless.add(tag)
        if tag in ("script", "style"):  # what is left of the page is no text
            at = len(page)
            break
        if tag in BLOCKS and stack and any(s[0] == "p" for s in stack):
            # an open paragraph ends where a block begins
            while any(s[0] == "p" for s in stack):
                pop()
        elif tag in ITEMS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SCOPES[tag]:
                    break
                if stack[k][0] in ITEMS[tag]:
                    while len(stack) > k:
                        pop()
                    break
        is_main = tag in ("article", "main") or bool(MAIN.search(m["rest"]))
        hidden = bool(m["rest"]) and not is_main and tag not in ("html", "body") and bool(HIDDEN.search(m["rest"]))
        named = not hidden and bool(m["rest"]) and not is_main and tag not in ("html", "body") and named_part(m["rest"], bool(main) and (tag in LEAVES or tag not in BLOCKS))
        aside = tag in ASIDE or hidden or named
        number += 1
        stack.append((tag, number, aside, is_main))
        if tag in MUTE or (hidden or named) and tag not in BLOCKS:
            mute.append((number, tag not in MUTE))
        if aside:
            off.append(number)
            if not hidden and (tag in WRAPPERS or tag not in ASIDE):
                wrappers.add(number)
        if is_main:
            main.append(number)
        links += tag == "a"
    if at < len(page) and not mute:
        piece.append(page[at:])
    close_line()
    spared = spare(out, wrappers)
    return [(text, link, any(n not in spared for n in own), article, inside, h1) for text, link, own, article, inside, h1 in out]


def spare(found: list[tuple], wrappers: set[int]) -> set[int]:
    """Those of ``wrappers`` that hold the marked article or most of the page's text (links aside), with no marked text outside."""
    total = marked = 0
    held: dict[int, list[int]] = {n: [0, 0] for n in wrappers}
    for text, link, own, article, *_ in found:
        size, main = max(0, len(text) - link), len(text) * bool(article)
        total += size
        # articles inside navigation, asides and footers are teasers
        main = main if all(n in held for n in own) else 0
        marked += main
        for n in own:
            if n in held:
                held[n][0] += size
                held[n][1] += main
    return {n for n, (size, main) in held.items() if main == marked and (main or 2 * size > total)}


def stretches(sizes: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first line, end) of what lies between surge and dive points of the windowed sums."""
    n = len(sizes)
    sums = [sum(sizes[max(0, i) : i + window]) for i in range(1 - window, n)]  # the window that ends at line i + window - 1
    found, k = [], 0
    while k < len(sums):
        if not sums[k]:
            k += 1
            continue
        end, most = k, 0
        while end < len(sums) and sums[end]:
            most = max(most, sums[end])
            end += 1
        inside = [i for i in range(max(0, k - window + 1), min(n, end)) if sizes[i]]
        found.append((inside[0], inside[-1] + 1, most >= surge))
        k = end
    strong = [f[:2] for f in found if f[2]]
    return strong or [f[:2] for f in found]


def measured(page: str) -> tuple[list[int], list[str], list[int]]:
    """Measure and text of each line of the page, gaps included, and the places of the lines of an h1."""
    sizes, texts, heads = [], [], []
    parted, before = False, None
    for text, link, aside, article, inside, h1 in lines(page):
        if aside:
            parted = True
            continue
        # set-aside parts between two containers and the borders of an article are as wide as a window
        if before and (article != before[0] or parted and inside != before[1] and not (article and article == before[0])):
            sizes += [0] * WINDOW
            texts += [""] * WINDOW
        if h1:
            heads.append(len(sizes))
        sizes.append(MARKED * len(text) if article else max(0, len(text) - link))
        texts.append(text)
        parted, before = False, (article, inside)
    return sizes, texts, heads


def extract(page: str | None) -> str:
    if not page:
        return ""
    sizes, texts, heads = measured(page)
    every = stretches(sizes, surge=0)
    found = [(sum(sizes[a:b]), a, b) for a, b in stretches(sizes)]
    if not found:
        return ""
    most = max(found)[0]
    strong = [(a, b) for size, a, b in found if size >= SHARE * most]
    kept = texts[strong[0][0] : strong[-1][1]]
    near = [(a, b) for a, b in every if b <= strong[0][0]][-1:]
    if len(heads) == 1 and near == [(heads[0], heads[0] + 1)]:
        kept.insert(0, texts[heads[0]])
    return " ".join(t for t in kept if t)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
