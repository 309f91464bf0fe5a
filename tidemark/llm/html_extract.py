"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  First pass: each block is judged by its
stop-word density, its length, its link density and the containers it lies in (menus,
headers, footers, side columns, notices, adverts, forms and comments by tag, role, class or
id).  Blocks in such containers and blocks that are mostly links are out; long blocks with
stop words, and long ones of the article element, are in; the rest (short blocks, long ones
without stop words) stay open.  Stop words are known for four languages: on a page without any block
that is in, all long open blocks are.  Second pass: an open block takes the label of the
nearest decided block of its own region (its innermost article, main or section element),
then of the page; if two are equally near and differ it is out.  Blocks of marked containers
say nothing of long ones, which are in if no other block decides.  A region without
any decided block is in if it is an article or main element, and so are open blocks of a
page on which nothing is decided.

Character references are decoded, white space inside a block becomes one space, and the
blocks that are in are joined in page order by an empty line.  Nothing else is dropped; texts
have no limit.  Null or empty pages give the empty text, each row is worked on alone
(repeated rows give equal results), extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_batches

#: Common function words of the languages that pages come in.
STOP_WORDS = frozenset((
    "the of to and a in is that it for was on are as with be by at this from or have an not but which his they "
    "der die das und in zu den von mit ist des sich auf für im dem nicht ein eine als auch es an aus er hat dass sie "
    "le la les de des et un une du en est que qui dans pour par sur au ne se pas plus il elle ce avec sont aux ou "
    "el los las y en un una del que se por con para no es al lo como más su sus o pero este ha").split())
BLOCK_TAGS = frozenset((
    "address article aside blockquote body canvas caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead title tr ul").split())
OUT_TAGS = frozenset(
    "head nav header footer aside form menu dialog select button noscript template svg iframe object canvas figcaption".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "textarea", "title", "xmp", "noembed", "noframes")
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"overlay|sidebar|side|aside|menu|nav|navbar|navigation|breadcrumbs?|toolbar|topbar|masthead|header|footer|foot|"
    r"comments?|commentlist|replies|reply|respond|disqus|share|sharing|social|related|recommend\w*|widget|newsletter|"
    r"subscribe|subscription|signup|login|search|pagination|pager|copyright|legal|disclaimer)(?:$|[\s_-]|\d)", re.I)

#: Parts of class names that say nothing of what is inside.
PLAIN_PARTS = frozenset("box bar block wrap wrapper container section list item items area main top bottom left right inner outer content body "
                        "link links button buttons icon icons text title group panel row col column module unit slot post page site js".split())

# Quotes count only after an equals sign; other values run to white space or the tag's end.  Every form also ends with the
# page, so no part of a page is read twice.
_INSIDE = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'>][^\s>]*+)?)*+"
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<raw>" + "|".join(RAW_TAGS) + r")\b" + _INSIDE + r"(?:>(?:.*?</(?P=raw)\b[^>]*+(?:>|\Z)|.*)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attributes>" + _INSIDE + r")(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.I | re.S)
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|$)", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")

LONG, SHORT, LINKED, STOPS = 80, 25, 0.4, 0.15
OUT, IN, OPEN = 0, 1, 2


def _out_name(name: str) -> bool:
    """Whether a whole class name says so: each part does, or says nothing.  Inside an article one part alone may as well be
    its subject (``legal-analysis``, ``share-price``)."""
    parts = [p for p in re.split(r"[\d_-]+", name.lower()) if p and p not in PLAIN_PARTS]
    return bool(parts) and all(OUT_NAMES.search(p) for p in parts)


def _marked(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether a container holds something other than main text."""
    if tag in OUT_TAGS:
        # an article's own header holds its title
        return not (tag in ("header", "figcaption") and in_article)
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "role":
            if value.lower() in OUT_ROLES:
                return True
        elif name in ("class", "id"):
            if OUT_NAMES.search(value) and (not in_article or any(map(_out_name, value.split()))):
                return True
        elif name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True
        elif name == "hidden" or value.lower() == "true":
            return True
    return False


def blocks(html: str) -> list[tuple[str, float, bool, int, bool]]:
    """(text, link density, marked, region, region is article or main) of each block."""
    out: list[tuple[str, float, bool, int, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, marked, region, region is article or main
    marked, region, main, regions = False, 0, False, 0
    links = linked = depth = 0
    fresh = around = False  # a link without text yet; a link around blocks
    opened: Counter[str] = Counter()  # tags on the stack

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, linked / len(text), marked, region, main))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(html):
        text = m["text"]
        if text is not None:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                size = len(text.strip())
                linked += size
                fresh = fresh and not size
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                links = 0
            elif tag in BLOCK_TAGS:
                close()
            if opened[tag]:
                if tag not in BLOCK_TAGS:
                    close()
                while opened[tag]:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
                _, marked, region, main = stack[-1] if stack else ("", False, 0, False)
                if len(stack) < depth:  # the link's own container has ended
                    links = 0
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links, fresh, around, depth = int(bool(_HREF.search(m["attributes"]))), True, False, len(stack)
        elif tag in VOID_TAGS:
            if tag == "hr":
                close()
        elif tag in BLOCK_TAGS or tag in OUT_TAGS:
            around = around or fresh
            close()
            if not around:  # a link with text of its own does not go on in the next block
                links = 0
            if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dt", "dd", "option"):
                # closed by the next of their kind, so not kept open; a mark on them holds for the block
                while stack and stack[-1][0] == "p":
                    stack.pop()
                    opened["p"] -= 1
                _, marked, region, main = stack[-1] if stack else ("", False, 0, False)
                if _marked(tag, m["attributes"], main):
                    stack.append(("p", True, region, main))
                    opened["p"] += 1
                    marked = True
                continue
            if tag == "body":
                stack.clear()
                opened.clear()
                marked, region, main = False, 0, False
            while stack and stack[-1][0] == "p":
                stack.pop()
                opened["p"] -= 1
            _, marked, region, main = stack[-1] if stack else ("", False, 0, False)
            if tag in ("article", "main", "section"):
                regions += 1
                region = regions
                main = main or tag != "section"
            marked = marked or _marked(tag, m["attributes"], main)
            if not m["attributes"].endswith("/") or tag in BLOCK_TAGS:
                stack.append((tag, marked, region, main))
                opened[tag] += 1
    close()
    return out


def first_pass(text: str, link_density: float, marked: bool, main: bool) -> int:
    if marked or link_density > LINKED:
        return OUT
    if len(text) < SHORT:
        return OPEN
    words = _LETTERS.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if len(text) >= LONG:
        return IN if stops >= STOPS or main else OPEN
    return IN if stops >= STOPS and main else OPEN


def _nearest(labels: list[int], regions: list[int], votes: list[bool], whole_page: bool) -> dict[int, int]:
    """Labels of open blocks from the nearest decided block that has a vote, in their region or on
    the page."""
    ahead: dict[int, tuple[int, int]] = {}
    near: dict[int, tuple[int, int]] = {}
    for step in (1, -1):
        ahead.clear()
        for i in range(len(labels))[::step]:
            key = 0 if whole_page else regions[i]
            if labels[i] != OPEN:
                if votes[i]:
                    ahead[key] = (i, labels[i])
            elif key in ahead:
                j, label = ahead[key]
                d = abs(i - j)
                if i not in near or d < near[i][0]:
                    near[i] = (d, label)
                elif d == near[i][0]:
                    near[i] = (d, min(label, near[i][1]))
    return {i: label for i, (_, label) in near.items()}


def extract(html: str | None) -> str:
    """The main text of a page."""
    found = blocks(html or "")
    labels = [first_pass(t, d, marked, main) for t, d, marked, _, main in found]
    regions = [r for *_, r, _ in found]
    long = [len(b[0]) >= LONG for b in found]
    if IN not in labels:  # a language whose stop words are not known, or no stop words
        labels = [IN if x == OPEN and y else x for x, y in zip(labels, long)]
    decided = labels
    for whole_page in (False, True):
        if OPEN not in decided:
            break
        # inside a region, blocks of marked containers (a form in an article) say nothing of the others
        if whole_page:  # nor do those of the page (menu, footer) of its long blocks
            near = _nearest(decided, regions, [not b[2] for b in found], True)
            decided = [near.get(i, IN) if x == OPEN and long[i] else x for i, x in enumerate(decided)]
        near = _nearest(decided, regions, [whole_page or not b[2] for b in found], whole_page)
        decided = [near.get(i, x) if x == OPEN else x for i, x in enumerate(decided)]
        if not whole_page:
            decided = [IN if x == OPEN and found[i][4] else x for i, x in enumerate(decided)]
    if all(x in (OPEN, OUT) for x in decided) and OPEN in decided:
        decided = [IN if x == OPEN else x for x in decided]
    return "\n\n".join(b[0] for b, x in zip(found, decided) if x == IN)


def _run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_batches(batches):
        texts = [extract(h) for h in b.column("text").to_pylist()]
        yield pa.record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()),
                               "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("text"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
