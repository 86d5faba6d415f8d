"""Main text of web pages, by a two-pass rule over text blocks.

The first pass looks at each block alone: how much of it is link text, how long it is
and how many of its words are stop words, and whether it stands in a part of the page
that is never text. It decides the clear cases. In the second pass a block that was
left open, mostly a short one, takes the label of the nearest decided block.

Names of elements and classes only help: what is marked as surroundings is bad, unless
it is a container that holds the article, and an article counts as one only if the
first pass finds good text in it or none elsewhere.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block is good on its own from this many characters and share of stop words on.
LONG_BLOCK, STOP_SHARE = 80, 0.15
#: A block with a larger share of link text is bad on its own.
LINK_SHARE = 0.5
#: Words of a text that is written without blanks are longer than this on average.
LONG_WORDS = 12

RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")
# Elements whose content is never part of an article.
OUTSIDE = frozenset(
    "head nav footer aside menu dialog select button svg math object audio video canvas".split()
)
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol
    option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class and id attributes, and roles, that mark what surrounds an article.
MARKS = frozenset(
    """ad ads advert advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent
    disclaimer footer header masthead menu nav navbar navigation newsletter notice notices pager
    pagination popup modal promo promotion related search share sharing sidebar skip social sponsor
    sponsored subscribe toolbar widget complementary contentinfo""".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
# With these in front, or behind, a name tells of a state and marks nothing.
STATES = frozenset("has no not with without is hide show toggle".split())
COMMENT_STATES = frozenset("open closed enabled disabled on off allowed".split())
ATTRIBUTE = re.compile(
    r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""", re.I
)
TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(script|style|textarea|title|noscript|template|iframe|xmp)\b[^>]*+>
    .*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z]
    [^\s/<>]*+)([^<>]*+)>|<[!?/][^<>]*+>""",
    re.S | re.X | re.I,
)
# Common function words of four and more letters; shorter ones are known by their length.
STOP_WORDS = frozenset(
    """from have that their they this were which will with
    aber auch dass eine einen einer eines nicht noch oder sich sind wird
    avec cette dans elle leur mais nous pour sont vous
    como cuando entre esta este para pero porque sobre
    anche della delle nella sono come questo
    maar voor niet zijn worden""".split()
)
# Containers that hold an article are lifted; these kinds are not.
LIFTED, STRUCTURE, COMMENT = "lifted", "structure", "comment"


@dataclass
class Container:
    """An element that is not text by its name or class, with what it holds."""

    kind: str
    above: int  # the container around it, or -1
    blocks: tuple[int, int]
    articles: int
    mains: int


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    container: int
    in_article: bool
    in_main: bool


def parse(page: str) -> tuple[list[Block], list[Container], int, int]:
    """Text blocks, containers, and the counts of articles and main elements."""
    out: list[Block] = []
    containers: list[Container] = []
    parts: list[str] = []
    linked: list[bool] = []
    stack: list[tuple[str, str, int]] = []  # name, article or main, container
    open_names: dict[str, int] = {}
    holds = {"article": 0, "main": 0, "": 0}  # open
    seen = {"article": 0, "main": 0, "": 0}  # so far
    links, inside = 0, -1

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                chars = sum(len(p.strip()) for p, a in zip(parts, linked) if a)
                out.append(Block(text, chars, inside, holds["article"] > 0, holds["main"] > 0))
            parts.clear()
            linked.clear()

    def pop() -> None:
        nonlocal links, inside
        name, kind, container = stack.pop()
        open_names[name] -= 1
        holds[kind] -= 1
        links -= name == "a"
        if container >= 0:
            flush()  # also where the element is no block
            c = containers[container]
            c.blocks = c.blocks[0], len(out)
            c.articles, c.mains = seen["article"] - c.articles, seen["main"] - c.mains
            inside = c.above

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            parts.append(page[at : token.start()])
            linked.append(links > 0)
        at = token.end()
        name = (token[3] or token[6] or "").lower()
        if not name:
            continue
        closing = token[2] or token[5]
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
            linked.append(False)
        if closing:
            if open_names.get(name, 0) > 0:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID:
            continue
        if name in BLOCKS and open_names.get("p", 0) > 0 and stack[-1][0] == "p":
            pop()  # a block ends an open paragraph
        if name == "a" and links:
            continue
        attributes = token[4] or token[7] or ""
        if attributes.rstrip().endswith("/") and name not in BLOCKS:
            continue
        marked = mark(name, attributes, holds["article"] + holds["main"] > 0)
        kind = name if name in ("article", "main") and not marked else ""
        # What stands in a part that is never text is no article of the page.
        if kind and inside >= 0 and containers[inside].kind != LIFTED:
            kind = ""
        container = -1
        if marked:
            flush()
            container = len(containers)
            fixed = inside >= 0 and containers[inside].kind
            of = fixed if fixed and fixed != LIFTED else marked
            containers.append(Container(of, inside, (len(out), 0), seen["article"], seen["main"]))
            inside = container
        stack.append((name, kind, container))
        open_names[name] = open_names.get(name, 0) + 1
        holds[kind] += 1
        seen[kind] += 1
        links += name == "a"
    if at < len(page):
        parts.append(page[at:])
        linked.append(links > 0)
    flush()
    while stack:
        pop()
    return out, containers, seen["article"], seen["main"]


def mark(name: str, attributes: str, in_article: bool) -> str:
    """What kind of container an element is; empty if it is none."""
    if name in ("html", "body"):
        return ""
    if name in OUTSIDE or (name == "header" and not in_article):
        return STRUCTURE
    found = LIFTED if name == "form" else ""
    for attribute, *values in ATTRIBUTE.findall(attributes):
        value, attribute = "".join(values).lower(), attribute.lower()
        if attribute == "hidden" or (attribute == "aria-hidden" and value == "true"):
            return STRUCTURE
        if attribute == "aria-hidden":
            continue
        for token in value.split():
            words = re.split("[-_]+", token.strip("-_"))
            if words[0] in COMMENTS or (words[0] in ("li", "div") and words[1:2] == ["comment"]):
                if not COMMENT_STATES & {*words[1:]}:
                    return COMMENT
            elif name not in ("article", "main") and words[0] not in STATES and MARKS & {words[0], words[-1]}:
                found = LIFTED
    return found


def outside(blocks: list[Block], containers: list[Container], articles: int, mains: int) -> list[bool]:
    """Which blocks stand in what surrounds the text.

    A form, or an element with a class that marks surroundings, is lifted if it holds
    all articles of the page (all main elements, if there is no article). On a page with
    neither it is lifted if it holds more than half of all characters.
    """
    ends = [0, *accumulate(len(b.text) for b in blocks)]
    closed: list[bool] = []
    for c in containers:  # outer ones come first
        if c.kind != LIFTED:
            counts = True
        elif articles:
            counts = c.articles < articles
        elif mains:
            counts = c.mains < mains
        else:
            counts = 2 * (ends[c.blocks[1]] - ends[c.blocks[0]]) <= ends[-1]
        closed.append(counts or (c.above >= 0 and closed[c.above]))
    return [b.container >= 0 and closed[b.container] for b in blocks]


def stop_share(text: str) -> float:
    """Share of function words: known ones, and lower-case words of up to three letters.

    A text without blanks between its words has none that could be counted; it counts
    as full of them, so length and links decide.
    """
    names = [w.strip(".,;:!?\"'()*#$%&|") for w in text.split()]
    if sum(map(len, names)) > LONG_WORDS * len(names) and sum(c > "\u0e00" for c in text) > len(text) // 2:
        return 1.0
    return sum((len(w) < 4 and w.isalpha() and w.islower()) or w.lower() in STOP_WORDS for w in names) / len(names)


def first_pass(block: Block, in_article: bool, out: bool) -> bool | None:
    """True for a good block, False for a bad one, None where it is not clear."""
    size = len(block.text)
    if out or block.links > LINK_SHARE * size and not (in_article and size > LONG_BLOCK):
        return False
    if size >= LONG_BLOCK and stop_share(block.text) >= STOP_SHARE:
        return True
    return None


def second_pass(found: list[bool | None], in_article: list[bool]) -> list[bool]:
    """Give open blocks the label of the nearest decided block on either side.

    Inside an article only the article's own good blocks vote. With a tie, or with
    nothing decided, a block is good inside an article and bad elsewhere.
    """
    n = len(found)
    far = n + 1
    before, after = [(far, False)] * n, [(far, False)] * n
    for order, out in ((range(n), before), (range(n - 1, -1, -1), after)):
        seen: dict[bool, tuple[int, bool]] = {}
        for i in order:
            place, label = found[i], in_article[i]
            if label in seen:
                out[i] = (abs(i - seen[label][0]), seen[label][1])
            if place is True or (place is False and not label):
                seen[label] = (i, place)
    labels = []
    for i in range(n):
        if found[i] is not None:
            labels.append(found[i])
            continue
        (a, left), (b, right) = before[i], after[i]
        if min(a, b) == far or (a == b and left != right):
            labels.append(in_article[i])
        else:
            labels.append(left if a <= b else right)
    return labels


def labels(blocks: list[Block], containers: list[Container], articles: int, mains: int) -> list[bool]:
    """Which blocks are text, after both passes."""
    out = outside(blocks, containers, articles, mains)
    in_article = [b.in_article if articles else b.in_main for b in blocks]
    found = [first_pass(*x) for x in zip(blocks, in_article, out)]
    inside = any(good and a for good, a in zip(found, in_article))
    if not inside and any(found):  # no article, or only short ones beside a longer text
        in_article = [False] * len(blocks)
        found = [first_pass(*x) for x in zip(blocks, in_article, out)]
    elif any(in_article):
        found = [good if a else False for good, a in zip(found, in_article)]
    return second_pass(found, in_article)


def main_text(page: str | None) -> str:
    """The page's main text; empty for null, for an empty page or one without any."""
    blocks, *others = parse(page or "")
    return " ".join(b.text for b, good in zip(blocks, labels(blocks, *others)) if good)


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Main text of every page: ``id_col``, ``url_col``, text, n_chars (code points).

    The whole page is read; character references are decoded, white space inside a
    block becomes one space, and blocks are joined in page order by one space. Tags
    need not be closed. A null page, an empty one and one without any text that stands
    out have an empty text. Repeated rows are all kept; an empty table gives an empty result;
    other columns are not read. Each page is worked on alone, without a shuffle.
    """
    pages = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    kind = pages.schema["id"].dataType.simpleString()
    url_kind = pages.schema["url"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])

    out = pages.mapInArrow(run, f"id {kind}, url {url_kind}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
