"""Main text of web pages: blocks labelled together by a minimum cut."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names, and words of class, id and role that tell what a part is for.
SKIPPED = set("script style noscript template head title svg math iframe object select option textarea button canvas audio video map datalist".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody tfoot caption "
    "blockquote pre figure figcaption header footer nav aside form fieldset menu address details summary hr dialog hgroup search".split()
)
CONTENT_TAGS = {"article": 3.0, "main": 2.0}
BOILER_TAGS = {"nav": 6.0, "footer": 6.0, "aside": 6.0, "header": 6.0, "form": 6.0, "menu": 6.0, "dialog": 6.0, "search": 6.0, "fieldset": 6.0}
BOILER_WORDS = set(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice alert popup "
    "modal overlay nav navigation navbar menu menubar breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar "
    "comment comments reply replies disqus share sharing social related recommended subscribe newsletter signup login search "
    "pagination pager toc copyright legal complementary contentinfo form tags".split()
)
CONTENT_WORDS = set("article content main post entry story body text page-content maincontent".split())
#: first parts of compound names that say something of another element, and last parts that leave the first one's meaning
_STATES = set("has no not with without is hide show hidden".split())
_PARTS = set("bar box list container wrapper wrap inner outer block area section panel item items content link links group row col column body title".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?P<close>>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?P<close2>>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?…。]['\")\]]*(?:\s|$)")


class Block:
    """A run of text with no block boundary in it, and where it stands."""

    __slots__ = ("text", "link", "place", "bias")

    def __init__(self, text: str, link: int, place: "Place", bias: float):
        self.text, self.link, self.place, self.bias = text, link, place, bias


class Place:
    """An open element: its parent's place, its depth, and the sum of its ancestors' biases and its own."""

    __slots__ = ("tag", "parent", "depth", "bias")

    def __init__(self, tag: str, parent: "Place | None", bias: float):
        self.tag, self.parent, self.bias = tag, parent, bias
        self.depth = parent.depth + 1 if parent else 0


def _names_boilerplate(name: str) -> bool:
    """Whether a whole class, id or role says boilerplate: by its last word, or by its first before a word for a part.

    A name such as has-sidebar or menu-open tells of a state of the page, not of the element.
    """
    words = [w.lower() for w in _NAME.findall(name)]
    if not words or words[0] in _STATES:
        return False
    return words[-1] in BOILER_WORDS or (words[0] in BOILER_WORDS and words[-1] in _PARTS)


def _steps_between(a: Place, b: Place) -> int:
    """How far the deeper of two places lies below the nearest one that holds both."""
    most = max(a.depth, b.depth)
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return most - a.depth


def _bias(tag: str, rest: str, inside: float) -> float:
    """How far an element speaks for content (positive) or boilerplate, by name and attributes."""
    if tag in ("html", "body"):
        return 0.0  # their names are about the page
    bias = CONTENT_TAGS.get(tag, 0.0)
    if tag in BOILER_TAGS and not (tag == "header" and inside > 0):
        bias -= BOILER_TAGS[tag]
    if rest and "=" in rest or "hidden" in rest:
        for name, *values in _ATTRIBUTE.findall(rest):
            if name.lower() in ("hidden", "aria-hidden"):
                if name.lower() == "hidden" or "true" in values:
                    bias -= 6.0
                continue
            named = "".join(values).split()
            if any(_names_boilerplate(n) for n in named):
                bias -= 6.0
            elif any(w.lower() in CONTENT_WORDS for n in named for w in _NAME.findall(n)[-1:]):
                bias += 1.5
    return bias


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order, character references decoded and white space folded.

    Unclosed elements, stray end tags and pages that break off are read as far as they go.
    """
    found: list[Block] = []
    here = Place("", None, 0.0)
    open_: dict[str, int] = {}  # how many elements of a name are open
    links, skip, skip_depth = 0, "", 0
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, linked, here, here.bias))
        parts, linked = [], 0

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else size
        if stop > at and not skip:
            text = unescape(html[at:stop])
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        end = bool(m["end"] or m["end2"])
        rest = m["rest"] or m["rest2"] or ""
        if not (m["close"] or m["close2"]):
            break  # the page ends within a tag
        if tag in SKIPPED:
            if end:
                if skip == tag:
                    skip_depth -= 1
                    if not skip_depth:
                        skip = ""
            elif not rest.endswith("/"):
                if tag in RAW:
                    over = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                    at = over.end() if over else size
                elif not skip:
                    skip, skip_depth = tag, 1
                elif skip == tag:
                    skip_depth += 1
            continue
        if tag == "body" and skip == "head":
            skip, skip_depth = "", 0  # a head left open ends where the body begins
        if skip:
            continue
        if tag == "a":
            links = max(0, links + (-1 if end else 1))
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            close()
            links = 0
            if end:
                while open_.get(tag):
                    last, here = here.tag, here.parent
                    open_[last] -= 1
                    if last == tag:
                        break
            elif tag not in VOID:
                if here.tag == "p" or tag == here.tag in ("li", "dt", "dd", "tr", "td", "th"):
                    open_[here.tag] -= 1
                    here = here.parent
                here = Place(tag, here, here.bias + _bias(tag, rest, here.bias))
                open_[tag] = open_.get(tag, 0) + 1
    close()
    return found


def cost(block: Block) -> float:
    """Log odds that a block is content: its place first, then its words, sentences and links."""
    words = len(block.text.split())
    sentences = len(_SENTENCE.findall(block.text))
    score = block.bias - 0.5
    score += min(words, 40) / 20.0 + min(sentences, 4) * 0.25
    score -= 3.0 * block.link / max(1, len(block.text))
    return score


def _links(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours, more the closer they stand in the tree, and between
    successive blocks under one parent with others between them."""
    edges, seen = [], {}
    for i, block in enumerate(found):
        if i:
            edges.append((i - 1, i, 1.0 / (1 + _steps_between(found[i - 1].place, block.place))))
        parent = block.place.parent
        if parent in seen and seen[parent] < i - 1:
            edges.append((seen[parent], i, 0.25))
        seen[parent] = i
    return edges


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the costs of disagreeing with ``costs`` and of cut edges; ties are false.

    A node whose own cost outweighs all its edges keeps its label in every optimum and is
    folded into the terminals first; what remains is cut by augmenting paths.
    """
    n = len(costs)
    costs = list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(costs[i]) > sum(near[i].values()):
            label[i] = costs[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                costs[j] += w if label[i] else -w
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
        room[source], room[sink] = {}, {}
        for i in rest:
            room[source][i], room[i][sink] = max(costs[i], 0.0), max(-costs[i], 0.0)
            room[i].setdefault(source, 0.0)
            room[sink].setdefault(i, 0.0)
        while True:
            came, queue = {source: source}, deque([source])
            while queue and sink not in came:
                i = queue.popleft()
                for j, w in room[i].items():
                    if w > 1e-12 and j not in came:
                        came[j] = i
                        queue.append(j)
            if sink not in came:
                break
            path, j = [], sink
            while j != source:
                path.append((came[j], j))
                j = came[j]
            flow = min(room[i][j] for i, j in path)
            for i, j in path:
                room[i][j] -= flow
                room[j][i] = room[j].get(i, 0.0) + flow
        for i in rest:
            label[i] = i in came
    return [bool(x) for x in label]


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by one space; null and empty pages give the empty text."""
    if not html:
        return ""
    found = blocks(html)
    labels = minimum_cut([cost(b) for b in found], _links(found))
    if not any(labels):  # too short for its words to count: what no element speaks against
        labels = [b.bias >= 0 and b.link < len(b.text) and bool(_NAME.search(b.text)) for b in found]
    return " ".join(b.text for b, content in zip(found, labels) if content)


def extract_pages(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: ``row`` (struct of the carried columns) and ``text``.

    Every row is a page of its own: repeated rows, null keys and null urls give what their
    html says. Null and empty pages give the empty text; columns not carried are ignored, whatever they are named, and an
    empty table gives no rows. A very long page is read whole, in time in proportion to its length but for the cut.
    Nothing is shuffled.
    """
    picked = pages.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(html).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("_html")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return picked.mapInArrow(run, f"row {picked.schema['row'].dataType.simpleString()}, text string")
