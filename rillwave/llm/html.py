"""Main text of web pages by composite text density.

A page becomes a tree of elements. Each node has C characters, T tags, LC characters in links and LT links; with the body's
totals LCb and Cb its density is

    C/T * log base ln(C/nLC * LC + LCb/Cb * C + e) of (C/LC * T/LT)        (nLC: characters outside links, empty counts as 1)

and its density sum is the sum of its children's densities. The node with the greatest density sum is the content; the
least density on its path to the body is the threshold, and every other part of the body whose density reaches the threshold
adds its own node of the greatest density sum, in page order. Where the densest node stands in an <article> or <main>, the
rest of that element is content as well.

Two kinds of elements carry no characters and are never content. Elements that by their name are no article text: scripts,
menus, headers, footers, asides, forms and the like. And elements that a word of class, id or role calls an advert, a
notice, comments, a sidebar or the like (`NOISE_WORDS`; as a whole token or its leading piece), if their form agrees, as a word
alone takes nothing out: a container that holds no article or main, and at most `MOST_SHARE` of the body's characters where the page has none, or a
line of text (paragraph, heading, item, cell, span) half of whose characters are links.

The text of the content: character references decoded, white space in a block made one space, blocks trimmed and joined by
one newline in page order; <br> is white space. Other control characters, NUL too, stay.

Defined results: null, empty or textless html gives the empty text; unclosed, stray and misnested tags are repaired as browsers
do for p, li, table cells and the like; a cut-off tag at the end is no text; neither depth nor length is limited; of nodes
with equal density sums the first in page order is taken; repeated rows give equal results; an empty table gives no rows;
extra columns pass through, and those named like a result are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .shared import numbered

# Fixed lists of HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption optgroup option".split()
)
NOISE = frozenset("script style noscript template textarea title head iframe object embed svg canvas nav menu header footer aside form button select input dialog noembed noframes xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An opening tag ends an open element of these names, up to the given container.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
#: Words that mark what is not the article, as a whole token of class, id or role or as its leading piece.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar side-bar widget nav navbar navigation menu breadcrumb breadcrumbs header masthead footer cookie cookies consent notice popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment comments disqus reply replies complementary contentinfo search toolbar pagination pager skip copyright legal disclaimer gdpr alert".split()
)
#: Of these, words that sections of articles are named after: as a whole token only.
TOPICS = frozenset("legal social search alert notice".split())
#: Elements that are the article however their class is called.
HOLDERS = frozenset("html body article main".split())
#: Elements that hold a line of text rather than a part of the page.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption summary legend span a b i em strong u s small mark q cite code time label font sub sup abbr address".split())
MOST_SHARE = 0.75
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)(?:>|\Z)", re.S)
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "items", "noise", "doubt", "C", "T", "LC", "LT", "density", "total")

    def __init__(self, name: str, parent: Node | None, noise: bool, doubt: bool = False):
        self.name, self.parent, self.noise, self.doubt = name, parent, noise, doubt
        self.items: list[Node | str] = []
        self.C = self.T = self.LC = self.LT = 0
        self.density = self.total = 0.0


def _noise_token(token: str) -> bool:
    if token in NOISE_WORDS:
        return True
    piece = re.split("[_-]", token, maxsplit=1)[0]
    return piece in NOISE_WORDS and piece not in TOPICS


def _is_noise(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is noise by its kind, and whether its class, id or role says so."""
    if name in NOISE:
        return True, False
    if not attributes or name in HOLDERS:
        return False, False
    return False, any(_noise_token(t) for _, a, b, c in _MARK.findall(attributes) for t in (a or b or c).lower().split())


def parse(page: str) -> Node:
    """The tree of a page; text items hold raw character data."""
    root = Node("html", None, False)
    at, here = 0, root
    page_end = len(page)
    while at < page_end:
        m = _TAG.search(page, at)
        if not m:
            lone = page.find("<", at)
            tail = page[at:] if lone < 0 or not re.match(r"<[A-Za-z/!?]", page[lone:]) else page[at:lone]
            here.items.append(tail)
            break
        if m.start() > at:
            here.items.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # a closing tag ends what is open up to its element, if that is open within the next block
            up = here
            while up.parent and up.name != name:
                up = up.parent
            if up.parent or up.name == name and up is not root:
                here = up.parent or root
            continue
        if name == "html":
            continue
        if name in CLOSES_P:
            up = here
            while up.parent and up.name not in BLOCKS:
                up = up.parent
            if up.name == "p":
                here = up.parent or root
        if name in ENDS:
            ended, within = ENDS[name]
            up, last = here, None
            while up.parent and up.name not in within:
                if up.name in ended:
                    last = up
                up = up.parent
            if last is not None:
                here = last.parent or root
        node = Node(name, here, *_is_noise(name, m[3]))
        here.items.append(node)
        if name in VOID or m[4] and name not in BLOCKS and name not in RAW:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else page_end
            continue
        here = node
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes without noise, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.noise]
    return order


def _settle(root: Node) -> None:
    """Elements that class, id or role call noise are taken out where their form agrees."""
    order = _walk(root)
    if not any(n.doubt for n in order):
        return
    chars: dict[int, int] = {}
    linked: dict[int, int] = {}
    holds: set[int] = set()
    for node in reversed(order):
        own, parts = sum(_length(x) for x in node.items if isinstance(x, str)), [id(x) for x in node.items if isinstance(x, Node) and id(x) in chars]
        chars[id(node)] = own + sum(chars[k] for k in parts)
        linked[id(node)] = chars[id(node)] if node.name == "a" else sum(linked[k] for k in parts)
        if node.parent is not None and (node.name in ("article", "main") or id(node) in holds):
            holds.add(id(node.parent))
    body = next((n for n in order if n.name == "body"), root)
    room = chars[id(body)] * (1.0 if holds else MOST_SHARE)
    for node in order:
        if node.doubt and node.name in LINES:
            node.noise = linked[id(node)] * 2 >= chars[id(node)]
        elif node.doubt:
            node.noise = id(node) not in holds and chars[id(node)] <= room


def _length(text: str) -> int:
    return len(_SPACE.sub(" ", text).strip())


def densities(root: Node) -> list[Node]:
    """Counts, densities and density sums of all nodes outside noise."""
    _settle(root)
    order = _walk(root)
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                node.C += _length(x)
            elif not x.noise:
                node.C += x.C
                node.T += x.T + 1
                node.LC += x.LC
                node.LT += x.LT + (x.name == "a")
        if node.name in ("a", "button", "select"):
            node.LC = node.C
    body = next((x for x in order if x.name == "body"), root)
    ratio = body.LC / max(1, body.C)
    for node in order:
        C, T, LC, LT = max(1, node.C), max(1, node.T), max(1, node.LC), max(1, node.LT)
        base = math.log(C / max(1, node.C - node.LC) * LC + ratio * C + math.e)
        node.density = node.C / T * (math.log(max(1.0, C / LC * T / LT)) / max(1e-9, math.log(base) if base > 1 else 1e-9)) if node.C else 0.0
    for node in order:
        node.total = sum(x.density for x in node.items if isinstance(x, Node) and not x.noise)
    return order


def _blocks(node: Node) -> Iterator[str]:
    """The text of a subtree, block by block."""
    current: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(node, False)]

    def ended() -> str:
        text = _SPACE.sub(" ", entities.unescape("".join(current))).strip()
        current.clear()
        return text

    while stack:
        item, closing = stack.pop()
        if isinstance(item, str):
            current.append(item)
            continue
        if item.noise:
            current.append(" " if item.name in VOID else "")
            continue
        if item.name in ("br", "wbr", "img", "hr") and not closing:
            current.append(" " if item.name == "br" else "")
        if item.name in BLOCKS:
            text = ended()
            if text:
                yield text
        if not closing and item.items:
            stack.append((item, True))
            stack += [(x, False) for x in reversed(item.items)]
    text = ended()
    if text:
        yield text


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    order = densities(parse(page))
    full = [n for n in order if n.C]
    if not full:
        return ""
    best = max(full, key=lambda n: n.total)
    if not best.total:
        best = next((n for n in full if n.name == "body"), full[0])
    # the densest node says which article is meant; that article is content as a whole
    chosen, up = best, best
    while up is not None:
        if up.name in ("article", "main"):
            chosen = up
        up = up.parent
    threshold, up = best.density, best
    while up is not None and up.name != "body":
        threshold = min(threshold, up.density)
        up = up.parent
    if up is not None:
        threshold = min(threshold, up.density)
    # the densest node of each part that is as dense as the threshold asks belongs to the content, wherever it stands
    peak: dict[int, Node] = {}
    for node in reversed(order):
        parts = [peak[id(x)] for x in node.items if isinstance(x, Node) and not x.noise and x.C]
        peak[id(node)] = max([node, *parts], key=lambda n: n.total)
    marked = {id(chosen)} | {id(peak[id(n)]) for n in full if n.density >= threshold and n.LC * 2 < n.C and n.name not in ("body", "html")}
    above, up = set(), chosen.parent
    while up is not None:
        above.add(id(up))
        up = up.parent
    picked, inside = [], set()
    for node in order:
        if node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
        elif id(node) in marked and id(node) not in above:
            picked.append(node)
            inside.add(id(node))
    return "\n".join(b for n in picked for b in _blocks(n))


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Rows of `pages` (columns in `keep`, or all but the html) with text and n_chars (code points)."""
    columns = [c for c in pages.columns if c not in ("text", "n_chars", html_col) and (keep is None or c in keep)]
    schema = T.StructType([*(pages.schema[c] for c in columns), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*columns, "text", "n_chars"])

    return numbered(pages, [*columns, html_col]).mapInArrow(run, schema)
