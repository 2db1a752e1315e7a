"""Main text of web pages by composite text density.

All tags of a page are put into a tree; inline tags are transparent. For every block the characters per tag are computed and
adjusted by its links (a block full of link text scores low). The densities of a block's children are summed up, and the
block of the largest sum holds the main text; it grows to its parent while that is at least half as dense. The smallest density
on the path from the body to it is the threshold: blocks beside the path that reach it belong to the main text too (articles and
sections need half of it, the first-level heading none). Tags decide between equal sums only: article and main go first, then the deeper one.

What the contract leaves out (menus, headers, footers, sidebars, notices, adverts, forms, comments) is marked by tag, role, class or
id, and marked blocks are pruned before the densities are taken. A mark that is no whole word, or does not come first in a
compound one, or may well name a part of the article there (`related-work`), is weak: the measure overrules it where the block holds at least OVERRULED times as much text outside links as the
page's unmarked blocks together. So do marks of forms, as some pages are one form. Marks on html, body and main count for nothing.

Defined cases: null and empty html give an empty text; html without tags is one block; a page without any density keeps all that is
not marked. Character references are decoded after the tags are split off. Very long pages are parsed whole, one at a time. Repeated rows each
keep a row. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import filled, ship, text_steps, tidied

SCHEMA = "page_id long, url string, text string, n_chars long"

_OPEN = re.compile(r"<!--|<[!?]|</?[a-zA-Z]")
#: A whole tag; quotes count where a value begins, at any length, and one that stays open does not.
_TAG = re.compile(r"<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
#: One whole attribute: its name, and its value in double, single or no quotes; a quote that stays open holds the rest.
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
#: Elements whose text is never read as text.
SILENT = RAW | frozenset("button select option canvas audio video map datalist object".split())
#: Elements beside the article.
BESIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img label br".split())
#: Words in a class, id or role that mark elements beside the article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notification popup modal overlay "
    "newsletter subscribe subscription paywall sidebar widget menu nav navbar navigation navigations breadcrumb breadcrumbs masthead footer comment comments commentlist disqus reply replies "
    "respond share sharing social related recommended recommendations pagination pager toolbar login signin signup search contentinfo complementary alert form skip".split()
)
#: Of these, words that begin the name of an article's own parts too: first in a compound word, they are weak.
AMBIGUOUS = frozenset("ad alert banner form login menu notice overlay promo related reply search share sharing signup skip social subscription".split())
_NOT = frozenset("no not has with without is".split())  # these turn what follows in a compound word
_OWN = frozenset("article entry post content story category tag".split())  # an article's own parts
FREE, WEAK, STRICT = 0, 1, 2
OVERRULED = 2  # times the text of unmarked blocks
_ROWS = {"tr", "td", "th", "caption", "colgroup"}
CLOSES = {  # a start tag ends the outermost of these open elements within the border in the second place
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (_ROWS | {"thead", "tbody", "tfoot"}, {"table"})),
    "tr": (_ROWS, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)


_KEEPS_P = frozenset(("table", "td", "button", "object"))  # a start tag within one of these ends no p outside of it
_IN_HEAD = frozenset("base link meta title noscript script style template head".split())  # others end an open head


class Node:
    __slots__ = ("tag", "parent", "depth", "children", "mark", "block", "p", "in_article", "chars", "tags", "link_chars", "link_tags", "own", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", place: int = 0, mark: int = FREE):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.depth = parent.depth + 1 if parent else 0
        # place on the stack of the open p that a block ends, 0 for none
        self.p = place if tag == "p" else 0 if parent is None or tag in _KEEPS_P else parent.p
        self.in_article = tag == "article" or (parent is not None and parent.in_article)
        self.block = tag not in INLINE
        self.children: list = []  # nodes and texts in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.own = (0, 0, 0)  # characters, link characters and links of the text that is in no block below
        self.density = self.total = 0.0


def _word_mark(word: str, tag: str, in_article: bool) -> int:
    """How a word of a class, an id or a role marks an element."""
    parts = [x for x in _SPLIT.split(word) if x]
    if not parts or tag == "article" and len(parts) > 1:
        return FREE
    if parts[0] in BESIDE:
        return WEAK if len(parts) > 1 and parts[0] in AMBIGUOUS else STRICT
    if "header" in parts and not in_article and tag not in ("h1", "h2", "article") and parts[0] not in _OWN:
        return STRICT if len(parts) == 1 else WEAK
    return WEAK if any(x in BESIDE and y not in _NOT for y, x in zip(parts, parts[1:])) else FREE


def mark_of(tag: str, attributes: str, in_article: bool) -> int:
    """How strongly an element's tag or attributes say that it does not belong to the article."""
    if tag in ("html", "body", "main"):
        return FREE
    if tag == "form":
        return WEAK
    if tag in BESIDE_TAGS or (tag == "header" and not in_article):
        return STRICT
    mark = FREE
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return STRICT
        if name in ("class", "id", "role"):
            mark = max([mark, *(_word_mark(w, tag, in_article) for w in value.split())])
    return mark


def is_beside(tag: str, attributes: str, in_article: bool) -> bool:
    return mark_of(tag, attributes, in_article) > FREE


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order, without silent elements."""
    root = Node("#root", None)
    nodes, stack = [root], [root]
    places: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements on the stack
    marked: Counter[str] = Counter()  # open elements with a mark
    blocks = [0]  # blocks on the stack up to each element

    def close(depth: int) -> None:
        for x in reversed(stack[depth:]):
            places[x.tag].pop()
            marked[x.tag] -= x.mark > FREE
        del stack[depth:], blocks[depth:]

    at, end = 0, len(page)
    while at < end:
        m = _OPEN.search(page, at)
        m = m and _TAG.match(page, m.start())  # a tag that does not end is text, with all that follows
        text = page[at : m.start() if m else end]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                close(len(stack) - 1)
            stack[-1].children.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m.group() == "<!--":
            over = page.find("-->", at)
            at = over + 3 if over >= 0 else end
            continue
        if m.group(2) is None:
            continue
        tag, attributes = m.group(2).lower(), m.group(3)
        if m.group(1):  # an end tag; that of an inline element ends no block, but for marked elements that hold blocks
            if places[tag]:
                depth = places[tag][-1]
                if tag not in INLINE or blocks[-1] == blocks[depth] or marked[tag]:
                    close(depth)
            continue
        closed = attributes.rstrip().endswith("/") and tag not in RAW
        if stack[-1].tag == "head" and tag not in _IN_HEAD:
            close(len(stack) - 1)
        if tag in RAW and not closed:
            over = re.compile("</" + re.escape(tag), re.I).search(page, at)
            at = (page.find(">", over.start()) + 1 or end) if over else end
            continue
        if tag in _ENDS_P and stack[-1].p:
            close(stack[-1].p)
        elif tag in CLOSES:
            ends, border = CLOSES[tag]
            least = max((places[x][-1] for x in border if places[x]), default=0)
            ended = [places[x][i] for x in ends if (i := bisect_right(places[x], least)) < len(places[x])]
            if ended:
                close(min(ended))
        above = stack[-1]
        node = Node(tag, above, len(stack), STRICT if tag in SILENT else mark_of(tag, attributes, above.in_article) if tag not in VOID else FREE)
        above.children.append(node)
        nodes.append(node)
        if tag not in VOID and not closed:
            places[tag].append(len(stack))
            marked[tag] += node.mark > FREE
            blocks.append(blocks[-1] + node.block)
            stack.append(node)
    return root, nodes


def prune(nodes: list[Node]) -> list[Node]:
    """The nodes outside of marked ones (but for those whose marks are overruled), without the marked ones among their children."""
    free: dict[int, int] = {}  # characters outside links, of all nodes
    for node in reversed(nodes):
        own = 0 if node.tag == "a" or node.tag in SILENT else sum(_solid(x) if isinstance(x, str) else free[id(x)] for x in node.children)
        free[id(node)] = own
    marked, unmarked = [], 0

    def walk(start: Node) -> int:
        """Free characters below a node outside of marked nodes, which are noted."""
        found, todo = 0, [start]
        while todo:
            x = todo.pop()
            for child in x.children if x.tag != "a" else ():
                if isinstance(child, str):
                    found += _solid(child)
                elif child.mark:
                    marked.append(child)
                else:
                    todo.append(child)
        return found

    unmarked = walk(nodes[0])
    while True:
        weak = [x for x in marked if x.mark == WEAK and free[id(x)]]
        most = max(weak, key=lambda x: free[id(x)], default=None)
        if most is None or free[id(most)] < OVERRULED * unmarked:
            break
        marked.remove(most)
        most.mark = FREE
        unmarked += walk(most)
    kept, out = set(), []
    for node in nodes:
        if node.parent is None or (id(node.parent) in kept and not node.mark):
            kept.add(id(node))
            out.append(node)
    for node in out:
        node.children = [x if isinstance(x, str) or id(x) in kept else "\n" for x in node.children]
    return out


def _solid(text: str) -> int:
    """Characters without white space."""
    return len(text) - sum(map(text.count, " \n\t\r"))


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, times a logarithm that falls with the links; share: of link characters in the whole page."""
    if not chars:
        return 0.0
    t, lc, lt, free = max(1, tags), max(1, link_chars), max(1, link_tags), max(1, chars - link_chars)
    base = math.log(chars / free * lc + share * chars + math.e)
    return chars / t * max(0.0, math.log(chars / lc * (t / lt)) / math.log(base))


def measure(nodes: list[Node]) -> None:
    """Composite density of each block and the sum of its children's (text beside blocks is a child of its own)."""
    for node in reversed(nodes):
        chars = link_chars = links = 0
        for child in node.children:
            if isinstance(child, str):
                chars += _solid(child)
                continue
            node.chars += child.chars
            node.link_chars += child.link_chars
            node.link_tags += child.link_tags
            node.tags += child.tags
            if child.block:
                node.tags += 1
                node.block = True
            else:
                chars, link_chars, links = chars + child.own[0], link_chars + child.own[1], links + child.own[2]
        node.chars += sum(_solid(x) for x in node.children if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.link_tags, node.tags = node.chars, node.link_tags + 1, node.tags + 1
            link_chars, links = chars, links + 1
        node.own = (chars, link_chars, links)
    whole = nodes[0]
    share = whole.link_chars / max(1, whole.chars)
    for node in nodes:
        if node.block:
            node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in nodes:
        below = [x.density for x in node.children if not isinstance(x, str) and x.block]
        if below:
            chars, link_chars, links = node.own
            node.total = sum(below) + density(chars, links, link_chars, links, share)


def chosen(nodes: list[Node]) -> tuple[Node, dict[int, float]]:
    """The topmost node of the main text's path, and the nodes on the path or kept whole: id -> threshold (0 to keep all below)."""
    root = nodes[0]
    best = max((x for x in nodes if x.block), key=lambda x: (round(x.total, 9), x.tag in ("article", "main"), x.depth))
    outer = ("body", "html", "#root")
    if best.total <= 0:
        return root, {id(root): 0.0}
    while best.tag not in outer and best.parent.tag not in outer and best.parent.density * 2 >= best.density:
        best = best.parent
    path = [best]
    while path[-1].tag != "body" and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min((x.density for x in path if x.tag not in ("html", "#root") or x is best), default=0.0)
    kept = {id(x): threshold for x in path[1:]} | {id(best): 0.0}
    for node in path[1:]:
        for child in node.children:
            if not isinstance(child, str) and child.block and id(child) not in kept:
                least = 0.0 if child.tag == "h1" else threshold / 2 if child.tag in ("article", "section") else threshold
                if child.density >= least and (child.density > 0 or child.tag == "h1"):
                    kept[id(child)] = 0.0
    return path[-1], kept


def pieces(top: Node, kept: dict[int, float]) -> list[str]:
    """Text of what is kept in page order, with a space at each border of a block."""
    out: list[str] = []
    todo: list = [(top, False)]
    while todo:
        item, inside = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        whole = inside or kept.get(id(item)) == 0.0
        if item.tag == "br" or item.tag not in INLINE:
            out.append(" ")
            todo.append((" ", True))
        # text beside the path counts if it is as dense as the threshold asks
        texts = whole or (id(item) in kept and item.own[0] and density(item.own[0], item.own[2], item.own[1], item.own[2], 0.0) >= kept[id(item)])
        for child in reversed(item.children):
            if isinstance(child, str):
                if texts:
                    todo.append((child, True))
            elif whole or id(child) in kept:
                todo.append((child, whole))
            elif texts and not child.block:
                todo.append((child, True))
    return out


def main_text(page: str) -> str:
    """The main text of one page."""
    if not page:
        return ""
    nodes = prune(parse(page)[1])
    measure(nodes)
    return " ".join("".join(pieces(*chosen(nodes))).split())


def page_texts(pages: DataFrame) -> DataFrame:
    """The main text of every page: SCHEMA."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_steps(filled(batch.column(2))):
                found = [main_text(t) for t in texts]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(tidied(run), SCHEMA)
