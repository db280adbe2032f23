"""Main text of web pages by composite text density.

A page becomes a small tree. Every node has a density: characters per tag, lowered where much of
the text stands in links. The density sum of a node is the sum of its children's densities, and
the node with the largest sum holds the article. What stands beside it or beside its ancestors is
article only where it reads like it: headings before it, paragraphs and parts of like density. The
least density on its path from the body is the threshold below which lists of bare links inside the
article are left out. Elements that say themselves that they are no article text
(navigation, forms, notices, comments) are taken out before the densities are computed; a form that
holds most of the page is its container and loses its controls only.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .rows import pick

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Names of elements by what html says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "head title script style noscript template nav footer aside form button input select textarea option iframe object embed svg canvas math audio video dialog menu map".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split()
)
# An element of the first kind ends open ones of the second, up to the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
# A name counts if it is made of these words, with words of layout at most: "related-posts" does, "related-work" does not.
NAMED = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|nav\w*|menu|"
    r"breadcrumbs?|side-?bar|foot(?:er)?|masthead|comments?|respond|disqus|share|sharing|social|related|recommend\w*|widget|pagination|pager|skip|notice|alert)",
    re.I,
)
LAYOUT = frozenset(
    "area bar body block bottom box button buttons col column container content count entry form global group head heading holder icon icons inner item items js left link "
    "links list lists main outer page panel post posts primary right row secondary section site slot space story stories article articles sub the this title to toggle top unit us wrap wrapper".split()
)
SIDE = re.compile(r"side-bar", re.I)
BLANK = re.compile(r"\s+")
NAME_ONLY = 2  # dropped, unless the article stands inside
FORM = 3  # dropped, unless it wraps the page
LISTS = frozenset("ul ol dl menu div section table".split())
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)\W*(?:\w+\W+){0,3}(?:19|20)\d\d|all rights reserved", re.I)
RIGHTS_CHARS = 300  # a line of rights is no longer
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NAME_TURNS = 4  # so often one more level of named elements is opened
PARAGRAPHS = frozenset("p blockquote pre ul ol dl figure".split())


class Node:
    __slots__ = (
        "tag", "parent", "children", "drop", "name", "bare", "chars", "tags", "link_chars", "link_tags", "density", "total", "block", "parts", "body",
    )

    def __init__(self, tag: str, parent: "Node | None", drop: bool = False, name: str = ""):
        self.tag, self.parent, self.drop, self.name = tag, parent, drop, name
        self.children: list[Node | str] = []


class Tree(HTMLParser):
    """Builds the tree; an element that is never closed ends with its parent."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None)
        self.feed(html)
        # What the parser still holds back is an unfinished tag at the end of the page, no text,
        # unless it is plain text.
        rest = self.rawdata
        self.close() if not rest.startswith("<") else None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P:
            self._close({"p"}, {"button", "table", "td", "th", "article", "section", "div", "li", "blockquote"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        named = {k: v or "" for k, v in attrs}
        node = Node(tag, self.at, self._dropped(tag, named), named.get("class", ""))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent and node.tag != tag:
            if node.tag in ("table", "article", "section", "div", "td") and tag in INLINE | {"p"}:
                return
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def unknown_decl(self, data: str) -> None:
        pass

    def _close(self, tags: set, stop: set) -> None:
        """End the innermost open element of ``tags``, unless one of ``stop`` is further in."""
        node = self.at
        while node.parent and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                return self._close(tags, stop)
            node = node.parent

    @staticmethod
    def _dropped(tag: str, named: dict) -> bool | int:
        if tag == "form" and "hidden" not in named and named.get("aria-hidden") != "true":
            return FORM
        if tag in DROPPED or "hidden" in named or named.get("aria-hidden") == "true" or named.get("role", "").lower() in ROLES:
            return True
        if tag in ("article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "em", "strong", "pre", "code"):
            return False
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", ""), re.I):
            return True
        return NAME_ONLY if _named(named.get("class", "")) or _named(named.get("id", "")) else False


@lru_cache(65_536)
def _named(names: str) -> bool:
    """Whether one of the names says that an element is no article text."""
    for name in SIDE.sub("sidebar", names).split():
        words = [w for w in re.split(r"[_-]+", name) if w and not w.isdigit()]
        listed = [w for w in words if NAMED.fullmatch(w)]
        if listed and all(w in listed or w.lower() in LAYOUT for w in words):
            return True
    return False


def _walk(root: Node) -> list[Node]:
    """Kept nodes, parents first. A header is dropped unless it stands inside an article."""
    out, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        out.append(node)
        inside = inside or node.tag in ("article", "main")
        for child in node.children:
            if isinstance(child, Node):
                if child.tag == "header" and not inside:
                    child.drop = True
                if not child.drop:
                    todo.append((child, inside))
    return out


def _settle_forms(root: Node) -> None:
    """Keep a form that holds most of the text of the page, or an element that says it is the article."""
    every, forms, todo = [], [], [(root, ())]
    while todo:
        node, within = todo.pop()
        every.append(node)
        if node.tag in ("article", "main"):
            for form in within:
                form.drop = False
        if node.drop == FORM:
            forms.append(node)
            within = (*within, node)
        todo += [(c, within) for c in node.children if isinstance(c, Node) and c.drop in (False, NAME_ONLY, FORM)]
    forms = [f for f in forms if f.drop]
    if not forms:
        return
    size: dict[int, int] = {}
    for node in reversed(every):
        size[id(node)] = _bare(node.children) + sum(size.get(id(c), 0) for c in node.children if isinstance(c, Node))
    for form in forms:
        if 2 * size[id(form)] > size[id(root)]:
            form.drop = False


def _settle_rights(root: Node) -> None:
    """Drop short blocks that say who holds the rights and stand apart: beside the article, not in it.

    In an element that says it is the article they stay, as they do where their container holds other
    text, or where the page says nothing else.
    """
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        inner = [c for c in node.children if isinstance(c, Node) and not c.drop and c.tag not in ("article", "main")]
        todo += inner
        if node is root or node.tag in INLINE or any(c.tag not in INLINE and c.tag not in VOID for c in inner):
            continue
        text = _all_text(node)
        if len(text) <= 2 * RIGHTS_CHARS and len(text := BLANK.sub(" ", text).strip()) <= RIGHTS_CHARS and RIGHTS.search(text):
            found.append(node)
    if not found:
        return
    said = {id(n) for n in found}
    for node in found:
        node.drop = True
    for node in found:
        at = node
        while at.parent and at.parent is not root and not _all_text(at.parent).strip():
            at = at.parent
        # Apart: all of a container, beside containers of other text.
        beside = [c for c in at.parent.children if isinstance(c, Node) and id(c) not in said and c.tag not in INLINE and _all_text(c).strip()] if at.parent else []
        if at.parent is not root and at is node or not beside or at is node and all(c.tag in PARAGRAPHS | HEADINGS for c in beside):
            node.drop = False


def _all_text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif not item.drop:
            todo += reversed(item.children)
    return "".join(out)


def _settle_names(root: Node) -> None:
    """Keep elements dropped for their name alone if the article stands inside them.

    It does if an element inside says so, or if what is left without the named elements is slight
    (under a quarter of the density sum) beside what one of them holds, as in a page "sidebar".
    """
    every, todo = [], [root]
    while todo:
        node = todo.pop()
        every.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and c.drop in (False, NAME_ONLY)]
    named = [n for n in every if n.drop == NAME_ONLY]
    if not named:
        return
    said = {id(n) for n in every if n.tag in ("article", "main")}
    for node in reversed(every):
        if id(node) in said and node.parent:
            said.add(id(node.parent))
    for node in named:
        if id(node) in said:
            node.drop = False
    # Beside an <article> a named element is never the article, inside of one it may be.
    articles = {id(n) for n in every if n.tag == "article"}
    if articles:
        for node in every:
            if node.parent and id(node.parent) in articles:
                articles.add(id(node))
        named = [n for n in named if id(n) in articles]
    for turn in range(NAME_TURNS):
        named = [n for n in named if n.drop]
        if not named:
            return
        left = max(n.total for n in measure(root) if n.block)
        for node in named:
            node.drop = False
        top = max((n for n in measure(root) if n.block), key=lambda n: n.total)
        for node in named:
            node.drop = NAME_ONLY
        above, node = [], top
        while node:
            if node.drop:
                above.append(node)
            node = node.parent
        if not above or left >= top.total / 4:
            return
        # The outermost first: comments inside a page so named are still no article.
        for node in above if turn == NAME_TURNS - 1 else above[-1:]:
            node.drop = False


def _composite(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Composite density of text with so many characters and tags, and of them in links."""
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    inner = c / max(lc, 1) * max(t, 1) / max(lt, 1)
    return c / max(t, 1) * math.log(max(inner, 1.0)) / math.log(max(base, math.e))


def _bare(children: list) -> int:
    return sum(len(BLANK.sub(" ", c).strip()) for c in children if isinstance(c, str))


def _own(node: Node, share: float) -> float:
    """Density of the text that stands in a node itself or in inline elements."""
    inline = [c for c in node.children if isinstance(c, Node) and not c.drop and not c.block]
    c = node.bare + sum(x.chars for x in inline)
    t = sum(1 + x.tags for x in inline)
    if node.tag == "a":
        return _composite(c, t, c, 1 + t, share)
    return _composite(c, t, sum(x.link_chars for x in inline), sum(x.link_tags for x in inline), share)


def measure(root: Node) -> list[Node]:
    """Fill in the counts, composite densities and density sums of all kept nodes.

    The text of a node outside its blocks counts as one block, so the sum of a node without blocks
    is its density. ``parts`` and ``body`` are the blocks with text besides headings, and their sum.
    """
    nodes = _walk(root)
    for node in reversed(nodes):
        kept = [c for c in node.children if isinstance(c, Node) and not c.drop]
        node.bare = _bare(node.children)
        node.chars = node.bare + sum(c.chars for c in kept)
        node.tags = sum(1 + c.tags for c in kept)
        node.block = node.tag not in INLINE or any(c.block for c in kept)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, 1 + sum(c.tags for c in kept)
        else:
            node.link_chars, node.link_tags = sum(c.link_chars for c in kept), sum(c.link_tags for c in kept)
    share = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        node.density = _composite(node.chars, node.tags, node.link_chars, node.link_tags, share)
        own = _own(node, share)
        inner = [x for x in node.children if isinstance(x, Node) and not x.drop and x.block and x.chars]
        node.total = own + sum(x.density for x in inner)
        rest = [x.density for x in inner if x.tag not in HEADINGS] + ([own] if own else [])
        node.parts, node.body = len(rest), sum(rest)
    return nodes


def _inner(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and not c.drop and c.block and c.chars]


def _joins(item: Node, beside: Node, best: Node, before: bool) -> bool:
    """Whether a block beside the article, or beside an ancestor of it, belongs to the article."""
    if before and (item.tag in HEADINGS or (_inner(item) and all(c.tag in HEADINGS for c in _inner(item)) and not item.parts)):
        return True
    if item.link_chars > 0.5 * item.chars or not item.parts and item.tag not in HEADINGS:
        return False
    alike = item.parts and item.body / item.parts >= best.body / max(best.parts, 1) / 2
    if item.tag in PARAGRAPHS:
        return bool(alike)
    if not _inner(item):
        return False
    twin = item.tag == beside.tag and item.name == beside.name
    return bool(alike and (twin or item.parts > 1 and item.body >= best.body / 4))


def article(root: Node) -> tuple[list[Node], float]:
    """The subtrees that hold the article, in page order, and the threshold of the path."""
    _settle_forms(root)
    _settle_rights(root)
    _settle_names(root)
    nodes = measure(root)
    share = root.link_chars / max(root.chars, 1)
    best = max((n for n in nodes if n.block), key=lambda n: n.total)
    if best.total == 0:
        best = root
    path = [best]
    while path[-1].parent:
        path.append(path[-1].parent)
    # An element that says it is the article is whole.
    said = [n for n in path if n.tag == "article"]
    best = said[-1] if said else best
    # A part that outweighs all beside it is the article; what joins it comes back below.
    while best.tag != "article" and (inner := [c for c in _inner(best) if _inner(c)]):
        first = max(inner, key=lambda c: c.total)
        beside = sum(c.total for c in _inner(best) if c is not first) + _own(best, share)
        if first.total <= beside:
            break
        best = first
    path = [best]
    while path[-1].parent:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    before: list[Node] = []
    after: list[Node] = []
    for child, node in zip(path, path[1:]):
        sides: list[list[Node]] = [[], []]
        side, run = 0, []
        for c in [*node.children, None]:
            if isinstance(c, str) or (c is not None and c is not child and not c.drop and not c.block):
                run.append(c)
                continue
            if run:
                # Text between blocks counts as a paragraph.
                loose = Node("p", None)
                loose.children, loose.bare = run, _bare(run)
                loose.chars = loose.bare + sum(x.chars for x in run if isinstance(x, Node))
                loose.link_chars = sum(x.link_chars for x in run if isinstance(x, Node))
                loose.density = _own(loose, share)
                loose.parts, loose.body = bool(loose.density), loose.density
                run = []
                if loose.chars and _joins(loose, child, best, side == 0):
                    sides[side].append(loose)
            if c is child:
                side = 1
            elif c is not None and not c.drop and c.chars and _joins(c, child, best, side == 0):
                sides[side].append(c)
        before, after = sides[0] + before, after + sides[1]
    return [*before, best, *after], threshold


def _bare_links(item: Node) -> bool:
    """Several links and nothing beside them."""
    return item.tag in LISTS and item.link_tags > 1 and item.link_chars >= 0.9 * item.chars


def blocks(node: Node, threshold: float) -> list[str]:
    """Texts of the blocks of a subtree in page order, without its lists of bare links."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = BLANK.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    todo: list = [(node, False)]
    while todo:
        item, closing = todo.pop()
        if isinstance(item, str):
            line.append(item)
        elif closing:
            flush()
        elif item.tag == "br":
            line.append(" ")
        elif not item.drop and not (item.chars and item is not node and item.density < threshold and _bare_links(item)):
            if item.tag not in INLINE:
                flush()
                todo.append((item, True))
            todo += [(c, False) for c in reversed(item.children)]
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article of one page, blocks joined by an empty line; empty if there is none."""
    if not html:
        return ""
    found, threshold = article(Tree(html).root)
    return "\n\n".join(text for node in found for text in blocks(node, threshold))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points of the text).

    NULL or empty html gives an empty text; a NULL id or url stays; repeated rows give repeated
    results; an empty table none; other columns are ignored. No shuffle; one batch in memory and
    the tree of one page at a time, built and walked without recursion.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
