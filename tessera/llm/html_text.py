"""Main text of web pages by composite text density.

The page is read into a tree with the implied end tags of HTML. Every node has its
characters, its tags, and of both those inside links. Its composite density is
the characters per tag, scaled down by the share of link characters and link tags:

    C/T * log_b(C/lc' * T/lt'),   b = ln(lc/C' * C + lc' + e)

(C, T: characters and tags; lc, lt those inside links; C' those outside; counts of zero
count as one; on a page without links, where the base is 1, the density is C/T). The density
sum of a node adds its children's densities, or is its own where it has text of its own and
that is more. The node of the largest sum is found; the smallest density on its path up to
``body`` is the threshold, and the subtree grows up that path over every ancestor that has
another child as dense as the threshold, or a heading beside it. An ``article`` or ``main`` on
the path is taken whole, and only a further one makes it grow. List-like children of the grown
ancestors that are mostly links, at less than the threshold, are menus and go.

Densities are computed on the page as it is shown, menus and footers included; only scripts,
styles and hidden elements leave the tree before. Elements whose tag or class says menu,
header, footer, sidebar, notice, advert or comment leave it before the main text is looked for.
A form, or an element that only a class or id word names so, stays if it holds the main text:
it holds the node of the largest density sum and more characters outside links than all that remains
beside it, and no ``article`` or ``main`` shows its text there. Comments, adverts, sidebars, widgets and cookie notices
never stay, however long they are.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_batches

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol
    optgroup option p plaintext pre search section summary table tbody td tfoot th thead title tr ul xmp""".split())
CLOSES_P = BLOCK - frozenset("body br caption head html legend optgroup option tbody td tfoot th thead title tr".split())
# an element of the first kind is ended by a start tag of the second kinds, up to the third
ENDED_BY = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
    "option": ("option optgroup", "select"), "optgroup": ("optgroup", "select"),
    "tr": ("tr tbody tfoot thead", "table"), "td": ("td th tr tbody tfoot thead", "table"),
    "th": ("td th tr tbody tfoot thead", "table"), "thead": ("tbody tfoot", "table"),
    "tbody": ("tbody tfoot", "table"), "tfoot": ("tbody", "table"), "head": ("body", "html"),
}
ENDS: dict[str, list[tuple[str, frozenset]]] = {}
for _open, (_by, _scope) in ENDED_BY.items():
    for _tag in _by.split():
        ENDS.setdefault(_tag, []).append((_open, frozenset(_scope.split())))
# not shown as text; boilerplate by tag
UNSEEN = frozenset("""head script style noscript template iframe object embed svg math canvas audio video map button
    input select textarea title""".split())
DROP = frozenset("nav menu header footer aside dialog".split())
# what happens to an element: kept, left out unless it holds the main text, left out, left out of the counts too
KEPT, NAMED, BOILERPLATE, GONE = range(4)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# a class with such a word says what an element has or lacks, not what it is
WITH = frozenset("no non not has have with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
WORDS = re.compile(r"[a-z]+")
BOILER = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted
    promotion popup modal overlay cookie cookies consent gdpr notice notices notification alert disclaimer
    nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination masthead topbar toolbar sidebar
    sidebars widget widgets footer footnav copyright share sharing social newsletter subscribe subscription signup
    login related recommended recommendations comment comments commentlist disqus replies respond""".split())
# of these, words that name what is never the article, however long it is
STRICT = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted
    promotion cookie cookies consent gdpr sidebar sidebars widget widgets comment comments commentlist disqus replies
    respond""".split())
SPACE = re.compile(r"\s+")
# a quote opens a value only right after its equals sign; anywhere else it is a character
TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
                   re.S)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
MARKS = re.compile(r"(?:^|\s)(?:class|id|role|hidden|aria-hidden|style)\b", re.I)


class Node:
    __slots__ = ("tag", "children", "parent", "drop", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, tag: str, parent, drop: int):
        self.tag, self.parent, self.drop, self.children = tag, parent, drop, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def _boiler(tag: str, attrs: str) -> int:
    if tag in UNSEEN:
        return GONE
    drop = BOILERPLATE if tag in DROP else NAMED if tag == "form" else KEPT
    if not MARKS.search(attrs):
        return drop
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
        if tag not in ("html", "body", "article", "main"):
            if name in ("class", "id"):
                for w in map(WORDS.findall, value.split()):
                    if WITH.isdisjoint(w) and not BOILER.isdisjoint(w):
                        drop = max(drop, NAMED if STRICT.isdisjoint(w) else BOILERPLATE)
            if name == "role" and value.strip() in ROLES:
                drop = max(drop, NAMED if value.strip() in ("form", "search") else BOILERPLATE)
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                drop = GONE
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                drop = GONE
    return drop


# what a start tag looks for among the open elements: the innermost of a kind or of its scope
NEAREST = {"p": frozenset("p td th caption button object table".split())} | {
    name: frozenset([name, *scope.split()]) for name, (_, scope) in ENDED_BY.items()}
KINDS = {tag: [k for k, found in NEAREST.items() if tag in found] for found in NEAREST.values() for tag in found}


class Open:
    """The open elements. The innermost of a name, and of what :data:`NEAREST` looks for, is known without
    a walk, so nesting costs nothing."""

    def __init__(self, body: Node):
        self.stack = [body]
        self.named: dict[str, list[int]] = {}
        self.near: dict[str, list[int]] = {k: [] for k in NEAREST}
        self.blocks: list[int] = []

    def _lists(self, tag: str) -> list[list[int]]:
        out = [self.named.setdefault(tag, []), *(self.near[k] for k in KINDS.get(tag, ()))]
        return [*out, self.blocks] if tag in BLOCK else out

    def push(self, node: Node) -> None:
        for places in self._lists(node.tag):
            places.append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            for places in self._lists(self.stack.pop().tag):
                places.pop()

    def innermost(self, kind: str) -> int | None:
        """The place of the innermost element of the kind, unless one of its scope is further in."""
        places = self.near[kind]
        return places[-1] if places and self.stack[places[-1]].tag == kind else None


def parse(page: str) -> Node:
    """The tree below ``html``; children are nodes and texts with references decoded."""
    root = Node("html", None, KEPT)
    body = Node("body", root, KEPT)
    root.children.append(body)
    held, pos, end = Open(body), 0, len(page)
    while pos < end:
        at = held.stack[-1]
        m = TOKEN.search(page, pos)
        if not m:
            at.children.append(html.unescape(page[pos:]))
            break
        if m.start() > pos:
            at.children.append(html.unescape(page[pos:m.start()]))
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        if m[1]:
            # an end tag ends the innermost element of its name; an inline one does not reach over a block
            places = held.named.get(tag)
            if places and (tag in BLOCK or not held.blocks or held.blocks[-1] < places[-1]):
                held.close(places[-1])
            elif tag == "p":
                at.children.append(Node("p", at, KEPT))
            continue
        for kind in (["p"] if tag in CLOSES_P else []) + [name for name, _ in ENDS.get(tag, ())]:
            place = held.innermost(kind)
            if place is not None:
                held.close(place)
        at = held.stack[-1]
        node = Node(tag, at, _boiler(tag, m[3]))
        at.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            node.children.append(page[pos:close.start() if close else end])
            pos = close.end() if close else end
        elif tag not in VOID:
            held.push(node)
    return body


def _measure(body: Node) -> list[Node]:
    """Counts of every node, from the leaves up; nodes that are not shown go."""
    order, todo = [], [(body, False)]
    while todo:
        node, linked = todo.pop()
        linked = linked or node.tag == "a"
        order.append((node, linked))
        kept = []
        for c in node.children:
            if isinstance(c, str):
                kept.append(c)
                n = len(SPACE.sub(" ", c).strip())
                node.chars += n
                node.link_chars += n if linked else 0
            elif c.drop != GONE:
                kept.append(c)
                todo.append((c, linked))
        node.children = kept
    for node, linked in reversed(order):
        up = node.parent
        if up is not None and node is not body:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (1 if linked else 0)
    return [n for n, _ in order]


def _densities(nodes: list[Node], body: Node) -> None:
    share = body.link_chars / max(body.chars, 1)
    for n in nodes:
        c, t = n.chars, max(n.tags, 1)
        if not c:
            continue
        plain = max(c - n.link_chars, 1)
        links, link_tags = max(n.link_chars, 1), max(n.link_tags, 1)
        base = math.log(n.link_chars * c / plain + share * c + math.e)
        ratio = c / links * t / link_tags
        n.density = c / t * math.log(max(ratio, 1.0)) / math.log(base) if base > 1.0 and ratio > 1.0 else (
            0.0 if base > 1.0 else c / t)


def _shown(n: Node) -> list:
    return [c for c in n.children if isinstance(c, str) or c.drop == KEPT]


def _below(top: Node, held: bool = False) -> list[Node]:
    """``top`` and the nodes below it, parents first, without what is left out
    (``held``: named elements are entered)."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in node.children if not isinstance(c, str) and c.drop <= (NAMED if held else KEPT))
    return out


def _plain_sums(nodes: list[Node]) -> tuple[dict[int, int], dict[int, int]]:
    """Characters outside links below every node (``nodes``: parents first, named elements entered): without what is left
    out, and with the named elements."""
    kept, held = {}, {}
    for n in reversed(nodes):
        inside = [c for c in n.children if not isinstance(c, str)]
        own = n.chars - n.link_chars - sum(c.chars - c.link_chars for c in inside)
        kept[id(n)] = own + sum(kept[id(c)] for c in inside if c.drop == KEPT)
        held[id(n)] = own + sum(held[id(c)] for c in inside if c.drop <= NAMED)
    return kept, held


def _keep_main(body: Node) -> None:
    """Named elements that hold the main text are kept: all those around the node of the largest density sum."""
    every = _below(body, True)
    seen = _below(body)
    if len(every) == len(seen):
        return
    kept, held = _plain_sums(every)
    if any(n.tag in ("article", "main") and 2 * kept[id(n)] >= held[id(n)] for n in seen):
        return
    outside = {id(n) for n in seen}
    best = max((n for n in every if id(n) not in outside), key=_total)
    around, n = [], best
    while n is not body:
        if n.drop == NAMED:
            around.append(n)
        n = n.parent
    if _total(best) > max(map(_total, seen)) and held[id(around[-1])] > kept[id(body)]:
        for n in around:
            n.drop = KEPT


def _total(n: Node) -> float:
    total = sum(c.density for c in n.children if not isinstance(c, str) and c.drop == KEPT)
    return max(total, n.density) if any(isinstance(c, str) and c.strip() for c in n.children) else total


def select(body: Node) -> Node:
    """The subtree that holds the main text."""
    _densities(_measure(body), body)
    _keep_main(body)
    nodes = _below(body)
    best, most = body, 0.0
    for n in nodes:
        n.children = _shown(n)
        total = _total(n)
        if total > most or total == most > 0:
            best, most = n, total
    # the path up to the body gives the threshold; the subtree grows over ancestors that have further dense text
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    marked = {id(n) for n in nodes if n.tag in ("article", "main") and n.chars}
    for n in reversed(nodes):
        if id(n) in marked and n.parent is not None:
            marked.add(id(n.parent))
    named = max((k for k, n in enumerate(path) if n.tag in ("article", "main")), default=None)
    chosen = named or 0
    for k, (below, n) in enumerate(zip(path, path[1:], strict=False), 1):
        others = [c for c in n.children if not isinstance(c, str) and c is not below and c.chars]
        if named is not None:
            grows = any(id(c) in marked for c in others)
        else:
            grows = (any(c.density >= threshold > 0 or c.tag in HEADINGS for c in others)
                     or any(isinstance(c, str) and c.strip() for c in n.children))
        if grows:
            chosen = max(chosen, k)
    if named is None:
        for k, n in enumerate(path[:chosen + 1]):
            n.children = [c for c in n.children if isinstance(c, str) or (k and c is path[k - 1])
                          or not _menu(c, threshold)]
    return path[chosen]


def _menu(n: Node, threshold: float) -> bool:
    return (n.density < threshold and n.link_tags > 1 and 2 * n.link_chars > n.chars and n.tag in BLOCK
            and n.tag != "p" and n.tag not in HEADINGS)


def blocks(node: Node) -> list[str]:
    """Texts between block boundaries, white space turned to one space."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        line = SPACE.sub(" ", "".join(run)).strip()
        if line:
            out.append(line)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        else:
            edge = x.tag in BLOCK
            if edge:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return " ".join(blocks(select(parse(page))))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` (code points) per page.

    Null or empty html gives an empty text; broken markup is read as far as it
    goes; repeated rows are all returned; an empty table gives no rows; other
    columns are not read.
    """
    def rows(*values):
        found = main_text(values[-1])
        yield (*values[:-1], found, len(found))

    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])
    return map_batches(pages.select(*keep, F.col(source).cast("string").alias("__html")), rows, schema)
