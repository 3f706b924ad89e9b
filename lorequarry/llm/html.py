"""Main-text extraction by composite text density.

Each DOM node gets a link-adjusted density of characters per tag, and the sum of
its children's densities.  The node of the largest sum is the main text (of the
containers of a node that only arranges them, the one that has it); the least
density on the path from ``body`` to it is the page's threshold.  Other subtrees
that reach the threshold are main text as well, each by its own node of the largest
sum; what stays below it is not.  A node that only arranges containers is not taken
whole; its containers are judged one by one.  So an article cut into several blocks comes out
whole, and menus, adverts and notices, short or full of links, do not.

Elements that are never article text (menus, headers, footers, sidebars, forms,
scripts, styles) are left out from the start.  A class, id or role with a word for
boilerplate in it is a hint: the container's text counts as link text when the main
text is chosen, but within the main text it goes only if its density without that
stays below the threshold too.  A few whole names (``comments``, ``advert``) say what
a part is, and a part of such a name goes unless it holds the main text: a name on the path
to that is taken for an unlucky one.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lorequarry.llm.arrow import map_batches, pick

# Elements of HTML by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIPPED = frozenset(
    "head script style noscript template title nav menu footer aside form button select option optgroup textarea input label "
    "datalist dialog iframe noembed noframes".split()
)
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul caption".split()
)
#: Elements that end an open ``p``.
ENDS_P = BLOCKS - frozenset("html body caption td th tr tbody thead tfoot".split())
#: Elements that the end of a ``p`` outside them does not reach into.
P_SCOPES = frozenset("table td th button caption object".split())
#: Elements that end an open element of the same kind, up to the container that holds them.
ENDS_ITS_LIKE = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Words of a class, id or role that name a part which is not the article.
BOILERPLATE = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion comment comments disqus "
    "sidebar menu navbar navigation nav breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup share sharing social related recommended pagination pager "
    "toolbar widget complementary contentinfo search alert disclaimer replies respond".split()
)
#: Whole names that leave no doubt.
CERTAIN = frozenset(
    "ad ads advert adverts advertisement sponsored comments comment-list comments-list comment-section comments-section comments-area reader-comments "
    "user-comments disqus_thread sidebar cookie-notice cookie-banner cookie-consent cookie-bar cookienotice cookiebanner newsletter-signup".split()
)
#: Words that say of a part that it lacks, or lies beside, what the next word names.
BESIDE = frozenset("no with without has non is not after before".split())
#: Containers, whose names count; a name on a paragraph or a phrase does not.
NAMEABLE = frozenset("div section ul ol dl table figure details center fieldset address".split())
#: Containers that may be the main text as a whole.
CONTAINERS = frozenset("#root html body article main div section center td".split())
#: Least share of the densest node's text that an ancestor's own blocks hold, for it to be the article.
OWN_SHARE = 0.1
#: Headings that belong to the block right after them.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=|\"|')*)>?",
    re.DOTALL,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = (
        "beside", "best", "chars", "children", "density", "dropped", "link_chars", "link_tags", "named", "parent", "plain", "plain_chars", "plain_tags", "sum", "tag", "tags",
    )

    def __init__(self, tag: str, parent: Node | None, dropped: bool, named: int) -> None:
        self.tag, self.parent, self.dropped, self.named = tag, parent, dropped, named
        self.beside = False
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.plain_chars = self.plain_tags = 0
        self.density = self.sum = self.plain = 0.0
        self.best = self

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and not c.dropped]


#: What the names of a container say: nothing, perhaps, for certain.
UNNAMED, HINTED, SURE = 0, 1, 2


def _naming(tag: str, attributes: str) -> int:
    """Whether a container's class, id or role names a part that is not the article."""
    if not attributes or tag not in NAMEABLE:
        return UNNAMED
    found = UNNAMED
    for m in _NAMED.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        for name in value.split():
            if name.lower() in CERTAIN:
                return SURE
            words = _WORD.findall(_CAMEL.sub(" ", name).lower())
            if any(w in BOILERPLATE and not BESIDE.intersection(words[:k]) for k, w in enumerate(words)):
                found = HINTED
    return found


class _Open:
    """The open elements, and how many there are of each kind: so that an element
    that nothing open concerns is placed without a look at all of them."""

    def __init__(self) -> None:
        self.root = Node("#root", None, False, UNNAMED)
        self.stack = [self.root]
        self.count: Counter = Counter()
        #: Open paragraphs in each scope that an end of a paragraph cannot leave.
        self.paragraphs = [0]

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.count[node.tag] += 1
        if node.tag in P_SCOPES:
            self.paragraphs.append(0)
        elif node.tag == "p":
            self.paragraphs[-1] += 1

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.count[tag] -= 1
            if tag in P_SCOPES:
                self.paragraphs.pop()
            elif tag == "p":
                self.paragraphs[-1] -= 1

    def close(self, tags: set[str], stop: frozenset[str] | set[str] = frozenset()) -> bool:
        """Close the innermost of ``tags``, unless one of ``stop`` stands before it."""
        if any(self.count[t] for t in tags):
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth].tag in tags:
                    self.close_to(depth)
                    return True
                if self.stack[depth].tag in stop:
                    break
        return False


def parse(source: str) -> Node:
    """The DOM of a page.  Unclosed and misnested tags are closed as browsers do:
    a block ends an open ``p``, an item ends the item before it, and an end tag
    without a start is ignored."""
    held, at = _Open(), 0
    while (m := _TAG.search(source, at)) is not None:
        top = held.stack[-1]
        if m.start() > at:
            top.children.append(source[at : m.start()])
        at = m.end()
        if m[1]:
            held.close({m[1].lower()})
        elif m[2]:
            tag = m[2].lower()
            if tag in ENDS_P and held.paragraphs[-1]:
                held.close({"p"})
            if tag in ENDS_ITS_LIKE:
                like, stop = ENDS_ITS_LIKE[tag]
                while held.close(like, stop):
                    pass
            top = held.stack[-1]
            # A page's header goes; an article's own header holds its title.
            dropped = tag in SKIPPED or tag == "header" and not (held.count["article"] or held.count["main"])
            node = Node(tag, top, top.dropped or dropped, _naming(tag, m[3] or ""))
            top.children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|</{tag}\Z", re.IGNORECASE).search(source, at)
                node.children.append(source[at : end.start() if end else len(source)])
                at = end.end() if end else len(source)
            elif tag not in VOID:  # HTML ignores the slash of <div/>
                held.push(node)
    if at < len(source):
        held.stack[-1].children.append(source[at:])
    return held.root


def _in_order(root: Node) -> list[Node]:
    """All nodes but dropped ones, parents first; no recursion, as pages may nest deeply."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            out.append(node)
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_links: float) -> float:
    """Characters a tag, scaled down as links take more of the text; ``body_links``
    is the share of link text in the whole body."""
    if not chars:
        return 0.0
    plain, links = max(chars - link_chars, 1), max(link_chars, 1)
    scale = math.log(chars / plain * link_chars + body_links * chars + math.e)
    return chars / max(tags, 1) * math.log(chars / links * max(tags, 1) / max(link_tags, 1) + 1) / scale


def measure(nodes: list[Node], body: Node) -> None:
    """Counts, densities, density sums, and the best node of each subtree, for
    ``nodes`` with parents first.  Text right in a node counts as a child without tags."""
    for node in nodes:
        node.beside = node.named != UNNAMED or node.parent is not None and node.parent.beside
    for node in reversed(nodes):
        kids = node.nodes()
        node.chars = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(c.chars for c in kids)
        node.tags = sum(c.tags + 1 for c in kids)
        if node.tag == "a" or node.beside:
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        else:
            node.link_chars = sum(c.link_chars for c in kids)
            node.link_tags = sum(c.link_tags for c in kids)
        # The same, whatever containers are called.
        if node.tag == "a":
            node.plain_chars, node.plain_tags = node.chars, node.tags + 1
        else:
            node.plain_chars, node.plain_tags = sum(c.plain_chars for c in kids), sum(c.plain_tags for c in kids)
    body_links = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, body_links)
        node.plain = density(node.chars, node.tags, node.plain_chars, node.plain_tags, body_links)
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        links = own if node.tag == "a" or node.beside else 0
        node.sum = sum(c.density for c in node.nodes()) + density(own, 1, links, min(links, 1), body_links)
        # The first of equal sums, and the outer one of a node and its descendants;
        # paragraphs and phrases are parts of a text, and so stand back.
        node.best = max([node, *(c.best for c in node.nodes())], key=lambda n: (n.tag in CONTAINERS, n.sum))


def main_nodes(root: Node) -> list[Node]:
    """The subtrees to keep, in page order."""
    nodes = _in_order(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    while True:
        measure(nodes, body)
        densest = body.best
        while _is_layout(densest):
            densest = max((c.best for c in densest.nodes()), key=lambda n: n.sum)
        path, node = [], densest
        while node is not None and node is not body.parent:
            path.append(node)
            node = node.parent
        unlucky = [n for n in path if n.named]
        if not unlucky:
            break
        for n in unlucky:
            n.named = UNNAMED
    if not densest.chars:
        return []
    threshold = min(n.density for n in path)
    # The article goes as far up as ancestors have text blocks of their own that reach it.
    for n in path[1:]:
        own = [c for c in n.nodes() if c.tag not in CONTAINERS and c.tag not in NAMEABLE and c.tag not in HEADINGS]
        if sum(c.chars for c in own if c.density >= threshold) >= OWN_SHARE * path[0].chars:
            densest = n
    kept, stack = [], [body]
    while stack:
        node = stack.pop()
        if node.density >= threshold:
            if node is densest or node.best is node and not _is_layout(node):
                kept.append(node)
            else:
                stack.extend(reversed(node.nodes()))
    kept = [x for n in kept for x in (*_headings_of(n), n)]
    # Within them, containers go that are named for certain, or stay below the threshold without their name's weight.
    for n in nodes:
        n.dropped = n.dropped or n.named != UNNAMED and n.density < threshold and (n.named == SURE or n.plain < threshold)
    return list(dict.fromkeys(kept))


def _is_layout(node: Node) -> bool:
    """Whether a node only arranges containers, and has no text block of its own."""
    kids = node.nodes()
    containers = [c for c in kids if c.tag in NAMEABLE or c.tag in ("article", "main")]
    others = [c for c in kids if c.tag not in HEADINGS and c not in containers and c.chars]
    return len(containers) > 1 and not others and not any(isinstance(c, str) and c.strip() for c in node.children)


def _headings_of(node: Node) -> list[Node]:
    """Headings right before a node, with nothing else between them."""
    found: list[Node] = []
    if node.parent is not None and node.tag not in ("html", "body"):
        siblings = node.parent.children
        for x in reversed(siblings[: next(k for k, c in enumerate(siblings) if c is node)]):
            if isinstance(x, str) and not x.strip() or isinstance(x, Node) and x.dropped:
                continue
            if isinstance(x, str) or x.tag not in HEADINGS:
                break
            found.append(x)
    return found[::-1]


def text_of(node: Node) -> str:
    """The blocks under a node, each on a line, with references decoded."""
    blocks: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        if inline and (block := _SPACE.sub(" ", "".join(inline)).strip()):
            blocks.append(block)
        inline.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            inline.append(entities.unescape(x))
        elif x.tag == "br":
            inline.append(" ")
        elif not x.dropped:
            is_block = x.tag in BLOCKS
            if is_block:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return "\n".join(blocks)


def extract_text(source: str | None) -> str:
    """The main text of a page; empty where there is none or the page is null."""
    if not source:
        return ""
    return "\n".join(filter(None, map(text_of, main_nodes(parse(source)))))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    Null and empty html give the empty text; repeated rows stay; an empty table
    gives an empty one; columns besides ``page_id, url, html`` are ignored.
    """
    rows = pick(pages, "page_id", "url", "html")
    schema = T.StructType(
        [rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def step(cols: dict[str, pa.Array]) -> dict[str, object]:
        found = [extract_text(x) for x in cols["html"].to_pylist()]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": found, "n_chars": [len(x) for x in found]}

    return map_batches(rows, step, schema)
