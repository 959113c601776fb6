"""Main-text extraction from HTML by tree scoring.

Each page is parsed to a tree without needing valid markup. Scripts, styles, controls and
hidden parts are never part of an article. Menus, page headers and footers and asides (by their element), and
reader comments, adverts and notices of consent (by class or id), are left out unless they hold an ``article`` or
``main`` element that is not itself a comment; nothing brings them back, whatever their size. Other words of
a class, id or role, and forms, lower a score: points passed out of such a part, and scores of containers in
it, count ``DOUBTED`` times, and if an ``article`` or ``main`` scores, no container in such a part outside it is chosen. A name is in doubt only if all its words are words
of that kind or neutral ones, so 'share-buttons' is and 'share-price-table' is not. Parts in doubt that do not hold the best container are then left out.

Every paragraph passes points for its length and its commas to its
ancestors, halved at each level; a container's points are discounted by its link density. The
best container and those of its siblings that score or read like it are kept (with the same class, a fifth of its
score is enough), inside ``article``
and ``main`` as elsewhere; within ``article`` all siblings up to it are kept but those that are mostly links.
Nothing else within the best container is left out.

A tag with an unclosed quote ends at the next ``>``. Null and empty pages give an empty text. Each row is
treated by itself, so repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a declaration, or a tag: with quotes that close before white space or the tag's end, else up to the next ``>``.
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"(?=[\s>]|/>)|'[^']*+'(?=[\s>]|/>))*+(?=>)|[^>]*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"\s+")

#: Elements by their role in the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
CUT = frozenset("head button select dialog svg canvas object audio video map label".split())
ASIDE = frozenset("nav footer aside menu header".split())
FORMS = frozenset("form fieldset".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption address header center details summary hr figure figcaption nav footer aside form fieldset".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd div section".split())
#: Words of a class or id of parts that never belong to an article.
FOREIGN = frozenset("ad ads advert adverts advertisement advertisements advertising comment comments commentlist consent cookie cookies disqus gdpr respond sponsor sponsored sponsors".split())
#: Words that make a part doubtful.
UNLIKELY = FOREIGN | frozenset(
    "banner breadcrumb breadcrumbs byline foot footer header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination paywall popup promo related reply share sharing sidebar signup social subscribe subscription tags toolbar widget".split()
)
#: Words beside them that say nothing about a part.
NEUTRAL = frozenset("area articles bar block bottom box btn button buttons center col column container form group icons inner is item items js left links list main modules module outer page panel popular post posts primary right row secondary section site slot stories text top unit us wrap wrapper".split())
#: What scores within a doubtful part count.
DOUBTED = 0.25
UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: A start tag of the key closes an open element of the value, up to the nearest element of the stop set.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table article section main div body html td th".split())


#: Class words about other parts of the page: 'no-sidebar', 'has-comments', 'with_banner'.
_NOT_ITSELF = re.compile(r"\b(?:no|not|has|have|with|without|hide|show)[-_][a-z]+")


class Node:
    __slots__ = ("children", "doubt", "dropped", "holds", "links", "name", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, doubt: str = "", name: str = ""):
        self.tag, self.parent, self.doubt, self.name = tag, parent, doubt, name
        self.dropped, self.holds = doubt == "never", False
        self.children: list[Node | str] = []
        self.points = 0.0
        self.size = self.links = 0


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(source)}


def _named(names: str) -> set[str]:
    """The words in doubt of a class or id: of each name of which all words are in doubt or neutral."""
    found = set()
    for name in _NOT_ITSELF.sub(" ", re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower()).split():
        words = [w for w in re.findall(r"[a-z]+", name) if len(w) > 1]
        if all(w in UNLIKELY or w in NEUTRAL for w in words):
            found.update(w for w in words if w in UNLIKELY)
    return found


def _doubt(tag: str, a: dict[str, str], in_article: bool) -> str:
    """Why a part may not be of the article: "never", "aside" (by its element), "foreign" or "name" (by its class, id or role, or a form)."""
    if tag in CUT:
        return "never"
    if tag in ASIDE and not (tag == "header" and in_article):
        return "aside"
    if not a or tag in ("html", "body"):
        return "name" if tag in FORMS else ""
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return "never"
    names = f"{a.get('class', '')} {a.get('id', '')}"
    if tag in ("article", "main"):
        return "foreign" if re.search(r"\bcomment\b", names.lower().replace("_", "-")) else ""
    found = _named(names)
    if found & FOREIGN:
        return "foreign"
    if tag in FORMS or a.get("role", "").lower() in UNLIKELY_ROLES:
        return "name"
    if in_article and (found <= {"header", "tags"} or tag in ("p", "pre", "blockquote")):
        return ""
    return "name" if found else ""


def parse(source: str) -> Node:
    """The tree of a page; elements that are left open end where HTML says they do."""
    root = node = Node("html", None)
    at, n, articles = 0, len(source), 0
    while at < n:
        m = _MARKUP.search(source, at)
        text = source[at : m.start() if m else n]
        if text:
            node.children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            up = node
            while up is not None and up.tag != tag:
                up = None if tag not in BLOCK and up.tag in BLOCK else up.parent
            if up is not None and up.parent is not None:
                while node is not up:
                    articles -= node.tag in ("article", "main")
                    node = node.parent
                articles -= tag in ("article", "main")
                node = up.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            up = node
            while up is not None and up.tag != "p" and up.tag not in STOPS:
                up = up.parent
            if up is not None and up.tag == "p":
                node = up.parent
        if tag in CLOSES:
            up = node
            while up.parent is not None and up.tag not in CLOSES[tag] and up.tag not in STOPS:
                up = up.parent
            if up.tag in CLOSES[tag]:
                node = up.parent
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            node.children.append("\n")
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "span", "em", "strong"):
            if tag == "hr":
                node.children.append(Node("hr", node))
            continue
        a = _attributes(m[3]) if m[3] else {}
        child = Node(tag, node, _doubt(tag, a, articles > 0), a.get("class", ""))
        node.children.append(child)
        articles += tag in ("article", "main")
        node = child
    return root


def _order(root: Node) -> list[Node]:
    """All parts that are not left out, parents first."""
    order, queue = [], [root]
    while queue:
        node = queue.pop()
        order.append(node)
        queue += [c for c in node.children if isinstance(c, Node) and not c.dropped]
    return order


def _measure(root: Node) -> list[Node]:
    """Sets the text and link sizes of all parts that are not left out; returns them, parents first."""
    order = _order(root)
    for node in reversed(order):
        node.size += sum(len(_SPACE.sub(" ", c)) for c in node.children if isinstance(c, str) and not c.isspace())
        node.holds |= node.tag in ("article", "main") and not node.doubt
        if node.tag == "a":
            node.links = node.size
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
            node.parent.holds |= node.holds
    return order


def _again(root: Node) -> list[Node]:
    """Measures what is left, from nothing."""
    order = _order(root)
    for node in order:
        node.size = node.links = 0
        node.points = 0.0
    return _measure(root)


def _settle(root: Node) -> list[Node]:
    """Leaves out foreign parts, and parts in doubt that do not hold the best container; then measures what is left."""
    for node in _measure(root):
        node.dropped |= node.doubt in ("aside", "foreign") and not node.holds
    nodes = _again(root)
    doubted = [x for x in nodes if x.doubt]
    if not doubted:
        return nodes
    final = _score(nodes)
    doubts: dict[int, int] = {}
    sure: set[int] = set()
    for node in nodes:  # parents come first
        up = node.parent
        named = node.tag in ("article", "main")
        doubts[id(node)] = 0 if named else bool(node.doubt) + (doubts[id(up)] if up is not None else 0)
        if named or up is not None and id(up) in sure:
            sure.add(id(node))
    if any(final.get(x, 0) > 0 for x in sure):
        final = {k: v for k, v in final.items() if k in sure or not doubts[k]}
    best = max((x for x in nodes if id(x) in final), key=lambda x: final[id(x)] * DOUBTED ** doubts[id(x)], default=None)
    around = set()
    while best is not None:
        around.add(id(best))
        best = best.parent
    for node in doubted:
        node.dropped = not node.holds and id(node) not in around
    return _again(root)


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _has_block(node: Node) -> bool:
    return any(isinstance(c, Node) and not c.dropped and c.tag in BLOCK for c in node.children)


def _plain(node: Node) -> str:
    out, queue = [], [node]
    while queue:
        x = queue.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.dropped:
            queue += reversed(x.children)
    return "".join(out)


def _score(nodes: list[Node]) -> dict[int, float]:
    """Passes the points of paragraphs to their ancestors; the discounted points of each that got any."""
    scored = []
    for node in nodes:
        if node.tag not in PARAGRAPH or _has_block(node) or node.parent is None:
            continue
        text = _plain(node).strip()
        if not text or _density(node) > 0.5:
            continue
        points = (1.0 if len(text) >= 25 else 0.1) + text.count(",") * 0.5 + min(len(text) / 100, 3.0)
        up, share = node.parent, 1.0
        while up is not None and share > 0.1:
            if not up.points:
                scored.append(up)
            up.points += points * share
            up, share = up.parent, share / 2 * (DOUBTED if up.doubt and not up.holds else 1)
    return {id(x): x.points * (1 - _density(x)) for x in scored}


def best_containers(root: Node) -> list[Node]:
    """The container with the most points and its kept siblings, in page order."""
    nodes = _settle(root)
    final = _score(nodes)
    if not final:
        named = [x for x in nodes if x.tag in ("article", "main") and x.size]
        return named[:1] or [root]
    best = max((x for x in nodes if id(x) in final), key=lambda x: final[id(x)])
    article = _up_to(best, "article")
    top = article or _up_to(best, "main")
    limit, kept, node = max(2.0, 0.2 * final[id(best)]), [best], best
    while node is not top and node.parent is not None and (top or node is best):
        around = [x for x in node.parent.children if isinstance(x, Node) and not x.dropped and x.size]
        at = next(i for i, x in enumerate(around) if x is node) if node.size else len(around)
        near = [x is not node and (_density(x) <= 0.5 if article else _like(x, final, limit)) for x in around]
        kept = [x for x, keep in zip(around[:at], near, strict=False) if keep] + kept + [x for x, keep in zip(around[at:], near[at:], strict=True) if keep]
        node = node.parent
    return kept


def _up_to(node: Node | None, tag: str) -> Node | None:
    while node is not None and node.tag != tag:
        node = node.parent
    return node


def _like(x: Node, final: dict[int, float], limit: float) -> bool:
    reads = x.tag in ("p", "pre", "blockquote") and (_density(x) < 0.25 if x.size > 80 else _density(x) == 0)
    title = x.tag in ("h1", "h2") and _density(x) < 0.5
    return final.get(id(x), 0) >= limit or reads or title


def _alike(x: Node, best: Node, final: dict[int, float]) -> bool:
    """Columns of one kind: the same element and class, and a fifth of the score."""
    return bool(x.name) and (x.tag, x.name) == (best.tag, best.name) and final.get(id(x), 0) >= 0.2 * final[id(best)]


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Appends the text of a kept part, a new list for each block; of a whole page, parts that are mostly links are left out."""
    page = node.parent is None
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif not x.dropped and not (page and x.tag in ("ul", "ol", "dl", "table", "div", "section") and x.size and _density(x) > 0.5):
            if x.tag in BLOCK:
                out.append([])
                stack.append(None)
            stack += reversed(x.children)


def main_text(source: str | None) -> str:
    """The article's blocks, one line each."""
    if not source:
        return ""
    out: list[list[str]] = [[]]
    for node in best_containers(parse(source)):
        _blocks(node, out)
    lines = (_SPACE.sub(" ", "".join(b)).strip() for b in out)
    return "\n".join(x for x in lines if x)


def _run(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page row: page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
