"""Main text of web pages by tree scoring.

Paragraphs earn points for length and commas and pass them to their ancestors, less with every step; a container's
points are discounted by its link density. The best container is kept with the article (or main element) around it,
less what is mostly links beside the way up; beside that the siblings that score well, headings and plain paragraphs.
Boilerplate elements earn and keep nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcube.llm.common import batches, table

MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|$)""", re.S)
MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements without content, elements whose content is not markup, elements that never hold main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed".split())
DROP = RAW | set("head nav footer aside form header menu button select option svg canvas object dialog".split())
#: Class, id or role words of boilerplate.
BAD = re.compile(r"""(?:^|[\s"'_-])(?:ads?|advert\w*|banner|comments?|commentlist|cookies?|consent|disqus|footer|header|masthead|menu|nav\w*|breadcrumbs?"""
                 r"""|newsletter|notice|notices|pager|pagination|popup|modal|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|navigation)(?:$|[\s"'_-])""", re.I)
#: A part of a class or id after one of these names what is there or not (`has-sidebar`, `no-comments`), not the element itself.
TOLD = set("has with no without".split())
#: What readers say is never the text, however long it is; other boilerplate names are kept where most of the page's paragraphs are inside.
READERS = re.compile(r"comments?|commentlist|disqus|replies")
#: Elements that hold paragraph text.
PROSE = {"p", "pre", "blockquote"}
#: Headers of these hold the heading of the text.
TITLED = set("post entry article page section".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
            "li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption"}
#: An opening tag ends an open element of these, inside the nearest of the borders.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SPACES = re.compile(r"[ \t\n\r\f\v\x85\xa0  -     　]+")

BASE, PER_CHARS, MOST_FOR_LENGTH = 1.0, 100.0, 3.0
SIBLING_SHARE, PLAIN_DENSITY, PLAIN_CHARS = 0.2, 0.25, 25
#: Blocks with a larger share of link text are lists of links.
LINK_DENSITY = 0.5


class Node:
    __slots__ = ("tag", "up", "drop", "kids", "score", "chars", "links")

    def __init__(self, tag: str, up: Node | None, drop: bool):
        self.tag, self.up, self.drop = tag, up, drop
        self.kids: list = []
        self.score = self.chars = self.links = 0.0


def boilerplate(names: str) -> bool:
    """One of the class, id or role names is boilerplate as a whole."""
    if not BAD.search(names):
        return False
    for name in names.lower().split():
        parts = [x for x in re.split("[-_]+", name) if x]
        told = next((i for i, x in enumerate(parts) if x in TOLD), len(parts))
        bad = {x for x in parts[:told] if BAD.fullmatch(x)}
        if bad and not (bad == {"header"} and TITLED & set(parts)):
            return True
    return False


def wrappers(root: Node, named: list[Node]) -> None:
    """Keep the elements with a boilerplate name that hold more than half of the page's paragraph text (a page's wrapper
    may be called `sidebar-layout`)."""
    inside_of: dict[int, int] = {}
    whole, todo = 0, [(root, False, ())]
    marked = {id(x) for x in named}
    while todo:
        x, prose, over = todo.pop()
        prose = prose or x.tag in PROSE
        over = (*over, id(x)) if id(x) in marked else over
        for k in x.kids:
            if not isinstance(k, str):
                if not k.drop or id(k) in marked:
                    todo.append((k, prose, over))
            elif prose:
                size = len(k.strip())
                whole += size
                for n in over:
                    inside_of[n] = inside_of.get(n, 0) + size
    for x in named:
        if 2 * inside_of.get(id(x), 0) > whole:
            x.drop = False


def inside(node: Node | None, tags: tuple[str, ...]) -> Node | None:
    """The outermost of a node and its ancestors with one of the tags."""
    found = None
    while node is not None:
        if node.tag in tags:
            found = node
        node = node.up
    return found


def tree(html: str) -> Node:
    """A tolerant tree: text children are strings; unclosed and stray tags do no harm."""
    root = here = Node("html", None, False)
    named: list[Node] = []  # dropped for their names alone
    at, end = 0, len(html)
    while at < end:
        m = MARKUP.search(html, at)
        if m is None:
            here.kids.append(html[at:])
            break
        if m.start() > at:
            here.kids.append(html[at:m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            x = here
            while x is not root and x.tag != tag:
                if tag not in BLOCK and x.tag in BLOCK:  # an inline tag can't end a block
                    x = root
                    break
                x = x.up
            if x is not root:
                here = x.up
            continue
        if tag in VOID:
            if tag == "br":
                here.kids.append(" ")
            elif tag == "hr":
                here.kids.append(Node(tag, here, False))
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = close.start() if close else end
            at = (html.find(">", at) + 1 or end) if close else end
            continue
        if tag in ("html", "body"):
            continue
        over, border = ENDS.get(tag, ({"p"}, {"td", "th", "li", "button", "blockquote", "div", "article", "section"}) if tag in CLOSES_P else ((), ()))
        if over:
            x = here
            while x is not root and x.tag not in border:
                if x.tag in over:
                    here = x.up
                    if tag not in ("tr",):
                        break
                x = x.up
        drop = tag in DROP and not (tag == "header" and inside(here, ("article",)))  # an article's own header holds its heading
        by_name = False
        if not drop and m[3]:
            for a in MARK.finditer(m[3]):
                name = a[1].lower()
                if name == "hidden" or name == "aria-hidden" and "true" in (a[2] or "").lower() or name in ("class", "id", "role") and a[2] and boilerplate(a[2].strip("\"'")):
                    drop = tag not in ("article", "main")
                    by_name = drop and name in ("class", "id") and not READERS.search(a[2].lower())
                    break
        x = Node(tag, here, drop)
        if by_name:
            named.append(x)
        here.kids.append(x)
        here = x
    if named:
        wrappers(root, named)
    return root


def blocks(node: Node, but: set[int] = frozenset()) -> list[str]:
    """Texts of a node's blocks in page order, white space normalised, empty ones and the nodes `but` (by id()) left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = SPACES.sub(" ", unescape("".join(run))).strip(" ")
            run.clear()
            if text:
                out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.drop and id(x) not in but:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.kids)
    flush()
    return out


def weigh(root: Node) -> Node:
    """Score the tree; the best container."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if not isinstance(k, str) and not k.drop]
    for x in reversed(order):
        own = sum(len(k) for k in x.kids if isinstance(k, str))
        x.chars += own
        if x.tag == "a":
            x.links = x.chars
        if x.up is not None:
            x.up.chars += x.chars
            x.up.links += x.links
    for x in order:
        if x.tag in ("p", "pre", "td", "blockquote") or x.tag in BLOCK and any(isinstance(k, str) and k.strip() for k in x.kids):
            if x.tag in HEADINGS or x.chars < 1:
                continue
            commas = sum(k.count(",") for k in texts(x))
            points = (BASE + commas + min(x.chars / PER_CHARS, MOST_FOR_LENGTH)) * (1 - x.links / x.chars)
            up, share = x.up or x, 1.0
            for depth in range(1, 4):
                up.score += points * share
                share = 1 / (2 * depth)
                if up.up is None:
                    break
                up = up.up
    best, most = root, -1.0
    for x in order:
        value = x.score * (1 - x.links / x.chars) if x.chars else 0.0
        if value > most:
            best, most = x, value
    best.score = most
    return best


def texts(node: Node) -> Iterator[str]:
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif not x.drop:
            todo += x.kids


def extract(html: str | None) -> str:
    root = tree(html or "")
    best = weigh(root)
    if best.up is None:
        return "\n".join(blocks(best))
    top = inside(best, ("article",)) or inside(best, ("main",))
    named = top is not None
    top, links = top or best, set()
    way = best
    while way is not top:
        links |= {id(x) for x in way.up.kids if not isinstance(x, str) and x is not way and x.tag in BLOCK and x.tag not in HEADINGS and density(x) > LINK_DENSITY}
        way = way.up
    out: list[str] = []
    for x in top.up.kids if top.up else [top]:
        if isinstance(x, str) or x.drop:
            continue
        if x is top or x.tag in HEADINGS or x.score * (1 - density(x)) >= max(10.0, SIBLING_SHARE * best.score) or density(x) < PLAIN_DENSITY and (
                x.tag == "p" and x.chars >= PLAIN_CHARS or not named and x.tag == top.tag and titled(x)):
            out += blocks(x, links)
    return "\n".join(out)


def density(x: Node) -> float:
    return x.links / x.chars if x.chars else 0.0


def titled(x: Node) -> bool:
    """A part of a text without article: a block that holds a heading or paragraphs."""
    return any(not isinstance(k, str) and not k.drop and k.tag in HEADINGS | {"p", "pre", "blockquote", "ul", "ol", "table"} for k in x.kids)


def pages_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it, text=2):
        found = [extract(h) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Null or empty html has the text "" of no characters. `br` is white space. Repeated rows give repeated rows; other
    columns are ignored; empty input gives empty output.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(pages_of, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
