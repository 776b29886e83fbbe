"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and every run of text is a binary variable, content or not. An edge potential connects
it to its parent, a node potential weighs its observed features. Sum-product messages go up from the
leaves and down from the root, which gives each node's exact marginal; runs of text whose marginal
for content reaches one half are kept. Potentials are smoothed log ratios counted over labelled
pages; ``labelled_pages`` writes such pages from a grammar of common layouts, each element marked.

Text: character references are decoded, white space within a block (a br too) becomes one space,
blocks are trimmed and joined by one newline in page order; nothing is capped. Scripts, styles and the like
are never text. Null or empty html gives an empty text. Markup that breaks off is read as far as it
goes. Repeated rows are extracted alike; extra columns stay.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.common import released, text_chunks

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an open p ends at.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element that a like one in the same list, table or dl ends, and where the search for it stops.
ENDS_LIKE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("down", "kids", "label", "links", "parent", "score", "size", "tag", "text", "up", "words")

    def __init__(self, tag: str, parent: Node | None, text: str = ""):
        self.tag, self.parent, self.text = tag, parent, text
        self.kids: list[Node] = []
        self.words: list[str] = []
        self.label: str | None = None
        self.size = self.links = 0


def parse(page: str) -> list[Node]:
    """Nodes in page order, the root first. Tags that HTML lets out are closed where it implies."""
    root = Node("#root", None)
    nodes, at, pos = [root], root, 0
    raw_end = None

    def text(part: str) -> None:
        if part and not part.isspace():
            node = Node("#text", at, html.unescape(part))
            at.kids.append(node)
            nodes.append(node)
        elif part and at.kids:
            node = Node("#space", at, " ")
            at.kids.append(node)
            nodes.append(node)

    while True:
        m = TOKEN.search(page, pos)
        if not m:
            text(page[pos:])
            return nodes
        text(page[pos : m.start()])
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            x = at
            while x is not root and x.tag != name:
                x = x.parent
            if x is not root:
                at = x.parent
            continue
        if name in ENDS_P:
            x = at
            while x is not root and x.tag in INLINE:
                x = x.parent
            if x.tag == "p":
                at = x.parent
        if name in ENDS_LIKE:
            ended, stop = ENDS_LIKE[name]
            x = at
            while x is not root and x.tag not in ended and x.tag not in stop:
                x = x.parent
            if x.tag in ended:
                at = x.parent
        node = Node(name, at)
        attributes = m[3] if m[2] else m[6]
        if attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "")
                if key.lower() == "data-y":
                    node.label = value
                else:
                    node.words += [w.lower() for w in PART.findall(value)]
        at.kids.append(node)
        nodes.append(node)
        if name in RAW:
            raw_end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
            pos = raw_end.end() if raw_end else len(page)
        elif name not in VOID:
            at = node


def _measure(nodes: list[Node]) -> None:
    """Length of the text below each node, and of that within links."""
    for x in reversed(nodes):
        if x.tag == "#text":
            x.size = len(x.text)
        elif x.tag == "a":
            x.links = x.size
        if x.parent is not None:
            x.parent.size += x.size
            x.parent.links += x.links


def _band(n: int) -> int:
    return 0 if n == 0 else 1 if n < 30 else 2 if n < 120 else 3


def features(x: Node) -> list[str]:
    if x.tag[0] == "#":
        return [x.tag]
    share = x.links / x.size if x.size else 0
    return [f"<{x.tag}", f"size{_band(x.size)}", f"link{0 if share == 0 else 1 if share < 0.4 else 2}", *(f".{w}" for w in sorted(set(x.words)))]


class TreeModel:
    """Log potentials: node[feature] for content against not, edge[parent state][state], by tag of
    the child where training has seen it."""

    def __init__(self, pages: list[str], smooth: float = 0.5):
        seen, edges, states, roles = {0: Counter(), 1: Counter()}, Counter(), Counter(), Counter()
        for page in pages:
            nodes = parse(page)
            _measure(nodes)
            for x in nodes:
                up = x.parent.score if x.parent is not None else 0
                x.score = int(x.label) if x.label is not None else up
                states[x.score] += 1
                seen[x.score].update(features(x))
                if x.parent is not None:
                    edges[up, x.score] += 1
                    roles[x.tag, up, x.score] += 1
        self.node = {}
        for f in {*seen[0], *seen[1]}:
            a, b = (seen[s][f] + smooth for s in (1, 0))
            self.node[f] = log(a / (states[1] + 1)) - log(b / (states[0] + 1))
        self.edge = {}
        base = {s: [(edges[s, t] + smooth) / (edges[s, 0] + edges[s, 1] + 2 * smooth) for t in (0, 1)] for s in (0, 1)}
        for tag in {k[0] for k in roles}:
            self.edge[tag] = [[(roles[tag, s, t] + 4 * base[s][t]) / (roles[tag, s, 0] + roles[tag, s, 1] + 4) for t in (0, 1)] for s in (0, 1)]
        self.base = [base[0], base[1]]

    def infer(self, nodes: list[Node]) -> None:
        """Set each node's score to its marginal for content."""
        known, edge, base = self.node, self.edge, self.base
        for x in nodes:
            s = sum(known.get(f, 0.0) for f in features(x))
            x.score = exp(max(-30.0, min(30.0, s)))
        for x in reversed(nodes):  # upward: the message to the parent's states
            b0, b1 = 1.0, x.score
            for k in x.kids:
                b0 *= k.up[0]
                b1 *= k.up[1]
                z = b0 + b1
                b0, b1 = b0 / z, b1 / z
            x.down = (b0, b1)
            e = edge.get(x.tag, base)
            m0, m1 = e[0][0] * b0 + e[0][1] * b1, e[1][0] * b0 + e[1][1] * b1
            z = m0 + m1
            x.up = (m0 / z or 1e-300, m1 / z or 1e-300)
        for x in nodes:  # downward: beliefs of the parent without this node's own message
            if x.parent is None:
                b0, b1 = x.down[0], 0.0  # a page as a whole is not content
            else:
                p, e = x.parent.down, edge.get(x.tag, base)
                q0, q1 = p[0] / x.up[0], p[1] / x.up[1]
                b0, b1 = x.down[0] * (q0 * e[0][0] + q1 * e[1][0]), x.down[1] * (q0 * e[0][1] + q1 * e[1][1])
            z = b0 + b1 or 1.0
            x.down = (b0 / z, b1 / z)
            x.score = x.down[1]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        _measure(nodes)
        self.infer(nodes)
        blocks: list[list[str]] = []
        home = None
        for x in nodes:
            block = x
            while block.tag[0] == "#" and block.parent is not None or block.tag in INLINE:
                block = block.parent
            if x.tag not in INLINE and x.tag[0] != "#":
                home = None  # a block element begins; what follows is another block
                continue
            if x.tag == "br" and home is block:
                blocks[-1].append(" ")
            if x.tag == "#space" and home is block:
                blocks[-1].append(" ")
            if x.tag == "#text" and x.score >= 0.5:
                if home is not block:
                    blocks.append([])
                    home = block
                blocks[-1].append(x.text)
        return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def labelled_pages(n: int = 600, seed: int = 11) -> list[str]:
    """Pages of a grammar of layouts; data-y marks content (1) and its opposite (0), and what an
    element marks holds for all it holds unless marked anew."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ba", "ke", "lo", "mi", "nu", "ra", "te", "so", "vi")) for _ in range(r.randint(1, 4)))
    text = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice((".", ".", "", "!"))
    pick = lambda *x: r.choice(x)
    maybe = lambda p, x: x if r.random() < p else ""

    def attrs(names: tuple[str, ...]) -> str:
        return maybe(0.75, f' {pick("class", "id")}="{r.choice(names)}{maybe(0.3, " " + word())}"')

    def links(a: int, b: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{text(1, 3)}</a></li>' for _ in range(r.randint(a, b))) + "</ul>"

    def noise() -> str:
        kind = r.randrange(9)
        if kind == 0:
            return f'<nav data-y="0"{attrs(("nav", "menu", "navbar", "breadcrumb"))}>{pick(links(3, 8), " ".join(f"<a href=#>{text(1, 2)}</a>" for _ in range(4)))}</nav>'
        if kind == 1:
            return f'<div data-y="0" class="{pick("ad", "ads", "advert", "banner", "sponsored", "promo", "adsbox")}">{pick(text(3, 25), f"<p>{text(3, 25)}</p>", f"<a href=x>{text(2, 8)}</a>")}</div>'
        if kind == 2:
            return f'<aside data-y="0"{attrs(("sidebar", "related", "widget", "side"))}><h3>{text(1, 3)}</h3>{pick(links(2, 6), f"<p>{text(5, 30)}</p>")}</aside>'
        if kind == 3:
            return f'<form data-y="0"{attrs(("search", "newsletter", "login", "subscribe", "form"))}><label>{text(1, 4)}</label><input type=text><button>{text(1, 2)}</button></form>'
        if kind == 4:
            return f'<div data-y="0" class="{pick("cookie", "notice", "popup", "modal", "alert", "consent", "cookie banner")}"><p>{text(6, 25)}</p><button>{text(1, 2)}</button></div>'
        if kind == 5:
            return f'<{(t := pick("div", "section"))} data-y="0" {pick("class", "id")}="{pick("comments", "comment list", "disqus", "replies", "responses")}"><h3>{text(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{text(4, 40)}</p></div>' for _ in range(r.randint(1, 4))) + f"</{t}>"
        if kind == 6:
            return f'<div data-y="0" class="{pick("menu", "nav", "sidebar", "share", "social", "related", "tags", "breadcrumbs", "widget", "toolbar")}">{links(2, 6)}</div>'
        if kind == 7:
            return f'<header data-y="0"{attrs(("header", "masthead", "site header", "top"))}>{maybe(0.5, f"<h1>{text(1, 3)}</h1>")}{maybe(0.6, links(2, 5))}{maybe(0.4, f"<p>{text(2, 8)}</p>")}</header>'
        return f'<footer data-y="0"{attrs(("footer", "bottom", "copyright"))}>&copy; {text(2, 25)} {maybe(0.5, links(2, 4))}</footer>'

    def inline() -> str:
        return pick(text(1, 40), text(1, 8), f"<b>{text(1, 20)}{pick('</b>', '')}<br>", f"{text(3, 15)} <a href=x>{text(1, 3)}</a> {text(3, 15)}", f"{text(4, 20)} <em>{text(1, 4)}</em>, {text(2, 12)}", text(20, 90), text(1, 2))

    def content() -> str:
        kind = r.randrange(12)
        if kind == 0:
            return f"<h2>{text(1, 8)}</h2>"
        if kind == 1:
            return f"<ul>{''.join(f'<li>{text(2, 20)}</li>' for _ in range(r.randint(1, 4)))}</ul>"
        if kind == 2:
            return f"<blockquote><p>{text(5, 40)}</p></blockquote>"
        if kind == 3:
            return f"<table><tr><td>{text(1, 3)}</td><td>{text(1, 3)}</td></tr></table>"
        if kind == 4:
            return pick(f"<pre>{text(3, 20)}</pre>", f"<figure><img src=x><figcaption>{text(2, 10)}</figcaption></figure>", f"<section><h3>{text(1, 5)}</h3><p>{text(4, 40)}</p></section>")
        return f"<p>{inline()}{maybe(0.85, '</p>')}"

    out = []
    for _ in range(n):
        tag = pick("article", "article", "article", "article", "main", "div", "section")
        mark = attrs(("article", "post", "content", "entry content", "story", "main", "post body", "text")) if tag == "article" else f' {pick("class", "id")}="{pick("article", "post", "content", "entry content", "story", "main content", "post body", "text body")}"'
        head = f"<h1>{text(1, 10)}</h1>" if r.random() < 0.8 else f"<header{pick('', ' class=entry')}><h1>{text(1, 10)}</h1></header>"
        body = maybe(0.85, head) + "".join(content() if r.random() < 0.93 else noise() for _ in range(r.randint(1, 14)))
        article = f'<{tag} data-y="1"{mark}>{body}</{tag}>'
        before, after = "".join(noise() for _ in range(r.randint(0, 3))), "".join(noise() for _ in range(r.randint(0, 4)))
        if r.random() < 0.3:
            wrap = pick("div", "main", "section")
            article = f'<{wrap} {pick("id", "class")}="{pick("wrapper", "page", "container", "main", "content", "layout")}">{maybe(0.3, noise())}{article}{maybe(0.5, noise())}</{wrap}>'
        out.append(f'<html><head><title>{text(1, 6)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body{attrs(("page", "home"))}>{before}{article}{after}</body></html>')
    return out


@cache
def default_model(pages: int = 600, seed: int = 11) -> TreeModel:
    return TreeModel(labelled_pages(pages, seed))


def extract_text(df: DataFrame, column: str = "html", out: str = "text", model: TreeModel | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns to keep) with the main text of a column of html; clashes raise ValueError."""
    rest = [c for c in df.columns if c != column] if keep is None else keep
    if out in rest:
        raise ValueError(f"the input already has a column {out}; name it otherwise")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model or default_model()
        for b in text_chunks(batches, column, 4_000_000):
            made = [m.extract(x) for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(made, pa.string())], [*rest, out])

    return df.select(*rest, column).mapInArrow(released(run), T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.StringType())]))
