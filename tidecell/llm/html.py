"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block elements; inline markup belongs to its block. Trees over a node's features (its tag, the
words of its class and id, those of its ancestors, text, link and tag density of its subtree, depth, and its share among
its siblings) give the log-odds that it belongs to the article. Decoding picks the best labelling in which nothing is
kept below a dropped node: the value of keeping a node is its own log-odds and, for each child, the better of keeping
and dropping it. The trees are trained once in a session, on pages that ``sample_page`` composes from made-up words: Spark composes and reads
them, and the driver gets the features of the nodes of PAGES pages, a constant.

Edge cases: a null or empty page has empty text; markup that is cut off or badly nested is read as far as it goes; text
outside any element is kept; formulas in MathML belong to their block; repeated rows give repeated results; an empty table gives an empty result. Pages are dealt
with one by one, whatever their length.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting

#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe object textarea select head title canvas annotation annotation-xml".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd".split())
TAGS = "nav header footer aside article main section form ul li p h1 h2 table blockquote figure button".split()
#: Words of class, id and role that speak for the article, and against it.
FOR = frozenset("article articlebody content post entry story main text body prose page".split())
AGAINST = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination links tabs",
    "frame": "header footer masthead topbar bottom copyright legal branding",
    "side": "sidebar aside rail widget related recommended recirc trending popular",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo banner adsense",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall toast",
    "reader": "comment comments reply replies disqus discussion respond review reviews share social",
    "form": "form login search searchbox feedback poll",
}
_WORDS = {w: k for k, names in AGAINST.items() for w in names.split()}
#: An open element of the key ends where one of its values starts.
ENDS = {"p": "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th tr", "th": "td th tr", "option": "option"}
_ENDS = {k: frozenset(v.split()) for k, v in ENDS.items()}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SEED, PAGES = 42, 1200


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "words", "chars", "links", "stops", "nodes", "kids", "depth")

    def __init__(self, tag: str, parent: Node | None, words: frozenset[str]):
        self.tag, self.parent, self.words = tag, parent, words
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.parts: list = []  # texts and children, in order
        self.chars = self.links = self.stops = self.kids = 0
        self.nodes = 1
        if parent:
            parent.children.append(self)
            parent.parts.append(self)


def _attr_words(attrs: str) -> frozenset[str]:
    if "=" not in attrs:
        return frozenset()
    return frozenset(w.lower() for m in _ATTR.finditer(attrs) for w in _SPLIT.findall(m[1] or m[2] or m[3] or ""))


def parse(page: str) -> list[Node]:
    """All nodes, parents first; the first is the root."""
    root = Node("#root", None, frozenset())
    nodes, open_, links, at = [root], [(root, "#root")], 0, 0
    held: Counter = Counter()  # open elements by name
    blocks: list[int] = []  # places of open elements that aren't inline

    def close(i: int) -> int:
        """Ends the open elements from the i-th on; how many links that ends."""
        names = [t for _, t in open_[i:]]
        held.subtract(names)
        del open_[i:]
        while blocks and blocks[-1] >= i:
            blocks.pop()
        return names.count("a")

    def text(s: str) -> None:
        if s:
            node = open_[-1][0]
            s = unescape(s)
            node.parts.append(s)
            n = len(s.strip())
            node.chars += n
            node.stops += s.count(".") + s.count(",")
            if links:
                node.links += n

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if held[name] > 0:
                links -= close(next(i for i in range(len(open_) - 1, 0, -1) if open_[i][1] == name))
            continue
        if name in HIDDEN:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            # an svg element may end in its own tag, and head may lack its end tag
            if not ((m[3] or m[6] or "").endswith("/") and name == "svg") and not (name == "head" and not end):
                at = end.end() if end else len(page)
            continue
        if name == "br":
            open_[-1][0].parts.append(" ")
        if name in VOID:
            if name == "hr":
                nodes.append(Node("hr", open_[-1][0], frozenset()))
            continue
        if blocks and name in _ENDS.get(open_[blocks[-1]][1], ()):
            links -= close(blocks[-1])
        attrs = m[3] or m[6] or ""
        words = _attr_words(attrs)
        if name in INLINE and not (name == "span" and any(w in _WORDS for w in words)):
            if (m[3] or m[6] or "").endswith("/") and name[0] == "m":  # as <mspace/>
                continue
            open_.append((open_[-1][0], name))
            held[name] += 1
            links += name == "a"
        else:
            node = Node(name, open_[-1][0], words)
            nodes.append(node)
            if name not in INLINE:
                blocks.append(len(open_))
            open_.append((node, name))
            held[name] += 1
    text(page[at:])
    return nodes


def features(nodes: list[Node]) -> list[list[float]]:
    for n in reversed(nodes):
        if n.parent:
            p = n.parent
            p.chars += n.chars
            p.links += n.links
            p.stops += n.stops
            p.nodes += n.nodes
            p.kids += n.tag == "p"
    total = max(nodes[0].chars, 1)
    out, above, place = [], {}, {}
    for n in nodes:
        kinds = {_WORDS[w] for w in n.words if w in _WORDS}
        good = bool(n.words & FOR)
        up = above.get(id(n.parent), (frozenset(), 0, 0))
        bad_up, good_up, art = up
        inside = art or n.tag in ("article", "main")
        above[id(n)] = (bad_up | kinds | ({n.tag} & {"nav", "header", "footer", "aside", "form"}), good_up or good, inside)
        sib = n.parent.children if n.parent else nodes[:1]
        i = place.get(id(n.parent), 0)
        place[id(n.parent)] = i + 1
        chars = max(n.chars, 1)
        out.append(
            [n.tag == t for t in TAGS]
            + [k in kinds for k in AGAINST]
            + [k in bad_up for k in AGAINST]
            + [t in bad_up for t in ("nav", "header", "footer", "aside", "form")]
            + [good, good_up, inside, np.log1p(n.chars), n.links / chars, n.nodes / chars, n.stops / chars, n.chars / total]
            + [n.chars / max(n.parent.chars if n.parent else n.chars, 1), n.depth, i / len(sib), len(sib), n.kids, len(n.children)]
        )
    return out


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The best labelling in which a dropped node's descendants are dropped; a node weighs by its subtree's text."""
    index = {id(n): i for i, n in enumerate(nodes)}
    weight = [float(np.log1p(n.chars)) for n in nodes]
    keep, drop = [0.0] * len(nodes), [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        own = [index[id(c)] for c in nodes[i].children]
        gain = weight[i] * float(odds[i]) / 2
        keep[i] = gain + sum(max(keep[c], drop[c]) for c in own)
        drop[i] = -gain + sum(drop[c] for c in own)
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[index[id(nodes[i].parent)]] and keep[i] > drop[i]
    return kept


def assemble(nodes: list[Node], kept: list[bool]) -> str:
    """The kept blocks in page order, each with its white space turned into single blanks."""
    keep = {id(n) for n, k in zip(nodes, kept) if k}
    blocks, run, stack = [], [], [iter([nodes[0]])]

    def end() -> None:
        if line := " ".join("".join(run).split()):
            blocks.append(line)
        run.clear()

    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            end()
        elif isinstance(part, str):
            run.append(part)
        elif id(part) in keep:
            if part.tag != "span":
                end()
            stack.append(iter(part.parts))
        elif part.tag != "span":
            end()
    return "\n".join(blocks)


def sample_pages(n: int, seed: int = SEED) -> Iterator[tuple[str, str]]:
    return (sample_page(i, seed) for i in range(n))


def sample_page(number: int, seed: int = SEED) -> tuple[str, str]:
    """A made-up page and the mark § that the article's text carries, and whatever else holds text does not."""
    r = random.Random(seed * 1_000_003 + number)
    syl = "an ber co da en fi ga hor in ja ko lu mi no or pa qui re sta tu ve wo xa yi zo".split()
    word = lambda: "".join(r.choices(syl, k=r.randint(1, 4)))
    prose = lambda k, m="": " ".join(m + word() + r.choice(["", "", "", ",", "."]) for _ in range(k))
    link = lambda m="": f'<a href="/{word()}">{m}{word()}</a>'
    cls = lambda kind: f' {r.choice(["class", "id"])}="{r.choice(AGAINST[kind].split())}{r.choice(["", "-" + word(), " " + word(), str(r.randint(1, 9))])}"'

    def menu() -> str:
        tag, attr = r.choice([("nav", ""), ("nav", cls("menu")), ("div", cls("menu")), ("ul", cls("menu"))])
        items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 9)))
        return f"<{tag}{attr}>{items if tag == 'ul' else f'<ul>{items}</ul>' if r.random() < 0.8 else ' '.join(link() for _ in range(6))}</{tag}>"

    def side(kind: str) -> str:
        tag = {"side": r.choice(["aside", "div", "section"]), "form": r.choice(["form", "form", "div"])}.get(kind, r.choice(["div", "div", "section", "aside"]))
        body = r.choice([lambda: prose(r.randint(2, 25)), lambda: f"<p>{prose(r.randint(3, 60))}</p>" * r.randint(1, 3), lambda: f"<h3>{prose(3)}</h3><ul>" + f"<li>{link()}</li>" * 4 + "</ul>"])()
        if kind == "reader":
            body = "".join(f"<{t}{cls('reader') if r.random() < 0.7 else ''}><b>{word()}</b><p>{prose(r.randint(3, 50))}</p></{t}>" for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 5)))
        if kind == "form":
            body = f"<label>{prose(3)}</label><input name=q><button>{word()}</button>"
        bare = tag in ("aside", "form") and r.random() < 0.5
        return f"<{tag}{'' if bare else cls(kind)}>{body}</{tag}>"

    def frame(tag: str) -> str:
        t, attr = r.choice([*[(tag, "")] * 3, (tag, cls("frame")), ("div", f' class="{tag}"'), ("div", f' id="site-{tag}"')])
        return f"<{t}{attr}>{r.choice(['&copy; ', ''])}{prose(r.randint(2, 20))}{r.choice(['', menu(), f'<p>{prose(8)}</p>'])}</{t}>"

    m = "§"
    body = []
    for _ in range(r.choice([1, 1, 2, 3, 5, 9, 15])):
        kind = r.random()
        if kind < 0.75:
            p = prose(r.choice([1, 5, 8, 20, 60, 150]), m)
            body.append(f"<p>{p}</p>" if r.random() < 0.7 else f"<p><b>{p}<br>" if r.random() < 0.5 else f"<p>{p} {link(m)} {prose(5, m)}")
        elif kind < 0.82:
            body.append(f"<ul>{''.join(f'<li>{prose(6, m)}</li>' for _ in range(4))}</ul>")
        elif kind < 0.88:
            body.append(f"<h2>{prose(4, m)}</h2>")
        elif kind < 0.92:
            body.append(f"<blockquote>{prose(20, m)}</blockquote>")
        elif kind < 0.94:
            body.append(f"<table><tr><td>{prose(3, m)}</td><td>{prose(2, m)}</td></tr></table>")
        else:
            body.append(side(r.choice(["advert", "advert", "reader", "side", "notice", "form"])))
    head = r.choice(["", f"<h1>{prose(6, m)}</h1>", f"<h1>{prose(8, m)}</h1>", f"<header><h1>{prose(6, m)}</h1></header>"])
    good = r.choice(sorted(FOR))
    wrap = r.choice([("<article>", "</article>")] * 3 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), (f'<div class="{good}">', "</div>"), (f'<div id="{good}-{word()}">', "</div>"), (f'<section class="{good}">', "</section>"), ("<div>", "</div>"), (f'<article class="{good}">', "</article>")])
    main = wrap[0] + head + "".join(body) + wrap[1]
    before = [x for x in (frame("header"), menu(), side("advert"), side("notice")) if r.random() < 0.5]
    after = [x for x in (side("side"), side("reader"), side("advert"), side("form"), side("notice"), frame("footer")) if r.random() < 0.5]
    for _ in range(r.choice([0, 0, 1, 2, 4])):
        main = f'<div{r.choice(["", f" class={word()}"])}>{main}</div>'
    bare = lambda: r.choice([lambda: "<ul>" + f"<li>{link()}</li>" * r.randint(2, 6) + "</ul>", lambda: f"<div{r.choice(['', f' class={word()}'])}>" + f"{link()} " * r.randint(2, 8) + "</div>"])()
    if r.random() < 0.15:
        before.insert(0, bare())
    if r.random() < 0.15:
        after.append(bare())
    inner = "".join([*before, main, *after])
    if r.random() < 0.06:
        inner = f"<table><tr><td>{'<br>'.join(link() for _ in range(r.randint(2, 6)))}</td><td>{main}</td></tr></table>"
    if r.random() < 0.3:
        inner = f'<div class="{r.choice(["page", "wrapper", "container", word()])}">{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{prose(4)}</title></head><body>{inner}</body></html>", m


def labelled_nodes(number: int) -> tuple[np.ndarray, np.ndarray]:
    """A made-up page's nodes: their features, and whether they hold any of the article's text."""
    page, mark = sample_page(number)
    nodes = parse(page)
    x, held = features(nodes), {}
    for n in reversed(nodes):
        held[id(n)] = any(mark in p if isinstance(p, str) else held[id(p)] for p in n.parts)
    return np.array(x, np.float64), np.array([held[id(n)] for n in nodes], np.float64)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = zip(*map(labelled_nodes, batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in y], pa.binary())], ["id", "x", "y"])


@lru_cache(maxsize=1)
def _trained(spark: SparkSession | None) -> boosting.Trees:
    if spark is None:
        parts = [labelled_nodes(i) for i in range(PAGES)]
    else:
        rows = sorted(spark.range(0, PAGES, 1, 24).mapInArrow(_samples, "id long, x binary, y binary").collect())
        parts = [(np.frombuffer(r["x"]).reshape(-1, len(r["x"]) // len(r["y"])), np.frombuffer(r["y"])) for r in rows]
    x, y = (np.concatenate(p) for p in zip(*parts))
    return boosting.train(x, y, 60, 5, .2)


def model(spark: SparkSession | None = None) -> boosting.Trees:
    return _trained(spark)


def extract(pages: list[str | None], trees: boosting.Trees) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    rows = [f for nodes in parsed for f in features(nodes)]
    odds, at, out = boosting.predict(trees, np.array(rows, float)) if rows else np.zeros(0), 0, []
    for nodes in parsed:
        out.append(assemble(nodes, decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    trees = model(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                text = extract(part.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
