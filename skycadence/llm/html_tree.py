"""Main text of web pages: a tree-structured graphical model over DOM nodes, with sum-product marginals."""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycadence.llm.shared import documents

SAMPLE, SAMPLE_BYTES = 200, 1 << 16  # pages of the table that are fitted on, at most, and their size
DRAWN = 300  # labelled pages that are drawn from layouts
EPOCHS, STEP = 6, 0.3

_NAME_END = re.compile(r"[\s/>]")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_NAME = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe template svg xmp noembed noframes".split())
_NEVER = frozenset("head script style title textarea noscript iframe template svg select option button object canvas audio video".split()) | {
    "xmp", "noembed", "noframes", "datalist", "map", "form", "input", "label"}
_SECTION = frozenset("html body main article section aside nav header footer div td table form ul ol".split())
_BLOCK = _SECTION | frozenset("""p h1 h2 h3 h4 h5 h6 li dl dt dd blockquote pre figure figcaption tr th thead tbody tfoot caption hr
    address details summary fieldset legend center br option""".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
_ENDED = frozenset(t for tags in _CLOSES.values() for t in tags)
_HOLDS = frozenset("ul ol dl table tbody thead tfoot tr select".split())  # implied ends do not reach past these


@dataclass
class Node:
    tag: str
    parent: int
    names: str = ""
    main: str | None = None
    pieces: list[str] = field(default_factory=list)
    kids: list[int] = field(default_factory=list)


class Scanner:
    """Tags of a page, from front to back. Whatever the markup, every character is looked at a bounded number of times."""

    def __init__(self, source: str):
        self.source, self.size = source, len(source)
        self.known: dict[int, int] = {}  # where a tag ends that meets this quote or bracket outside of quotes; -1 never
        self.stop_from, self.stop_at = 0, -2  # the next quote or bracket from a place on

    def _next_stop(self, at: int) -> int:
        if not (self.stop_at == -1 and at >= self.stop_from) and not self.stop_from <= at <= self.stop_at:
            found = _STOP.search(self.source, at)
            self.stop_from, self.stop_at = at, found.start() if found else -1
        return self.stop_at

    def _tag_end(self, at: int) -> int:
        """Place after the tag's closing bracket; quoted brackets do not count. -1 if the text ends first."""
        met, end = [], -1
        while (stop := self._next_stop(at)) >= 0:
            if stop in self.known:
                end = self.known[stop]
                break
            met.append(stop)
            if self.source[stop] == ">":
                end = stop + 1
                break
            at = self.source.find(self.source[stop], stop + 1) + 1
            if not at:
                break
        self.known.update(dict.fromkeys(met, end))
        return end

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, rest) of the next tag or comment from a place on; the name is empty for a comment."""
        source = self.source
        while (at := source.find("<", at)) >= 0:
            head = source[at + 1:at + 3]
            if head[:1] in ("!", "?"):
                if source.startswith("!--", at + 1):
                    end = source.find("-->", at + 4)
                    return at, end + 3 if end >= 0 else self.size, False, "", ""
                end = source.find(">", at + 2)
                return at, end + 1 if end >= 0 else self.size, False, "", ""
            closing = head[:1] == "/"
            letter = head[1:2] if closing else head[:1]
            if letter.isascii() and letter.isalpha():
                first = at + 1 + closing
                found = _NAME_END.search(source, first)
                if not found:
                    return None
                end = self._tag_end(found.start())
                if end >= 0:
                    return at, end, closing, source[first:found.start()].lower(), source[found.start():end - 1]
            at += 1
        return None


class Open:
    """The elements that are open, with the places of each kind, so that looking one up does not walk the others."""

    def __init__(self):
        self.nodes, self.tags = [0], ["html"]
        self.of_tag: dict[str, list[int]] = {}
        self.blocks, self.held = [], []

    def push(self, node: int, tag: str) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.of_tag.setdefault(tag, []).append(k)
        if tag in _BLOCK:
            self.blocks.append(k)
        if tag in _ENDED or tag in _HOLDS:
            self.held.append(k)

    def pop(self) -> str:
        k, tag = len(self.nodes) - 1, self.tags.pop()
        self.nodes.pop()
        self.of_tag[tag].pop()
        for places in (self.blocks, self.held):
            if places and places[-1] == k:
                places.pop()
        return tag

    def last(self, *tags: str) -> int:
        return max((self.of_tag[t][-1] for t in tags if self.of_tag.get(t)), default=0)


def parse(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, runs): nodes come before their children; runs are (node, text) in page order, (-1, "") ends a block."""
    nodes, runs, there, scan = [Node("html", -1)], [], Open(), Scanner(source)
    last, size = 0, len(source)

    def close(k: int) -> None:
        while len(there.nodes) > k:
            if there.pop() in _BLOCK:
                runs.append((-1, ""))

    found = scan.next(0)
    while True:
        end = found[0] if found else size
        if end > last:
            runs.append((there.nodes[-1], source[last:end]))
        if not found:
            break
        _, last, closing, tag, extra = found
        if tag and closing:
            k = there.last(tag)
            # a cell or table that was opened later is not closed from inside by other tags
            if k and (tag in ("tr", "table", "tbody", "thead", "tfoot") or there.last("td", "th", "table") <= k):
                close(k)
        elif tag:
            if tag in _BLOCK and tag != "br" and there.blocks and there.tags[there.blocks[-1]] == "p":
                close(there.blocks[-1])
            if tag in _CLOSES:
                at = len(there.held) - 1
                while at >= 0:
                    k = there.held[at]
                    if there.tags[k] in _CLOSES[tag]:
                        close(k)
                        if tag not in ("tr", "tbody"):
                            break
                    elif there.tags[k] in _HOLDS and not (tag == "tbody" and there.tags[k] != "table"):
                        break
                    at -= 1
            if tag in _BLOCK:
                runs.append((-1, ""))
            if tag == "html" and len(nodes) == 1:
                found = scan.next(last)
                continue
            node = Node(tag, there.nodes[-1])
            for piece in _ATTRIBUTE.finditer(extra):
                key = piece.group(1).lower()
                if key in ("class", "id", "role"):
                    node.names += " " + (piece.group(2) or piece.group(3) or piece.group(4) or "").lower()
                elif key == "data-main":
                    node.main = piece.group(2)
            nodes[there.nodes[-1]].kids.append(len(nodes))
            nodes.append(node)
            if tag in _RAW:
                stop = re.compile(f"</{tag}\\s*>", re.I).search(source, last)
                last = stop.end() if stop else size
            elif tag not in _VOID and not extra.endswith("/"):
                there.push(len(nodes) - 1, tag)
        found = scan.next(last)
    return nodes, runs


def _bin(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x >= c for c in cuts)


def features(nodes: list[Node], runs: list[tuple[int, str]]) -> list[list[str]]:
    """Of each node: its tag, the words of its class, id and role, and the length and link density of its subtree."""
    text, linked, stops = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for k, piece in runs:
        if k >= 0:
            n = len(piece.strip())
            text[k] += n
            stops[k] += piece.count(".") + piece.count(",")
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent
        if nodes[k].tag == "a":
            linked[k] = text[k]
        text[up] += text[k]
        linked[up] += linked[k]
        stops[up] += stops[k]
    out = []
    for k, node in enumerate(nodes):
        own = ["bias", "tag:" + node.tag, f"size:{_bin(text[k], (1, 25, 100, 400))}",
               f"links:{_bin(linked[k] / text[k] if text[k] else 0, (0.01, 0.3, 0.7))}", f"stops:{_bin(stops[k], (1, 3))}"]
        if node.names:
            own += ["name:" + x for x in set(_NAME.findall(node.names))]
        out.append(own)
    return out


def _kind(node: Node) -> str:
    return "section" if node.tag in _SECTION else "block" if node.tag in _BLOCK else "inline"


@dataclass
class Model:
    unary: dict[str, float]
    pair: dict[str, list[float]]  # by kind of the child: potentials of (parent, child) labels 00, 01, 10, 11

    def marginals(self, nodes: list[Node], feats: list[list[str]]):
        """(P(content), P(parent and child labels)) of every node: messages to the root, then back to the leaves.

        A message is the log-odds a node would have from one side of the tree alone."""
        get = self.unary.get
        own = [sum(get(f, 0.0) for f in fs) if node.tag not in _NEVER else -30.0 for node, fs in zip(nodes, feats)]
        pots = [self.pair[_kind(node)] for node in nodes]
        belief, up = own[:], [0.0] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            p = pots[k]
            up[k] = _ratio(p[2], p[3] + belief[k], p[0], p[1] + belief[k])
            belief[nodes[k].parent] += up[k]
        pairs = [None] * len(nodes)
        for k in range(1, len(nodes)):
            p, below = pots[k], belief[k]
            above = belief[nodes[k].parent] - up[k]
            cells = (p[0], p[1] + below, p[2] + above, p[3] + above + below)
            top = max(cells)
            weights = [math.exp(c - top) for c in cells]
            total = sum(weights)
            pairs[k] = [w / total for w in weights]
            belief[k] += _ratio(p[1], p[3] + above, p[0], p[2] + above)
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, b)))) for b in belief], pairs


def _ratio(a: float, b: float, c: float, d: float) -> float:
    """log((e^a + e^b) / (e^c + e^d))"""
    x = a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))
    y = c + math.log1p(math.exp(d - c)) if c >= d else d + math.log1p(math.exp(c - d))
    return x - y


def fit(pages: list[tuple[list[Node], list[list[str]], list[int]]]) -> Model:
    """Maximum likelihood of the labels by stochastic gradient: observed less expected counts, which the marginals give."""
    model = Model({}, {k: [0.0] * 4 for k in ("section", "block", "inline")})
    squares: dict[str, float] = {}
    pair_squares = {k: [1e-2] * 4 for k in model.pair}
    order = random.Random(4)
    for _ in range(EPOCHS):
        for nodes, feats, labels in order.sample(pages, len(pages)):
            found, pairs = model.marginals(nodes, feats)
            for node, fs, p, y in zip(nodes, feats, found, labels):
                g = y - p
                if node.tag in _NEVER or abs(g) < 1e-3:
                    continue
                for f in fs:
                    squares[f] = squares.get(f, 1e-2) + g * g
                    model.unary[f] = model.unary.get(f, 0.0) * (1 - 1e-5) + STEP * g / math.sqrt(squares[f])
            for k in range(1, len(nodes)):
                cell, kind = 2 * labels[nodes[k].parent] + labels[k], _kind(nodes[k])
                for c in range(4):
                    g = (c == cell) - pairs[k][c]
                    if abs(g) >= 1e-3:
                        pair_squares[kind][c] += g * g
                        model.pair[kind][c] += STEP * g / math.sqrt(pair_squares[kind][c])
    return model


def main_text(source: str, model: Model) -> str:
    nodes, runs = parse(source)
    found, _ = model.marginals(nodes, features(nodes, runs))
    blocks, block = [], []
    for k, piece in runs:
        if k < 0:
            if block:
                blocks.append("".join(block))
                block = []
        elif found[k] >= 0.5:
            block.append(piece)
    blocks.append("".join(block))
    return " ".join(x for b in blocks if (x := " ".join(entities.unescape(b).split())))


# Labelled pages: layouts with main parts marked data-main="1" and other parts "0".

def _layout(rng: random.Random) -> str:
    def word():
        return "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))

    def words(a, b):
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence():
        return words(4, 16).capitalize() + rng.choice(".,.?") + " "

    def prose(a=1, b=5):
        inline = rng.choice(["{}", "{}", "<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "<strong>{}"])
        return "".join(sentence() for _ in range(rng.randint(a, b))) + inline.format(words(1, 4)) + ". " + sentence()

    def links(n, wrap="li"):
        return "".join(f'<{wrap}><a href="/{word()}">{words(1, 3)}</a></{wrap}>' for _ in range(n))

    def name(*options):
        return rng.choice([f' class="{x}"' for x in options] + [f' id="{options[0]}"'])

    def boiler():
        return rng.choice([
            lambda: f'<nav{name("nav", "menu", "site-menu")} data-main="0"><ul>{links(rng.randint(3, 8))}</ul></nav>',
            lambda: f'<ul{name("menu", "navigation", "main-nav")} data-main="0">{links(rng.randint(3, 8))}</ul>',
            lambda: f'<header{name("header", "masthead", "site-header")} data-main="0"><div>{words(1, 4)}</div>{links(3, "span")}</header>',
            lambda: f'<footer{name("footer", "site-footer", "bottom")} data-main="0">&copy; {words(2, 4)} {sentence() * rng.randint(0, 3)}</footer>',
            lambda: f'<footer data-main="0"><p>{sentence()}</p>{links(3, "span")}</footer>',
            lambda: f'<aside{name("sidebar", "aside", "widget", "side")} data-main="0"><h3>{words(1, 3)}</h3><p>{sentence()}</p><ul>{links(4)}</ul></aside>',
            lambda: f'<div{name("sidebar", "widget", "right-column", "side")} data-main="0"><h4>{words(1, 3)}</h4><p>{prose(0, 2)}</p></div>',
            lambda: f'<div{name("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")} data-main="0">{rng.choice([sentence(), "<p>" + sentence() + "</p>"])}</div>',
            lambda: f'<div{name("cookie-notice", "notice", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "warning")} data-main="0"><p>{prose(0, 1)}</p></div>',
            lambda: f'<form{name("search", "newsletter", "subscribe", "login")} data-main="0"><label>{words(1, 3)}</label><input><button>{word()}</button></form>',
            lambda: f'<div{name("newsletter", "subscribe", "signup")} data-main="0"><p>{sentence()}</p><form><input></form></div>',
            lambda: f'<div{name("share", "social", "sharing", "tags", "meta", "breadcrumb", "breadcrumbs", "pagination")} data-main="0">{links(3, "span")}</div>',
            lambda: f'<section{name("related", "recommended", "more", "trending")} data-main="0"><h2>{words(1, 3)}</h2><ul>{links(4)}</ul></section>',
            comments,
        ])()

    def comments():
        tag, one = rng.choice([("section", "div"), ("div", "div"), ("ol", "li"), ("div", "article")])
        each = "".join(f'<{one}{name("comment", "reply", "user-comment")}><b>{word()}</b><p>{prose(0, 2)}</p></{one}>' for _ in range(rng.randint(1, 5)))
        return f'<{tag}{name("comments", "comment-list", "responses", "discussion", "reader-comments")} data-main="0"><h3>{words(1, 2)}</h3>{each}</{tag}>'

    def part():
        return rng.choice([
            lambda: f"<p>{prose()}</p>", lambda: f"<p>{prose()}", lambda: f"<p>{prose()}<br>{prose()}</p>", lambda: f"<p>{sentence()}</p>",
            lambda: f"<p>{words(1, 2)}.</p>", lambda: f"<h2>{words(1, 6)}</h2><p>{prose()}</p>", lambda: f"<p><b>{prose()}<br><p>{prose()}",
            lambda: "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote><p>{prose()}</p></blockquote>",
            lambda: f"<div><p>{prose()}</p><p>{prose()}</p></div>", lambda: f"<section><h3>{words(1, 4)}</h3><p>{prose()}</p></section>",
            lambda: f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", lambda: f"<pre>{words(3, 9)}</pre>",
            lambda: f"<figure><img><figcaption>{sentence()}</figcaption></figure>",
        ])()

    tag, names = rng.choice([("article", ()), ("article", ()), ("article", ("post", "story", "article")), ("main", ()), ("main", ("main", "content")),
                             ("div", ("content", "post-content", "article-body", "entry-content", "story", "main")), ("section", ("article", "story", "post"))])
    inside = [f"<h1>{words(2, 8)}</h1>"] * rng.randint(0, 1) + [part() for _ in range(rng.randint(1, 7))]
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        inside.insert(rng.randint(1, len(inside)), boiler())
    body = f'<{tag}{name(*names) if names else ""} data-main="1">{"".join(inside)}</{tag}>'
    before, after = ("".join(boiler() for _ in range(rng.randint(0, 3))) for _ in range(2))
    if rng.random() < 0.3:
        body = f'<div{name("wrapper", "container", "page", "row", "column")}>{body}{boiler() * rng.randint(0, 1)}</div>'
    return f"<html><head><title>{words(2, 6)}</title><script>x</script></head><body>{before}{body}{after}</body></html>"


def labelled(source: str) -> tuple[list[Node], list[list[str]], list[int]]:
    """Nodes, features and labels: a node has the label of the nearest marked node; without any, 1 in article or main."""
    nodes, runs = parse(source)
    marked = any(n.main for n in nodes)
    labels = [0] * len(nodes)
    for k, node in enumerate(nodes):
        up = labels[node.parent] if k else 0
        if node.tag in _NEVER:
            labels[k] = 0
        elif marked:
            labels[k] = int(node.main) if node.main else up
        else:
            labels[k] = int(up or node.tag in ("article", "main")) * (node.tag not in ("nav", "aside", "footer", "header"))
    return nodes, features(nodes, runs), labels


def drawn_pages() -> list[str]:
    rng = random.Random(19)
    return [_layout(rng) for _ in range(DRAWN)]


def sample_pages(pages: DataFrame) -> DataFrame:
    """At most SAMPLE pages that mark their article themselves, by hash of the id."""
    known = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]") & (F.octet_length("html") <= SAMPLE_BYTES))
    picked = known.where("page_id IS NOT NULL").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    return known.select("page_id", "html").join(F.broadcast(picked), "page_id")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page, from its whole html.

    Every element of the parsed tree is a content or non-content variable; potentials couple it to its parent, its own
    evidence is its tag, its class words and its subtree's length and link density. A text belongs to the page's main
    text if its element's marginal is at least one half. Scripts, styles, head, forms and controls never are. Inline
    elements do not split a block. The model is fitted on DRAWN pages drawn from labelled layouts and on at most SAMPLE
    pages of the table that mark their article. NULL or empty html gives an empty text and 0; broken markup is read as
    far as it goes; rows are independent, so NULL or repeated ids do not matter; columns other than page_id, url and
    html are not read; an empty table gives an empty result.
    """
    rows = sorted(r.html for r in sample_pages(pages).collect())
    spread = pages.sparkSession.sparkContext.broadcast(fit([labelled(x) for x in drawn_pages() + rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        for batch in batches:
            texts = [main_text(x.as_py() or "", model) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op10_dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))
