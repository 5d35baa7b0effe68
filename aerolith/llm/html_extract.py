"""HTML extraction: a tree-structured graphical model over DOM blocks, solved by sum-product messages up and down."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import slices

# Fixed values of HTML: elements that make blocks, that never hold text of the page, and what an opening tag closes.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select
summary table tbody td tfoot th thead tr ul""".split())
SILENT = frozenset("script style noscript template iframe object svg textarea title noframes xmp".split())
#: Of these, the ones whose content is markup: skipped only up to an end tag of their own, and inline without one.
NESTED = frozenset("noscript object svg template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
_CLOSES_NO_P = frozenset("button caption dd dt head html body label legend li optgroup option tbody td tfoot th thead tr summary select".split())

#: An open paragraph outside of the innermost of these stays open.
_HOLDS_P = ("button", "table", "td", "th", "caption")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_NAME = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    """A block: its tag, words of its class, id and role, parent, own text runs' totals and its label, if any."""

    tag: str
    names: tuple
    parent: int
    label: int | None = None
    chars: int = 0
    linked: int = 0
    ends: int = 0
    children: list = field(default_factory=list)


def _ends(page: str, at: int, tag: str) -> dict[int, int]:
    """From where each element of ``tag`` begins to where its end tag stops, in one pass; nested ones pair up, those without an end tag are absent."""
    out: dict[int, int] = {}
    begun: list[int] = []
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).finditer(page, at):
        if m.group(1):
            if begun:
                out[begun.pop()] = m.end()
        elif not (tag == "svg" and m.group().endswith("/>")):
            begun.append(m.start())
    return out


def parse(page: str, labelled: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """Blocks of a page in order, parents first, and its text runs (block, text) in page order.

    A run is the text between two block boundaries: inline tags add nothing, a line break is white space.
    Character references are decoded, white space is one space, empty runs are left out. Missing end tags are
    implied as browsers do for paragraphs, list items, table cells and the like; a tag cut by the page's end is dropped.
    Scripts, styles and the like without an end tag run to the page's end, as in browsers; of svg, object, noscript and
    template only elements with an end tag are skipped. Work is linear in the page, however deep it nests. ``labelled``
    pages carry labels in ``data-y``; in others this attribute, like any but class, id and role, means nothing.
    """
    nodes = [Node("html", (), -1)]
    stack: list[tuple[str, int]] = [("html", 0)]
    places: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements in the stack, ascending
    runs: list[tuple[int, str]] = []
    held: list[str] = []
    links = linked = 0
    at, n = 0, len(page)
    ends: dict[str, dict[int, int]] = {}

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                k = stack[-1][1]
                runs.append((k, text))
                node = nodes[k]
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.ends += text[-1] in ".!?…:;\"»”"
        linked = 0

    def shut_from(k: int) -> None:
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            held.append(page[at:start])
            if links:
                linked += start - at
        if start == n:
            break
        m = _TAG.match(page, start)
        if not m:
            held.append("<")
            at = start + 1
            continue
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):  # an end tag
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                if places[tag]:
                    flush()
                    shut_from(places[tag][-1])
            continue
        if tag in NESTED:
            if tag not in ends:
                ends[tag] = _ends(page, m.start(), tag)
            at = ends[tag].get(m.start(), at)
            continue
        if tag in SILENT:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag == "a":
            links += 1
        if tag not in BLOCKS or tag == "html":
            continue
        flush()
        if tag in CLOSES:
            shut, wall = CLOSES[tag]
            above = last(wall)
            first = [x[k] for t in shut for x in (places[t],) if (k := bisect_right(x, above)) < len(x)]
            if first:
                shut_from(min(first))
        elif tag not in _CLOSES_NO_P and last("p") > last(_HOLDS_P):
            shut_from(last("p"))
        if tag in ("body", "head"):
            shut_from(1)
        names, label = (), None
        if "=" in m.group(3):
            found = {a.lower(): b or c or d or "" for a, b, c, d in _ATTR.findall(m.group(3))}
            names = tuple(sorted({w for a in ("class", "id", "role") for w in _NAME.findall(found.get(a, "").lower())}))
            label = int(found["data-y"]) if labelled and "data-y" in found else None
        if tag in VOID:
            continue
        parent = stack[-1][1]
        nodes.append(Node(tag, names, parent, label))
        nodes[parent].children.append(len(nodes) - 1)
        places[tag].append(len(stack))
        stack.append((tag, len(nodes) - 1))
        links = 0 if tag in ("nav", "article", "section", "main") else links
    flush()
    return nodes, runs


def around(nodes: list[Node]) -> list[int]:
    """For every block the characters, outside of links, of its own text and of its children's."""
    out = [node.chars - node.linked for node in nodes]
    for node in nodes[1:]:
        out[node.parent] += node.chars - node.linked
    return out


def unary(node: Node, known: frozenset, held: int, beside: int) -> tuple:
    """Features of one block: tag, names (``known`` ones, else a mark that there are others), coarse measures of its own text, and of the
    text that it and its children (``held``) and its parent's children (``beside``) hold."""
    names = [x for x in node.names if x in known] or ["?"] * bool(node.names)
    size = 0 if not node.chars else min(6, int(math.log2(node.chars + 1)))
    share = 0 if not node.chars else int(3 * node.linked / node.chars)
    return ("bias", "t=" + node.tag, *("n=" + x for x in names), f"z={size}", f"l={share}", f"e={min(node.ends, 1)}", f"t={node.tag} l={share}",
            f"h={min(7, int(math.log2(held + 1) / 1.5))}", f"b={min(7, int(math.log2(beside + 1) / 1.5))}")


def pairwise(node: Node) -> tuple:
    """Kinds of the edge from a block to its parent; each has a 2 x 2 table of potentials."""
    return ("edge", "tag " + node.tag, "named" if node.names else "plain")


@dataclass
class TreeModel:
    """Weights: a number for each unary feature (for content), a table [parent][child] for each edge kind.

    Names of classes and ids outside of ``known`` count as one, so a page of a layout never seen is judged by its structure.
    """

    one: dict[str, float]
    two: dict[str, list]
    known: frozenset = frozenset()

    def marginals(self, nodes: list[Node], edges: bool = False):
        """Content probability of every block, by one sweep of messages to the root and one back.

        With ``edges`` also, for each block, the probabilities of (parent, child) labels. All in log space.
        """
        n = len(nodes)
        one, two = self.one, self.two
        u = [0.0] * n
        table = [None] * n
        held = around(nodes)
        for k, node in enumerate(nodes):
            u[k] = sum(one.get(f, 0.0) for f in unary(node, self.known, held[k], held[node.parent] if k else 0))
            if k:
                a = b = c = d = 0.0
                for f in pairwise(node):
                    w = two.get(f)
                    if w:
                        a += w[0]
                        b += w[1]
                        c += w[2]
                        d += w[3]
                table[k] = (a, b, c, d)
        up, belief = [0.0] * n, u[:]  # up: log ratio sent to the parent; belief: own and all below
        for k in range(n - 1, 0, -1):
            a, b, c, d = table[k]
            up[k] = _log_add(c, d + belief[k]) - _log_add(a, b + belief[k])
            belief[nodes[k].parent] += up[k]
        down = [0.0] * n
        pairs = [None] * n
        for k in range(1, n):
            p = nodes[k].parent
            rest = belief[p] + down[p] - up[k]  # the parent without this child
            a, b, c, d = table[k]
            down[k] = _log_add(b, d + rest) - _log_add(a, c + rest)
            if edges:
                x = [a, b + belief[k], c + rest, d + rest + belief[k]]
                top = max(x)
                e = [math.exp(v - top) for v in x]
                s = sum(e)
                pairs[k] = [v / s for v in e]
        prob = [_sigmoid(belief[k] + down[k]) for k in range(n)]
        return (prob, pairs) if edges else prob


def _log_add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x + math.log1p(math.exp(y - x))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def labelled_pages(pages: int = 480, seed: int = 19) -> list[str]:
    """The labelled pages, written by a seeded rule from usual layouts; ``data-y`` marks blocks as content (1) or not (0).

    Blocks without a mark take their parent's. In some pages the article has no element of its own: its blocks, or its bare text
    between line breaks, stand in the body beside menus and the like. Some wrappers have names that occur once, as names of sites do.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda p: rng.random() < p
    bits = ["an", "ti", "re", "ou", "the", "ver", "lo", "sch", "ción", "é", "ing", "st"]
    word = lambda: "".join(pick(bits) for _ in range(int(rng.integers(1, 4))))
    text = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b)))).capitalize() + pick([".", ".", ".", "", "!"])
    link = lambda: f'<a href="/{word()}">{word()}</a>'
    short = lambda: text(1, 12)

    def menu(tag: str = "nav") -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(2, 8))))
        return f'<{tag} data-y="0"{pick(["", " class=menu", " id=nav", " class=navbar"])}>{pick([f"<ul>{items}</ul>", " ".join(link() for _ in range(4))])}</{tag}>'

    def junk() -> str:
        name = pick(["ad", "ads", "advert", "banner", "promo", "sponsor", "cookie", "notice", "alert", "newsletter", "share", "social", "related", "sidebar", "widget", "breadcrumb", "popup", "subscribe", "disclaimer", "consent"])
        inner = pick([text(2, 14), f"<p>{text(2, 30)}</p>", f"<p>{short()}</p><p>{link()}</p>", f"<ul><li>{link()}</li><li>{link()}</li></ul>", f"<h3>{short()}</h3><p>{text(4, 40)}</p>"])
        return f'<div data-y="0" {pick(["class", "class", "id"])}="{name}{pick(["", "-box", "-wrap", " block"])}">{inner}</div>'

    def comments() -> str:
        t, name = pick(["div", "li", "article"]), pick(["comment", "reply", "comment-body"])
        form = pick([f'<{t} class="{name}"><p>%s</p></{t}>', f'<{t} class="{name}">%s</{t}>', "<p>%s</p>", "<p>%s"])
        each = "".join(form % text(2, 40) for _ in range(int(rng.integers(1, 5))))
        tag = pick(["section", "div", "ol"])
        return f'<{tag} data-y="0" {pick(["id", "class"])}="{pick(["comments", "comment-list", "responses", "discussion", "replies"])}">{pick(["", f"<h2>{short()}</h2>"])}{each}</{tag}>'

    def form() -> str:
        return f'<form data-y="0" action="/s"><label>{short()}</label><input name="q"><button>{word()}</button>{pick(["", f"<p>{short()}</p>"])}<select><option>{word()}<option>{word()}</select></form>'

    def aside() -> str:
        return f'<aside data-y="0">{pick([f"<p>{text(3, 40)}</p>", f"<h3>{short()}</h3><ul><li>{link()}</li></ul>", text(3, 20)])}</aside>'

    def body() -> str:
        longest = pick([20, 35, 90, 90])  # words of a paragraph: some articles have short ones only
        out = [f"<h1>{short()}</h1>"] if some(0.8) else []
        for _ in range(int(rng.integers(1, 12))):
            kind = rng.random()
            if kind < 0.7:
                t = text(1, longest)
                if some(0.2):
                    t = f"<b>{t}"
                if some(0.15):
                    t += " " + link()
                out.append(f"<p>{t}" + pick(["</p>", "</p>", "<br>"]))
            elif kind < 0.78:
                out.append(f"<h{pick('2345')}>{short()}</h2>".replace("</h2>", "") + "</h2></h3></h4></h5>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{text(1, 20)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{text(5, 40)}</p></blockquote>")
            elif kind < 0.92:
                out.append(f"<table><tr><td>{short()}<td>{short()}</table>")
            elif kind < 0.95:
                out.append(f"<pre>{text(3, 20)}</pre>")
            else:
                out.append(f"<figure><figcaption>{text(3, 12)}</figcaption></figure>")
            if some(0.15):
                out.append(pick([junk, aside, form])())
        return "".join(out)

    def head() -> str:
        return f'<header data-y="0">{pick([link(), f"<h2>{short()}</h2>", f"<p>{text(2, 14)}</p>"])}{menu() if some(0.4) else ""}</header>'

    def plain() -> str:
        """A page whose body is the article."""
        inner = body()
        if some(0.4):
            inner = pick(["<br>", "<br><br>", "\n"]).join(text(8, 120) for _ in range(int(rng.integers(1, 7))))
        before, after = "".join(f() for f in (menu, head, junk) if some(0.4)), "".join(f() for f in (junk, aside, comments, form) if some(0.25))
        foot = f'<footer data-y="0">{pick([text(3, 20), f"<p>{text(3, 20)}</p>"])}</footer>' if some(0.5) else ""
        return f'<html><body data-y="1">{before}{inner}{after}{foot}</body></html>'

    def strange() -> tuple[str, str]:
        """A wrapper with a name that says nothing, or none."""
        name = word() + pick(["", "-" + word(), f"-{int(rng.integers(1, 99))}"])
        return pick(["div", "div", "section", "td"]), pick(["", f' class="{name}"', f' id="{name}"', f' class="{name} {word()}"'])

    made = []
    for _ in range(pages):
        if some(0.25):
            made.append(plain())
            continue
        wrap = pick([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="article-body"'), ("div", ' class="entry"'), ("section", ' class="story"'), ("div", ' class="post-text"')])
        wrap = strange() if some(0.25) else wrap
        main = f'<{wrap[0]} data-y="1"{wrap[1]}>{body()}{comments() if some(0.35) else ""}</{wrap[0]}>'
        if some(0.3):
            main = f'<div class="{pick(["container", "wrap", "page", "row", word()])}" data-y="0">{main}{aside() if some(0.4) else ""}</div>'
        before = [pick([menu(), menu("div").replace("<div", '<div class="menu"', 1), ""])]
        before += [head()] if some(0.5) else []
        before += [f() for f in (junk, form, aside) if some(0.4)]
        after = [f() for f in (junk, aside, comments, form) if some(0.35)]
        after += [f'<footer data-y="0">{pick([text(3, 40), f"<p>{text(3, 30)}</p>", " ".join(link() for _ in range(3)), f"&copy; {word()} {text(3, 12)}"])}</footer>'] if some(0.85) else []
        made.append(f'<html><body data-y="0">{"".join(before)}{main}{"".join(after)}</body></html>')
    return made


def train_tree(pages: list[str], epochs: int = 8, rate: float = 0.25, seed: int = 23) -> TreeModel:
    """Likelihood ascent page by page: observed minus expected features, expectations from the model's own messages.

    The result is the mean of the weights after each epoch of the later half, which depends less on the last pages seen.
    """
    data = []
    seen: Counter = Counter()
    for p in pages:
        nodes, _ = parse(p, labelled=True)
        y = []
        for node in nodes:
            y.append(node.label if node.label is not None else y[node.parent] if node.parent >= 0 else 0)
        data.append((nodes, y))
        seen.update({x for node in nodes for x in node.names})
    model = TreeModel({}, {}, frozenset(x for x, k in seen.items() if k >= 3))
    rng = np.random.default_rng(seed)
    one, two = defaultdict(float), defaultdict(lambda: [0.0] * 4)
    later = epochs - epochs // 2
    for epoch in range(epochs):
        lr = rate / (1 + 0.5 * epoch)
        for k in rng.permutation(len(data)):
            nodes, y = data[k]
            prob, pairs = model.marginals(nodes, edges=True)
            held = around(nodes)
            for i, node in enumerate(nodes):
                g = lr * (y[i] - prob[i])
                for f in unary(node, model.known, held[i], held[node.parent] if i else 0):
                    model.one[f] = model.one.get(f, 0.0) * 0.9999 + g
                if i:
                    for f in pairwise(node):
                        w = model.two.setdefault(f, [0.0] * 4)
                        for c in range(4):
                            w[c] -= lr * pairs[i][c]
                        w[2 * y[node.parent] + y[i]] += lr
        if epoch >= epochs - later:
            for f, v in model.one.items():
                one[f] += v / later
            for f, w in model.two.items():
                two[f] = [a + b / later for a, b in zip(two[f], w)]
    return TreeModel(dict(one), dict(two), model.known)


def main_text(page: str, model: TreeModel) -> str:
    nodes, runs = parse(page)
    if not runs:
        return ""
    prob = model.marginals(nodes)
    return "\n\n".join(t for k, t in runs if prob[k] >= 0.5)


def _rows(batches: Iterator[pa.RecordBatch], model: TreeModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [main_text(p, model) if p else "" for p in part.column("html").to_pylist()]
            kept = {c: part.column(c) for c in part.schema.names if c != "html"}
            yield pa.record_batch([*kept.values(), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*kept, "text", "n_chars"])


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple = ("page_id", "url"), labelled: list[str] | None = None) -> DataFrame:
    """The main text of every page: the ``keep`` columns, ``text`` and ``n_chars`` (code points).

    Binary labels of DOM blocks, with potentials for blocks and for parent-child pairs, are learnt on the
    driver from ``labelled`` pages; executors get the weights (a few hundred numbers). A block's text is kept when its content
    marginal is at least one half. Work and memory are linear in a page; nothing crosses pages.

    Null and empty pages, and pages without content, give the empty text; very long and deeply nested pages are read whole, one
    being the least a task holds; repeated rows are read each; an empty table gives no rows; columns other than ``keep`` and
    the page are not read, whatever their names.
    """
    model = pages.sparkSession.sparkContext.broadcast(train_tree(labelled or labelled_pages()))
    own = [f"_k{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(c).alias(k) for c, k in zip(keep, own)], F.col(html_col).alias("html"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "html") + "text string, n_chars long"
    found = rows.mapInArrow(lambda it: _rows(it, model.value), schema)
    return found.select(*[F.col(k).alias(c) for c, k in zip(keep, own)], "text", "n_chars")
