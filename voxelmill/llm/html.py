"""Main-text extraction with a tree-structured graphical model.

Every block element and every run of text between block boundaries is a node of the
page's tree: a run of text is content or not, a block holds content or doesn't. The
potential of a single node comes from its own tag, names and direct text, that of
parent and child from their tags, and no block holds content while nothing in it does.
Sum-product messages, first upward, then downward, give each node's marginal. All potentials are learned together: the likelihood of the
states of whole labelled trees is maximised, with the same messages for its slope.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A quoted value ends where a quote ends a value; a quote that nothing closes is a character of the tag, which then ends at its first >.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[\"'])*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: The attribute by which labelled pages mark an element and all below it: 1 content, 0 not.
LABEL_ATTRIBUTE = "data-content"
_LABELLED = re.compile(LABEL_ATTRIBUTE + r"\s*=\s*[\"']?([01])")

#: Elements whose content is no text of the page.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed"}
HIDDEN = RAW | {"head", "svg", "select", "option", "button", "datalist"}
#: Hidden elements that the next of these ends, if they are still open.
_UNCLOSED = {"select", "option", "button", "datalist"}
_AFTER = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "main", "ul", "ol", "table", "blockquote", "footer"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = {
    "html", "body", "div", "p", "article", "section", "main", "nav", "header", "footer", "aside", "form", "fieldset", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr",
    "td", "th", "caption", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "figcaption", "details", "summary", "address", "hr", "menu", "dialog", "center", "legend", "hgroup", "search",
}
#: A start tag of the first kind ends an open element of the second.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "nav", "aside", "body"}


@dataclass
class Node:
    parent: int
    tag: str
    words: tuple[str, ...] = ()
    text: str | None = None
    chars: int = 0
    linked: int = 0
    stops: int = 0
    label: int | None = None
    within: bool = False
    children: list[int] = field(default_factory=list)


def _squeeze(text: str) -> str:
    return " ".join(_html.unescape(text).split())


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents before children; text nodes have ``text``. Broken markup is read as far as it goes."""
    nodes = [Node(-1, "root")]
    stack: list[tuple[str, int, bool]] = [("root", 0, False)]  # tag, node, hidden
    open_at: dict[str, list[int]] = {}  # places in the stack of open elements of each tag
    open_blocks: list[int] = []
    pieces: list[str] = []
    linked: list[int] = []
    links = 0
    at, size = 0, len(page)

    def flush() -> None:
        if pieces:
            text = _squeeze("".join(pieces))
            if text:
                above = stack_node()
                stops = sum(text.count(c) for c in ".!?;:…。")
                nodes.append(Node(above, "#text", text=text, chars=len(text), linked=min(sum(linked), len(text)), stops=stops, label=nodes[above].label))
                nodes[above].children.append(len(nodes) - 1)
            pieces.clear()
            linked.clear()

    def stack_node() -> int:
        return stack[-1][1]

    def pop_to(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            tag = stack.pop()[0]
            open_at[tag].pop()
            if tag in BLOCK:
                open_blocks.pop()
            if tag == "a":
                links -= 1

    def last(tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags, or 0."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def take(text: str) -> None:
        if text and not stack[-1][2]:
            pieces.append(text)
            if links:
                linked.append(len(text.strip()))

    while at < size:
        found = _MARKUP.search(page, at)
        if not found:
            take(page[at:])
            break
        take(page[at : found.start()])
        at = found.end()
        close, tag, attributes = found[1], found[2], found[3]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                take(found[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if close:
            place = last((tag,))
            if tag in BLOCK:
                flush()
            elif place and open_blocks and open_blocks[-1] > place:
                place = 0  # an inline end tag doesn't end blocks
            if place:
                pop_to(place)
            elif tag == "br":
                take(" ")
            continue
        if tag in BLOCK:
            flush()
            # a paragraph ends where the next block begins; what was inline in it too
            if tag in _AFTER and stack[-1][2] and (place := last(_UNCLOSED)):
                pop_to(min(open_at[t][0] for t in _UNCLOSED if open_at.get(t)))
            place = open_blocks[-1] if open_blocks else 0
            if place and stack[place][0] == "p" or place and tag[0] == "h" and stack[place][0] in ("h1", "h2", "h3", "h4", "h5", "h6") and tag[1:].isdigit():
                pop_to(place)
            if tag in _ENDS:
                while (place := last(_ENDS[tag])) > last(_SCOPE):
                    pop_to(place)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        if tag in VOID:
            if tag in ("br", "img", "wbr"):
                take(" " if tag != "wbr" else "")
            continue
        # <a href=/> isn't closed, its value is a slash
        if attributes.endswith("/") and attributes[-2:-1] in ("", " ", '"', "'") and tag not in BLOCK and tag not in HIDDEN:
            continue
        hidden = stack[-1][2] or tag in HIDDEN
        node = stack_node()
        if tag in BLOCK:
            label = _LABELLED.search(attributes)
            words = _names(attributes) if "=" in attributes else ()
            nodes.append(Node(node, tag, words, label=int(label[1]) if label else nodes[node].label))
            nodes[node].children.append(len(nodes) - 1)
            node = len(nodes) - 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        links += tag == "a"
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            open_blocks.append(len(stack))
        stack.append((tag, node, hidden))
    flush()
    for k in range(len(nodes) - 1, 0, -1):
        nodes[nodes[k].parent].chars += nodes[k].chars
    for node in nodes[1:]:
        above = nodes[node.parent]
        node.within = above.within or above.tag in ("article", "main")
    return nodes


def _names(attributes: str) -> tuple[str, ...]:
    """Features of the class, id and role: every word, and the parts of those that are made of several."""
    found = set()
    for m in _NAMED.finditer(attributes):
        for word in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in _TOKEN.findall(word)]
            if len(parts) == 1:
                found.add(f"name {parts[0]}")
            elif parts:
                found.add("name " + "-".join(parts))
                found.update(f"part {p}" for p in parts)
    return tuple(sorted(found))


def _features(node: Node) -> tuple[str, ...]:
    """Of a block its tag and names, of a text its length, links and stops; neither counts what lies below or above as its own."""
    place = "within" if node.within else "outside"
    if node.text is None:
        return (f"block {node.tag}", f"block {node.tag} {place}", f"block {node.tag} {'named' if node.words else 'bare'}", *node.words)
    share = node.linked / node.chars if node.chars else 0.0
    density = "none" if share == 0 else "some" if share < 0.3 else "much" if share < 0.8 else "all"
    size = sum(node.chars >= s for s in (20, 60, 150, 400))
    return (f"text links {density}", f"text links {density} {place}", f"text size {size} {'stops' if node.stops else 'plain'}", f"text sign {'©' in node.text}")


def _joints(parent: str, child: str) -> tuple[str, str, str]:
    return "any", f"under {parent}", f"{parent} > {child}"


@dataclass(frozen=True)
class PageModel:
    """Log-potentials: of state 1 against 0 for each feature of a node, and of the four joint states for each of a parent and child."""

    weights: dict[str, float]
    joint: dict[str, tuple[float, float, float, float]]

    def unary(self, node: Node) -> float:
        return sum(self.weights.get(f, 0.0) for f in _features(node))

    def pair(self, parent: str, child: str) -> tuple[tuple[float, float], tuple[float, float]]:
        """Potentials by the parent's state, then the child's."""
        a, b, c, d = (float(np.exp(sum(v))) for v in zip(*(self.joint.get(f, (0.0,) * 4) for f in _joints(parent, child)), strict=True))
        return (a, b), (c, d)

    def marginals(self, nodes: list[Node], known: dict | None = None) -> list[float]:
        """Chance of state 1 for every node, by one upward and one downward pass of sum-product messages; blocks without text have none."""
        n = len(nodes)
        known = {} if known is None else known
        up0, up1 = [1.0] * n, [1.0] * n  # product of potentials and messages from below
        low, high = [1.0] * n, [1.0] * n  # message to the parent, in its two states
        barren, none = [0.0] * n, [0.0] * n  # log-chance that this node, and that all below it, are 0 if what is above is 1
        joint: list = [None] * n
        for k in range(n - 1, -1, -1):
            node = nodes[k]
            if not node.chars:
                continue
            if node.text is None:
                key = (node.tag, node.words, node.within)
            else:
                key = (node.chars if node.chars < 400 else 400, node.linked * 10 // node.chars, node.linked > 0, node.stops > 0, node.within, "©" in node.text)
            ratio = known.get(key)
            if ratio is None:
                ratio = known[key] = float(np.exp(np.clip(self.unary(node), -30, 30)))
            a, b = up0[k], up1[k] * ratio
            if node.text is None:
                b *= -math.expm1(none[k])  # not all below are 0
            total = a + b
            up0[k], up1[k] = a, b = a / total, b / total
            if k:
                p = node.parent
                key = (nodes[p].tag, node.tag)
                psi = known.get(key)
                if psi is None:
                    psi = known[key] = self.pair(*key)
                joint[k] = psi
                low[k] = a * psi[0][0] + b * psi[0][1]
                high[k] = a * psi[1][0] + b * psi[1][1]
                barren[k] = -math.log1p(b * psi[1][1] / max(a * psi[1][0], 1e-300))
                none[p] += barren[k]
                up0[p] *= low[k]
                up1[p] *= high[k]
                scale = up0[p] + up1[p]
                up0[p] /= scale
                up1[p] /= scale
        out = [0.0] * n
        out[0] = up1[0] if nodes[0].chars else 0.0
        for k in range(1, n):
            psi = joint[k]
            if psi is None:
                continue
            p = nodes[k].parent
            # the parent's belief without this child's message
            c0, c1 = (1 - out[p]) / max(low[k], 1e-300), out[p] / max(high[k] * -math.expm1(none[p]), 1e-300)
            others = -math.expm1(min(0.0, none[p] - barren[k]))
            d0, d1 = c0 * psi[0][0] + c1 * psi[1][0] * others, c0 * psi[0][1] + c1 * psi[1][1]
            a, b = up0[k] * d0, up1[k] * d1
            out[k] = b / (a + b) if a + b else 0.0
        return out

    def extract(self, page: str | None, known: dict | None = None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        chances = self.marginals(nodes, known)
        return "\n\n".join(n.text for n, c in zip(nodes, chances, strict=True) if n.text is not None and c >= 0.5)


def _sparse(rows: list[tuple[str, ...]], least: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of the features that at least ``least`` rows have, and the (row, feature) places where they occur."""
    count: dict[str, int] = {}
    for row in rows:
        for f in row:
            count[f] = count.get(f, 0) + 1
    names = sorted(f for f, c in count.items() if c >= least)
    number = {f: i for i, f in enumerate(names)}
    places = [(k, number[f]) for k, row in enumerate(rows) for f in row if f in number]
    owner, feature = np.array(places, dtype=np.int64).reshape(-1, 2).T
    return names, owner, feature


def _spread(index: np.ndarray, tables: np.ndarray, size: int) -> np.ndarray:
    """Sum of the 2 x 2 tables that go to each place."""
    return np.stack([np.bincount(index, weights=column, minlength=size) for column in tables.reshape(-1, 4).T], axis=1).reshape(size, 2, 2)


def fit(pages: Iterable[str], steps: int = 300, ridge: float = 0.05, least: int = 3) -> PageModel:
    """Learn potentials from pages whose elements are marked by ``data-content`` (inherited downward; unmarked: not content).

    A text's state is its label; a block's is 1 if any text below it is content. The
    states of all trees are observed, so the slope of their likelihood is what was seen
    minus the marginals that messages give, for single nodes and for pairs alike. It is
    followed by steps with momentum (Adam); ``ridge`` holds weights near zero, and
    features that fewer than ``least`` nodes have get none.
    """
    rows, joints, parent, depth, states = [], [], [], [], []
    for page in pages:
        nodes = parse(page)
        place = {}
        inside = [int(n.text is not None and n.label == 1) for n in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            inside[nodes[k].parent] |= inside[k]
        for k, node in enumerate(nodes):
            if node.chars:
                place[k] = len(rows)
                rows.append(_features(node))
                states.append(inside[k])
                joints.append(_joints(nodes[node.parent].tag, node.tag) if k else ())
                parent.append(place[node.parent] if k else -1)
                depth.append(depth[parent[-1]] + 1 if k else 0)
    if not rows:
        return PageModel({}, {})
    names, owner, feature = _sparse(rows, least)
    kinds, joint_owner, joint_feature = _sparse(joints, least)
    n, y = len(rows), np.array(states)
    up_to, level = np.array(parent), np.array(depth)
    levels = [np.flatnonzero(level == d) for d in range(level.max() + 1)]
    inner = np.flatnonzero(up_to >= 0)
    seen = np.zeros((n, 2, 2))
    seen[inner, y[up_to[inner]], y[inner]] = 1
    blocks = np.array([r[0].startswith("block") for r in rows])
    some = lambda none: np.log(np.maximum(-np.expm1(np.minimum(none, 0.0)), 1e-300))  # not all of them are 0
    values = [np.zeros(len(names)), np.zeros((len(kinds), 2, 2))]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for step in range(1, steps + 1):
        score = np.zeros((n, 2))
        score[:, 1] = np.bincount(owner, weights=values[0][feature], minlength=n)
        psi = _spread(joint_owner, values[1][joint_feature], n)
        message, barren, none = np.zeros((n, 2)), np.zeros(n), np.zeros(n)
        for at in reversed(levels):
            held = at[blocks[at]]
            score[held, 1] += some(none[held])
            if at is levels[0]:
                break
            message[at] = np.logaddexp(*np.moveaxis(score[at][:, None, :] + psi[at], 2, 0))
            barren[at] = score[at, 0] + psi[at, 1, 0] - message[at, 1]
            none += np.bincount(up_to[at], weights=barren[at], minlength=n)
            for state in (0, 1):
                score[:, state] += np.bincount(up_to[at], weights=message[at, state], minlength=n)
        belief = np.zeros((n, 2))
        both = np.zeros((n, 2, 2))
        for d, at in enumerate(levels):
            if d:
                rest = belief[up_to[at]] - message[at]
                rest[:, 1] -= some(none[up_to[at]])
                both[at] = rest[:, :, None] + psi[at] + score[at][:, None, :]
                both[at, 1, 0] += some(none[up_to[at]] - barren[at])
                belief[at] = np.logaddexp(both[at][:, 0], both[at][:, 1])
            else:
                belief[at] = score[at]
            total = np.logaddexp(belief[at][:, 0], belief[at][:, 1])
            belief[at] -= total[:, None]
            both[at] -= total[:, None, None]
        error = y - np.exp(belief[:, 1])
        amiss = seen - np.exp(both)
        amiss[up_to < 0] = 0
        slope = _spread(joint_feature, amiss[joint_owner], len(kinds))
        for v, g, (m, s) in zip(values, (np.bincount(feature, weights=error[owner], minlength=len(names)), slope), moments, strict=True):
            g = g - ridge * v
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += 0.15 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    joint = {f: tuple(float(x) for x in table.ravel()) for f, table in zip(kinds, values[1], strict=True)}
    return PageModel({f: float(v) for f, v in zip(names, values[0], strict=True)}, joint)


#: Names that labelled example pages give their parts. Fixed values.
_NOT_CONTENT = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "main-menu", "top-nav", "toc"],
    "header": ["header", "site-header", "masthead", "top-bar", "page-header", "logo", "branding"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon"],
    "aside": ["sidebar", "side", "related", "widget", "recommended", "more-stories", "popular", "tags", "author-box"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "promotion"],
    "notice": ["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "banner", "disclaimer", "privacy"],
    "form": ["form", "search", "newsletter", "subscribe", "login", "signup", "contact-form"],
    "comments": ["comments", "comment", "comment-list", "responses", "replies", "discussion", "reader-comments", "disqus"],
    "share": ["share", "social", "sharing", "follow", "social-links", "tools"],
}
#: Share of example pages that are an article and little else.
PLAIN = 0.4
TINY = 0.1
_CONTENT = ["content", "article", "post", "entry", "entry-content", "post-body", "article-body", "story", "main", "main-content", "text", "body"]


def example_pages(count: int = 600, seed: int = 7) -> list[str]:
    """Labelled pages of many layouts: wrappers, names, order, unclosed tags and lengths vary by a seeded generator."""
    draw = random.Random(seed)
    letters = "etaoinshrdlu"

    def words(lo: int, hi: int) -> str:
        made = ["".join(draw.choice(letters) for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(lo, hi))]
        return " ".join(made)

    def prose(lo: int, hi: int) -> str:
        return ". ".join(words(3, 18).capitalize() for _ in range(draw.randint(lo, hi))) + draw.choice([".", ".", "!", "?"])

    def links(lo: int, hi: int) -> str:
        items = [f'<a href="/{k}">{words(1, 4)}</a>' for k in range(draw.randint(lo, hi))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if draw.random() < 0.7 else draw.choice([" | ", " ", " &middot; "]).join(items)

    def named(kind: str, inner: str, tags: list[str], label: int) -> str:
        names = _CONTENT if kind == "content" else _NOT_CONTENT[kind]
        tag, name = draw.choice(tags), draw.choice(names)
        if draw.random() < 0.3:  # a name made of several words
            name = draw.choice([f"{words(1, 1)}-{name}", f"{name}-{words(1, 1)}", f"{words(1, 1)}_{name}", name + words(1, 1).capitalize(), f"{name}-{draw.randint(1, 99)}"])
        if draw.random() < 0.15:
            name = f"{words(1, 1)} {name}"
        attribute = "" if tag != "div" and draw.random() < 0.5 else f' {draw.choice(["class", "class", "id"])}="{name}"'
        return f'<{tag}{attribute} {LABEL_ATTRIBUTE}="{label}">{inner}</{tag}>'

    def plain() -> str:
        """An article and little else: short or long, with or without wrappers, names and paragraphs."""
        listed = lambda: "<ul>" + "".join(f"<li>{words(1, 8)}</li>" for _ in range(draw.randint(2, 6))) + "</ul>"
        blocks = [draw.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<section><p>{}</p></section>", listed(), "<pre>{}</pre>"]).format(prose(1, draw.choice([1, 2, 6]))) for _ in range(draw.choice([1, 1, 2, 3, 6, 15, 40]))]
        if draw.random() < 0.5:
            blocks.insert(0, draw.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>"]).format(words(1, 7)))
        inner = "".join(blocks) if draw.random() < 0.9 else prose(1, 4)
        for tag in draw.choice([[], [], [], ["article"], ["article"], ["main"], ["main", "article"], ["div"], ["div", "div"], ["div", "article", "div"], ["section"]]):
            name = draw.choice(["", "", "", f' class="{words(1, 1)}"', f' id="{words(1, 1)}"', f' class="{draw.choice(_CONTENT)}"'])
            inner = f"<{tag}{name}>{inner}</{tag}>"
        inner = f'<div {LABEL_ATTRIBUTE}="1">{inner}</div>' if draw.random() < 0.05 else inner
        around = [junk(k) if draw.random() < 0.2 else "" for k in ("nav", "header", "footer", "comments")]
        body = f'<body {LABEL_ATTRIBUTE}="1">{around[0]}{around[1]}{inner}{around[3]}{around[2]}</body>'
        return draw.choice([f"<!DOCTYPE html><html><head><title>{words(1, 4)}</title></head>{body}</html>", f"<html>{body}</html>", body])

    def misleading() -> str:
        """Names of content in which a word for something else is a part, as in a page free of adverts."""
        return draw.choice(["{0}-{1}", "{1}-{0}", "post {0}-{1}", "{1} {0}-{1}"]).format(draw.choice(draw.choice(list(_NOT_CONTENT.values()))), words(1, 1))

    def opening(title: str) -> str:
        """A title with what articles put beside it: their own header, the writer, a figure with its caption."""
        byline = draw.choice(["", "", f"<p>{words(2, 5)}</p>", f'<p class="{draw.choice(["byline", "author", "meta", "date", "entry-meta", "post-meta"])}">{words(2, 6)}</p>', f"<address>{words(2, 4)}</address>"])
        figure = f"<figure><img src=x><figcaption>{draw.choice([words(3, 9), prose(1, 1)])}</figcaption></figure>" if draw.random() < 0.15 else ""
        name = draw.choice(["", "", f' class="{draw.choice(["entry", "post", "article", "story"])}-header"'])
        return f"<header{name}>{title}{byline}</header>{figure}" if title and draw.random() < 0.4 else title + byline + figure

    def closing() -> str:
        """What may end an article: links for further reading, notes, and a footer that is no content."""
        reading = draw.choice(["", "", "", links(1, 6), f"<h3>{words(1, 3)}</h3>{links(2, 5)}", f"<h3>{words(1, 2)}</h3><p>{prose(1, 2)}</p>", f"<h3>{words(1, 1)}</h3><ol>" + "".join(f"<li>{draw.choice([words(2, 6), prose(1, 1)])}</li>" for _ in range(draw.randint(1, 5))) + "</ol>"])
        return reading + (f'<footer {LABEL_ATTRIBUTE}="0">{draw.choice([words(1, 5), prose(1, 1), links(1, 3)])}</footer>' if draw.random() < 0.25 else "")

    def around_all(inner: str) -> str:
        """Pages of some systems put one form around everything."""
        return f'<form {draw.choice(["id", "name", "class"])}="{draw.choice(["aspnetForm", "form1", "mainForm", "Form", words(1, 1)])}" method=post action="/x">{inner}</form>' if draw.random() < 0.08 else inner

    def paragraph() -> str:
        text = prose(1, 6) if draw.random() < 0.75 else draw.choice([words(1, 5), words(2, 12) + ".", words(5, 60), words(20, 120)])
        if draw.random() < 0.2:
            text += f' <a href="/x">{words(1, 3)}</a> {words(1, 6)}.'
        if draw.random() < 0.15:
            return f"<p><b>{text}<br>"
        if draw.random() < 0.08:
            return f'<{(t := draw.choice(["p", "p", "div", "section"]))} class="{misleading()}">{text}</{t}>'
        return f"<p>{text}</p>" if draw.random() < 0.85 else draw.choice([f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li><li>{prose(1, 2)}</li></ul>", f"<h2>{words(2, 6)}</h2><p>{text}</p>", f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", f"<pre>{text}</pre>"])

    def junk(kind: str) -> str:
        if kind == "nav" and draw.random() < 0.2:  # a menu without a name
            return f'<{(t := draw.choice(["div", "div", "p", "center"]))} {LABEL_ATTRIBUTE}="0">{links(2, 8)}</{t}>'
        if kind == "nav":
            return named(kind, links(1, 9), ["nav", "nav", "div", "ul"], 0)
        if kind == "header":
            return named(kind, draw.choice([f"<h1>{words(1, 4)}</h1>", f'<a href="/">{words(1, 3)}</a>', f"<p>{words(2, 6)}</p>" + links(2, 5)]), ["header", "header", "div"], 0)
        if kind == "footer":
            return named(kind, draw.choice(["&copy; ", ""]) + words(1, 5) + draw.choice(["", " &middot; " + prose(1, 2), links(2, 6), f"<p>{prose(1, 2)}</p>"]), ["footer", "footer", "div"], 0)
        if kind == "aside":
            return named(kind, f"<h3>{words(1, 3)}</h3>" + draw.choice([links(3, 8), f"<p>{prose(1, 2)}</p>", links(2, 4) + f"<p>{prose(1, 1)}</p>"]), ["aside", "aside", "div", "section"], 0)
        if kind == "ad":
            return named(kind, draw.choice([prose(1, 2), f'<a href="/buy">{words(2, 6)}</a>', f"<p>{prose(1, 3)}</p>"]), ["div", "div", "section", "aside"], 0)
        if kind == "notice":
            return named(kind, f"<p>{prose(1, 3)}</p>" + draw.choice(["", "<button>ok</button>", '<a href="/privacy">more</a>']), ["div", "div", "section", "dialog"], 0)
        if kind == "form":
            return named(kind, f"<label>{words(1, 4)}</label><input name=q><p>{prose(1, 1)}</p>", ["form", "form", "div"], 0)
        if kind == "share":
            return named(kind, links(2, 5), ["div", "ul"], 0)
        reply = lambda t, under="": f'<{t} class="{draw.choice(["comment", "comment-body", "reply", words(1, 1)])}">' + draw.choice([f"<p>{prose(1, 4)}</p>", f"<p>{prose(1, 3)}</p><p>{prose(1, 2)}</p>", f"<b>{words(1, 2)}</b> {prose(1, 3)}"]) + under + f"</{t}>"
        replies = "".join(reply(t, reply(t) if draw.random() < 0.2 else "") for t in [draw.choice(["div", "li", "article"])] * draw.choice([1, 2, 3, 4, 8, 15]))
        return named("comments", draw.choice([f"<h3>{words(1, 2)}</h3>", f"<h2>{words(1, 2)}</h2>", ""]) + replies, ["div", "section", "ol"], 0)

    pages = []
    for _ in range(count):
        if draw.random() < PLAIN:
            pages.append(plain())
            continue
        title, article = draw.choice([f"<h1>{prose(1, 1)}</h1>", f"<h1>{words(2, 9)}</h1>", f"<h2>{words(2, 9)}</h2>", ""]), ""
        if draw.random() < TINY:  # tiny articles beside large other parts
            title, article = None, draw.choice(["", f"<h1>{words(1, 2)}.</h1>"]) + draw.choice([f"<p>{words(1, 4)}.</p>", f"<p><b>{words(1, 4)}.<br>", f"<p>{words(1, 6)}</p>"])
        for _ in range(draw.choice([1, 2, 3, 5, 8, 12]) if title is not None else 0):
            article += paragraph()
            if draw.random() < 0.04:
                article += junk(draw.choice(["ad", "aside", "share", "form"]))
        article = opening(title) + article + closing() if title is not None else article
        if draw.random() < 0.2:
            article += junk("comments")
        if draw.random() < 0.1:
            article = f'<{(t := draw.choice(["div", "section"]))} class="{misleading()}">{article}</{t}>'
        body = named("content", article, ["article", "article", "article", "main", "div", "div", "section"], 1)
        if draw.random() < 0.4:
            body = f'<{draw.choice(["main", "div", "section"])}>{body}</div>'
        before = [junk(k) for k in ("header", "nav", "notice", "ad", "form") if draw.random() < 0.5]
        after = [junk(k) for k in ("share", "comments", "aside", "ad", "form", "footer", "notice") if draw.random() < 0.45]
        if draw.random() < 0.3:
            before, after = before + after[:2], after[2:]
        page = "".join(before) + body + "".join(after)
        if draw.random() < 0.05:  # laid out by a table
            cells = [f'<td {LABEL_ATTRIBUTE}="0">{draw.choice([links(2, 8), "<br>".join(links(1, 1) for _ in range(3)), words(1, 3)])}</td>', f'<td {LABEL_ATTRIBUTE}="1">{article}</td>']
            page = "".join(before[:1]) + f"<table><tr>{''.join(cells if draw.random() < 0.7 else cells[::-1])}</tr></table>" + "".join(after[:1])
        if draw.random() < 0.3:
            page = f'<div {draw.choice(["class", "id"])}="{draw.choice(["wrapper", "page", "container", "site"])}">{page}</div>'
        if draw.random() < 0.04:  # no article at all
            page = "".join(before + after)
        page = around_all(page)
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 4)}</title></head><body>{page}" + draw.choice(["</body></html>", ""]))
    return pages


def extract_pages(pages: DataFrame, model: PageModel, html_col: str = "html", into: str = "text") -> DataFrame:
    """Add the main text of every page; all rows and columns stay, and ``into`` must be new.

    A null or empty page gives the empty text. Character references are decoded, white
    space inside a block becomes one space, blocks are joined in page order by a blank
    line; a block is kept if its marginal is at least one half.
    """
    if into in pages.columns:
        raise ValueError(f"column {into!r} exists already; name another with into=")
    column = pages.columns.index(html_col)
    schema = pages.withColumn(into, pages[html_col]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            if len(known) > 100_000:
                known.clear()
            texts = [model.extract(page, known) for page in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=[*batch.schema.names, into])

    return pages.mapInArrow(run, schema)
