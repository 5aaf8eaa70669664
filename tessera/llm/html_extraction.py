"""Main text of web pages by a tree-structured graphical model over the DOM.

A page's block elements and text runs are nodes of a tree.  Each node has one
of three states: boilerplate, content, or mixed (it holds both).  Potentials
between parent and child, by the child's tag, and potentials of a node's observed traits (all
hints in class, id and role, length of text runs, share of links) are smoothed
counts over labelled pages.  Sum-product messages go up from the leaves and
down from the root; the product at a text run is its marginal, and runs whose
content marginal exceeds one half make the text.

Labelled pages are pages whose elements carry data-y="1" (content) or "0";
`labelled_pages` writes a bounded number of them from layout rules: articles of
one paragraph or of many, with and without hints, in nested wrappers, holding
boxes, and under names that contradict each other.  Any others can be passed to
`train`.  data-y is no trait.

White space inside a block becomes one space, blocks are trimmed and joined in
page order by a line break, and character references are decoded.  Scripts,
styles, titles, form fields and embedded media, drawings and frames hold no text.

Nulls and odd rows: a null or blank html has empty text; broken markup is read
as far as it goes (unclosed elements end with their parent, scripts, styles,
titles and text fields with the page, embedded ones at once; a tag whose quotes
don't match ends at the next ">"); a page of any length is read in its task, in time
in proportion to it, its nodes held at once; repeated rows are
extracted alike; empty tables give no rows.  Only page_id, url and html are
read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .textkit import tidy

TRAINING_PAGES = 800
SMOOTH = 1.0
BACK_OFF = 3.0
OTHER, CONTENT, MIXED = 0, 1, 2

#: HTML's elements that start a block, and those of them that mostly hold runs of text.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
LEAVES = set("button caption dd dt h1 h2 h3 h4 h5 h6 label legend li option p pre td th".split())
#: Words of class, id and role by what they say of an element; each group that fits is evidence.
HINTS = {
    "comment": "comment comments reply replies respond discussion disqus responses reader",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense",
    "notice": "cookie cookies consent notice notices alert modal popup overlay gdpr newsletter subscribe subscription signup paywall warning hidden",
    "side": "sidebar side aside widget widgets related rail recommended recommendations trending popular complementary",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs toc pagination pager tabs skip",
    "foot": "footer foot copyright legal colophon contentinfo",
    "head": "header masthead topbar logo branding",
    "share": "share sharing social tags tools print",
    "form": "form login search contact",
    "main": "article content main post entry story body text prose hentry page",
}
_HINT = {w: kind for kind, ws in reversed(HINTS.items()) for w in ws.split()}
#: Words after which a name says what an element has or lacks, or where it shows, not what it is.
_ABOUT_OTHERS = set("with without has have no not is hide show in on off for to under over after before".split())
_SCREENS = set("xs sm md lg xl print mobile desktop tablet phone".split())
#: Comments, and elements of raw text, run to the end of the page if unclosed.
_RAW = r"<!--.*?(?:-->|(?P<open_comment>\Z))|<(?P<raw>script|style|textarea|title)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|(?P<open_raw>\Z))"
#: Elements that hold no text of the page; of an unclosed one only the tag goes.
_EMBEDDED = r"(?P<embedded>noscript|template|svg|iframe|object|select|audio|video|canvas)(?=[\s/>])(?P<its>[^>]*)>"
_EMBEDDED_TAG = re.compile(r"</?" + _EMBEDDED, re.I)
_NESTING = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title)(?=[\s/>])[^>]*>|<(?P<end>/?)" + _EMBEDDED, re.S | re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in ("script", "style", "textarea", "title")}
#: What begins a tag; an opening tag's attributes are read from there on.
_TOKEN = re.compile(_RAW + r"|<" + _EMBEDDED + r"|<[!?][^>]*>|</(?P<closed>[a-zA-Z][^\s>/]*)[^>]*>|<(?P<opened>[a-zA-Z][^\s>/]*)", re.S | re.I)
#: Attributes up to the tag's end, which may stand in quotes.
_ATTRIBUTES = re.compile(r"((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>", re.S)
#: Tags with unmatched quotes after which a page's quotes are no longer heeded: each is looked for up to the page's end.
MISQUOTED = 16
_ATTRIBUTE = re.compile(r"(?<![-\w])(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LIST_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"form"}}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Node:
    tag: str
    parent: int
    hint: tuple[str, ...] = ("none",)
    label: int | None = None
    text: str = ""
    links: int = 0  # of a run: characters inside links
    length: int = 0  # of all runs below
    linked: int = 0


def _names(value: str) -> Iterator[str]:
    """The hint groups of an attribute's names."""
    for name in _CAMEL.sub("-", value).lower().split():
        parts = _WORD.findall(name)
        for k, w in enumerate(parts):
            about = k and parts[k - 1] in _ABOUT_OTHERS or w in ("hidden", "visible") and k + 1 < len(parts) and parts[k + 1] in _SCREENS
            if w in _HINT and not about and not (k and w in _SCREENS):
                yield _HINT[w]


def _hint(attributes: str) -> tuple[tuple[str, ...], int | None]:
    found, label = set(), None
    if "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            if name.lower() == "data-y":
                label = int(value == "1")
            else:
                found.update(_names(value))
    if _HIDDEN.search(attributes):
        found = {"unseen"}
    return tuple(sorted(found)) or ("none",), label


def _embedded(page: str) -> dict[int, int]:
    """Where each embedded element of a page starts and ends, for those that are closed."""
    ends: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    n_open: Counter[str] = Counter()
    at, limit = 0, page.rfind(">") + 1
    if not _EMBEDDED_TAG.search(page, 0, limit):
        return ends
    # Behind the last ">" no tag ends, so that none is looked for in vain.
    while m := _NESTING.search(page, at, limit):
        at = m.end()
        if m["raw"]:
            # Inside SVG, a title or style may close itself.
            if not (n_open["svg"] and page[at - 2] == "/"):
                closing = _RAW_END[m["raw"].lower()].search(page, at, limit)
                at = closing.end() if closing else limit
        elif m["embedded"]:
            tag = m["embedded"].lower()
            if not m["end"]:
                if not (tag == "svg" and m["its"].endswith("/")):
                    opened.append((tag, m.start()))
                    n_open[tag] += 1
            elif n_open[tag]:
                # What is still open inside ends unclosed.
                while True:
                    last, start = opened.pop()
                    n_open[last] -= 1
                    if last == tag:
                        break
                ends[start] = at
    return ends


def parse(page: str) -> list[Node]:
    """The nodes of a page in page order, parents first; text runs have tag #text."""
    nodes = [Node("#root", -1)]
    stack, run, inside_link, linked = [0], [], 0, 0

    def close_run() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                nodes.append(Node("#text", stack[-1], text=text, links=min(linked, len(text)), label=nodes[stack[-1]].label))
        linked = 0

    def pop_to(depth: int) -> None:
        close_run()
        del stack[depth:]

    embedded = _embedded(page)
    at, end, misquoted = 0, page.rfind(">") + 1, 0
    while m := _TOKEN.search(page, at, end):
        if m.start() > at:
            piece = page[at : m.start()]
            run.append(piece)
            if inside_link:
                linked += len(piece.strip())
        at = embedded.get(m.start(), m.end()) if m["embedded"] else m.end()
        if m["open_comment"] is not None or m["open_raw"] is not None:
            at = len(page)
        opened, closed = m["opened"], m["closed"]
        if opened:
            quoted = _ATTRIBUTES.match(page, at, end) if misquoted < MISQUOTED else None
            misquoted += quoted is None
            attributes = quoted[1] if quoted else page[at : page.index(">", at)]
            at += len(attributes) + 1
            tag = opened.lower()
            if tag == "a":
                inside_link = 1
            elif tag == "br" or tag in ("hr", "img", "input"):
                run.append(" ") if tag != "hr" else close_run()
            elif tag in BLOCK:
                close_run()
                if tag in _CLOSES:
                    for k in range(len(stack) - 1, 0, -1):
                        open_tag = nodes[stack[k]].tag
                        if open_tag in _CLOSES[tag]:
                            pop_to(k)
                            if open_tag == tag or tag in ("dt", "dd", "td", "th"):
                                break
                        elif open_tag in _LIST_SCOPE[tag]:
                            break
                elif (nodes[stack[-1]].tag == "p" and tag not in ("button", "label", "caption", "legend", "optgroup")) or (tag[0] == "h" and nodes[stack[-1]].tag in ("h1", "h2", "h3", "h4", "h5", "h6")):
                    pop_to(len(stack) - 1)
                hint, label = _hint(attributes)
                nodes.append(Node(tag, stack[-1], hint, nodes[stack[-1]].label if label is None else label))
                stack.append(len(nodes) - 1)
        elif closed:
            tag = closed.lower()
            if tag == "a":
                inside_link = 0
            elif tag in BLOCK:
                close_run()
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        pop_to(k)
                        inside_link = 0
                        break
    run.append(page[at:].partition("<!--")[0])
    pop_to(1)
    for k in range(len(nodes) - 1, 0, -1):
        node = nodes[k]
        if node.tag == "#text":
            node.length, node.linked = len(node.text), node.links
        up = nodes[node.parent]
        up.length += node.length
        up.linked += node.linked
    return nodes


def _level(n: int, steps: tuple[int, ...]) -> int:
    return sum(n >= s for s in steps)


def traits(node: Node, parent: Node) -> tuple:
    """What is observed of a node; each entry has its own table of counts."""
    if node.tag == "#text":
        return (("run", parent.tag if parent.tag in LEAVES else "box", _level(node.length, (20, 60, 150, 400)), _level(100 * node.linked // max(1, node.length), (1, 40))),)
    hints = tuple(("hint", h) for h in node.hint)
    # What leaf elements hold is observed at their runs; of the others, only whether links make up most of them.
    return hints if node.tag in LEAVES or not node.length else (*hints, ("links", 100 * node.linked // node.length >= 40))


@dataclass
class TreeModel:
    edges: list[list[float]]  # [parent state][child state], for tags not seen
    root: list[float]
    by_tag: dict[str, list[list[float]]] = field(default_factory=dict)  # the same by the child's tag
    tables: dict[tuple, tuple[float, ...]] = field(default_factory=dict)
    unknown: tuple[float, ...] = (1.0, 1.0, 1.0)

    def local(self, node: Node, parent: Node) -> list[float]:
        out = [1.0, 1.0, 0.0] if node.tag == "#text" else [1.0, 1.0, 1.0]
        for trait in traits(node, parent):
            p = self.tables.get(trait, self.unknown)
            out = [a * b for a, b in zip(out, p, strict=True)]
        return out

    def between(self, node: Node) -> list[list[float]]:
        """The potentials [parent state][own state] of a node."""
        return self.by_tag.get(node.tag, self.edges)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of state CONTENT at each node, by messages up and then down the tree."""
        n = len(nodes)
        belief = [self.local(node, nodes[node.parent]) if k else list(self.root) for k, node in enumerate(nodes)]
        up: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            b = belief[k]
            total = b[0] + b[1] + b[2] or 1.0
            b[0], b[1], b[2] = b[0] / total, b[1] / total, b[2] / total
            message = tuple(e[0] * b[0] + e[1] * b[1] + e[2] * b[2] for e in self.between(nodes[k]))
            up[k] = message
            p = belief[nodes[k].parent]
            p[0] *= message[0]
            p[1] *= message[1]
            p[2] *= message[2]
            if p[0] + p[1] + p[2] < 1e-200:
                p[0], p[1], p[2] = p[0] * 1e200, p[1] * 1e200, p[2] * 1e200
        out = [0.0] * n
        for k in range(n):
            b = belief[k]
            if k:
                p, m, edges = belief[nodes[k].parent], up[k], self.between(nodes[k])
                rest = [x / y if y else 0.0 for x, y in zip(p, m, strict=True)]
                for s in range(3):
                    b[s] *= rest[0] * edges[0][s] + rest[1] * edges[1][s] + rest[2] * edges[2][s]
            total = b[0] + b[1] + b[2] or 1.0
            b[0], b[1], b[2] = b[0] / total, b[1] / total, b[2] / total
            out[k] = b[CONTENT]
        return out

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        return "\n".join(node.text for node, p in zip(nodes, self.marginals(nodes), strict=True) if node.tag == "#text" and p > 0.5)


def states(nodes: list[Node]) -> list[int | None]:
    """The state of each labelled node: what its text runs are, None without any."""
    seen = [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        if nodes[k].tag == "#text":
            seen[k] = 1 << (nodes[k].label or 0)
        seen[nodes[k].parent] |= seen[k]
    return [{0: None, 1: OTHER, 2: CONTENT, 3: MIXED}[s] for s in seen]


def train(pages: list[str], smooth: float = SMOOTH) -> TreeModel:
    """Potentials from labelled pages, as smoothed conditional frequencies.

    A tag's frequency under a parent's state backs off to that under any.
    """
    edge = [[smooth] * 3 for _ in range(3)]
    pairs: dict[str, list[list[int]]] = {}
    root = [smooth] * 3
    counts: dict[tuple, list[float]] = {}
    totals: dict[str, list[float]] = {}
    for page in pages:
        nodes = parse(page)
        state = states(nodes)
        for k, node in enumerate(nodes):
            if state[k] is None:
                continue
            if not k:
                root[state[k]] += 1
                continue
            edge[state[node.parent]][state[k]] += 1
            pairs.setdefault(node.tag, [[0] * 3 for _ in range(3)])[state[node.parent]][state[k]] += 1
            for trait in traits(node, nodes[node.parent]):
                counts.setdefault(trait, [0.0] * 3)[state[k]] += 1
                totals.setdefault(trait[0], [0.0] * 3)[state[k]] += 1
    kinds = {name: sum(t[0] == name for t in counts) for name in totals}
    tables = {t: tuple((c + smooth) / (n + smooth * (kinds[t[0]] + 1)) for c, n in zip(cs, totals[t[0]], strict=True)) for t, cs in counts.items()}
    level = lambda row: [x / sum(row) for x in row]
    edges = [level(r) for r in edge]
    n_state = [sum(c[p][k] for c in pairs.values() for p in range(3)) for k in range(3)]
    by_tag = {}
    for tag, seen in pairs.items():
        often = [(sum(seen[p][k] for p in range(3)) + smooth) / (n_state[k] + smooth * (len(pairs) + 1)) for k in range(3)]
        by_tag[tag] = [[edges[p][k] * (seen[p][k] + BACK_OFF * often[k]) / (edge[p][k] + BACK_OFF) for k in range(3)] for p in range(3)]
    return TreeModel(edges, level(root), by_tag, tables)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 11) -> list[str]:
    """n pages in varied layouts whose elements are labelled by data-y."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstuvwy") for _ in range(rnd.randrange(2, 10)))
    words = lambda a, b: " ".join(word() for _ in range(rnd.randrange(a, b)))
    sentence = lambda: words(5, 18).capitalize() + rnd.choice([".", ".", ".", "?", "!"])
    prose = lambda: " ".join(sentence() for _ in range(rnd.choice([1, 1, 2, 3, 5, 8])))
    link = lambda a=1, b=4: f'<a href="/{word()}">{words(a, b)}</a>'
    pick = rnd.choice

    others = "with-sidebar has-ads no-comments page-header-fixed hide-share hidden-xs page nav-open top-menu has-banner wide side-by-side promo-free".split()

    def some(kind: str) -> str:
        name = pick(HINTS[kind].split())
        more = f" {pick(others)}" if rnd.random() < 0.15 else ""
        if kind != "main" and rnd.random() < 0.08:
            name += f"-{pick(HINTS['main'].split())}"
        return f"{pick(['id', 'class', 'class'])}=\"{pick(['', word() + ' ', word() + '-'])}{name}{pick(['', ' ' + word(), '-' + word()])}{more}\""

    def box(tag: str, kind: str, inner: str) -> str:
        attributes = f" {some(kind)}" if tag in ("div", "section", "ul", "p") or rnd.random() < 0.3 else ""
        if rnd.random() < 0.15:
            inner = f"<div{pick(['', f' class={word()}'])}>{inner}</div>"
        return f'<{tag}{attributes} data-y="0">{inner}</{tag}>'

    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randrange(3, 9))) + "</ul>"
    boilerplate = {
        "menu": lambda: box(pick(["nav", "nav", "div"]), "menu", menu()),
        "head": lambda: box(pick(["header", "div"]), "head", f"<h1>{words(1, 4)}</h1>" + pick([menu(), f"<p>{words(3, 9)}</p>", link()])),
        "foot": lambda: box(pick(["footer", "footer", "div"]), "foot", pick([f"&copy; {words(1, 4)} &middot; {prose()}", f"<p>&copy; {words(2, 6)}</p>{menu()}", " | ".join(link() for _ in range(4)), f"<p>{prose()}</p>"])),
        "side": lambda: box(pick(["aside", "aside", "div", "section"]), "side", f"<h3>{words(1, 4)}</h3>" + pick([menu(), f"<p>{prose()}</p>", "".join(f"<p>{link(3, 8)}</p>" for _ in range(3)), f"<p>{prose()}</p><p>{prose()}</p>"])),
        "ad": lambda: box(pick(["div", "div", "section", "aside"]), "ad", pick([prose(), f"<p>{prose()}</p>", link(2, 8), f"<a href='/x'>{prose()}</a>"])),
        "notice": lambda: box(pick(["div", "section", "p"]), "notice", pick([prose() + " " + link(1, 2), f"{prose()} <button>{words(1, 2)}</button>", prose()])),
        "form": lambda: pick([
            lambda: box("form", "form", f"<label>{words(1, 4)}</label><input type='text'><p>{words(2, 9)}</p><button>{words(1, 2)}</button>"),
            lambda: box(pick(["div", "section"]), pick(["form", "notice"]), pick(["", f"<h3>{words(1, 4)}</h3>", f"<p>{sentence()}</p>"]) + f"<form><label>{words(1, 4)}</label><input type='text'><button>{words(1, 2)}</button></form>"),
        ])(),
        "share": lambda: box(pick(["div", "ul"]), "share", pick([" ".join(link(1, 2) for _ in range(4)), words(2, 6)])),
        "comment": lambda: box(pick(["section", "div"]), "comment", f"<h3>{words(1, 3)}</h3>" + "".join(pick([f"<div><b>{word()}</b><p>{prose()}</p></div>", f"<p>{prose()}</p>", f"<article><p>{prose()}</p></article>"]) for _ in range(rnd.randrange(1, 6)))),
    }
    made = lambda kinds, p: "".join(boilerplate[k]() for k in kinds if rnd.random() < p)

    def paragraph() -> str:
        r = rnd.random()
        if r < 0.78:
            inner = prose()
            inner = pick([inner, inner, inner, f"<b>{inner}</b>", f"<b>{inner}<br>", f"{inner} {link(1, 3)} {sentence()}", f"<em>{words(1, 4)}</em> {inner}", words(1, 6).capitalize() + ".", words(1, 6), words(4, 14), words(10, 80)])
            return f"<p>{inner}" + pick(["</p>", "</p>", "</p>", ""])
        if r < 0.86:
            return f"<h2>{words(1, 7)}</h2>"
        if r < 0.91:
            return "<ul>" + "".join(f"<li>{pick([sentence(), words(2, 7)])}</li>" for _ in range(rnd.randrange(2, 6))) + "</ul>"
        if r < 0.94:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if r < 0.96:
            return f"<pre>{words(5, 30)}</pre>"
        if r < 0.98:
            return f"<figure><img src='/x.png'><figcaption>{pick([words(2, 9), sentence()])}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{word()}<td>{words(1, 4)}</tr>" for _ in range(3)) + "</table>"

    def wrapped(inner: str, p: float) -> str:
        for _ in range(2):
            if rnd.random() < p:
                inner = f"<{(t := pick(['div', 'div', 'div', 'section']))}{pick(['', '', f' class={word()}', f' class={chr(34)}{word()} {word()}{chr(34)}', ' ' + some('main')])}>{inner}</{t}>"
        return inner

    def opening() -> str:
        title = f"<h1>{words(2, 12)}</h1>"
        if rnd.random() < 0.75:
            return title
        byline = pick(["", f"<p{pick(['', ' class=byline', ' class=meta'])}>{words(2, 6)}</p>"])
        return f"<header{pick(['', '', ' class=' + pick(['entry-header', 'post-header', 'article-header', 'title'])])}>{title}{byline}</header>"

    def bare() -> str:
        return pick(["<br><br>", "<br>", "<br /><br />", " <hr> "]).join(prose() for _ in range(pick([1, 2, 3, 5, 9])))

    def article() -> str:
        body = [opening()] * (rnd.random() < 0.85) + [paragraph() for _ in range(pick([1, 1, 2, 2, 3, 4, 6, 9, 14, 25]))]
        if rnd.random() < 0.2:
            body = [*body[: rnd.randrange(2)], bare()]
            for _ in range(pick([0, 0, 1, 3])):
                body += [paragraph(), bare()]
        if rnd.random() < 0.4:
            for _ in range(pick([1, 1, 2])):
                body.insert(rnd.randrange(len(body) + 1), boilerplate[pick(["ad", "share", "share", "side", "notice", "form"])]())
        style = rnd.random()
        if style < 0.3:
            body = [wrapped(b, 0.6) for b in body]
        elif style < 0.5 and len(body) > 2:
            cut = rnd.randrange(1, len(body))
            body = [wrapped("".join(body[:cut]), 0.8), wrapped("".join(body[cut:]), 0.8)]
        tag = pick(["article", "article", "article", "main", "div", "section"])
        hint = f" {some('main')}" if tag in ("div", "section") and rnd.random() < 0.8 or rnd.random() < 0.2 else ""
        if tag == "div" and rnd.random() < 0.15:
            hint = f" id=main class={chr(34)}{pick(others)}{chr(34)}"
        tail = boilerplate["comment"]() if rnd.random() < 0.2 else ""
        return f'<{tag}{hint} data-y="1">{"".join(body)}{tail}</{tag}>'

    pages = []
    for _ in range(n):
        if rnd.random() < 0.08:  # nothing but the article, with little markup
            inner = pick([bare, bare, lambda: opening() + bare(), lambda: "".join(paragraph() for _ in range(4))])()
            pages.append(pick([f'<body data-y="1">{inner}', f'<{(t := pick(["div", "div", "main", "section"]))} {some("main")} data-y="1">{inner}</{t}>']))
            continue
        core = made(["side", "ad"], 0.25) + article() + made(["ad", "share", "comment", "form"], 0.3) + made(["side"], 0.35)
        for _ in range(pick([0, 0, 1, 2])):
            core = f'<{pick(["div", "div", "main"])}{pick(["", f" class={chr(34)}{word()}{chr(34)}", " " + some("main")])}>{core}</div>'
        if rnd.random() < 0.1:
            core = f'<table><tr><td {some(pick(["menu", "side"]))} data-y="0">{pick([menu(), "<br>".join(link(1, 3) for _ in range(pick([1, 2, 3, 5])))])}</td><td{pick(["", " " + some("main")])}>{core}</td></tr></table>'
        body = made(["notice"], 0.3) + made(["head"], 0.5) + made(["menu", "ad"], 0.6) + core + made(["notice", "form"], 0.2) + made(["foot"], 0.85)
        pages.append(f'<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body data-y="0">{body}' + pick(["</body></html>", "</body></html>", ""]))
    return pages


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """(page_id, url, text, n_chars) of each page, by a map over the pages."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(h.as_py()) for h in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"].cast(pa.int64()), batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), train(labelled_pages()))
