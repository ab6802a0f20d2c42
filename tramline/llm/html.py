"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is parsed to a tree of block elements. Each node has features of its subtree (text, links, marks, tags), of the
tokens of its own and its ancestors' attributes, of its depth and of its siblings. Boosted trees say how likely a
node holds main text. The decoder picks the set of nodes with the largest sum of logits in which no node stands
without its parent, so nothing inside a dropped part is kept. The trees learn from generated pages, whose
main text is known.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.boosting import Trees, fit_trees
from tramline.llm.text import whole

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*+)>|<[!?/](?:[^<>]++|<(?![!?/]))*+>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop|aria-label|data-[\w-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
#: Elements without running text; of RAW ones even the markup inside is no markup.
SKIPPED = RAW | frozenset("head template svg math object canvas audio video select option button datalist meter progress map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag closes an open element of the set, unless one of the second set is nearer.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
SCOPE = frozenset("table td th caption button object template".split())
#: What a head may hold; anything else ends it, with or without its end tag.
HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
CLOSE = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}

TAGS = ["p", "h1", "h2 h3 h4 h5 h6", "li", "ul ol menu dl", "div section center", "article main", "nav", "header", "footer", "aside", "form fieldset", "table tbody thead tr td th", "blockquote pre figure figcaption dd dt", "#text", "body html"]
#: Words in attributes, by what they speak for.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination tabs skip",
    "header": "header masthead topbar top logo branding hero",
    "footer": "footer bottom copyright colophon legal imprint",
    "side": "sidebar side aside widget rail related recommended popular trending more tags",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner teaser doubleclick",
    "comment": "comment comments reply replies discussion disqus respond thread reader readers",
    "notice": "cookie cookies consent notice gdpr popup modal alert overlay paywall privacy warning message",
    "form": "form search subscribe newsletter login signup register share social contact feedback",
    "main": "content article post entry main story body text prose page articlebody",
}
HINT_OF = {w: i for i, ws in enumerate(HINTS.values()) for w in ws.split()}
TAG_OF = {t: i for i, ts in enumerate(TAGS) for t in ts.split()}
ANCESTORS = ["nav", "header", "footer", "aside", "form", "article", "main", "li", "table", "blockquote"]
MARKS = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "hints", "parent", "children", "pieces", "depth", "links", "tags", "start", "text", "size", "marks")

    def __init__(self, tag: str, hints: int, parent: Node | None, start: int):
        self.tag, self.hints, self.parent, self.children, self.pieces, self.start = tag, hints, parent, [], [], start
        self.depth = 0 if parent is None else parent.depth + 1
        self.links = self.tags = self.size = self.marks = 0
        self.text = ""


def hints_of(attributes: str) -> int:
    """Bits of HINTS that the words of a tag's attributes speak for."""
    bits = 0
    for found in ATTRIBUTE.findall(attributes) if attributes else ():
        for word in WORDS.findall(found[0] or found[1] or found[2]):
            if (i := HINT_OF.get(word.lower())) is not None:
                bits |= 1 << i
    return bits


class _Stack:
    """The open elements, with the places of each tag, of blocks and of SCOPE tags, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.open: list[tuple[str, Node]] = [("html", root)]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def top(self) -> Node:
        return self.open[-1][1]

    def last(self, tags: Iterable[str]) -> int:
        """The innermost place of any of the tags; 0 if none is open."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)

    def push(self, tag: str, node: Node) -> None:
        place = len(self.open)
        self.open.append((tag, node))
        self.at.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self.blocks.append(place)
        if tag in SCOPE:
            self.scopes.append(place)

    def pop(self) -> str:
        tag, _ = self.open.pop()
        self.at[tag].pop()
        if tag not in INLINE:
            self.blocks.pop()
        if tag in SCOPE:
            self.scopes.pop()
        return tag


def parse(page: str) -> list[Node]:
    """Block nodes in page order, the root first; runs of inline content beside blocks become #text nodes."""
    root = Node("html", 0, None, 0)
    nodes, stack, links, skip = [root], _Stack(root), 0, 0
    at, size = 0, len(page)

    def put(raw: str) -> None:
        node = stack.top()
        if node.children or node.tag in ("html", "body"):
            if not node.children or node.children[-1].tag != "#text" or node.children[-1].size < 0:
                node.children.append(Node("#text", 0, node, at))
                nodes.append(node.children[-1])
            node = node.children[-1]
        node.pieces.append(raw)
        if links:
            node.links += len(raw)

    def seal() -> None:
        """What inline content follows now makes a block of its own."""
        node = stack.top()
        if node.children and node.children[-1].tag == "#text":
            node.children[-1].size = -1
        elif node.pieces and node.tag != "#text":
            text = Node("#text", 0, node, node.start)
            text.pieces, text.links, text.size, node.pieces, node.links = node.pieces, node.links, -1, [], 0
            node.children.append(text)
            nodes.append(text)

    def pop(to: int) -> None:
        nonlocal links, skip
        while len(stack.open) > to:
            tag = stack.pop()
            links -= tag == "a"
            skip -= tag in SKIPPED

    while at < size:
        token = TOKEN.search(page, at)
        end = token.start() if token else size
        if end > at:
            if skip and stack.open[-1][0] == "head" and not page[at:end].isspace():
                pop(len(stack.open) - 1)
            if not skip:
                put(page[at:end])
        if token is None:
            break
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        if token[1] or token[4]:
            to = stack.last((tag,))
            if to and (tag not in INLINE or not stack.blocks or stack.blocks[-1] < to):  # an inline end tag doesn't close a block
                pop(to)
                if tag not in INLINE:
                    seal()
            continue
        attributes = token[3] or token[6] or ""
        if stack.open[-1][0] == "head" and tag not in HEAD:
            pop(len(stack.open) - 1)
        if tag in RAW:
            close = CLOSE[tag].search(page, at)
            at = close.end() if close else size
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr", "input") and not skip:
                if tag == "br":
                    put(" ")
                elif tag == "hr":
                    seal()
                stack.top().tags += 1
            continue
        if tag in CLOSES_P and (to := stack.last(("p",))) and (not stack.scopes or stack.scopes[-1] < to):
            pop(to)
            seal()
        if tag in CLOSES:
            shut, stop = CLOSES[tag]
            if (to := stack.last(shut)) > stack.last(stop):
                pop(to)
                seal()
        if attributes.rstrip().endswith("/") and tag in ("svg", "path", "iframe"):
            continue
        parent = stack.top()
        parent.tags += 1
        if tag in INLINE or tag in SKIPPED or skip:
            links += tag == "a"
            skip += tag in SKIPPED
            stack.push(tag, parent)
            continue
        seal()
        if tag in ("html", "body") and parent is root:
            root.hints |= hints_of(attributes)
            stack.push(tag, root)
            continue
        node = Node(tag, hints_of(attributes), parent, at)
        parent.children.append(node)
        nodes.append(node)
        stack.push(tag, node)
    return nodes


def measure(nodes: list[Node]) -> list[list[float]]:
    """Features of every node, from one pass up and one down the tree."""
    for node in nodes:
        node.text = " ".join(html.unescape("".join(node.pieces)).split()) if node.pieces else ""
        node.size = len(node.text)
        node.links = min(node.links, node.size)
        node.marks = len(MARKS.findall(node.text))
    totals = {}
    for node in sorted(nodes, key=lambda n: -n.depth):
        t = [node.size, node.links, node.marks, node.tags, 1, int(node.size > 0)]
        for child in node.children:
            t = [x + y for x, y in zip(t, totals[id(child)], strict=True)]
        totals[id(node)] = t
    page, last = max(1, totals[id(nodes[0])][0]), max(1, max(n.start for n in nodes))
    above, rows, place, beside = {id(nodes[0]): (0, 0)}, [], {}, {}
    for node in nodes:
        if node.children:  # the children's sizes and tags, once for all of them
            sizes = [totals[id(c)][0] for c in node.children]
            beside[id(node)] = (sum(sizes), max(sizes), Counter(c.tag for c in node.children))
        place.update((id(c), (i, len(node.children), node)) for i, c in enumerate(node.children))
    for node in sorted(nodes, key=lambda n: n.depth):
        hints, tags = above[id(node)]
        deeper = (hints | node.hints, tags | (1 << ANCESTORS.index(node.tag) if node.tag in ANCESTORS else 0))
        above.update((id(c), deeper) for c in node.children)
    for node in nodes:
        size, links, marks, tags, count, leaves = totals[id(node)]
        i, n, parent = place.get(id(node), (0, 1, None))
        if parent is None:
            mean, most, same = size, size, 1.0
        else:
            total, most, tagged = beside[id(parent)]
            mean, same = total / n, tagged[node.tag] / n
        hints, over = above[id(node)]
        kind = TAG_OF.get(node.tag, TAG_OF["div"])
        rows.append([
            math.log1p(size), math.log1p(node.size), links / max(1, size), 10 * marks / max(1, size), 10 * tags / max(1, size), math.log1p(size / max(1, leaves)),
            min(node.depth, 20), min(len(node.children), 30), math.log1p(count), i / n, math.log1p(n), same, math.log1p(mean), size / max(1, most), size / page, node.start / last,
            *[float(kind == k) for k in range(len(TAGS))], *[float(node.hints >> k & 1) for k in range(len(HINTS))], *[float(hints >> k & 1) for k in range(len(HINTS))], *[float(over >> k & 1) for k in range(len(ANCESTORS))],
        ])
    return rows


def decode(nodes: list[Node], logits: np.ndarray) -> list[bool]:
    """The nodes of the best sum of logits in which each has its parent; the root holds no text and is free."""
    at = {id(n): i for i, n in enumerate(nodes)}
    best = np.clip(logits, -6, 6)
    best[0] = 0.0
    for i in sorted(range(1, len(nodes)), key=lambda i: -nodes[i].depth):
        if best[i] > 0:
            best[at[id(nodes[i].parent)]] += best[i]
    keep = [True] * len(nodes)
    for i in sorted(range(1, len(nodes)), key=lambda i: nodes[i].depth):
        keep[i] = bool(keep[at[id(nodes[i].parent)]] and best[i] > 0)
    return keep


def in_page_order(nodes: list[Node]) -> list[Node]:
    out, todo = [], [nodes[0]]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def extract(pages: list[str], model: Trees) -> list[str]:
    """Main text of each page."""
    trees = [parse(p) for p in pages]
    rows = [measure(nodes) for nodes in trees]
    logits = model.logits(np.array([r for rs in rows for r in rs])) if rows else np.zeros(0)
    out, at = [], 0
    for nodes in trees:
        keep = {id(n) for n, k in zip(nodes, decode(nodes, logits[at : at + len(nodes)]), strict=True) if k}
        at += len(nodes)
        out.append("\n".join(n.text for n in in_page_order(nodes) if n.text and id(n) in keep))
    return out


# Generated pages to learn from. Main text is wrapped in \x02 and \x03, which the labels are read from.

SYLLABLES = "an en on the re ti er de la que es ou ing sch el or ka mi lo ent is at".split()


class Maker:
    """Pages of many layouts, with their main text marked."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        words = ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n)]
        for i in range(self.r.randint(6, 12), n, self.r.randint(6, 12)):
            words[i - 1] += self.r.choice([".", ".", ",", "?", "!"])
        style = self.r.random()
        if style < 0.06:
            words = [w.upper() + "!!" for w in words]
        elif style < 0.12:
            words = [w + self.r.choice(["***", "$$$", "&amp;&amp;&amp;", " |"]) for w in words]
        elif style < 0.16:
            words = [words[0]] * n
        return (" ".join(words)).capitalize() + self.r.choice([".", ".", ""])

    def mark(self, text: str) -> str:
        return f"\x02{text}\x03"

    def attrs(self, *options: str) -> str:
        r = self.r
        if r.random() < 0.25:
            return ""
        value = r.choice(options) + r.choice(["", "", "-box", " wide", "-1", " c" + str(r.randint(1, 99))])
        return f' {r.choice(["class", "class", "id"])}="{value}"'

    def links(self, n: int, sep: str = "") -> str:
        return sep.join(f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(n))

    def menu(self) -> str:
        r = self.r
        items = f"<ul>{''.join(f'<li>{self.links(1)}</li>' for _ in range(r.randint(2, 12)))}</ul>"
        items = r.choice([items, self.links(r.randint(2, 8), r.choice([" ", " | ", ""]))])
        return r.choice([f"<nav>{items}</nav>", f"<nav{self.attrs('menu', 'navbar', 'main-nav')}>{items}</nav>", f'<div class="{r.choice(["menu", "nav", "breadcrumb", "navigation", "tabs"])}">{items}</div>', f'<div role="navigation">{items}</div>'])

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 4)}</h1><p>{self.words(3, 8)}</p>", f'<a href="/">{self.words(1, 3)}</a>', f"<div>{self.words(1, 6)}</div>" + self.menu(), self.words(2, 6)])
        return self.r.choice([f"<header>{inner}</header>", f'<div class="{self.r.choice(["header", "masthead", "site-header", "topbar", "logo"])}">{inner}</div>'])

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.words(1, 3)} &middot; {self.words(2, 12)}", f"<p>{self.words(4, 25)}</p>{self.links(3, ' ')}", f"<p>&copy; {self.words(2, 5)}</p><p>{self.words(5, 40)}</p>", self.menu()])
        return self.r.choice([f"<footer>{inner}</footer>", f"<footer{self.attrs('footer', 'site-footer')}>{inner}</footer>", f'<div class="{self.r.choice(["footer", "page-footer", "copyright", "legal"])}">{inner}</div>'])

    def advert(self) -> str:
        inner = self.r.choice([self.words(3, 30), f"<p>{self.words(3, 30)}</p>", f'<a href="x">{self.words(3, 9)}</a>', f"<b>{self.words(1, 4)}</b><p>{self.words(5, 15)}</p>"])
        return f'<{(t := self.r.choice(["div", "div", "aside", "section", "p"]))} class="{self.r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "teaser"])}">{inner}</{t}>'

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + self.r.choice([f"<ul>{''.join(f'<li>{self.links(1)}</li>' for _ in range(self.r.randint(2, 8)))}</ul>", f"<p>{self.words(5, 40)}</p>", f"<p>{self.words(5, 20)}</p>{self.links(3, ' ')}"])
        return self.r.choice([f"<aside>{inner}</aside>", f"<aside{self.attrs('sidebar', 'related')}>{inner}</aside>", f'<div class="{self.r.choice(["sidebar", "related", "widget", "recommended", "side"])}">{inner}</div>'])

    def notice(self) -> str:
        inner = self.r.choice([f"<p>{self.words(5, 30)}</p>", self.words(5, 30), f"<p>{self.words(5, 20)}</p><button>{self.words(1, 2)}</button>"])
        return f'<div class="{self.r.choice(["cookie", "cookie-banner", "consent", "notice", "gdpr", "popup", "modal", "alert", "paywall", "privacy-notice"])}">{inner}</div>'

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>"
        return self.r.choice([f"<form>{inner}</form>", f"<form{self.attrs('search', 'newsletter', 'login')}><p>{self.words(3, 20)}</p>{inner}</form>", f'<div class="{self.r.choice(["newsletter", "subscribe", "share", "social", "login"])}"><p>{self.words(2, 12)}</p>{self.links(2)}</div>'])

    def comments(self) -> str:
        one = lambda: self.r.choice([f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.words(4, 60)}</p></div>', f"<li><p>{self.words(4, 60)}</p></li>", f"<p>{self.words(4, 40)}</p>"])
        return f'<{(t := self.r.choice(["div", "section", "ol"]))} {self.r.choice(["class", "id"])}="{self.r.choice(["comments", "comment-list", "discussion", "replies", "reader-comments", "respond"])}">' + self.r.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + "".join(one() for _ in range(self.r.randint(1, 6))) + f"</{t}>"

    def block(self) -> str:
        r, w = self.r, self.words
        m = lambda low, high: self.mark(w(low, high))
        kind = r.random()
        if kind < 0.62:
            return f"<p>{m(1, r.choice([5, 20, 60, 200]))}</p>"
        if kind < 0.70:
            return f"<p><b>{m(2, 30)}<br>"
        if kind < 0.76:
            return f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{m(1, 9)}</{h}>"
        if kind < 0.82:
            return f"<{(u := r.choice(['ul', 'ol']))}>{''.join(f'<li>{m(1, 25)}</li>' for _ in range(r.randint(1, 7)))}</{u}>"
        if kind < 0.86:
            return f"<blockquote>{r.choice([m(4, 40), f'<p>{m(4, 40)}</p>'])}</blockquote>"
        if kind < 0.89:
            return f"<pre>{m(2, 30)}</pre>"
        if kind < 0.92:
            return f"<table>{''.join(f'<tr><td>{m(1, 5)}</td><td>{m(1, 5)}</td></tr>' for _ in range(r.randint(1, 5)))}</table>"
        if kind < 0.95:
            return f'<p>{self.mark(f"""{w(5, 40)} <a href="/x">{w(1, 4)}</a> {w(3, 30)}""")}</p>'
        return f"<figure><img src=x><figcaption>{m(2, 15)}</figcaption></figure>" if kind < 0.97 else f"<div>{m(3, 90)}</div>"

    def article(self) -> str:
        r = self.r
        parts = [self.block() for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14, 25]))]
        title = r.choice(["", f"<h1>{self.mark(self.words(1, 12))}</h1>", f"<h1>{self.mark(self.words(1, 12))}</h1>"])
        if not title and not parts:
            parts = [f"<p>{self.mark(self.words(1, 60))}</p>"]
        if parts and r.random() < 0.2:
            parts.insert(r.randint(0, len(parts)), r.choice([self.advert, self.side, self.form, self.notice])())
        if r.random() < 0.1:
            parts.append(r.choice([self.comments, self.menu, self.footer])())
        inner = title + "".join(parts)
        return r.choice([
            f"<article>{inner}</article>", f"<article>{inner}</article>", f"<article{self.attrs('post', 'story')}>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
            f'<div class="{r.choice(["content", "article-body", "post", "entry-content", "story", "main-text"])}">{inner}</div>', f'<div id="content"><div class="{r.choice(["row", "text", "inner"])}">{inner}</div></div>', f"<div>{inner}</div>" if len(parts) > 2 else f"<article>{inner}</article>",
        ])

    def page(self) -> str:
        r = self.r
        some = lambda p, f: [f()] if r.random() < p else []
        before = some(0.75, self.menu) + some(0.4, self.header) + some(0.5, self.advert) + some(0.25, self.notice) + some(0.15, self.form)
        after = some(0.3, self.side) + some(0.3, self.comments) + some(0.2, self.advert) + some(0.2, self.form) + some(0.15, self.menu)
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.15:
            before += [after.pop()] if after else []
        body = "".join(before) + self.article() + "".join(after) + "".join(some(0.85, self.footer)) + "".join(some(0.15, self.notice))
        body = r.choice([body, body, f'<div class="{r.choice(["wrapper", "page", "container"])}">{body}</div>'])
        open_, close = r.choice([("<head>", "</head><body>")] * 4 + [("<head>", "<body>"), ("<head>", ""), ("", ""), ("", "<body>")])
        return f"<!DOCTYPE html><html>{open_}<title>{self.words(1, 6)}</title><script>x('<p>')</script>{close}{body}" + r.choice(["</body></html>", "", "</html>"])


PAGES, SEED = 900, 20
SLICE = 1 << 21  # characters of the pages that are taken apart at a time


@cache
def trained(pages: int = PAGES, seed: int = SEED) -> Trees:
    """Trees learnt from generated pages: a node's label is whether its subtree holds marked text."""
    maker, x, y = Maker(seed), [], []
    for _ in range(pages):
        nodes = parse(maker.page())
        marked = {id(n) for n in nodes if any("\x02" in p for p in n.pieces)}
        for node in nodes:
            node.pieces = [p.replace("\x02", "").replace("\x03", "") for p in node.pieces]
        for node in sorted(nodes, key=lambda n: -n.depth):
            if id(node) in marked and node.parent is not None:
                marked.add(id(node.parent))
        x += measure(nodes)
        y += [id(n) in marked for n in nodes]
    return fit_trees(np.array(x), np.array(y, float))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars. A null page counts as empty and has an empty text.

    Blocks are joined in page order by a line feed; white space inside a block is one space. Pages of any length and
    nesting are read whole, in time in proportion to them. Repeated rows give repeated rows, an empty table an empty
    result; other columns are ignored.
    """
    model = trained()

    @F.pandas_udf("string")
    def text(htmls: pd.Series) -> pd.Series:
        out: list[str] = []
        part: list[str] = []
        size = 0
        for page in htmls:
            part.append(page)
            size += len(page)
            if size > SLICE or len(part) == 200:
                out += extract(part, model)
                part, size = [], 0
        return pd.Series(out + extract(part, model), dtype=object)

    found = pages.select(F.col(id_col), F.col(url_col), text(whole(F.col(html_col))).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
