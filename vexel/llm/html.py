"""Main text of web pages by boosted trees over DOM-node features, decoded over the hierarchy.

A page's block elements are described by their tag, the words of their attributes, depth, siblings and the density of
text and links in their subtree. Boosted trees, trained on pages generated by rule, give each the chance of holding
main text. The labels of a page are then chosen together: no element under a dropped one is kept, and the kept and
dropped ones are as likely as can be.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .boosting import Trees

# Fixed values of HTML: elements without content, with raw content, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template svg select button canvas audio video dialog".split())
NEVER = frozenset(["head"])
IN_HEAD = frozenset("base link meta title style script noscript template".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An opening tag ends open elements of these names, up to the nearest of the second group.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: Quotes count only as values of attributes, right after "=", and only if they are closed.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "attributes", "parent", "depth", "parts", "text", "links", "words", "children", "place")

    def __init__(self, tag, attributes, parent):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list = []  # strings and block nodes in page order; None: a break between inline pieces
        self.text = self.links = self.words = self.children = self.place = 0


def parse(html: str) -> list[Node]:
    """The block elements of a page in page order, the root first. Inline elements belong to their block."""
    root = Node("html", "", None)
    nodes, stack = [root], [("html", root)]  # open elements: inline ones stand with the block they are in
    at, n = 0, len(html)
    links = never = 0

    def text(s: str) -> None:
        if never and any(k == "head" for k, _ in stack) and not s.isspace():
            leave_head()
        if s and not never:
            node = stack[-1][1]
            node.parts.append(s)
            node.text += len(s)
            node.words += s.count(" ")
            if links:
                node.links += len(s)

    def close(depth: int) -> None:
        nonlocal links, never
        while len(stack) > depth:
            name, _ = stack.pop()
            links -= name == "a"
            never -= name in NEVER

    def leave_head() -> None:
        for i in range(1, len(stack)):
            if stack[i][0] == "head":
                close(i)
                break

    while at < n:
        m = TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name == "p" and not any(k == "p" for k, _ in stack):
                stack[-1][1].parts.append(None)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in VOID:
            if name in ("br", "hr") and not never:
                stack[-1][1].parts.append(" " if name == "br" else None)
            continue
        closes_itself = m[3].endswith("/") and (len(m[3]) == 1 or m[3][-2] in " \t\n\r\f\"'")  # else it ends a bare value
        if name not in IN_HEAD and name not in ("html", "head"):
            leave_head()
        if name in RAW:
            # Content up to the end tag goes. Without one, only that of scripts and styles does; an element that closes
            # itself has none, unless its end tag is the next one.
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            if end and (not closes_itself or html.find("<", at) == end.start()):
                at = end.end()
            elif name in ("script", "style") and not closes_itself:
                at = n
            continue
        if name in BLOCK:
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, but not beyond a cell or the like
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if name in ENDS:
            names, stops = ENDS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in stops:
                    break
                if stack[i][0] in names:
                    close(i)
        if name == "html":
            continue
        node = stack[-1][1]
        if name in BLOCK and not never:
            parent = node
            node = Node(name, " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(m[3])) if m[3] else "", parent)
            node.place = parent.children
            parent.children += 1
            parent.parts.append(node)
            nodes.append(node)
        if closes_itself and name not in BLOCK:
            continue
        links += name == "a"
        never += name in NEVER
        stack.append((name, node))
    return nodes


#: Words of attributes that tell what an element is for, by kind.
WORDS = {
    "main": "article content post entry main body story text blog prose page articlebody",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs toc tabs pagination pager links skip",
    "top": "header head banner masthead top logo topbar toolbar branding hero",
    "foot": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside rail widget complementary secondary related recommended popular trending more read",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion dfp adsense banner commercial affiliate outbrain taboola",
    "notice": "cookie consent gdpr notice alert popup modal overlay subscribe newsletter signup paywall message disclaimer",
    "form": "form login search contact register input",
    "share": "share social sharing tools meta tags byline author follow buttons print actions",
    "comment": "comment comments commentlist reply replies respond discussion disqus reviews thread reader responses",
}
KIND = {w: i for i, ws in enumerate(WORDS.values()) for w in ws.split()}
TAGS = [{"article"}, {"main"}, {"section"}, {"div"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "menu", "dl"}, {"li", "dt", "dd"}, {"nav"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"table", "tbody", "thead", "tfoot", "tr"}, {"td", "th"}, {"blockquote", "pre"}, {"figure", "figcaption"}, {"html", "body"}, {"form", "fieldset"}]
TAG_OF = {t: i for i, ts in enumerate(TAGS) for t in ts}
#: Elements whose name says the same as such a word; what is under them should know it, too.
TAG_KIND = {t: list(WORDS).index(k) for t, k in (("nav", "menu"), ("aside", "side"), ("footer", "foot"), ("form", "form"))}
#: Words of attributes that say nothing of what an element is for.
PLAIN = frozenset("site my js css page wrap wrapper box row col inner grid container".split())
FIRST = 16  # features before the words of attributes
N_FEATURES = FIRST + 3 * len(WORDS)


@lru_cache(maxsize=20_000)
def kinds(attributes: str) -> tuple[int, ...]:
    return tuple(sorted({KIND[w] for x in WORD.findall(attributes) if (w := x.lower()) in KIND}))


@lru_cache(maxsize=20_000)
def others(attributes: str) -> int:
    """How many words of the attributes are neither of a kind nor plain: a `related-work` isn't a `related`."""
    return sum(len(w) > 2 and w.lower() not in KIND and w.lower().removesuffix("s") not in KIND and w.lower() not in PLAIN for w in WORD.findall(attributes))


def _log(n: float) -> int:
    return min(63, int(4 * np.log2(1 + n)))


def features(nodes: list[Node]) -> np.ndarray:
    """Small integers: tag, depth, siblings, subtree density, attribute words of the node, its parent and ancestors."""
    n = len(nodes)
    at = {id(x): i for i, x in enumerate(nodes)}
    parent = [at[id(x.parent)] if x.parent else -1 for x in nodes]
    text, links, words, size, ps = ([0] * n for _ in range(5))
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        text[i] += x.text
        links[i] += x.links
        words[i] += x.words
        size[i] += 1
        ps[i] += x.tag == "p"
        if (k := parent[i]) >= 0:
            text[k] += text[i]
            links[k] += links[i]
            words[k] += words[i]
            size[k] += size[i]
            ps[k] += ps[i]
    out = np.zeros((n, N_FEATURES), np.uint8)
    k = len(WORDS)
    whole = max(1, text[0])
    log = [min(63, int(4 * v)) for v in np.log2(1 + np.array([text, words, size, ps], float)).ravel()]
    for i, x in enumerate(nodes):
        p = parent[i]
        row = out[i]
        row[:FIRST] = (
            TAG_OF.get(x.tag, 31), min(x.depth, 63), min(x.place, 63), min(nodes[p].children if p >= 0 else 1, 63), log[i], log[n + i], log[2 * n + i], log[3 * n + i],
            63 * links[i] // max(1, text[i]), 63 * text[i] // whole, min(63, text[i] // size[i] // 8), TAG_OF.get(nodes[p].tag, 31) if p >= 0 else 30, min(x.children, 63), 63 * text[i] // max(1, text[p]) if p >= 0 else 63, min(others(x.attributes), 63), out[p, FIRST - 2] if p >= 0 else 0,
        )
        for c in kinds(x.attributes):
            row[FIRST + c] = 1
        if x.tag in TAG_KIND:
            row[FIRST + TAG_KIND[x.tag]] = 1
        if p >= 0:
            row[FIRST + k : FIRST + 2 * k] = out[p, FIRST : FIRST + k]
            row[FIRST + 2 * k :] = out[p, FIRST + 2 * k :] | out[p, FIRST + k : FIRST + 2 * k]
    return out


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """The likeliest labels of which no kept node has a dropped ancestor. margin: ln of the odds for keeping."""
    keep_cost = np.logaddexp(0, -margin).tolist()
    drop_cost = np.logaddexp(0, margin).tolist()
    at = {id(x): i for i, x in enumerate(nodes)}
    parent = [at[id(x.parent)] if x.parent else -1 for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):  # children before parents
        keep_cost[parent[i]] += min(keep_cost[i], drop_cost[i])
        drop_cost[parent[i]] += drop_cost[i]
    kept: list[bool] = []
    for i in range(len(nodes)):
        kept.append((parent[i] < 0 or kept[parent[i]]) and keep_cost[i] <= drop_cost[i])
    return kept


def unmarked(nodes: list[Node], x: np.ndarray) -> list[bool]:
    """What is kept of a page on which the trees keep no text: the prose that neither its element nor one above it marks as
    something else than main text. Prose has five words or more, not mostly links; its headings stay, too."""
    main = list(WORDS).index("main")
    marks = x[:, FIRST:].reshape(len(nodes), 3, len(WORDS)).any(1)
    marks[:, main] = False
    free = ~marks.any(1)
    prose = [f and n.words >= 4 and 2 * n.links < n.text for f, n in zip(free, nodes)]
    if not any(prose):
        return [False] * len(nodes)
    keep = [p or (f and n.text > 0 and n.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and 2 * n.links < n.text) for p, f, n in zip(prose, free, nodes)]
    at = {id(n): i for i, n in enumerate(nodes)}
    for i in range(len(nodes) - 1, 0, -1):
        if keep[i]:
            keep[at[id(nodes[i].parent)]] = True
    return keep


def render(nodes: list[Node], kept: list[bool]) -> str:
    """The kept nodes' text: blocks in page order, white space inside a block as one space."""
    keep = {id(x) for x, k in zip(nodes, kept) if k}
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        block = " ".join(unescape("".join(held)).split())
        held.clear()
        if block:
            blocks.append(block)

    walk = [iter(nodes[:1])]
    while walk:  # no recursion: pages may be deep
        part = next(walk[-1], walk)
        if part is walk:
            walk.pop()
            flush()
        elif part is None:
            flush()
        elif isinstance(part, str):
            held.append(part)
        elif id(part) in keep:
            flush()
            walk.append(iter(part.parts))
    return "\n".join(blocks)


class Pages:
    """Generates pages by rule, with the main text marked; their words are random, so only structure can be learnt."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def attributes(self, kind: str | None, chance: float = 0.8) -> str:
        r = self.r
        names = WORDS[kind].split() if kind else ["row", "col", "box", "inner", "wrap", "grid", "x1", "css"]
        if r.random() > chance:
            return ""
        name = r.choice(names) if r.random() < 0.6 else r.choice(["", "site", "my", "js", "page"]) + r.choice("-_") + r.choice(names) + r.choice(["", "-wrap", "-box", "s", "-1"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def link(self) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(1, 5)}</a>'

    def menu(self, tag: str = "") -> str:
        r = self.r
        tag = tag or r.choice(["nav", "nav", "div", "ul"])
        items = "".join(f"<li>{self.link()}</li>" for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8, 12])))
        body = items if tag == "ul" else f"<ul>{items}</ul>" if r.random() < 0.7 else r.choice([" | ", " "]).join(self.link() for _ in range(r.randint(2, 9)))
        return f"<{tag}{self.attributes('menu', 0.4 if tag == 'nav' else 0.9)}>{body}</{tag}>"

    def junk(self, inside: bool = False) -> str:
        r = self.r
        prose = f"<p>{self.words(3, 40)}</p>" if r.random() < 0.5 else self.words(2, 30)
        kind = r.choice(["ad", "ad", "notice", "side", "form", "share", "comment"] if not inside else ["ad", "ad", "side", "share", "notice", "form"])
        if kind == "ad":
            return f"<{(t := r.choice(['div', 'div', 'aside', 'section']))}{self.attributes('ad', 1)}>{prose}</{t}>"
        if kind == "notice":
            return f"<div{self.attributes('notice', 1)}>{prose}{r.choice(['', '<button>ok</button>'])}</div>"
        if kind == "form":
            return f"<form{self.attributes('form', 0.5)}><label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 1)}</button></form>"
        if kind == "share":
            return f"<{(t := r.choice(['div', 'ul']))}{self.attributes('share', 1)}>{'<li>' * (t == 'ul')}{self.link()} {self.link()}</{t}>"
        if kind == "side":
            tag = r.choice(["aside", "aside", "div", "section"])
            body = f"<h3>{self.words(1, 4)}</h3>" * r.randint(0, 1) + (self.menu("ul") if r.random() < 0.6 else f"<p>{self.words(5, 60)}</p>")
            return f"<{tag}{self.attributes('side', 0.5 if tag == 'aside' else 1)}>{body}</{tag}>"
        tag = r.choice(["section", "div", "ol", "div"])
        inner = "li" if tag == "ol" else r.choice(["div", "article", "p"])
        one = lambda: f"<{inner}{self.attributes('comment', 0.5)}>{self.words(1, 3)} <p>{self.words(4, 90)}</p></{inner}>"
        return f"<{tag}{self.attributes('comment', 1)}>{f'<h{r.randint(2, 4)}>{self.words(1, 3)}</h3>' * r.randint(0, 1)}{''.join(one() for _ in range(r.randint(1, 6)))}</{tag}>"

    def piece(self) -> str:
        """A part of the main text; its words are upper-cased, which marks them."""
        r = self.r
        mark = lambda low, high: self.words(low, high).upper()
        return r.choice([
            lambda: f"<p>{mark(1, 8)}</p>", lambda: f"<p>{mark(10, 120)}</p>", lambda: f"<p>{mark(30, 200)}", lambda: f"<p>{mark(5, 60)} <a href=x>{mark(1, 6)}</a> {mark(1, 30)}</p>",
            lambda: f"<p><b>{mark(5, 40)}<br><p>{mark(5, 50)}</p>", lambda: f"<h{r.randint(2, 4)}>{mark(1, 9)}</h2>", lambda: f"<ul>{''.join(f'<li>{mark(2, 25)}</li>' for _ in range(r.randint(2, 6)))}</ul>",
            lambda: f"<blockquote><p>{mark(5, 60)}</p></blockquote>", lambda: f"<table><tr><td>{mark(1, 4)}</td><td>{mark(1, 4)}</td></tr></table>", lambda: f"<div>{mark(10, 80)}</div>", lambda: f"<pre>{mark(3, 30)}</pre>",
            lambda: f"<p><a href=x>{mark(4, 40)}</a></p>", lambda: self.section(mark),
            lambda: f"<p>{mark(10, 120)}</p>", lambda: f"<p>{mark(3, 30)}<svg class=i></svg> <math><mi>{mark(1, 2)}</mi></math> <label>{mark(1, 4)}</label></p>", lambda: f"<figure><img src=x><figcaption>{mark(3, 15)}</figcaption></figure>",
        ])()

    def section(self, mark) -> str:
        """A part of the main text whose name holds a word that means something else, and another word."""
        r = self.r
        kind = r.choice([k for k in WORDS if k != "main"])
        name = f"{r.choice(WORDS[kind].split())}{r.choice('-_ ')}{self.words(1, 1)}{r.choice('mnrst')}"
        name = " ".join(reversed(name.split())) if r.random() < 0.3 else name
        tag = r.choice(["div", "section"])
        return f'<{tag} {r.choice(["class", "id"])}="{name}"><h{r.randint(2, 4)}>{mark(1, 6)}</h2>{"".join(f"<p>{mark(6, 90)}</p>" for _ in range(r.randint(1, 4)))}</{tag}>'

    def page(self) -> str:
        r = self.r
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        few = r.random() < 0.25
        parts = [self.piece() for _ in range(r.randint(0, 2) if few else r.randint(2, 18))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            parts.insert(r.randint(0, len(parts)), self.junk(inside=True))
        title = f"<h1>{self.words(2, 16).upper()}</h1>"
        title = f"<header>{title}</header>" if r.random() < 0.15 else title
        if r.random() < 0.1:
            parts.append(f"<footer{self.attributes('share', 0.5)}>{self.words(1, 9)} {self.link()}</footer>")
        main = f"<{tag}{self.attributes('main', 0.3 if tag in ('article', 'main') else 0.95)}>{title}{''.join(parts)}</{tag}>"
        bare = r.random() < 0.15
        if bare:  # nothing around the main text
            main = f"{title}{''.join(parts)}"
        elif tag == "td":
            main = f"<table><tr><td>{self.menu('ul')}</td>{main}</tr></table>"
        for _ in range(r.choice([0, 0, 0, 1, 2]) * (not bare or r.random() < 0.3)):
            main = f"<div{self.attributes(None, 0.6)}>{main}{self.junk() if r.random() < 0.3 else ''}</div>"
        if tag != "main" and not bare and r.random() < 0.2:
            main = f"<main>{main}</main>"
        head = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        top = "".join(r.choice([self.menu, self.junk, lambda: f"<header{self.attributes('top', 0.5)}>{self.words(1, 8)}{self.menu()}</header>", lambda: f"<div{self.attributes('top', 1)}>{self.words(1, 9)}</div>"])() for _ in range(r.randint(0, 4)))
        end = "".join(r.choice([self.junk, self.junk, self.menu])() for _ in range(r.randint(0, 3)))
        foot = r.choice([lambda: f"<footer{self.attributes('foot', 0.4)}>{self.words(2, 30)}</footer>", lambda: f"<footer>{self.words(2, 9)}{self.menu()}</footer>", lambda: f"<div{self.attributes('foot', 1)}><p>{self.words(2, 30)}</p></div>", str])()
        body = top + main + end + foot
        if r.random() < 0.1:
            body = f"<form{self.attributes('form', 0.5)}>{body}</form>"  # some servers wrap whole pages
        if r.random() < 0.1:
            body = f"<noscript>{self.words(3, 20)}</noscript>" + body
        return head + body + "</body></html>"


def train(pages: int = 1200, seed: int = 1, trees: int = 60) -> Trees:
    """Trees from generated pages; the driver trains them in some seconds, on a table of fixed size."""
    source = Pages(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = parse(source.page())
        at = {id(x): i for i, x in enumerate(nodes)}
        y = [any(isinstance(p, str) and re.search("[A-Z]{2}", p) for p in x.parts) for x in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            if y[i]:
                y[at[id(nodes[i].parent)]] = True
        xs.append(features(nodes))
        ys.append(np.array(y, float))
    return Trees(depth=5, rate=0.3).fit(np.concatenate(xs), np.concatenate(ys), trees=trees)


def main_texts(model: Trees, htmls: list[str]) -> list[str]:
    parsed = [parse(h) for h in htmls]
    if not parsed:
        return []
    described = [features(nodes) for nodes in parsed]
    margins = model.margins(np.concatenate(described))
    out, at = [], 0
    for nodes, x in zip(parsed, described):
        out.append(render(nodes, decode(nodes, margins[at : at + len(nodes)])) or render(nodes, unmarked(nodes, x)))
        at += len(nodes)
    return out


def extract(pages: DataFrame, model: Trees | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of the main text of each row of pages, from its whole html.

    Null, empty and text-free html give an empty text. Repeated rows give repeated results; ids and urls pass as they
    are, other columns are left out.
    """
    spark = pages.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model or train())

    def run(batches):
        for batch in batches:
            htmls = batch.column(2).to_pylist()
            texts = [t for i in range(0, len(htmls), 64) for t in main_texts(shared.value, htmls[i : i + 64])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
