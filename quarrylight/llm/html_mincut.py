"""Main-text extraction by minimum cut.

A page is cut into blocks of text at block-level tags. A logistic classifier gives each block the probability that it
is content; minus the logarithms of it and of its opposite are the costs of calling the block boilerplate or content,
and become the capacities of its edges from the source (content) and to the sink (boilerplate). Neighbouring blocks and
blocks under the same parent are joined by smoothness edges whose capacity falls with their distance in the DOM. The
maximum flow's minimum cut is the labelling of least cost; blocks on the source's side are the main text.

No tag or class name decides by itself. The classifier weighs, each apart, what stands above a block: elements and whole
names that mark boilerplate, below the nearest article or above it, by whether they hold most of the page's text; names
that only contain such a word (has-sidebar, comments-open); article elements and names; and the block's own text. Its
weights are fitted to labelled pages of many layouts, made by `training_pages`.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that don't end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup; none of it is text of the page.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg object audio video canvas select".split())
#: Elements that an opening tag of the key closes.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
#: Elements that an open paragraph ends at.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Elements and words of class, id or role that mark what isn't the article.
CHROME_TAGS = frozenset("nav header footer aside form menu dialog button fieldset head".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright "
    "dialog disclaimer disqus discussion footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promoted promotion related reply replies respond rail search share sharing sidebar signup social sponsor sponsored sponsors subscribe "
    "subscription tags toolbar topbar widget widgets".split()
)
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_WORDS = frozenset("article articlebody body content entry main post story text".split())
#: Parts of a name that say nothing about what it holds.
NEUTRAL_WORDS = frozenset("area bar block bottom box buttons col column container global group holder inner item left links list outer page panel primary right row secondary section site slot top unit wrap wrapper".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)|</[^>]*(?:>|\Z)|([^<]+|<)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.!?,;:]")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(maxsize=4096)
def name_kind(name: str) -> tuple[bool, bool, bool]:
    """(marks boilerplate by all it says, contains such a word beside others, marks an article by all it says)."""
    parts = {x.lower() for x in _NAME_PARTS.findall(name)} - NEUTRAL_WORDS
    chrome = parts & CHROME_WORDS
    whole = bool(parts) and parts == chrome
    return whole, bool(chrome) and not whole, bool(parts) and parts <= ARTICLE_WORDS


class Node:
    """An open element: what it and its ancestors say about the text in it.

    tag_in and name_in are the nearest boilerplate element and name below the nearest article; tag_out and name_out those
    above it.
    """

    __slots__ = ("article", "depth", "hidden", "length", "mixed", "name_in", "name_out", "named_article", "number", "parent", "tag", "tag_in", "tag_out")

    def __init__(self, tag: str, attributes: str, parent: Node | None, number: int):
        self.tag, self.parent, self.number, self.length = tag, parent, number, 0
        self.depth = parent.depth + 1 if parent else 0
        whole = part = named_article = hidden = other = False
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                key = m[1].lower()
                value = m[2] or m[3] or m[4] or ""
                if key in ("class", "id", "role"):
                    for name in value.split():
                        w, p, a = name_kind(name)
                        whole, part, named_article, other = whole or w, part or p, named_article or a, other or not w
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value):
                    hidden = True
        if tag in ("html", "body"):  # names of the whole page
            part, whole, named_article = part or whole, False, False
        article = tag in ARTICLE_TAGS
        if (article or named_article) and other:  # one of several names of an article is no more than a hint
            part, whole = part or whole, False
        self.hidden = hidden or bool(parent and parent.hidden)
        self.mixed = part or bool(parent and parent.mixed)
        self.article = article or bool(parent and parent.article)
        self.named_article = named_article or bool(parent and parent.named_article)
        self.tag_in, self.name_in, self.tag_out, self.name_out = (parent.tag_in, parent.name_in, parent.tag_out, parent.name_out) if parent else (None, None, None, None)
        if article or named_article:
            self.tag_out, self.name_out = self.tag_in or self.tag_out, self.name_in or self.name_out
            self.tag_in = self.name_in = None
        if tag in CHROME_TAGS:
            self.tag_in = self
        if whole:
            self.name_in = self


class Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, linked: int, node: Node):
        self.text, self.linked, self.node = text, linked, node


def blocks_of(page: str | None) -> list[Block]:
    """The page's blocks of text in order, character references decoded and white space collapsed."""
    page = page or ""
    stack = [Node("", "", None, 0)]
    out: list[Block] = []
    parts: list[str] = []
    in_link = linked = made = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                node = stack[-1]
                while node.tag in INLINE and node.parent:
                    node = node.parent
                out.append(Block(text, linked, node))
                while node:
                    node.length += len(text)
                    node = node.parent
            parts.clear()
        linked = 0

    def close(tags: frozenset[str] | set[str], stops: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of these tags, unless one of stops lies within."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        text = m[5]
        if text is not None:
            parts.append(text)
            linked += in_link * len(text)
            continue
        if not m[2] or not m[4]:  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag not in INLINE:
                flush()
            if tag in ("p", "br"):
                close({"p"}, ENDS_P - {"p"})
            else:
                close({tag})
            continue
        if tag in RAW:
            if tag not in INLINE:
                flush()
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            flush()
        if tag == "a":
            in_link = 1
        if tag in ENDS_P:
            close({"p"}, ENDS_P - {"p"} | {"td", "th", "li"})
        if tag in CLOSES:
            close(CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        if tag not in VOID and not (m[3].endswith("/") and tag in INLINE):
            made += 1
            stack.append(Node(tag, m[3], stack[-1], made))
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """A row a block: bias; boilerplate elements and names around it, by place and by share of the page; articles; its own text."""
    total = max(1, sum(len(b.text) for b in blocks))
    framed = any(b.node.article or b.node.named_article for b in blocks)
    rows = []
    for b in blocks:
        n, node = len(b.text), b.node
        above = (node.tag_in, node.name_in, node.tag_out, node.name_out)
        inside = node.tag_in is None and node.name_in is None
        own = inside and (node.article or node.named_article)
        rows.append(
            (
                1.0,
                *(float(x is not None and 2 * x.length <= total) for x in above),
                *(float(x is not None and 2 * x.length > total) for x in above),
                float(node.mixed),
                float(node.hidden),
                float(node.article and inside),
                float(node.named_article and inside),
                float(framed and not node.article and not node.named_article),
                min(1.0, b.linked / n) * (not own),
                min(1.0, b.linked / n) * own,
                min(1.0, n / 400),
                min(1.0, len(_MARKS.findall(b.text)) / 4),
                float(node.tag in ("li", "td", "th", "button", "caption")),
                float(node.tag in ("h1", "h2", "h3")),
            )
        )
    return np.array(rows)


#: Frames of the article in the labelled pages.
_FRAMES = (
    "<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>', '<div class="entry-content">{}</div>', '<article class="post-1 post comments-open">{}</article>',
    '<div class="layout has-sidebar"><article>{}</article></div>', '<article class="story social">{}</article>', '<main role="main"><article class="h-entry">{}</article></main>',
    '<form id="aspnetForm"><div id="main-content">{}</div></form>', '<div class="x7"><div class="c2">{}</div></div>', '<section class="post-body">{}</section>',
    '<div class="page-wrapper with-menu"><div class="article-text">{}</div></div>', '<div class="widget-free"><main>{}</main></div>', "<div>{}</div>", "{}",
    '<div class="grid sidebar"><article>{}</article></div>', '<div class="widget"><main>{}</main></div>', '<section class="social"><div class="post">{}</div></section>',
)
#: Frames of boilerplate in the labelled pages.
_LISTS = ("<nav>{}</nav>", '<div class="menu">{}</div>', '<ul id="site-nav">{}</ul>', '<div class="sidebar">{}</div>', '<div class="related-links">{}</div>', "<aside>{}</aside>", '<div class="breadcrumbs">{}</div>', "<footer>{}</footer>", "<div>{}</div>")
_PROSE = (
    '<section class="comments">{}</section>', '<div id="comments">{}</div>', '<ol class="comment-list">{}</ol>', '<div class="comments-area"><article class="comment">{}</article></div>', "<aside>{}</aside>",
    '<div id="sidebar">{}</div>', '<div class="cookie-banner">{}</div>', '<div class="cookie-notice">{}</div>', "<footer>{}</footer>", '<div id="footer">{}</div>', "<header>{}</header>", '<div class="site-header">{}</div>',
    '<div class="newsletter-signup">{}</div>', '<div class="ad">{}</div>', '<div class="advertisement">{}</div>', "<form>{}</form>", "<div hidden>{}</div>", '<div style="display:none">{}</div>', '<dialog class="modal">{}</dialog>',
    '<div class="gdpr-consent">{}</div>', '<div class="promo-box">{}</div>',
)


def training_pages(pages: int = 400, seed: int = 10) -> list[tuple[str, list[int]]]:
    """Labelled pages of many layouts: (html, 1 or 0 for each block, in block order)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    sentence = lambda n: (" ".join(word() for _ in range(n)) + rng.choice((".", ".", "!", "?", ", and more."))).capitalize()
    prose = lambda: " ".join(sentence(rng.randint(4, 18)) for _ in range(rng.randint(1, 6)))
    link = lambda: f"<a href=x>{' '.join(word() for _ in range(rng.randint(1, 4)))}</a>"

    def boilerplate() -> tuple[str, list[int]]:
        if rng.random() < 0.4:
            n = rng.randint(1, 8)
            return rng.choice(_LISTS).format("<ul>" + "".join(f"<li>{link()}" for _ in range(n)) + "</ul>"), [0] * n
        n = rng.choice((1, 1, 2, 5))
        return rng.choice(_PROSE).format("".join(f"<p>{prose()} {link() if rng.random() < 0.2 else ''}</p>" for _ in range(n))), [0] * n

    def article(framed: bool) -> tuple[str, list[int]]:
        parts, labels = [], []
        if rng.random() < 0.7:
            parts.append(f"<h1>{sentence(5)}</h1>")
            labels.append(1)
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.62:
                parts.append(f"<p>{prose()} {link() if rng.random() < 0.3 else ''}</p>")
                labels.append(1)
            elif kind < 0.7:
                parts.append(f"<h2>{sentence(3)}</h2>")
                labels.append(1)
            elif kind < 0.78:
                n = rng.randint(1, 4)
                parts.append("<ul>" + "".join(f"<li>{sentence(rng.randint(1, 9))}" for _ in range(n)) + "</ul>")
                labels += [1] * n
            elif kind < 0.84:
                parts.append(f"<table><tr><td>{sentence(2)}<td>{word()}</table><blockquote>{prose()}</blockquote>")
                labels += [1, 1, 1]
            elif kind < 0.88:
                n = rng.randint(1, 4)
                parts.append("<ul>" + "".join(f"<li>{link()}" for _ in range(n)) + "</ul>" if framed else f"<p>{word()}</p>" * n)
                labels += [1] * n
            else:
                html, own = boilerplate()
                parts.append(html)
                labels += own
        return "".join(parts), labels

    out = []
    for _ in range(pages):
        frame = rng.choice(_FRAMES)
        html, labels = article(any(x in frame for x in ("article", "main", "content", "post")))
        html = frame.format(html)
        for before in (True, False):
            for _ in range(rng.randint(0, 4)):
                more, own = boilerplate()
                html, labels = (more + html, own + labels) if before else (html + more, labels + own)
        out.append((f'<body class="{rng.choice(("", "home page", "has-sidebar", "single-post comments-open"))}">{html}</body>', labels))
    return out


def fit_weights(pages: list[tuple[str, list[int]]], steps: int = 25, ridge: float = 0.05) -> np.ndarray:
    """Logistic weights fitted to labelled pages by Newton's method."""
    found = [(blocks_of(page), labels) for page, labels in pages]
    if any(len(b) != len(labels) for b, labels in found):
        raise ValueError("a training page has as many labels as blocks")
    x = np.vstack([features(b) for b, _ in found])
    y = np.array([c for _, labels in found for c in labels], float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


@cache
def weights() -> np.ndarray:
    return fit_weights(training_pages())


def smoothness(blocks: list[Block], adjacent: float, related: float) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order, and between a block and the one before it under the same parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a, c = blocks[i - 1].node, b.node
            apart = 0
            while a is not c:
                if a.depth >= c.depth:
                    a = a.parent
                else:
                    c = c.parent
                apart += 1
            out.append((i - 1, i, adjacent / (1 + apart)))
        parent = (b.node.parent or b.node).number
        if parent in last:
            out.append((last[parent], i, related))
        last[parent] = i
    return out


def source_side(to_source: np.ndarray, to_sink: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Blocks on the source's side of a minimum cut (Dinic's algorithm). Flow straight through a block is pushed first."""
    n = len(to_source)
    rest = to_source - to_sink
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[float] = []

    def join(u: int, v: int, there: float, back: float) -> None:
        graph[u].append(len(head))
        head.append(v)
        room.append(there)
        graph[v].append(len(head))
        head.append(u)
        room.append(back)

    s, t, tiny = n, n + 1, 1e-9
    for i, r in enumerate(rest.tolist()):
        if r > 0:
            join(s, i, r, 0.0)
        elif r < 0:
            join(i, t, -r, 0.0)
    for u, v, c in edges:
        join(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if room[e] > tiny and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if level[t] < 0:
            return np.array([x >= 0 for x in level[:n]])
        turn = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(room[e] for e in path)
                cut = next(k for k, e in enumerate(path) if room[e] <= flow)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                u = head[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[u] < len(graph[u]):
                e = graph[u][turn[u]]
                if room[e] > tiny and level[head[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(graph[u]):
                path.append(graph[u][turn[u]])
                u = head[path[-1]]
            elif path:
                e = path.pop()
                u = head[e ^ 1]
                turn[u] += 1
            else:
                break


def main_text(page: str | None, adjacent: float = 0.5, related: float = 0.25) -> str:
    """The page's main text: blocks labelled content, one space between them. No text: empty."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    score = features(blocks) @ weights()
    # -log of the probabilities of boilerplate and of content
    keep = source_side(np.logaddexp(0, score), np.logaddexp(0, -score), smoothness(blocks, adjacent, related))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages plus main_text; null and empty html give an empty text, and such a column of pages is replaced.

    Repeated rows give repeated rows, an empty table an empty result. Each page is worked on by itself.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(main_text, na_action=None)

    return pages.withColumn("main_text", run.asNondeterministic()(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))


def op10_html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages; nulls, ties, empty tables and the like as `extract` says."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
