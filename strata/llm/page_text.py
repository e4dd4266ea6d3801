"""Main text of web pages by minimum-cut labelling (operator 4).

A page is cut into blocks of text. A logistic classifier gives each block the cost of either label;
the costs are capacities from the source (content) and to the sink (boilerplate). Neighbours in
the page, and blocks of one DOM container (each joined to a node of the container, and containers
to those around them), are joined by smoothness edges. Maximum flow finds the labelling of least
cost: content is what the source still reaches.

The classifier is fitted on a bounded sample of pages (`TRAIN_PAGES` pages of the least hash, at
most `TRAIN_BLOCKS` blocks of each). Blocks that the markup declares (in an article or main element
without a hint against it; in navigation, footers, asides, forms, or containers named so) are its
labels. Half of the training rows have these declarations hidden, so the weights of length, links,
punctuation and tags are learnt for pages without them. The fit starts from, and is held near,
`PRIOR`, which stands alone where no page declares anything.

Cases: null and empty pages have an empty text; unclosed tags, comments and scripts end with the
page; a page is one row, whatever its length; repeated rows and null ids are rows of their own;
an empty table gives an empty result; added columns replace columns of the same name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.tables import bound_batches, column, map_arrow

TRAIN_PAGES = 400
TRAIN_BLOCKS = 200
NEIGHBOUR = 0.35
SIBLING = 0.7
CONTAINER = 0.35
MOST_COST = 8.0

#: An attribute by the states of the HTML standard: name, value in either quotes or none. A quote that is never closed
#: belongs to an unquoted value.
_VALUE = r"\s*+=\s*+(?>\"[^\"]*\"|'[^']*'|[^\s>]*+)"
_ATTRS = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|select|svg|math|iframe|object|title|button|option|audio|video|canvas)"
    rf"(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)(?=[\s/>]){_ATTRS}>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(rf"([^\s/>][^\s/>=]*+)({_VALUE})?+")
_NAMING = frozenset(["class", "id", "role"])
_PARTS = re.compile(r"[a-z]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr input".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(["head"])
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
AGAINST = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars widget "
    "widgets footer header masthead comment comments commentlist reply replies respond disqus share sharing social related "
    "recommended newsletter subscribe subscription signup login search toolbar copyright legal pagination pager tags "
    "complementary contentinfo skip".split()
)
FOR = frozenset("article content main post entry story body text prose page".split())

FEATURES = (
    "bias length links marks paragraph heading item cell article nav header footer aside form against for".split()
)
PRIOR = np.array([-0.5, 1.5, -4.0, 1.0, 1.0, 0.5, -0.5, -0.5, 3.0, -12.0, -9.0, -12.0, -12.0, -12.0, -12.0, 1.0])
DECLARED = slice(FEATURES.index("article"), len(FEATURES))
_STATE = {"article": 1, "main": 1, "nav": 2, "menu": 2, "header": 4, "footer": 8, "aside": 16, "form": 32, "fieldset": 32, "dialog": 64}


class _Open:
    """An open element: its tag, container number and what it and those around it declare."""

    __slots__ = ("tag", "node", "state")

    def __init__(self, tag: str, node: int, state: int):
        self.tag, self.node, self.state = tag, node, state


def _declared(tag: str, attrs: str, outer: int) -> int:
    state = outer | _STATE.get(tag, 0)
    if tag == "header" and outer & 1:  # an article's own heading is part of it
        state = outer
    if attrs and "=" in attrs:
        for name, value in _ATTR.findall(attrs):
            if name.lower().rpartition("-")[2] not in _NAMING:
                continue
            names = set(_PARTS.findall(value.lower()))
            if names & AGAINST and tag not in ("body", "html"):
                state |= 64
            if names & FOR:
                state |= 128
    return state


def blocks(page: str | None) -> tuple[list[str], list[list[float]], list[int], list[int]]:
    """Texts of the blocks, their features, the container of each, and the container around each
    container."""
    texts: list[str] = []
    rows: list[list[float]] = []
    owners: list[int] = []
    around = [-1]
    stack = [_Open("", 0, 0)]
    parts: list[str] = []
    link_chars = chars = anchors = hidden = 0
    at = 0
    page = page or ""

    def close() -> None:
        nonlocal link_chars, chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[-1]
                texts.append(text)
                rows.append(_features(text, link_chars / max(chars, 1), top.tag, top.state))
                owners.append(top.node)
            parts.clear()
        link_chars = chars = 0

    def add(text: str) -> None:
        nonlocal link_chars, chars
        if text and not hidden:
            parts.append(text)
            chars += len(text)
            if anchors:
                link_chars += len(text)

    for match in _TOKEN.finditer(page):
        start = match.start()
        if start > at:
            add(page[at:start])
        at = match.end()
        tag = match["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                anchors = max(anchors + (-1 if match["end"] else 1), 0)
            elif tag == "br":
                add(" ")
            continue
        close()
        if match["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    for left in stack[depth:]:
                        hidden -= left.tag in HIDDEN
                    del stack[depth:]
                    break
            continue
        if tag in VOID:
            continue
        top = stack[-1].tag
        if (top == "p" and tag in CLOSES_P) or (top == tag and tag in ("li", "tr", "td", "th", "dt", "dd", "option")):
            stack.pop()
        if tag == "body":
            while len(stack) > 1 and stack[-1].tag == "head":
                hidden -= stack.pop().tag in HIDDEN
        outer = stack[-1]
        attrs = match["attrs"]
        state = _declared(tag, attrs, outer.state)
        if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th") and state == outer.state:
            node = outer.node  # a leaf shares the container around it
        else:
            node = len(around)
            around.append(outer.node)
        anchors = 0
        stack.append(_Open(tag, node, state))
        hidden += tag in HIDDEN
    if at < len(page):
        add(page[at:])
    close()
    return texts, rows, owners, around


def _features(text: str, links: float, tag: str, state: int) -> list[float]:
    words = text.count(" ") + 1
    marks = sum(text.count(c) for c in ".,;:!?")
    return [
        1.0,
        min(np.log1p(words) / 3.0, 2.0),
        links,
        min(marks / words * 5.0, 1.0),
        float(tag == "p"),
        float(len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()),
        float(tag == "li"),
        float(tag in ("td", "th", "dt", "dd")),
        float(state & 1 > 0),
        float(state & 2 > 0),
        float(state & 4 > 0),
        float(state & 8 > 0),
        float(state & 16 > 0),
        float(state & 32 > 0),
        float(state & 64 > 0),
        float(state & 128 > 0),
    ]


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays with the source. A positive cost is the capacity from the source,
    a negative one that to the sink; edges have their capacity both ways. Levels by breadth-first
    search, blocking flows by depth-first search, until no path is left."""
    n = len(costs)
    graph: list[list[list]] = [[] for _ in range(n)]  # entries: [other node, capacity left, index of the way back]
    for a, b, capacity in edges:
        graph[a].append([b, capacity, len(graph[b])])
        graph[b].append([a, capacity, len(graph[a]) - 1])
    supply = [max(c, 0.0) for c in costs]
    demand = [max(-c, 0.0) for c in costs]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if supply[i] > tiny]
        for i in queue:
            level[i] = 0
        reaches = False
        for i in queue:
            if demand[i] > tiny:
                reaches = True
            deeper = level[i] + 1
            for other, capacity, _ in graph[i]:
                if capacity > tiny and level[other] < 0:
                    level[other] = deeper
                    queue.append(other)
        if not reaches:
            return [x >= 0 for x in level]
        turn = [0] * n
        for start in [i for i in range(n) if supply[i] > tiny]:
            path: list[list] = []
            at = start
            while supply[start] > tiny:
                if demand[at] > tiny:
                    pushed = min([supply[start], demand[at], *(e[1] for e in path)])
                    supply[start] -= pushed
                    demand[at] -= pushed
                    for edge in path:
                        edge[1] -= pushed
                        graph[edge[0]][edge[2]][1] += pushed
                    path, at = [], start
                    continue
                ways = graph[at]
                while turn[at] < len(ways):
                    edge = ways[turn[at]]
                    if edge[1] > tiny and level[edge[0]] == level[at] + 1:
                        break
                    turn[at] += 1
                if turn[at] < len(ways):
                    path.append(edge)
                    at = edge[0]
                elif path:
                    last = path.pop()
                    at = graph[last[0]][last[2]][0]
                    turn[at] += 1
                else:
                    break


def label(costs: list[float], owners: list[int], around: list[int]) -> list[bool]:
    """Content or not, for each block."""
    n = len(costs)
    edges = [(i, i + 1, NEIGHBOUR) for i in range(n - 1)]
    used = set(owners)
    for node in list(used):
        while node > 0:
            node = around[node]
            used.add(node)
    place = {node: n + i for i, node in enumerate(sorted(used))}
    edges += [(i, place[node], SIBLING) for i, node in enumerate(owners)]
    edges += [(place[node], place[around[node]], CONTAINER) for node in used if node > 0]
    return min_cut([*costs, *[0.0] * len(place)], edges)[:n]


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The content blocks of a page, in page order, joined by a blank."""
    texts, rows, owners, around = blocks(page)
    if not texts:
        return ""
    costs = np.clip(np.asarray(rows) @ weights, -MOST_COST, MOST_COST).tolist()
    return " ".join(t for t, keep in zip(texts, label(costs, owners, around)) if keep)


# --- classifier -------------------------------------------------------------------


def fit(rows: np.ndarray, labels: np.ndarray, strength: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression held near `PRIOR` (Newton steps); classes count alike."""
    weights = PRIOR.copy()
    if not len(labels):
        return weights
    share = np.where(labels > 0, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1)) * 200
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (share * (labels - p)) - strength * (weights - PRIOR)
        curve = (rows * (share * p * (1 - p))[:, None]).T @ rows + strength * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def train(pages: DataFrame, id_col: str, html_col: str, train_pages: int = TRAIN_PAGES, train_blocks: int = TRAIN_BLOCKS) -> np.ndarray:
    """Weights from the blocks that a bounded sample of pages declares."""
    source = pages.select(column(pages, html_col).cast("string").alias("html"), column(pages, id_col).cast("string").alias("id"))
    order = F.xxhash64("id", F.octet_length("html"))
    sample = source.withColumn("hash", order).orderBy("hash").limit(train_pages).select("html")

    def declared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, kinds = [], []
            for page in batch.column("html").to_pylist():
                for row in blocks(page)[1][:train_blocks]:
                    inside, against = row[DECLARED.start] > 0, any(row[DECLARED.start + 1 : -1])
                    if inside or against:
                        found.append(row)
                        kinds.append(float(inside and not against))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), pa.array(kinds, pa.float64())], ["row", "kind"])

    known = sample.mapInArrow(declared, "row array<double>, kind double").collect()
    rows = np.array([r["row"] for r in known], float).reshape(-1, len(FEATURES))
    labels = np.array([r["kind"] for r in known], float)
    hidden = rows.copy()
    hidden[:, DECLARED] = 0.0
    return fit(np.concatenate([rows, hidden]), np.concatenate([labels, labels]))


def extract(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", weights: np.ndarray | None = None, text_name: str = "text"
) -> DataFrame:
    """The pages with their main text in place of the html."""
    bound_batches(pages.sparkSession)
    if weights is None:
        weights = train(pages, id_col, html_col)
    kept = [f for f in pages.schema.fields if f.name not in (html_col, text_name)]
    schema = T.StructType([*kept, T.StructField(text_name, T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(html_col).to_pylist()]
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [f.name for f in schema.fields])

    return map_arrow(pages.select(*[column(pages, f.name) for f in kept], column(pages, html_col).cast("string").alias(html_col)), read, schema)
