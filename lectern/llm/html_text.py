"""Main text of web pages from a tree-structured graphical model over the DOM.

The block elements of a page and the runs of text between them are the nodes of a tree. Each is content or boilerplate; a node's
evidence comes from its tag, its class names, its text and its links, and parent-child potentials tie states along
the tree. Sum-product messages upward and downward give every node's content marginal, and the runs of text whose marginal is at least
one half are the main text.

The potentials are fitted by maximum likelihood on labelled pages: those that mark their main text themselves
(`article` or `main`). So that the model does not depend on that mark, every such page is used twice more in a varied form
whose labels are known.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages the model is fitted on: the first by a hash of their id, and the longest that takes part in fitting.
TRAIN_PAGES = 80
TRAIN_CHARS = 20_000
STEPS, RATE, PENALTY = 200, 0.3, 1e-4

# HTML elements by their role, and words that name the role of a block in its class or id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style textarea title xmp iframe noembed noframes noscript template svg object audio video canvas select datalist button annotation annotation-xml".split()
)
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
BLOCK = CLOSES_P | frozenset("html head body li dt dd tr td th thead tbody tfoot caption colgroup option optgroup legend summary frameset listing plaintext search".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
FRAME_TAGS = frozenset("nav footer aside header form button menu dialog fieldset".split())
MAIN_TAGS = frozenset(["article", "main"])
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
LIST_TAGS = frozenset("ul ol li dl dt dd menu".split())
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted comment comments reply replies disqus respond responses "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget footer foot header masthead topbar toolbar cookie cookies consent "
    "gdpr notice alert popup modal overlay newsletter subscribe subscription signup login register form search share sharing social related recommended "
    "recommendations trending popular copyright legal disclaimer tags meta byline skip complementary contentinfo dialog hidden".split()
)
MAIN_WORDS = frozenset("article content post entry story main body text articlebody maincontent".split())
OPEN_TAG = re.compile(r"([a-zA-Z][^\s/>]*)")
NAMES = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
MAY_HIDE = re.compile("hidden|style", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([^\s/][^\s/=]*)(?:\s*=\s*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\s"']\S*)))?""")
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([^;]*)", re.IGNORECASE)
QUOTED = re.compile(r"""=\s*(["'])""")
SPLIT_NAME = re.compile(r"[a-z]+|[A-Z]+[a-z]*")

FEATURES = ["bias", "run", "frame tag", "main tag", "prose tag", "list tag", "frame word", "main word", "links", "length", "stops", "short", "other block"]


@dataclass
class Page:
    """Nodes in document order: parent's number, tag ("" for a run of text), features, text of runs."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    marks: list[tuple[int, int]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, marks: tuple[int, int] = (0, 0), text: str = "", links: int = 0) -> int:
        for column, value in zip((self.parent, self.tag, self.marks, self.text, self.links), (parent, tag, marks, text, links), strict=True):
            column.append(value)
        return len(self.parent) - 1


def _tag_end(source: str, start: int) -> int:
    """Position of the > that ends the tag starting at `start`; one in a quoted value does not, unless the quote never ends."""
    while True:
        end = source.find(">", start)
        if end < 0:
            return len(source)
        quote = QUOTED.search(source, start, end)
        close = source.find(quote[1], quote.end()) if quote else -1
        if close < 0:
            return end
        start = close + 1


def hides(attributes: str) -> bool:
    """Whether an element is hidden by its attribute hidden, aria-hidden=true, or display: none as the display its style ends up with."""
    if not MAY_HIDE.search(attributes):
        return False
    values: dict[str, str] = {}
    for name, *value in ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), html.unescape("".join(value)))  # the first of a name counts
    shown = [v.lower() for v in DISPLAY.findall(re.sub(r"/\*.*?\*/", " ", values.get("style", ""), flags=re.DOTALL))]
    shown = [v for v in shown if "!important" in v.replace(" ", "")] or shown
    return "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true" or bool(shown) and shown[-1].split("!")[0].strip() == "none"


def parse(source: str) -> Page:
    """The tree of block elements and runs of text. Unclosed and misnested tags are closed as browsers do; an element that is no known block runs in its text."""
    page = Page()
    stack: list[tuple[str, int]] = [("", page.add(-1, "root"))]
    buffer: list[str] = []
    linked, hidden, in_link = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                page.add(next(n for t, n in reversed(stack) if n >= 0), "", text=text, links=min(linked, len(text)))
            buffer.clear()
        linked = 0

    def pop() -> None:
        nonlocal hidden, in_link
        tag, node = stack[-1]
        if node >= 0:
            flush()
        hidden -= node == -2
        in_link -= tag == "a" and node == -1
        stack.pop()

    def close(names: frozenset[str] | tuple[str, ...], until: tuple[str, ...] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in until:
                return

    def leave_head() -> None:
        """An open head ends before what does not belong in it; its end tag is optional."""
        while stack[-1][0] == "head":
            pop()

    at, size = 0, len(source)
    while at < size:
        start = source.find("<", at)
        start = size if start < 0 else start
        if hidden and source[at:start].strip():
            leave_head()
        if start > at and not hidden:
            text = html.unescape(source[at:start])
            buffer.append(text)
            linked += len(text) if in_link else 0
        if start == size:
            break
        following = source[start + 1 : start + 2]
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if following in ("!", "?"):
            end = source.find(">", start)
            at = size if end < 0 else end + 1
            continue
        closing = following == "/"
        name = OPEN_TAG.match(source, start + 1 + closing)
        if not name:
            leave_head()
            if not hidden:
                buffer.append("<")
            at = start + 1
            continue
        tag, end = name[1].lower(), _tag_end(source, name.end())
        at = end + 1
        if closing:
            if tag not in BLOCK:  # never closes a block
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag or stack[i][1] >= 0), 0)
            else:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth and stack[depth][0] == tag:
                while len(stack) > depth:
                    pop()
            elif tag in BLOCK and not hidden:
                flush()
            continue
        attributes = source[name.end() : end]
        if tag not in HEAD_TAGS:
            leave_head()
        if tag == "br" or tag == "wbr":
            if tag == "br" and not hidden:
                buffer.append(" ")
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
            at = _tag_end(source, stop.end()) + 1 if stop else size
            continue
        if tag in CLOSES_P:
            close(("p",), frozenset(["button", "td", "th", "table"]))
        if tag in CLOSES:
            names, until = CLOSES[tag]
            close(tuple(names.split()), tuple(until.split()))
        if tag in VOID:
            if tag == "hr" and not hidden:
                flush()
            continue
        if attributes.endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            continue
        if hidden or tag in HIDDEN or hides(attributes):  # what is not shown does not end a block either
            stack.append((tag, -2))
            hidden += 1
            continue
        if tag not in BLOCK:
            stack.append((tag, -1))
            in_link += tag == "a"
            continue
        flush()
        words = {w.lower() for m in NAMES.finditer(attributes) for w in SPLIT_NAME.findall(m[1])}
        marks = (int(bool(words & FRAME_WORDS)), int(bool(words & MAIN_WORDS)))
        stack.append((tag, page.add(next(n for t, n in reversed(stack) if n >= 0), tag, marks)))
    flush()
    return page


def features(page: Page) -> np.ndarray:
    n = len(page.parent)
    length, links = [len(t) for t in page.text], list(page.links)
    stops = [sum(map(t.count, ".,;:!?。，")) if t else 0 for t in page.text]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        length[p] += length[i]
        links[p] += links[i]
        stops[p] += stops[i]
    rows = []
    for i in range(n):
        tag, (frame, main) = page.tag[i], page.marks[i]
        run, prose, listed = tag == "", tag in PROSE_TAGS, tag in LIST_TAGS
        rows.append((
            1.0, run, tag in FRAME_TAGS, tag in MAIN_TAGS, prose, listed, frame, main, links[i] / max(length[i], 1),
            min(math.log1p(length[i]) / 7, 1.5), min(stops[i] / (1 + length[i] / 40), 2.0), run and length[i] < 30,
            not (run or prose or listed or tag in FRAME_TAGS or tag in MAIN_TAGS),
        ))
    return np.array(rows, dtype=float)


def marginals(parent: list[int], evidence: list[float], bond: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Content marginals of all nodes, and the summed marginals of parent-child states, by messages up and down the tree.

    `evidence` is the log odds of content, `bond[s][t]` the log potential of a parent in state s with a child in state t.
    Parents come before their children, so one backward and one forward pass are the whole schedule.
    """
    n = len(parent)
    b00, b01, b10, b11 = (math.exp(x) for row in bond for x in row)
    odds = [math.exp(max(-30.0, min(30.0, e))) for e in evidence]
    low, high = [1.0 / (1 + o) for o in odds], [o / (1 + o) for o in odds]
    up0, up1 = [1.0] * n, [1.0] * n
    for i in range(n - 1, 0, -1):
        m0, m1 = b00 * low[i] + b01 * high[i], b10 * low[i] + b11 * high[i]
        total = m0 + m1
        up0[i], up1[i] = m0 / total, m1 / total
        p = parent[i]
        a, b = low[p] * up0[i], high[p] * up1[i]
        total = a + b or 1.0
        low[p], high[p] = max(a / total, 1e-30), max(b / total, 1e-30)
    pairs = [[0.0, 0.0], [0.0, 0.0]]
    good = [0.0] * n
    total = low[0] + high[0]
    good[0] = high[0] / total
    for i in range(1, n):
        p = parent[i]
        r0, r1 = (1 - good[p]) / up0[i], good[p] / up1[i]
        j00, j01, j10, j11 = r0 * b00 * low[i], r0 * b01 * high[i], r1 * b10 * low[i], r1 * b11 * high[i]
        total = j00 + j01 + j10 + j11
        good[i] = (j01 + j11) / total
        pairs[0][0] += j00 / total
        pairs[0][1] += j01 / total
        pairs[1][0] += j10 / total
        pairs[1][1] += j11 / total
    return good, pairs


@dataclass
class Model:
    weights: np.ndarray
    bond: list[list[float]]

    def text(self, source: str) -> str:
        page = parse(source)
        good, _ = marginals(page.parent, (features(page) @ self.weights).tolist(), self.bond)
        return "\n\n".join(t for t, g in zip(page.text, good, strict=True) if t and g >= 0.5)


def labelled(page: Page) -> list[int] | None:
    """States that the page's own marks give: inside an article or main, and not in a frame block; None without such a mark."""
    state = []
    for i, (p, tag) in enumerate(zip(page.parent, page.tag, strict=True)):
        above = state[p] if i else 0
        frame = tag in FRAME_TAGS or page.marks[i][0]
        state.append(int((above or tag in MAIN_TAGS) and not frame))
    return state if any(s and t for s, t in zip(state, page.text, strict=True)) else None


def varied(page: Page, state: list[int], rng: np.random.Generator) -> tuple[Page, list[int]]:
    """The page with its mark taken away or turned into a class name, boilerplate marked in other ways, filled with prose and moved
    into the main text, and prose under other tags: labels stay known, and no single sign decides alone."""
    children: list[list[int]] = [[] for _ in state]
    for i in range(1, len(state)):
        children[page.parent[i]].append(i)
    top = next(i for i in range(len(state)) if state[i])
    frames = [i for i in range(1, len(state)) if page.tag[i] and not state[i] and (page.tag[i] in FRAME_TAGS or page.marks[i][0])]
    prose = [i for i in range(len(state)) if state[i] and page.text[i]]
    named = rng.random() < 0.5
    out, label = Page(), []
    moved = frames[rng.integers(len(frames))] if frames else -1

    def emit(i: int, above: int, good: int) -> None:
        # Depth is bounded by TRAIN_CHARS; an explicit stack keeps deep pages from ending the interpreter's own.
        todo = [(i, above, good)]
        while todo:
            i, above, good = todo.pop()
            tag, marks = page.tag[i], page.marks[i]
            if i == top or tag in MAIN_TAGS:
                tag, marks = "div", (0, int(named and i == top))
            elif i in frames:
                tag, marks = ("div", (1, 0)) if rng.random() < 0.5 else (rng.choice(sorted(FRAME_TAGS)), (int(rng.random() < 0.3), 0))
            elif good and tag == "p" and rng.random() < 0.3:
                tag = rng.choice(["li", "td", "div", "blockquote"])
            node = out.add(above, str(tag), marks, page.text[i], page.links[i])
            label.append(good)
            if i in frames and prose and rng.random() < 0.6:
                text = page.text[prose[rng.integers(len(prose))]]
                inner = out.add(node, "p")
                out.add(inner, "", text=text)
                label.extend([0, 0])
            below = [(c, node, state[c]) for c in children[i] if i == moved or c != moved]
            if i == top and moved >= 0:
                below.insert(int(rng.integers(len(below) + 1)), (moved, node, 0))
            todo += reversed(below)

    emit(0, -1, state[0])
    return out, label


def fit(sources: list[str]) -> Model:
    """Maximum likelihood with a small penalty on the pages that mark their main text; without any, prose outside frame blocks counts."""
    data, rng = [], np.random.default_rng(5)
    for source in sources:
        page = parse(source)
        state = labelled(page)
        if state:
            data += [(page, state), varied(page, state, rng), varied(page, state, rng)]
    width = len(FEATURES)
    theta = np.zeros(width + 4)
    if not data:
        start = {"bias": -1.0, "frame tag": -6.0, "main tag": 4.0, "prose tag": 2.0, "frame word": -6.0, "main word": 2.0, "links": -4.0, "length": 2.0}
        return Model(np.array([start.get(f, 0.0) for f in FEATURES]), [[1.0, -1.0], [-1.0, 1.0]])
    matrices = [(features(page), page.parent, np.array(state)) for page, state in data]
    total = sum(len(s) for _, _, s in matrices)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        gradient = -PENALTY * theta
        bond = theta[width:].reshape(2, 2).tolist()
        for x, parent, state in matrices:
            good, pairs = marginals(parent, (x @ theta[:width]).tolist(), bond)
            gradient[:width] += x.T @ (state - np.array(good)) / total
            seen = np.bincount(2 * state[np.array(parent[1:], dtype=int)] + state[1:], minlength=4) if len(state) > 1 else np.zeros(4)
            gradient[width:] += (seen - np.array(pairs).ravel()) / total
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:width], theta[width:].reshape(2, 2).tolist())


def train(pages: DataFrame, number: int = TRAIN_PAGES) -> Model:
    chosen = (
        pages.where(F.length("html").between(1, TRAIN_CHARS) & F.lower("html").rlike("<(article|main)[\\s>]"))
        .select("html", F.xxhash64("page_id", "html").alias("order")).orderBy("order", "html").limit(number)
    )
    return fit([r.html for r in chosen.toLocalIterator()])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """`page_id`, `url`, `text` and `n_chars` of every row. A null, empty or textless page gives an empty text; ids and urls may be null
    and rows repeated; other columns are ignored; an empty table gives no rows."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.text(h) if h else "" for h in batch], dtype=object)

    done = pages.select("page_id", "url", text("html").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
