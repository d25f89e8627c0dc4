"""Main text of web pages by a minimum cut over their blocks.

A page is cut into blocks: runs of text between block-level tags. A classifier
says what it costs to call a block content or boilerplate; these costs are the
capacities of its edges to the two terminals. Blocks that follow each other, or
that hang on the same or a near node, are joined by smoothness edges. The maximum
flow gives the labelling of least total cost.

The cost of a block has two parts: what its place in the page says (fixed
weights), and a logistic regression on its text, trained on blocks whose place
settles their label, so that pages without telling tags are judged by their text.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.llm.common import prepare

# Elements by their role in the page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe object svg math textarea title select audio video canvas".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button fieldset head".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline-links comment comments consent cookie"
    " cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice pagination"
    " popup promo promoted promotion recommended related reply respond share sharing sidebar signup social sponsor"
    " sponsored subscribe subscription toolbar topbar widget".split()
)
FOREIGN_WORDS = frozenset("comment comments disqus recommended related replies reply respond".split())  # hold articles of others
CONTENT_WORDS = frozenset("article articlebody content entry main post story".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre"
    " section table ul".split()
)

PLACE_BAD, PLACE_GOOD, HEADER = 3.5, 5.0, 3.0  # weights of what the place says; text and neighbours can outweigh the first
HIDDEN, HINT = 8.0, 1.5  # of what is not shown; of a class with a boilerplate word among others ("with-sidebar")
SMOOTH = 0.8  # of two blocks that follow each other on the same node; less the farther apart their nodes are
TRAIN_PAGES = 400  # bound of the sample of pages whose blocks train the text classifier
SCALE = 1000  # capacities are whole numbers

TAG = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")


class Node:
    """An open element: depth in the tree, and the nearest element, itself or an ancestor, that says something about its text."""

    __slots__ = ("tag", "parent", "depth", "score", "marked", "hidden", "form", "holds", "link", "header", "inside", "fixed")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        bad, good, hint, hidden = tag in BOILERPLATE_TAGS, tag in CONTENT_TAGS, False, False
        content, foreign = good, tag in BOILERPLATE_TAGS and tag != "form"
        if attributes:
            values = {n.lower(): v.strip("\"'").lower() for n, v in ATTRIBUTE.findall(attributes)}
            names = [set(filter(None, re.split(r"[^a-z0-9]+", n))) for n in f"{values.get('class', '')} {values.get('id', '')}".split()]
            bad |= values.get("role") in BOILERPLATE_ROLES
            content |= values.get("role") in ("main", "article") or values.get("itemprop") == "articlebody"
            good |= content
            hidden = "hidden" in values or values.get("aria-hidden") == "true"
            hidden |= "display:none" in values.get("style", "").replace(" ", "")
            if tag not in ("html", "body"):  # their classes speak of the layout of the whole page
                bad |= any(n and n <= BOILERPLATE_WORDS for n in names)
                foreign |= any(n and n <= FOREIGN_WORDS for n in names)
                hint = any(not n.isdisjoint(BOILERPLATE_WORDS) for n in names)
                good |= any(not n.isdisjoint(CONTENT_WORDS) for n in names)
        # Of nested articles the outermost is content whatever the elements around it are called; those inside it
        # (reader comments) and those in an aside or the like (related stories) are what their own place says.
        self.fixed = foreign or (parent.fixed if parent else False)
        self.inside = parent.inside if parent else False
        resets = content and not self.inside and not self.fixed
        self.inside |= resets
        self.score = -PLACE_BAD if bad and not resets else PLACE_GOOD if good and (resets or not hint) else -HINT if hint else 0.0
        above = parent.marked if parent else None
        if above and above.score < 0 and not resets:
            # A class inside a footer is still the footer, an article below comments still one of them.
            if self.score == -HINT or (self.score > 0 and (self.fixed or self.inside)):
                self.score = 0.0
        self.marked = self if self.score else above
        self.hidden = hidden or (parent.hidden if parent else False)
        self.form = self if tag == "form" else parent.form if parent else None
        self.holds = False
        if resets and self.form:
            self.form.holds = True  # a form around the whole page says nothing
        self.link = tag == "a" or (parent.link if parent else False)
        self.header = tag == "header" or (parent.header if parent else False)


class Block:
    __slots__ = ("text", "node", "linked", "chars")

    def __init__(self, text: str, node: Node, linked: int, chars: int):
        self.text, self.node, self.linked, self.chars = text, node, linked, chars


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order, white space made single; none for null."""
    page = page or ""
    root = node = Node("#", None)
    found: list[Block] = []
    parts: list[str] = []
    home, linked, at, end = root, 0, 0, len(page)

    def add(raw: str) -> None:
        nonlocal home, linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            if not parts or not "".join(parts).strip():
                home = node
            if node.link:
                linked += len(text.strip())
            parts.append(text)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                place = home
                while place.tag in INLINE and place.parent:  # the block hangs on its block-level element
                    place = place.parent
                found.append(Block(text, place, linked, len(text)))
            parts.clear()
        linked = 0

    while at < end:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        match = TAG.match(page, start)
        if not match:  # a lone "<" is text
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        at = match.end()
        closing, name, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not name:
            continue  # comment or declaration
        name = name.lower()
        if closing:
            if name not in INLINE:
                flush()
            up = node
            while up.parent and up.tag != name:
                up = up.parent
            if up.parent:
                node = up.parent
            continue
        if name in SKIPPED:  # inside a paragraph they do not end it
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name == "br":
            add(" ")
            continue
        if name not in INLINE:
            flush()
        if name in CLOSES_P or name == "li":
            up = node
            while up.parent and up.tag in INLINE:
                up = up.parent
            if up.tag == ("li" if name == "li" else "p") and up.parent:
                node = up.parent
        if name not in VOID and not attributes.rstrip().endswith("/"):
            node = Node(name, node, attributes)
    flush()
    return found


def text_features(block: Block) -> list[float]:
    words = block.text.split()
    letters = sum(map(str.isalpha, block.text))
    return [
        1.0,
        min(6.0, math.log1p(len(words))),
        block.linked / block.chars,
        float(block.text[-1] in ".!?…\"'”»)"),
        sum(block.text.count(c) for c in ".,;:") / len(words),
        letters / block.chars,
        float(len(words) < 4),
        float(block.node.tag in ("p", "blockquote", "pre")),
        float(block.node.tag in ("li", "td", "dd")),
        float(block.node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
    ]


FEATURES = 10


def fit_text_model(features: np.ndarray, labels: np.ndarray, steps: int = 200) -> np.ndarray:
    """Logistic regression, classes of equal weight; zero weights when there is one class only."""
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(FEATURES)
    share = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    w = np.zeros(FEATURES)
    for _ in range(steps):  # Newton steps would do with fewer; plain ones cannot fail
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        w -= 0.2 * (features.T @ (share * (p - labels)) + 0.001 * w)
    return w


def place_score(node: Node) -> float:
    """What the place of a block says: positive for content."""
    if node.hidden:
        return -HIDDEN
    mark = node.marked
    while mark and mark.holds:
        mark = mark.parent.marked
    if mark:
        return mark.score
    return -HEADER if node.header else 0.0


def distance(a: Node, b: Node) -> int:
    """Steps between two nodes of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(source: Sequence[int], sink: Sequence[int], edges: Sequence[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut.

    ``source[i]`` and ``sink[i]`` are the capacities of node i to the terminals,
    ``edges`` (i, j, capacity) run both ways. Dinic's algorithm; of all minimum
    cuts the one with the fewest nodes on the source side.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i in range(n):
        both = min(source[i], sink[i])  # flows straight through
        if source[i] > both:
            join(s, i, source[i] - both, 0)
        if sink[i] > both:
            join(i, t, sink[i] - both, 0)
    for i, j, c in edges:
        if c:
            join(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nexts = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                amount = min(room[e] for e in path)
                for e in path:
                    room[e] -= amount
                    room[e ^ 1] += amount
                cut = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nexts[a] < len(out[a]):
                e = out[a][nexts[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                nexts[a] += 1
            if nexts[a] < len(out[a]):
                path.append(out[a][nexts[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                nexts[a] += 1
            else:
                break


def label_blocks(found: Sequence[Block], model: np.ndarray) -> list[bool]:
    """True for the blocks of content."""
    if not found:
        return []
    scores = np.array([place_score(b.node) for b in found])
    scores += np.clip(np.array([text_features(b) for b in found]) @ model, -2.0, 2.0)
    whole = np.round(scores * SCALE).astype(int).tolist()
    edges = []
    last_of: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            near = SMOOTH / (1 + distance(found[i - 1].node, block.node) / 2)
            edges.append((i - 1, i, round(near * SCALE)))
        siblings = id(block.node.parent or block.node)
        if last_of.get(siblings, i - 1) != i - 1:  # the last block on the same element, if others are between
            edges.append((last_of[siblings], i, round(SMOOTH / 2 * SCALE)))
        last_of[siblings] = i
    return minimum_cut([max(0, x) for x in whole], [max(0, -x) for x in whole], edges)


def page_text(page: str | None, model: np.ndarray) -> str:
    found = blocks_of(page)
    return "\n".join(b.text for b, keep in zip(found, label_blocks(found, model)) if keep)


def train_text_model(pages: DataFrame, sample: int = TRAIN_PAGES) -> np.ndarray:
    """Fit the text classifier on the blocks of at most ``sample`` pages (page_id, html), picked by a hash of the id."""
    prepare(pages.sparkSession)
    picked = pages.where("page_id IS NOT NULL").select("page_id").distinct().orderBy(F.xxhash64("page_id")).limit(sample)

    def collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (place_score(b.node) > 0, text_features(b))
                for page in frame["html"]
                for b in blocks_of(page)
                if abs(place_score(b.node)) > HINT
            ]
            yield pd.DataFrame(rows, columns=["content", "features"])

    chosen = pages.select("page_id", "html").join(F.broadcast(picked), "page_id").dropDuplicates(["page_id"])
    # Blocks with equal features count once per page sample: the table stays small however long a page is.
    blocks = chosen.select("html").mapInPandas(collect, "content boolean, features array<double>").distinct()
    got = blocks.orderBy("content", "features").toPandas()
    if not len(got):
        return np.zeros(FEATURES)
    return fit_text_model(np.vstack(got["features"]), got["content"].to_numpy(float))


def main_text(model: np.ndarray, page: Column) -> Column:
    weights = model.tolist()

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([page_text(p, np.array(weights)) for p in pages], dtype=object)

    return extract(page)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    The whole html is read. Character references are decoded, white space inside
    a block becomes one space, blocks are trimmed and joined in page order by a
    line break; nothing else is dropped or cut. A null or empty page, and one
    without content, has an empty text. Repeated rows are extracted each; an
    empty table gives no rows. Plain text without tags is one block, judged by
    its words.
    """
    model = train_text_model(pages)
    got = pages.select("page_id", "url", main_text(model, F.col("html")).alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))
