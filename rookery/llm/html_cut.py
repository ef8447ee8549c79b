"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of running text. A classifier of a block's wording (words, share of links, end of a sentence, heading or not)
gives its log odds of being content; they and the costs of the asides it is in are its capacity to source or sink. The
classifier is trained here, on the pages themselves: blocks of article elements outside asides count as content, blocks
in asides as boilerplate, and the logarithms of the two balanced counts of each of 84 cells, drawn towards odds set by
hand while there are few, are the odds (``learn``: one job over all pages, whose result has at most 168 rows).

Smoothness edges join blocks that follow each other and blocks that are neighbours below one parent, the more weakly the
farther apart they are in the document tree and across the border of an aside. An article or main element is a node of
its own, likely content, with a weak edge to each of its blocks outside asides. So a block whose wording speaks against
it is content where its neighbours are. The minimum cut (maximum flow, after fixing every node whose own cost
outweighs all its edges) separates content from boilerplate.

An element is in an aside for its tag, for being hidden, or for a class, id or role all of whose words are those of
asides or general ones (``sidebar``, ``ad-box``). A name that only contains such a word (``login-history``) is a hint,
which counts outside articles only and which wording and neighbours can outweigh.

Defined cases: a null or empty page has the text "". Unclosed, misplaced or unknown tags are tolerated, as are character
references without a semicolon. Formulas keep their characters. What is not shown as text (``svg``, ``canvas``, media and
their fallbacks, templates, annotations of formulas) is markup; ``noscript`` is text inside an article and a notice
outside. Pages of any length are read whole. Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = set("script style template textarea title iframe object svg canvas audio video annotation annotation-xml".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
PARAGRAPH_STAYS_OPEN = set("button body html".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table select menu".split())
ASIDE_TAGS = set("nav footer aside form menu dialog button select fieldset".split())
ASIDE_WORDS = set(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus dropdown footer gdpr "
    "form login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related "
    "replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget".split()
)
GENERAL_WORDS = set(
    "a area article bar block body bottom box bubble button buttons card center col column container content entry field fixed global group header icon icons "
    "info inline inner item items js label large left link links list listing main mobile module nested news outer page pane panel popular post posts primary "
    "reader region right row secondary section site slot small sticky stories story text title top user users view visible wrap wrapper".split()
)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


@dataclass
class Costs:
    """Weights of the classifier (log odds of content) and of the smoothness edges."""

    article: float = 4.0  # of an article or main element itself
    inside: float = 0.2  # between it and a block in it
    inside_heading: float = 0.6
    hint: float = -3.0  # outside article and main elements
    aside_word: float = -6.0
    aside_tag: float = -8.0
    hidden: float = -9.0
    base: float = -0.5
    words: float = 2.0  # reached at ``words_full`` words
    words_full: int = 24
    links: float = -3.0  # times the share of linked characters
    sentence: float = 0.4
    smooth: float = 2.4  # of blocks that follow each other, over 1 + distance in the tree
    sibling: float = 1.2
    contrast: float = 0.1  # times this where one block is in an aside and the other isn't
    prior: float = 50.0  # blocks that the odds by hand count as in each cell
    most: float = 2.0  # what wording can speak for a block, or against one with links
    against: float = 0.4  # what wording can speak against a block without links
    learned: dict[int, float] = field(default_factory=dict)  # log odds of a cell; by hand where there are none


#: Kinds of asides, the weakest first.
HINT, WORD, ELEMENT, HIDDEN = 1, 2, 3, 4


@dataclass
class Block:
    text: str
    linked: float  # share of linked characters
    far: int  # distance in the tree to the block before
    parent: int
    article: int  # number of the innermost article or main element around it, 0 if there is none
    aside: int  # 0 or the strongest kind around it
    heading: bool


@dataclass
class _Element:
    name: str
    number: int
    article: int
    aside: int


def _kind(names: str, article: int) -> int:
    """What the words of a class, id or role say of an element."""
    out = 0
    for name in names.split():
        words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)}
        if words & ASIDE_WORDS or "header" in words and not article:
            out = max(out, WORD if words <= ASIDE_WORDS | GENERAL_WORDS else HINT)
    return out


def _open(name: str, attributes: str, number: int, parent: _Element) -> _Element:
    article, aside = parent.article, parent.aside
    if name in ("article", "main"):
        article, aside = number, aside if aside > HINT else 0
    if name in ASIDE_TAGS or name in ("header", "noscript") and not article:
        aside = max(aside, ELEMENT)
    if attributes and name not in ("html", "body", "main"):
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                aside = HIDDEN
            elif key in ("class", "id", "role"):
                aside = max(aside, _kind(value, article))
                article = number if key == "role" and value in ("main", "article") else article
    return _Element(name, number, article, aside)


class _Open:
    """The open elements, and where those of a name, blocks and scopes are among them, so that none is sought."""

    def __init__(self) -> None:
        self.stack = [_Element("", 0, 0, 0)]
        self.at: dict[str, list[int]] = {}
        self.blocks, self.scopes = [0], [0]

    def last(self, name: str) -> int:
        return self.at[name][-1] if self.at.get(name) else 0

    def push(self, element: _Element, block: bool) -> None:
        k = len(self.stack)
        self.stack.append(element)
        self.at.setdefault(element.name, []).append(k)
        if block:
            self.blocks.append(k)
        if element.name in SCOPES:
            self.scopes.append(k)

    def pop(self) -> None:
        k, name = len(self.stack) - 1, self.stack.pop().name
        self.at[name].pop()
        for own in (self.blocks, self.scopes):
            if own[-1] == k:
                own.pop()


def blocks_of(page: str) -> list[Block]:
    """The blocks of running text of a page, in order, with their place in the tree; in linear time."""
    out: list[Block] = []
    tree = _Open()
    stack = tree.stack
    parts: list[str] = []
    total = linked = count = at = 0
    low, before = 0, 0  # elements open since the last block, and its depth

    def flush() -> None:
        nonlocal total, linked, low, before
        text = " ".join("".join(parts).split())
        if text:
            top, inner = tree.blocks[-1], stack[-1]
            depth = top + 1
            far = before + depth - 2 * min(before, depth, low)
            out.append(Block(text, linked / max(1, total), far, stack[top - 1].number if top else -1, inner.article, inner.aside, stack[top].name in HEADINGS))
            low, before = len(stack), depth
        parts.clear()
        total = linked = 0

    def text_until(end: int) -> None:
        nonlocal total, linked
        if end > at:
            piece = page[at:end]
            parts.append(html.unescape(piece) if "&" in piece else piece)
            n = len(piece.strip())
            total += n
            linked += n if tree.last("a") else 0

    def close(upto: int) -> None:
        """Ends the elements from place ``upto`` of the stack on."""
        nonlocal low
        if tree.blocks[-1] >= upto:
            flush()
        low = min(low, upto)
        while len(stack) > upto:
            tree.pop()

    end_of_tags = page.rfind(">")
    while at <= end_of_tags and (m := TAG.search(page, at)):
        text_until(m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            k = tree.last(name)
            if k and (name in BLOCKS or k > tree.scopes[-1] or stack[k].name in SCOPES):
                close(k)
            continue
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
        block = name in BLOCKS or name == "noscript" and not stack[-1].article
        if block:
            flush()
            if name not in PARAGRAPH_STAYS_OPEN and stack[tree.blocks[-1]].name == "p":
                close(tree.blocks[-1])
            if name in CLOSES and (k := max(map(tree.last, CLOSES[name]))) > tree.scopes[-1]:
                close(k)
        if name not in VOID and not m[3].endswith("/"):
            count += 1
            tree.push(_open(name, m[3], count, stack[-1]), block)
    text_until(len(page))
    flush()
    return out


def cell_of(block: Block) -> int:
    """The cell of a block: its words in powers of two, how much of it is linked, whether a sentence ends, and whether it is a heading."""
    n = min(7, (block.text.count(" ") + 1).bit_length())
    linked = 0 if not block.linked else 1 if block.linked < 0.5 else 2
    return n * 12 + linked * 4 + block.text.endswith((".", "!", "?", "…")) * 2 + block.heading


def by_hand(cell: int, c: Costs) -> float:
    """Log odds of a cell where nothing has been learned."""
    n, linked, sentence = 1.5 * 2 ** (cell // 12 - 1), (0.0, 0.25, 1.0)[cell % 12 // 4], cell % 4 // 2
    return c.base + c.words * min(1.0, n / c.words_full) + c.links * linked + c.sentence * sentence


def learn(pages: DataFrame, costs: Costs | None = None) -> Costs:
    """``costs`` with the log odds of all pages' blocks in and outside article elements; without any, those by hand."""
    c = costs or Costs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[int, bool]] = Counter()
        for batch in batches:
            for page in batch.column(0):
                found.update((cell_of(b), not b.aside) for b in blocks_of(page.as_py() or "") if b.aside > HINT or b.article and not b.aside)
        yield pa.RecordBatch.from_pylist([{"cell": k, "content": x, "n": n} for (k, x), n in found.items()], schema=pa.schema([("cell", pa.int32()), ("content", pa.bool_()), ("n", pa.int64())]))

    rows = pages.select("html").mapInArrow(run, "cell int, content boolean, n long").groupBy("cell", "content").agg(F.sum("n").alias("n")).collect()
    n = {(r.cell, r.content): r.n for r in rows}
    good, bad = (sum(x for (_, content), x in n.items() if content is side) for side in (True, False))
    learned = {}
    for cell in {k for k, _ in n} if good and bad else ():
        p = 1 / (1 + math.exp(-by_hand(cell, c)))
        learned[cell] = math.log((n.get((cell, True), 0) + c.prior * p) / (n.get((cell, False), 0) * good / bad + c.prior * (1 - p)))
    return Costs(**{**c.__dict__, "learned": learned})


def odds(block: Block, c: Costs) -> float:
    """Log odds that a block is content, by its wording and the asides it is in."""
    cell = cell_of(block)
    wording = c.learned[cell] if cell in c.learned else by_hand(cell, c)
    return max(-(c.most if block.linked else c.against), min(c.most, wording)) + (0.0, 0.0 if block.article else c.hint, c.aside_word, c.aside_tag, c.hidden)[block.aside]


def edges_of(blocks: list[Block], c: Costs) -> dict[tuple[int, int], float]:
    """Smoothness edges (i < j) with their weights."""
    out: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, bool], int] = {}
    for j, b in enumerate(blocks):
        if j:
            alike = (b.aside > HINT) == (blocks[j - 1].aside > HINT)
            out[j - 1, j] = c.smooth / (1 + b.far) * (1 if alike else c.contrast)
        parent = (b.parent, b.aside > HINT)
        if parent in last:
            out[last[parent], j] = out.get((last[parent], j), 0.0) + c.sibling
        last[parent] = j
    return out


def minimum_cut(unary: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The labels (True: source side) of least cost: -unary for True or +unary for False where positive, and each edge
    whose ends differ."""
    n = len(unary)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for (i, j), w in edges.items():
        near[i].append((j, w))
        near[j].append((i, w))
    pull, free = list(unary), [sum(w for _, w in x) for x in near]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # what outweighs all its open edges has this label in some minimum cut
        i = todo.popleft()
        if label[i] is None and abs(pull[i]) >= free[i] - 1e-12:
            label[i] = pull[i] >= 0
            for j, w in near[i]:
                if label[j] is None:
                    pull[j] += w if label[i] else -w
                    free[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _max_flow(rest, pull, near), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], pull: list[float], near: list[list[tuple[int, float]]]) -> list[bool]:
    """Source side of the minimum cut among ``nodes``, by Dinic's algorithm."""
    at = {i: k + 2 for k, i in enumerate(nodes)}  # 0: source, 1: sink
    graph: list[list[int]] = [[] for _ in range(len(nodes) + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        for x, y, w in ((a, b, forth), (b, a, back)):
            graph[x].append(len(to))
            to.append(y)
            room.append(w)

    for i in nodes:
        join(*((0, at[i]) if pull[i] > 0 else (at[i], 1)), abs(pull[i]), 0.0)
        for j, w in near[i]:
            if j > i and j in at:
                join(at[i], at[j], w, w)
    while True:
        level = [-1] * len(graph)
        level[0], todo = 0, deque([0])
        while todo:
            a = todo.popleft()
            for e in graph[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[1] < 0:
            return [level[at[i]] >= 0 for i in nodes]
        tried, path, a = [0] * len(graph), [], 0
        while True:
            if a == 1:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                a = to[path[k] ^ 1]
                del path[k:]
            elif tried[a] < len(graph[a]):
                e = graph[a][tried[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    tried[a] += 1
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1
            else:
                break


def labelled(page: str | None, costs: Costs | None = None) -> tuple[list[Block], list[float], list[bool]]:
    """The blocks of a page, their own log odds and the labels of the minimum cut."""
    costs, blocks = costs or Costs(), blocks_of(page or "")
    own, edges = [odds(b, costs) for b in blocks], edges_of(blocks, costs)
    articles: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if b.article and b.aside <= HINT:
            edges[k, articles.setdefault(b.article, len(blocks) + len(articles))] = costs.inside_heading if b.heading else costs.inside
    labels = minimum_cut(own + [costs.article] * len(articles), edges)
    return blocks, own, labels[: len(blocks)]


def main_text(page: str | None, costs: Costs | None = None) -> str:
    blocks, _, labels = labelled(page, costs)
    return "\n\n".join(b.text for b, content in zip(blocks, labels, strict=True) if content)


def extract(pages: DataFrame, costs: Costs | None = None) -> DataFrame:
    """page_id, url and the main text of every row of ``pages``, by ``costs`` or by what these pages teach."""
    costs = costs or learn(pages)
    schema = pages.select("page_id", "url").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x, costs) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
