"""Benchmark decontamination: a BM25 index of the test items with block-max WAND, queried with every passage.

Impacts (BM25 contributions) are divided by their item's threshold, ``ratio`` of the score it has with itself, so an item
is retrieved where its impacts add up to 1. Items lie in blocks of neighbours, and blocks in at most ``GROUPS`` groups;
the index has the greatest impact of each term in each block and group. Passages are windows of every text, overlapping by
half. Items go by length, in classes up to a power of two, and each class has an index and windows of its own, of twice
that power: an item lies in one window wherever it begins, and which windows it meets depends on its own length alone. The
bounds of all passages
in all groups are summed at once; only groups whose bound reaches 1 are searched, by block-max WAND: cursors over the
posting lists of the passage's terms, a pivot where the lists' greatest impacts reach 1, blocks skipped whose own greatest
impacts don't. Bounds are never below scores, so every item above its threshold is retrieved. Retrieved items are
verified: of the question's word five-grams and the answer's word pairs, ``overlap`` must occur in the passage. The answer
is an item's last sentence (of a single sentence, its last quarter).

Document frequencies and lengths are counted over all items by Spark. Items go out to the tasks in chunks of about
``CHUNK_WORDS`` words, dealt by hash; more items mean more passes, never a larger broadcast, and change no score.

Defined cases: null texts and items are empty; an item without words is never found; equal items are all reported. Words
are compared in lower case without punctuation at their ends. A row is reported once per item, with its best passage.
Scores are multiples of the item's threshold.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType

from ._shared import plain_object, saved, slices, split_words

CHUNK_WORDS = 150_000
BLOCK = 2
GROUPS = 128
COMMON = 0.4
SLACK = 1e-3  # for sums in single precision
K1, B = 1.2, 0.75
SLICE, SLICE_BYTES = 256, 1 << 20
BOUNDS = 1 << 15  # (passage, term) pairs whose bounds are summed at once, GROUPS numbers each
BROADCAST_ROWS = 200_000
PUNCTUATION = ".,;:!?\"'()[]{}|*#%$&<>…«»“”’"


def normal(word: str) -> str:
    return word.lower().strip(PUNCTUATION)


def terms_of(text: str | None) -> list[str]:
    return [x for w in re.split(r"[\x20\x09-\x0D]+", text or "") if (x := normal(w))]


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The words of an item without and of its last sentence."""
    sentences = [x for s in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if (x := terms_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = [w for s in sentences for w in s]
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def grams(words: list, n: int) -> set[tuple]:
    n = max(1, min(n, len(words)))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


class Index:
    """Impacts of some items by term and block. ``found``, ``n`` and ``mean`` are about all items;
    none of these has more than ``longest`` words."""

    def __init__(self, items: list[tuple], ratio: float, found: dict[str, int], n: int, mean: float, longest: int):
        items = [(i, t) for i, t in items if terms_of(t)]
        items.sort(key=lambda x: (len(terms_of(x[1])), str(x[0]), x[1]))
        words = [terms_of(t) for _, t in items]
        self.ids, self.longest = [i for i, _ in items], longest
        names = sorted({w for x in words for w in x})
        self.vocabulary = {w: k for k, w in enumerate(names)}
        self.blocks = -(-len(items) // BLOCK)
        per_group = BLOCK * max(1, -(-self.blocks // GROUPS))
        idf = {w: np.log(1 + (n - found[w] + 0.5) / (found[w] + 0.5)) for w in names}
        #: by group and term: the items that have it, its impacts, and for each the greatest impact in the item's block
        self.postings: list[dict[int, tuple[list[int], list[float], list[float]]]] = [{} for _ in range(-(-len(items) // per_group))]
        for k, w in enumerate(words):
            c, norm = Counter(w), K1 * (1 - B + B * len(w) / mean)
            own = {self.vocabulary[x]: idf[x] * c[x] * (K1 + 1) / (c[x] + norm) for x in c}
            limit = ratio * sum(own.values())
            for t in sorted(own):
                at, impacts, _ = self.postings[k // per_group].setdefault(t, ([], [], []))
                at.append(k)
                impacts.append(own[t] / limit)
        self.group_max = np.zeros((len(names), max(1, len(self.postings))), np.float32)
        for g, lists in enumerate(self.postings):
            for t, (at, impacts, peaks) in lists.items():
                best: dict[int, float] = {}
                for k, x in zip(at, impacts, strict=True):
                    best[k // BLOCK] = max(best.get(k // BLOCK, 0.0), x)
                peaks += [best[k // BLOCK] for k in at]
                self.group_max[t, g] = max(impacts)
        # terms of more than COMMON of the items are not summed: every passage is taken to have all of them
        common = np.array([found[w] > COMMON * n for w in names], bool)
        self.rare = np.append(~common, False)
        self.group_limits = 1 - self.group_max[common].sum(axis=0)
        if (self.group_limits <= 0).any():  # some item is made of common terms
            self.rare[:-1], self.group_limits = True, np.ones(self.group_max.shape[1])
        parts = [question_and_answer(t) for _, t in items]
        code = lambda x: {tuple(self.vocabulary[w] for w in g) for g in x}
        self.question = [code(grams(q, 5)) for q, _ in parts]
        self.answer = [code(grams(a, 2)) for _, a in parts]
        self.sizes = [(min(5, len(q)), min(2, len(a))) for q, a in parts]

    def search(self, own: list[int], group: int) -> Iterator[tuple[int, float]]:
        """(item, score) of all items of a group whose score reaches 1; ``own``: distinct known terms. Block-max WAND."""
        lists = self.postings[group]
        cursors = [[0, *lists[t], float(self.group_max[t, group]) + SLACK / 100] for t in own if t in lists]
        while True:
            cursors = [c for c in cursors if c[0] < len(c[1])]
            cursors.sort(key=lambda c: c[1][c[0]])
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += c[4]
                if bound >= 1:
                    pivot = k
                    break
            if pivot is None:
                return
            item = cursors[pivot][1][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == item:
                pivot += 1
            first, upto = item // BLOCK * BLOCK, item // BLOCK * BLOCK + BLOCK
            peaks = 0.0
            for at, items, _, best, _ in cursors[: pivot + 1]:
                k = bisect_left(items, first, at)
                if k < len(items) and items[k] < upto:
                    peaks += best[k]
            if peaks < 1 - 1e-9:  # nothing in this block before another list joins in
                if pivot + 1 < len(cursors):
                    upto = min(upto, cursors[pivot + 1][1][cursors[pivot + 1][0]])
                for c in cursors[: pivot + 1]:
                    c[0] = bisect_left(c[1], upto, c[0])
            elif cursors[0][1][cursors[0][0]] == item:
                score = sum(c[2][c[0]] for c in cursors[: pivot + 1])
                if score >= 1 - 1e-9:
                    yield item, score
                for c in cursors[: pivot + 1]:
                    c[0] += 1
            else:
                for c in cursors[:pivot]:
                    c[0] = bisect_left(c[1], item, c[0])

    def verify(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's grams that occur in the passage."""
        words = passage.tolist()
        share = lambda own, n: len(own & grams(words, n)) / len(own) if own else 1.0
        return share(self.question[item], self.sizes[item][0]), share(self.answer[item], self.sizes[item][1])


def _terms(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct terms of some texts, which of them stands at each place, and where each text begins and ends."""
    words, ends = split_words(texts)
    coded = words.dictionary_encode()
    terms, codes = [normal(w) for w in coded.dictionary.to_pylist()], coded.indices.to_numpy()
    full = np.array([w != "" for w in terms], bool)
    if not full.all():  # punctuation only: no word
        before = np.concatenate(([0], np.cumsum(full[codes])))
        codes, ends = codes[full[codes]], before[ends]
    return terms, codes, ends


def _search_texts(index: Index, terms: list[str], codes: np.ndarray, ends: np.ndarray, overlap: float) -> list[dict[int, tuple[float, float, float]]]:
    """For each text the verified items with their best score and overlaps."""
    out: list[dict[int, tuple[float, float, float]]] = [{} for _ in range(len(ends) - 1)]
    if not len(codes) or not index.ids:
        return out
    unknown = len(index.vocabulary)
    ids = np.array([index.vocabulary.get(w, unknown) for w in terms], np.int64)[codes]
    # window w of a text covers its stretches w and w + 1 of the length that items have at most
    step, n = index.longest, np.diff(ends)
    count = np.maximum(1, -(-n // step) - 1)
    first = np.concatenate(([0], np.cumsum(count)))
    at = np.flatnonzero(index.rare[ids])
    owner = np.searchsorted(ends, at, side="right") - 1
    stretch = (at - ends[owner]) // step
    window = np.concatenate((np.minimum(stretch, count[owner] - 1), np.maximum(stretch - 1, 0))) + np.tile(first[owner], 2)
    keys = np.unique(window * unknown + np.tile(ids[at], 2))
    window, term = keys // max(1, unknown), keys % max(1, unknown)
    begin = np.append(np.flatnonzero(np.diff(window, prepend=-1)), len(keys))
    a = 0
    while a < len(begin) - 1:
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + BOUNDS, side="right")) - 1)
        bounds = np.add.reduceat(index.group_max[term[begin[a] : begin[b]]], begin[a:b] - begin[a], axis=0)
        likely = bounds >= index.group_limits - SLACK
        for k in np.flatnonzero(likely.any(axis=1)):
            w = window[begin[a + k]]
            text = int(np.searchsorted(first, w, side="right")) - 1
            start = ends[text] + (w - first[text]) * step
            passage = ids[start : min(start + 2 * step, ends[text + 1])]
            own = np.unique(passage)
            own = own[own < unknown].tolist()
            for group in np.flatnonzero(likely[k]):
                for item, score in index.search(own, int(group)):
                    question, answer = index.verify(item, passage)
                    if question >= overlap and answer >= overlap:
                        known = out[text].get(item)
                        if known is None or (score, question, answer) > known:
                            out[text][item] = score, question, answer
        a = b
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, text, number of words and distinct terms of every item that has words."""
    schema = benchmark.select("item_id").schema.add("text", "string").add("n", "long").add("terms", ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [terms_of(x) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in terms], pa.int64()), pa.array([sorted(set(x)) for x in terms], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return saved(benchmark.select("item_id", "text").mapInArrow(run, schema).where("n > 0"), "items")


def find(docs: DataFrame, benchmark: DataFrame, *, ratio: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """doc_id, node (hash of the text), item_id, score and overlaps for each text and each test item in it."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("node"), "text")
    item = benchmark.schema["item_id"].dataType
    schema = docs.select("doc_id").schema.add("node", "long").add("item_id", item)
    for name in ("score", "question_overlap", "answer_overlap"):
        schema = schema.add(name, "double")
    kind = to_arrow_type(item)
    out: list[DataFrame] = []
    items = _items(benchmark)
    n, total = items.agg(F.count("*"), F.sum("n")).first()
    chunks = -(-(total or 0) // CHUNK_WORDS)
    terms = items.select("item_id", "text", F.explode("terms").alias("term"))
    found = saved(terms.groupBy("term").agg(F.count("*").alias("found")), "terms")
    for chunk in range(chunks):
        mine = F.pmod(F.xxhash64("text"), F.lit(chunks)) == chunk
        own = [(r["item_id"], r["text"]) for r in items.where(mine).collect()]  # about CHUNK_WORDS words
        counts = dict(terms.where(mine).select("term").distinct().join(found, "term").collect())
        classes: dict[int, list[tuple]] = {}
        for i, text in own:
            classes.setdefault((len(terms_of(text)) - 1).bit_length(), []).append((i, text))
        sent = spark.sparkContext.broadcast([vars(Index(x, ratio, counts, n, total / n, 1 << c)) for c, x in sorted(classes.items())])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            indexes = [plain_object(Index, x) for x in sent.value]
            for part in slices(batches, 2, SLICE, SLICE_BYTES):
                ids, nodes = part.column(0).to_pylist(), part.column(1).to_pylist()
                words = _terms(part.column(2))
                rows = []
                for index in indexes:
                    hits = _search_texts(index, *words, overlap)
                    rows += [(ids[r], nodes[r], index.ids[k], *x) for r, own in enumerate(hits) for k, x in sorted(own.items())]
                if rows:
                    types = [part.schema.field(0).type, pa.int64(), kind, *[pa.float64()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), types, strict=True)], names=schema.names)

        out.append(rows.mapInArrow(run, schema))
    if not out:  # no items; an empty table made by createDataFrame would start Python workers of another kind beside these
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema[2:]]
        return rows.where(F.lit(False)).select("doc_id", "node", *empty)
    return reduce(DataFrame.union, out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in whose text no test item is found."""
    names = docs.columns
    found = saved(find(docs, benchmark, **options).select("doc_id", "node").distinct(), "contaminated")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_node"))
    kept = packed.join(found, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_node") == F.col("node")), "left_anti")
    return kept.select(*(F.col("_row")[c].alias(c) for c in names))
