"""Near-duplicate classes by ProbMinHash over weighted five-word shingles, banding and verification.

Sketch: every shingle of a text is a Poisson process of arrivals at rate weight (1 + ln of its count); each arrival hits
one of the registers, which keep the earliest. Processes are advanced together and stop as soon as their next arrival is
later than the latest register, so the work is near shingles + registers x log(registers). Two registers agree with the
probability Jaccard similarity of the texts.

A text that repeats shingles has a second, plain sketch, all weights 1, whose registers agree with the probability of the
set similarity that is verified. Without repeats both sketches are the same, so plain ones compare with all texts.

Candidates: registers of both sketches are hashed in bands, in common buckets. Copies are one node from the start (the
hash of the text). In each bucket all nodes are paired with one only, its pivot, that which shares most buckets with
others. Where this leaves nodes of one pivot in several components, pairs of these are sought by what the nodes changed
of the pivot: linked nodes must share changes. This is exact, and altered copies of one text make pairs only where they
share alterations (see ``_across``).
Plain signatures sort out hopeless pairs (``MARGIN`` below the threshold: four standard errors of the set similarity).

Verification: exact Jaccard similarity of the shingle sets, at least ``threshold``. Classes are the connected components.

Defined cases: texts without words (and null, which counts as empty) are in one class only with equal texts; texts of
one to four words have one shingle, all their words. A row with a null doc_id belongs to a class but does not name it,
unless all its rows are null. Repeated rows share their class. Nodes are 64-bit hashes of texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ._shared import cells, mix, plain, saved, slices, split_words, window_hashes, word_hashes

WORDS = 5
BANDS, ROWS = 28, 4
REGISTERS = BANDS * ROWS
MARGIN = 0.15
BROADCAST_NODES = 500_000
SLICE, SLICE_BYTES, SEEN = 512, 1 << 20, 200_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def counted(windows: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (window, owner), by owner and window, with their counts."""
    order = np.lexsort((windows, owners))
    windows, owners = windows[order], owners[order]
    new = np.ones(len(windows), bool)
    new[1:] = (windows[1:] != windows[:-1]) | (owners[1:] != owners[:-1])
    at = np.flatnonzero(new)
    return windows[at], owners[at], np.diff(np.append(at, len(windows)))


def sketch(windows: np.ndarray, owners: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n x registers hashes of the shingles that arrive first; rows of owners without shingles are 0."""
    earliest = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    limit = np.full(n, np.inf)
    w, o, rate, time, step = windows, owners, weights.astype(float), np.zeros(len(windows)), 0
    while len(w):
        with np.errstate(over="ignore"):
            x = mix(w + GOLDEN * np.uint64(2 * step + 1))
            slot = o * registers + (mix(w + GOLDEN * np.uint64(2 * step + 2)) % np.uint64(registers)).astype(np.int64)
        time = time - np.log(((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        on = time < limit[o]
        w, o, rate, time, slot = w[on], o[on], rate[on], time[on], slot[on]
        np.minimum.at(earliest, slot, time)
        won = time == earliest[slot]
        winner[slot[won]] = w[won]
        limit = earliest.reshape(n, registers).max(axis=1)
        on = time < limit[o]
        w, o, rate, time = w[on], o[on], rate[on], time[on]
        step += 1
    return winner.reshape(n, registers)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    n = len(signatures)
    rows = signatures.reshape(n, BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = mix((out * GOLDEN + rows[:, :, k]).ravel()).reshape(n, BANDS)
    return out.view(np.int64)


def plain_sketch(weighted: np.ndarray, windows: np.ndarray, owners: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sketch with all weights 1, made anew only for owners that repeat a shingle."""
    out = weighted.copy()
    repeats = np.unique(owners[counts > 1])
    if len(repeats):
        on = np.isin(owners, repeats)
        out[repeats] = sketch(windows[on], np.searchsorted(repeats, owners[on]), np.ones(int(on.sum())), len(repeats))
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node, and for the first row of a node in its task: bands of both sketches, bytes of the plain signature,
    sorted shingle hashes."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    schema = docs.select("doc_id").schema.add("node", "long").add("bands", ArrayType(LongType())).add("signature", "binary").add("shingles", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, 2, SLICE, SLICE_BYTES):
            nodes = part.column(1).to_pylist()
            fresh = []
            for k, x in enumerate(nodes):
                if x not in seen:
                    seen.add(x)
                    fresh.append(k)
            if len(seen) > SEEN:
                seen.clear()
            words, ends = split_words(plain(part.column(2).take(pa.array(fresh, pa.int64()))))
            windows, owners, counts = counted(*window_hashes(word_hashes(words), ends, WORDS))
            weighted = sketch(windows, owners, 1 + np.log(counts), len(fresh))
            signatures = plain_sketch(weighted, windows, owners, counts)
            bands = np.concatenate((band_hashes(weighted), band_hashes(signatures)), axis=1)
            small = mix(signatures.ravel()).astype(np.uint8).reshape(len(fresh), REGISTERS)
            cuts = np.searchsorted(owners, np.arange(len(fresh) + 1))
            columns: list[list] = [[None] * len(nodes) for _ in range(3)]
            for k, row in enumerate(fresh):
                if cuts[k] < cuts[k + 1]:
                    columns[0][row] = np.unique(bands[k])
                    columns[1][row] = small[k].tobytes()
                    columns[2][row] = np.sort(windows[cuts[k] : cuts[k + 1]].view(np.int64)).astype("<i8").tobytes()
            kinds = (pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=schema.names)

    return saved(rows.mapInArrow(run, schema), "sketches")


def _of(sketches: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """(node, column) for some nodes, once each. Their list is broadcast if a count finds it short (8 bytes a node)."""
    nodes = saved(nodes.distinct(), "nodes")
    if nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    return sketches.where(F.col(column).isNotNull()).select("node", column).join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _hopeful(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree often enough."""
    light = saved(_of(sketches, "signature", _ends(pairs)), "signatures")
    both = pairs.join(light.toDF("a", "sa"), "a").join(light.toDF("b", "sb"), "b")
    least = math.floor((threshold - MARGIN) * REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, REGISTERS) for k in (2, 3))
                good = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with exact Jaccard similarity of at least the threshold."""
    pairs = saved(_hopeful(saved(pairs, "candidates"), sketches, threshold), "pairs")
    sets = saved(_of(sketches, "shingles", _ends(pairs)), "shingle-sets")
    both = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(cells(batch.column(2), "<i8"), cells(batch.column(3), "<i8"), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= threshold * (len(x) + len(y) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return saved(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")


def _differences(stars: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """For stars (a, b, comp of b): a as ``pivot``, b as ``node``, comp, the sizes n of b and np of a, whether b is far
    (less similar to the pivot than the threshold), the number nd of shingles that only one of them has, and these."""
    sets = saved(_of(sketches, "shingles", _ends(stars)), "shingle-sets")
    both = stars.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pivot", "node", "comp", "n", "np", "far", "nd", "shingle"]
        for batch in batches:
            ids = (batch.column(k).to_pylist() for k in range(3))
            for pivot, node, comp, x, y in zip(*ids, *(cells(batch.column(k), "<i8") for k in (3, 4)), strict=True):
                apart = np.setxor1d(x, y, assume_unique=True)
                common = (len(x) + len(y) - len(apart)) // 2
                far = common < threshold * (len(x) + len(y) - common)
                k = len(apart)
                rows = [np.full(k, v) for v in (pivot, node, comp, len(y), len(x), far, k)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*rows, apart)], names=names)

    kinds = "pivot long, node long, comp long, n long, np long, far boolean, nd long, shingle long"
    return saved(both.select("a", "b", "comp", "sa", "sb").mapInArrow(run, kinds), "differences")


def _across(stars: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes (a, b) of different components around one pivot that may be linked; exact.

    ``stars`` are pairs (a: pivot, b: node) with the node's comp, of pivots whose nodes are in several components. With
    Dx the difference of x from the pivot P, x and y differ in |Dx| + |Dy| - 2 |Dx & Dy| shingles, of which a similarity
    of t allows c (|x| + |y|), c = (1 - t) / (1 + t). So linked nodes share their changes: at least
    (|Dx| + |Dy| - c (|x| + |y|)) / 2. At least one of them, x, is far from P (nodes near P are in one component), so
    |Dx| > c (|x| + |P|), and y shares more than (|Dy| - c (|y| - |P|)) / 2, about half of its changes. By prefix
    filtering it is enough to compare the ``half`` of y's changes that are rarest around P with a far x's (all but the
    least number that it must share), and halves only if both are far. What a node has changed alone meets nobody, however
    many copies of P there are.
    """
    each = _differences(stars, sketches, threshold)
    known = each.groupBy("pivot", "shingle").agg(F.count("*").alias("count")).where("count > 1")
    both = each.join(known, ["pivot", "shingle"])
    by = Window.partitionBy("pivot", "node").orderBy("count", "shingle")
    place = F.row_number().over(by) + F.col("nd") - F.count("*").over(Window.partitionBy("pivot", "node"))
    c = (1 - threshold) / (1 + threshold)
    # changes that a node has alone come first in the order, so ``place`` counts them
    half = F.col("nd") - F.floor((F.col("nd") - c * (F.col("n") - F.col("np"))) / 2 - 1e-9)
    most = F.col("nd") - F.greatest(F.lit(1), F.ceil(F.col("nd") - c * (1 + 1 / threshold) * F.col("n") - 1e-9)) + 1
    ranked = both.select("pivot", "node", "comp", "n", "far", "nd", "shingle", place.alias("place"), half.alias("half"), most.alias("most"))
    ranked = ranked.where((F.col("place") <= F.col("half")) | F.col("far") & (F.col("place") <= F.col("most")))
    ranked = ranked.select("pivot", "shingle", "node", "comp", "n", "far", "nd", "place", (F.col("place") <= F.col("half")).alias("rare"))
    ranked = saved(ranked, "prefixes")
    met = ranked.groupBy("pivot", "shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.bool_or("far").alias("f"), F.bool_or("rare").alias("r"))
    ranked = ranked.join(met.where("x < y and f and r").select("pivot", "shingle"), ["pivot", "shingle"])
    names = ["node", "comp", "n", "far", "nd", "place", "rare"]
    one = ranked.where("rare").select("pivot", "shingle", *(F.col(x).alias(f"{x}1") for x in names))
    two = ranked.where("far").select("pivot", "shingle", *(F.col(x).alias(f"{x}2") for x in names))
    apart = (F.col("comp1") != F.col("comp2")) & (~F.col("far1") | F.col("rare2") & (F.col("comp1") < F.col("comp2")))
    alike = F.least("n1", "n2") >= threshold * F.greatest("n1", "n2")
    # at the first change that they share, what is left of both must hold the others
    enough = 2 * (1 + F.least(F.col("nd1") - F.col("place1"), F.col("nd2") - F.col("place2"))) >= F.col("nd1") + F.col("nd2") - c * (F.col("n1") + F.col("n2")) - 1e-6
    pairs = one.join(two, ["pivot", "shingle"]).where(apart & alike & enough)
    return pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): comp is the least node of the connected component."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        heard = both.join(labels.toDF("b", "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        lower = labels.join(heard, "node").select("node", F.least("comp", "c").alias("comp"), F.col("comp").alias("old"))
        lower = saved(lower, "labels")
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("c"))
        new = saved(lower.join(jump, "comp").select("node", F.col("c").alias("comp"), "old"), "labels")
        if new.where("comp <> old").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, node (hash of the text), comp (least node of the class) and class_id (its least doc_id) for every row."""
    sketches = _sketches(docs)
    members = sketches.where("bands is not null").select("node", F.explode("bands").alias("bucket")).distinct()
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = saved(members.join(shared, "bucket").select("node", "bucket", "size"), "buckets")
    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    middle = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("m")).select("bucket", F.col("m.node").alias("middle"))
    stars = members.join(middle, "bucket").where("node <> middle").select(F.col("middle").alias("a"), F.col("node").alias("b")).distinct()
    stars = saved(stars, "stars")
    links = _verified(stars, sketches, threshold)
    labels = components(links)
    placed = saved(_labelled(stars.toDF("a", "node"), labels).select("a", F.col("node").alias("b"), "comp"), "placed")
    torn = placed.groupBy("a").agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("a")
    more = _verified(_across(placed.join(torn, "a", "left_semi").select("a", "b", "comp"), sketches, threshold), sketches, threshold)
    if not more.isEmpty():
        labels = components(links.union(more))
    named = saved(_labelled(sketches.select("doc_id", "node"), labels), "members")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    return named.join(least, "comp").select("doc_id", "node", "comp", "class_id")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of ``docs`` per class: of the rows of its least doc_id (null if it has no other) one of least hash."""
    names = docs.columns
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node")).alias("m")
    chosen = saved(classes(docs, threshold).groupBy("comp").agg(first).select("m.doc_id", "m.node"), "chosen")
    node: Column = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("doc_id").alias("_id"), node.alias("_node"))
    kept = packed.join(chosen, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_node") == F.col("node")), "left_semi")
    twice = docs.select("doc_id", node.alias("_node")).groupBy("doc_id", "_node").count().where("count > 1")
    if not twice.isEmpty():  # equal ids and texts: any of them stays
        kept = kept.dropDuplicates(["_id", "_node"])
    return kept.select(*(F.col("_row")[c].alias(c) for c in names))
