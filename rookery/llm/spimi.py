"""Source divergence audit over term frequencies from single-pass in-memory indexing.

One pass over the texts. Each task builds the postings of a block, (lang, term, source) -> occurrences and documents, in
memory until they take ``block_bytes``; then it spills them as term-sorted runs, one per hash shard, cut into packed
segments of at most ``SEGMENT`` postings. Spark shuffles the segments to their shards and sorts them by first posting; the
task of a shard merges its runs through a heap of the segments whose range the merge has reached, so memory is that of the
open segments and not of the shard. What comes out per term is final: its frequency in each source and in its language.
A term that is everywhere costs one posting per block and source, a hot source or language no more than any other.

With N occurrences of the V kept terms in a group, a term with count occurrences has p = 1 + floor(10^9 (count + 2) / (N + 2 V)),
and f(p, q) = floor((p - q)^2 / (p + q)). A pair of sources differs by the sum of f over all kept terms. Most counts are 0,
so that sum is V f(p0, q0) plus corrections: of terms that one source has, by the distinct values of p and their numbers;
and of terms that both have, by streaming the postings term by term and adding up the pairs of a term's sources in tiles,
which are handed on when they take ``tile_bytes``. What is emitted is sums per pair and task. All numbers are whole, and
fit 64 bits for up to 9 * 10^15 occurrences in a group, since quotients are taken by long division.

Defined cases: null text, lang and source are ''; a group without terms counts as one with N = 0; a language without kept
terms gives pairs of value 0; one with a single source no pairs; repeated rows are documents of their own; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import saved, slices

#: What is no part of a term becomes a blank, and A to Z lower case. Bytes of 0x80 and above belong to other letters.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEGMENT = 4096
#: About what a posting takes in a block besides its term.
POSTING_BYTES = 150
DOCUMENTS = 24  # bits; a block's number of documents of a term, below its occurrences
#: Segments that a merge opens before it folds what is final.
OPENED = 64
TILE = 256
NAMES = ("lang", "term", "source")
POSTINGS = pa.schema([*((c, pa.binary()) for c in NAMES), ("count", pa.int64()), ("docs", pa.int64())])
RUNS = "shard int, lang binary, term binary, source binary, postings binary"
FREQUENCIES = "lang string, term string, source string, count long, total long, head boolean"


def packed(postings: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, POSTINGS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(postings)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


def index_blocks(docs: DataFrame, shards: int, block_bytes: int) -> DataFrame:
    """The runs of all blocks: a row per segment, with its shard and first posting."""

    def ranked(values: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The distinct values in order, and the place of each value among them."""
        coded = pa.array(values, pa.binary()).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]

    def spill(block: dict[tuple[bytes, bytes], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        sizes = [len(p) for p in block.values()]
        if not sum(sizes):
            return
        terms, term = ranked([t for p in block.values() for t in p])
        langs, lang = ranked([g for g, _ in block])
        sources, source = ranked([s for _, s in block])
        n = np.fromiter((x for p in block.values() for x in p.values()), np.int64, sum(sizes))
        block.clear()
        lang, source = np.repeat(lang, sizes), np.repeat(source, sizes)
        shard = np.fromiter((xxhash.xxh3_64_intdigest(t) % shards for t in terms.to_pylist()), np.int32, len(terms))[term]
        order = np.lexsort((source, term, lang, shard))
        shard, n = shard[order], n[order]
        columns = [values.take(pa.array(at[order])) for values, at in ((langs, lang), (terms, term), (sources, source))]
        run = pa.RecordBatch.from_arrays([*columns, pa.array(n >> DOCUMENTS), pa.array(n & ((1 << DOCUMENTS) - 1))], schema=POSTINGS)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
        cuts = [(k, min(k + SEGMENT, b)) for a, b in zip(edges, edges[1:], strict=False) for k in range(a, b, SEGMENT)]
        for at in range(0, len(cuts), OPENED):
            some = cuts[at : at + OPENED]
            first = pa.array([a for a, _ in some])
            heads = [c.take(first) for c in run.columns[:3]]
            yield pa.RecordBatch.from_arrays([pa.array(shard[[a for a, _ in some]]), *heads, pa.array([packed(run.slice(a, b - a)) for a, b in some], pa.binary())], names=["shard", *NAMES, "postings"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[tuple[bytes, bytes], dict[bytes, int]] = {}
        used = held = 0
        for part in slices(batches, 0, 1000, 16 << 20):
            texts, langs, sources = (c.cast(pa.binary()).to_pylist() for c in part.columns)
            for text, lang, source in zip(texts, langs, sources, strict=True):
                own = block.setdefault((lang, source), {})
                before = len(own)
                counts = Counter(text.translate(FOLD).split())
                for term, n in counts.items():
                    own[term] = own.get(term, 0) + (n << DOCUMENTS) + 1
                if len(own) > before:  # new terms are the last ones
                    used += POSTING_BYTES * (len(own) - before) + sum(map(len, islice(reversed(own), len(own) - before)))
                held += 1
                if used >= block_bytes or held >> DOCUMENTS - 1:
                    yield from spill(block)
                    block, used, held = {}, 0, 0
        yield from spill(block)

    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return texts.mapInArrow(build, RUNS)


def merge_runs(runs: DataFrame, shards: int, least: int) -> DataFrame:
    """Frequencies of the terms that at least ``least`` documents of their language have: a row per term and source that
    has it, with the total of the language; ``head`` marks one row per term.

    Segments come in the order of their first postings, so what lies before the first term of the next one is final in
    all that are open. These wait in a heap by the posting they have got to."""

    def before(segment: pa.RecordBatch, term: tuple) -> int:
        """How many postings of a segment lie before a (lang, term)."""
        return bisect_left(range(segment.num_rows), term, key=lambda k: (segment.column(0)[k].as_py(), segment.column(1)[k].as_py()))

    def folded(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        own = pa.Table.from_batches(parts, POSTINGS).group_by([*NAMES], use_threads=False).aggregate([("count", "sum"), ("docs", "sum")])
        of_lang = own.group_by(["lang", "term"], use_threads=False).aggregate([("docs_sum", "sum"), ("count_sum", "sum"), ("source", "min")])
        kept = of_lang.filter(pc.greater_equal(of_lang["docs_sum_sum"], least))
        if not kept.num_rows:
            return None
        out = own.join(kept.select(["lang", "term", "count_sum_sum", "source_min"]), ["lang", "term"], join_type="inner", use_threads=False).combine_chunks()
        text = [out[c].cast(pa.string()).combine_chunks() for c in NAMES]
        numbers = [out[c].combine_chunks() for c in ("count_sum", "count_sum_sum")]
        head = pc.equal(out["source"], out["source_min"]).combine_chunks()
        return pa.RecordBatch.from_arrays([*text, *numbers, head], names=[*NAMES, "count", "total", "head"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        heap: list[tuple] = []
        ahead, serial = next(segments, None), 0
        while heap or ahead:
            opened = 0
            while ahead and opened < OPENED and (not heap or ahead[0] == heap[0][0][0]):
                heapq.heappush(heap, ((ahead[0], ahead[1], ahead[2]), serial, unpacked(ahead[4])))
                serial, opened = serial + 1, opened + 1
                ahead = next(segments, None)
            edge, final = ahead and ahead[:3], []
            while heap and (edge is None or heap[0][0] < edge):
                (shard, *_), number, segment = heapq.heappop(heap)
                n = segment.num_rows if edge is None or shard < edge[0] else before(segment, edge[1:])
                final.append(segment.slice(0, n))
                if n < segment.num_rows:
                    heapq.heappush(heap, ((shard, segment.column(0)[n].as_py(), segment.column(1)[n].as_py()), number, segment.slice(n)))
            if final and (out := folded(final)) is not None:
                yield out

    dealt = runs.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", *NAMES)
    return dealt.mapInArrow(frequencies, FREQUENCIES)


def term_frequencies(docs: DataFrame, *, least: int = 10, shards: int | None = None, block_bytes: int = 96 << 20) -> DataFrame:
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(merge_runs(index_blocks(docs, shards, block_bytes), shards, least), "frequencies")


def per_billion(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 count / whole) for count <= whole, by three steps of long division, which stay within 64 bits."""
    rest, out = count, F.lit(0).cast("long")
    for _ in range(3):
        shifted = rest * 1000
        quotient = F.call_function("div", shifted, whole)
        out, rest = out * 1000 + quotient, shifted % whole
    return out + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if a count finds at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def groups_of(docs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(lang, source, sid, v, p0, whole, lang_whole) of every group that occurs: its number inside the language, the
    language's kept terms, p of a term it hasn't, and what counts are divided by."""
    occurring = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    n = frequencies.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum(F.col("head").cast("long")).alias("heads"))
    own = occurring.join(n, ["lang", "source"], "left").na.fill(0, ["n", "heads"])
    of_lang = Window.partitionBy("lang")
    own = own.withColumns({"v": F.sum("heads").over(of_lang), "lang_n": F.sum("n").over(of_lang), "sid": F.row_number().over(of_lang.orderBy("source")) - 1})
    whole = lambda c: F.greatest(F.col(c) + 2 * F.col("v"), F.lit(2))  # noqa: E731  # 2 where nothing is kept
    own = own.select("lang", "source", "sid", "v", whole("n").alias("whole"), whole("lang_n").alias("lang_whole"))
    return saved(own.withColumn("p0", per_billion(F.lit(2).cast("long"), F.col("whole"))), "groups")


def shared_corrections(postings: DataFrame, tile_bytes: int) -> DataFrame:
    """(lang, a, b, value), a < b: partial sums of what terms of both sources change."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = p[:, None] - q[None, :]
        return d * d // (p[:, None] + q[None, :])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
        """Each term's language and (sid, p, p0), which may go on in a later batch."""
        held, rest = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            numbers = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[2:]])
            at = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for a, b in zip(at, at[1:], strict=False):
                if names[a] == held:
                    rest = np.concatenate((rest, numbers[:, a:b]), axis=1)
                    continue
                if held is not None:
                    yield held[0], rest
                held, rest = names[a], numbers[:, a:b]
        if held is not None:
            yield held[0], rest

    def sums(tiles: dict[tuple[str, int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (lang, i, j), tile in tiles.items():
            a, b = np.nonzero(tile)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a)), pa.array(a + i * TILE, pa.int32()), pa.array(b + j * TILE, pa.int32()), pa.array(tile[a, b])], names=["lang", "a", "b", "value"])
        tiles.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[str, int, int], np.ndarray] = {}
        for lang, (sid, p, p0) in terms(batches):
            if len(sid) < 2:
                continue
            order = np.argsort(sid)
            sid, p, p0 = sid[order], p[order], p0[order]
            cuts = np.flatnonzero(np.diff(sid // TILE)) + 1
            spans = list(zip([0, *cuts], [*cuts, len(sid)], strict=True))
            for x, (a, b) in enumerate(spans):
                for c, d in spans[x:]:
                    change = f(p[a:b], p[c:d]) - f(p[a:b], p0[c:d]) - f(p0[a:b], p[c:d]) + f(p0[a:b], p0[c:d])
                    if a == c:
                        change = np.triu(change, 1)
                    key = (lang, int(sid[a]) // TILE, int(sid[c]) // TILE)
                    if key not in tiles:
                        if len(tiles) * TILE * TILE * 8 >= tile_bytes:
                            yield from sums(tiles)
                        tiles[key] = np.zeros((TILE, TILE), np.int64)
                    tiles[key][np.ix_(sid[a:b] % TILE, sid[c:d] % TILE)] += change
        yield from sums(tiles)

    ordered = postings.select("lang", "term", "sid", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(run, "lang string, a int, b int, value long")


def audit(docs: DataFrame, *, least: int = 10, top: int = 10, shards: int | None = None, block_bytes: int = 96 << 20, tile_bytes: int = 64 << 20) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: how far each other source of the language lies from the
    source; part ``term``: the ``top`` terms that the source has more of than its language."""
    frequencies = term_frequencies(docs, least=least, shards=shards, block_bytes=block_bytes)
    groups = groups_of(docs, frequencies)
    known = small(groups)
    count = F.col("count") + 2
    met = frequencies.join(known, ["lang", "source"])
    postings = saved(met.select("lang", "source", "sid", "term", "p0", per_billion(count, F.col("whole")).alias("p"), per_billion(F.col("total") + 2, F.col("lang_whole")).alias("q")), "postings")

    more = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    # V terms that neither has, then for each distinct p of one source the number of its terms
    values = postings.groupBy("lang", "sid", "p0", "p").agg(F.count("*").alias("n")).withColumn("base", F.lit(False))
    nothing = groups.select("lang", "sid", "p0", F.col("p0").alias("p"), F.col("v").alias("n"), F.lit(True).alias("base"))
    other = small(groups.select("lang", F.col("sid").alias("b"), F.col("p0").alias("q0")))
    sides = values.unionByName(nothing).withColumnRenamed("sid", "a").join(other, "lang").where((F.col("a") != F.col("b")) & (~F.col("base") | (F.col("a") < F.col("b"))))
    change = F.col("n") * (gap(F.col("p"), F.col("q0")) - F.when(F.col("base"), 0).otherwise(gap(F.col("p0"), F.col("q0"))))
    one = sides.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), change.alias("value"))
    sums = one.unionByName(shared_corrections(postings, tile_bytes)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("s")).select("lang", "value", "s.x", "s.y")
    name = lambda at, to: small(groups.select("lang", F.col("sid").alias(at), F.col("source").alias(to)))
    pairs = both.join(name("x", "source"), ["lang", "x"]).join(name("y", "item"), ["lang", "y"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = more.withColumn("rank", place).where(F.col("rank") <= top)
    return pairs.withColumn("rank", place).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
