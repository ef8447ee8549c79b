"""Language-model scoring with Katz back-off over word pairs, learned from the corpus itself.

Counts of words and word pairs are discounted after Good and Turing where they are at most five; what a context saves
goes to the words it was not seen before, in proportion to their own probability, with a weight that makes every
context's probabilities add up to exactly 1. The mass that single words save belongs to one unknown word. A context
none of whose pairs is discounted gives up one count instead, so that nothing has probability 0.

The model is three tables in the shared folder: words (word, count), pairs (in buckets, with the counts of their second
words), contexts (context, norm, back-off weight). Scoring follows the recursion token by token: the pair if it was seen,
else the weight of the context times the word. Tokens travel once, as packed numbers, to the bucket of their pair, where
its count and the count of its second word are found by binary search; the terms of a context are added there if it is
frequent, else in a join on contexts. What a bucket finds for a slice of texts travels back packed, to be added up per
slice.

What is frequent has a proven bound. At most HOT words of highest count go to all tasks (32 bytes each). Pairs that make up
more than 1/HOT_PAIRS of all tokens, of which there are fewer than HOT_PAIRS, go to all tasks and are scored in place;
so no bucket gets more than its share plus 1/HOT_PAIRS of the tokens, and a pair whose second word is frequent is
bucketed by the pair, else by the word.

A slice is named by a hash of what is in it, so a task that is run again names its slices alike if it reads its rows in
the same order, as it does from files; write other inputs of ``score`` to a table first.

Defined cases: a null text counts as empty and consists of its end; a null doc_id is hashed as "". Equal rows get equal
scores. Without training rows every token is unknown and scores log10(1). Words and pairs are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import mix, plain_object, saved, slices, split_words, word_hashes

HOT = 1 << 19
HOT_PAIRS = 1 << 16
BUCKET_TOKENS = 1_500_000
DISCOUNTED = 5
SLICE, SLICE_BYTES = 4096, 4 << 20
FLUSH = 1_000_000
END = np.uint64(2)
RARE = np.uint64(1 << 63)


def good_turing(n: dict[int, int]) -> np.ndarray:
    """Factors by count, from 0 to DISCOUNTED + 1 (which stands for all higher counts); 1 where the estimate is unsound."""
    out = np.ones(DISCOUNTED + 2)
    if not n.get(1) or (DISCOUNTED + 1) * n.get(DISCOUNTED + 1, 0) >= n[1]:
        return out
    rest = (DISCOUNTED + 1) * n.get(DISCOUNTED + 1, 0) / n[1]
    for r in range(1, DISCOUNTED + 1):
        if n.get(r):
            d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - rest) / (1 - rest)
            out[r] = d if 0 < d <= 1 else 1.0
    return out


def _factor(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, DISCOUNTED + 1)]


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log10(x)


def _code(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(v.view(np.uint64)) + np.uint64(3) * w.view(np.uint64))


def sequences(texts: pa.Array, ids: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all tokens (words in lower case, then one end per text), and each text's first position (n + 1).

    ``ids`` gets the hashes of distinct words and the end."""
    words, ends = split_words(texts)
    n = len(ends) - 1
    coded = words.dictionary_encode()
    known = ids(np.append(word_hashes(coded.dictionary, lower=True), END))
    out = np.full(len(words) + n, known[-1])
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(ends))] = known[coded.indices.to_numpy()]
    return out, ends + np.arange(n + 1)


class Words:
    """The frequent words: a word's id is its place among their sorted hashes; others keep a marked hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, buckets: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.start, self.buckets = hashes[order], counts[order], len(hashes), buckets

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, self.start - 1))
        hot = self.hashes[at] == hashes if self.start else np.zeros(len(hashes), bool)
        return np.where(hot, at.astype(np.uint64), hashes | RARE).view(np.int64)

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context and token of every token, and each text's first position (n + 1)."""
        w, first = sequences(texts, self.ids)
        v = np.roll(w, 1)
        v[first[:-1]] = self.start
        return v, w, first

    def bucket(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        code = np.where(w >= 0, _code(v, w), mix(w.view(np.uint64)))
        return (code % np.uint64(self.buckets)).astype(np.int32)


def _table(columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys (rows of parallel columns) with their summed counts. Keys of 31 bits each are sorted as one number."""
    if len(keys) == 2:
        low = (keys[0] >= 0) & (keys[1] >= 0) & (keys[0] < 1 << 31) & (keys[1] < 1 << 31)
        if low.any():
            one = keys[0][low] << 31 | keys[1][low]
            order = np.argsort(one)
            one = one[order]
            at = np.flatnonzero(np.diff(one, prepend=-1))
            rest, more = _summed([np.append(k[~low], -1) for k in keys], np.append(counts[~low], 0))
            sums = np.add.reduceat(counts[low][order], at)
            some = more > 0
            return [np.append(a, b[some]) for a, b in zip((one[at] >> 31, one[at] & (1 << 31) - 1), rest, strict=True)], np.append(sums, more[some])
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: the ids of frequent words have few bytes that are not 0."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T)
    return planes.nbytes.to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    if not size:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(x[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _numbers(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(_unpack(x, kind) for x in column.to_pylist() if x is not None)])


def count_words(train: DataFrame) -> DataFrame:
    """Table words: (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, 0, SLICE, SLICE_BYTES):
            held.append(sequences(part.column(0), lambda x: x)[0])
            size += len(held[-1])
            if size >= FLUSH:
                w, c = np.unique(np.concatenate(held), return_counts=True)
                yield _table({"word": w.view(np.int64), "n": c})
                held, size = [], 0
        if held:
            w, c = np.unique(np.concatenate(held), return_counts=True)
            yield _table({"word": w.view(np.int64), "n": c})

    return saved(train.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


class Katz:
    """A model learned from the texts of ``train``. Only what the module's notes bound is held on the driver."""

    def __init__(self, train: DataFrame):
        spark = train.sparkSession
        self.words = count_words(train)
        self.tokens, self.types = (x or 0 for x in self.words.agg(F.sum("n"), F.count("*")).first())
        few = dict(self.words.where(F.col("n") <= DISCOUNTED + 1).groupBy("n").count().collect())
        level = F.floor(16 * F.log2("n")).cast("int")
        levels, least = dict(self.words.groupBy(level).count().collect()), 0  # at most 1024 rows
        while sum(k for x, k in levels.items() if x >= least) > HOT:
            least += 1
        self.d1 = good_turing(few)
        self.unknown = sum((1 - self.d1[r]) * r * few.get(r, 0) for r in range(1, DISCOUNTED + 1)) / max(1, self.tokens)
        self.mass = self.tokens
        if self.unknown <= 0:
            self.mass, self.unknown = self.tokens + 1, 1 / (self.tokens + 1)
        top = self.words.where(level >= least).toArrow()
        self.hot = Words(top["word"].to_numpy().view(np.uint64), top["n"].to_numpy(), max(12, self.tokens // BUCKET_TOKENS))
        self.sent = spark.sparkContext.broadcast(vars(self.hot))
        self.pairs = self._count_pairs(train)
        few = dict(self.pairs.mapInArrow(_few_counts, "n long, k long").groupBy("n").agg(F.sum("k")).collect())
        self.d2 = good_turing(few)
        self.contexts = self._contexts()
        self._frequent()

    def chance(self, c: np.ndarray) -> np.ndarray:
        """Probability of a word of count c; of the unknown word for 0."""
        return np.where(c > 0, _factor(self.d1, c) * c / max(1, self.mass), self.unknown)

    def _rare_words(self) -> DataFrame:
        """Counts of words that are not hot, by bucket, in the columns of ``_count_pairs``."""
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot = plain_object(Words, sent.value)
            for batch in batches:
                w = hot.ids(batch.column(0).to_numpy().view(np.uint64))
                rare = w < 0
                w, c = w[rare], batch.column(1).to_numpy()[rare]
                for b, at in _parts(hot.bucket(w, w)):
                    yield _table({"bucket": pa.array([b], pa.int32()), "v": pa.array([None], pa.binary()), "w": [_pack(w[at])], "n": [_pack(c[at])]})

        return self.words.select("word", "n").mapInArrow(run, "bucket int, v binary, w binary, n binary")

    def _count_pairs(self, train: DataFrame) -> DataFrame:
        """Table pairs: per bucket the packed v, w, n of its pairs and rw, rn of its rarer words."""
        sent = self.sent

        def flush(held: list[tuple[np.ndarray, np.ndarray]], hot: Words) -> Iterator[pa.RecordBatch]:
            v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            (v, w), c = _summed([v, w], np.ones(len(v), np.int64))
            for b, at in _parts(hot.bucket(v, w)):
                yield _table({"bucket": pa.array([b], pa.int32()), "v": [_pack(v[at])], "w": [_pack(w[at])], "n": [_pack(c[at])]})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, hot = [], 0, plain_object(Words, sent.value)
            for part in slices(batches, 0, SLICE, SLICE_BYTES):
                held.append(hot.pairs(part.column(0))[:2])
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield from flush(held, hot)
                    held, size = [], 0
            if held:
                yield from flush(held, hot)

        def merge(group: pa.Table) -> pa.Table:
            is_pair = group.column("v").is_valid()
            own, rare = group.filter(is_pair), group.filter(pc.invert(is_pair))
            (v, w), n = _summed([_numbers(own.column("v"), "<i8"), _numbers(own.column("w"), "<i8")], _numbers(own.column("n"), "<i8"))
            (rw,), rn = _summed([_numbers(rare.column("w"), "<i8")], _numbers(rare.column("n"), "<i8"))
            return pa.table({"bucket": group.column("bucket")[:1], **{k: [_pack(x)] for k, x in (("v", v), ("w", w), ("n", n), ("rw", rw), ("rn", rn))}})

        raw = train.select("text").mapInArrow(run, "bucket int, v binary, w binary, n binary").union(self._rare_words())
        return saved(raw.groupBy("bucket").applyInArrow(merge, "bucket int, v binary, w binary, n binary, rw binary, rn binary"), "pairs")

    def _word_counts(self, w: np.ndarray, rw: np.ndarray, rn: np.ndarray) -> np.ndarray:
        """Counts of words, of which the rarer ones are in rw (sorted) if they were seen."""
        at = np.minimum(np.searchsorted(rw, w), max(0, len(rw) - 1))
        rare = np.where(rw[at] == w, rn[at], 0) if len(rw) else np.zeros(len(w), np.int64)
        counts = self.hot.counts
        return np.where(w >= 0, counts[np.clip(w, 0, max(0, len(counts) - 1))] if len(counts) else 0, rare)

    def _state(self) -> dict:
        """What the tasks need, in plain arrays and numbers: they rebuild the model with ``_model``."""
        out = {k: x for k, x in vars(self).items() if k not in ("words", "pairs", "contexts", "sent")}
        return out | {"hot": vars(self.hot)}

    def _contexts(self) -> DataFrame:
        """Table contexts: context, logs of its norm and of its back-off weight."""
        model = self.pairs.sparkSession.sparkContext.broadcast(self._state())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = _model(model.value)
            for batch in batches:
                for row in batch.to_pylist():
                    v, w, n, rw, rn = (_unpack(row[k], "<i8") for k in ("v", "w", "n", "rw", "rn"))
                    if not len(v):
                        continue
                    values = (n, _factor(m.d2, n) * n, m.chance(m._word_counts(w, rw, rn)))
                    order = np.argsort(v, kind="stable")
                    at = np.flatnonzero(np.diff(v[order], prepend=v[order[0]] - 1))
                    n, kept, seen = (np.add.reduceat(x[order], at) for x in values)
                    yield _table({"v": v[order][at], "n": n, "kept": kept, "seen": seen})

        sums = self.pairs.mapInArrow(run, "v long, n long, kept double, seen double").groupBy("v").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"), F.sum("seen").alias("seen"))
        saves = F.col("kept") < F.col("n") - F.lit(1e-9)
        norm = F.when(saves, F.col("n")).otherwise(F.col("n") + 1)
        weight = (1 - F.col("kept") / norm) / F.greatest(1 - F.col("seen"), F.lit(1e-300))
        return saved(sums.select("v", F.log10(norm.cast("double")).alias("norm"), F.log10(weight).alias("weight")), "contexts")

    def _frequent(self) -> None:
        """Takes in the contexts that are hot words (or the start) and the pairs of more than 1/HOT_PAIRS of the tokens."""
        self.norm, self.weight = np.zeros(self.hot.start + 1), np.zeros(self.hot.start + 1)
        own = self.contexts.where(F.col("v") >= 0).toArrow()
        self.norm[own["v"].to_numpy()], self.weight[own["v"].to_numpy()] = own["norm"].to_numpy(), own["weight"].to_numpy()
        least = self.tokens / HOT_PAIRS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    v, w, n = (_unpack(row[k], "<i8") for k in ("v", "w", "n"))
                    on = n > max(least, 1)
                    yield _table({"v": v[on], "w": w[on], "n": n[on]})

        top = self.pairs.select("v", "w", "n").mapInArrow(run, "v long, w long, n long").where("v >= 0 and w >= 0").toArrow()
        codes = _code(top["v"].to_numpy(), top["w"].to_numpy())
        order = np.argsort(codes)
        self.top_codes, n = codes[order], top["n"].to_numpy()[order]
        self.top_scores = _log(_factor(self.d2, n) * n) - self.norm[top["v"].to_numpy()[order]]

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, n_known, base_score and score of every row of ``docs``."""
        model = docs.sparkSession.sparkContext.broadcast(self._state())
        kinds = "bucket int, slice long, o binary, v binary, w binary, n binary, rw binary, rn binary"

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, none = _model(model.value), pa.array([None], pa.binary())
            for part in slices(batches, 1, SLICE, SLICE_BYTES):
                v, w, first = m.hot.pairs(part.column(1))
                size = np.diff(first)
                o = np.repeat(np.arange(len(size)), size)
                hot = w >= 0
                c = m.hot.counts[w[hot]] if len(m.hot.counts) else w[hot]
                known = np.bincount(o[hot], c > 0, len(size)).astype(np.int64)
                base = np.bincount(o[hot], m.base(c), len(size))
                codes = _code(v, w)
                at = np.minimum(np.searchsorted(m.top_codes, codes), max(0, len(m.top_codes) - 1))
                top = m.top_codes[at] == codes if len(m.top_codes) else np.zeros(len(w), bool)
                score = np.bincount(o[top], m.top_scores[at[top]], len(size)) if top.any() else np.zeros(len(size))
                ids = _ids_bytes(part.column(0))
                name = np.uint64(xxhash.xxh3_64_intdigest(b"".join((ids, first.tobytes(), w.tobytes())))).view(np.int64)
                # of the texts themselves: sizes, sums so far and ids, in the columns v, w, n, rw and rn
                values = {k: [_pack(x)] for k, x in (("v", size.astype(np.int64)), ("w", known), ("n", base), ("rw", score))}
                yield _table({"bucket": pa.array([int(name) % m.hot.buckets], pa.int32()), "slice": [name], "o": none, **values, "rn": pa.array([ids], pa.binary())})
                v, w, o = v[~top], w[~top], o[~top]
                for b, k in _parts(m.hot.bucket(v, w)):
                    steps = np.diff(o[k], prepend=0).astype("<u2")
                    yield _table({"bucket": pa.array([b], pa.int32()), "slice": [name], "o": [_pack(steps)], "v": [_pack(v[k])], "w": [_pack(w[k])], "n": none, "rw": none, "rn": none})

        def meet(group: pa.Table) -> pa.Table:
            return _model(model.value).meet(group)

        sent = docs.select("doc_id", "text").mapInArrow(send, kinds)
        table = self.pairs.select("bucket", F.lit(None).cast("long").alias("slice"), F.lit(None).cast("binary").alias("o"), "v", "w", "n", "rw", "rn")
        back = "slice long, o binary, size binary, known binary, base binary, score binary, ids binary"
        met = sent.union(table).groupBy("bucket").applyInArrow(meet, back + ", at int, v long, hit boolean")
        met = saved(met, "token-sums")
        late = met.where("v is not null").select("slice", "at", "v", "hit").join(self.contexts, "v", "left")
        add = F.coalesce(F.when(F.col("hit"), -F.col("norm")).otherwise(F.col("weight")), F.lit(0.0))
        late = late.select("slice", *(F.lit(None).cast("binary").alias(k) for k in ("o", "size", "known", "base", "score", "ids")), "at", add.alias("add"))
        packed = met.where("v is null").select("slice", "o", "size", "known", "base", "score", "ids", "at", F.lit(None).cast("double").alias("add"))
        schema = docs.select("doc_id").schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
        return packed.union(late).groupBy("slice").applyInArrow(_added_up, schema)

    def base(self, c: np.ndarray) -> np.ndarray:
        """log10 of the add-one probability of a word of count c."""
        return np.log10((c + 1) / (self.tokens + self.types + 1))

    def meet(self, group: pa.Table) -> pa.Table:
        """Scores the tokens of a bucket with its pairs: packed sums per slice, and a row per token of a rare context."""
        kinds = {"slice": pa.int64(), **dict.fromkeys(("o", "size", "known", "base", "score", "ids"), pa.binary()), "at": pa.int32(), "v": pa.int64(), "hit": pa.bool_()}

        def rows(n: int, **columns) -> pa.Table:
            return pa.table({k: pa.array(columns[k], x) if k in columns else pa.nulls(n, x) for k, x in kinds.items()})

        own, others = group.filter(group.column("slice").is_null()), group.filter(group.column("slice").is_valid())
        texts, tokens = others.filter(others.column("o").is_null()), others.filter(others.column("o").is_valid())
        cells = lambda t, k: t.column(k).to_pylist()
        out = [rows(texts.num_rows, slice=cells(texts, "slice"), size=cells(texts, "v"), known=cells(texts, "w"), base=cells(texts, "n"), score=cells(texts, "rw"), ids=cells(texts, "rn"))]
        if tokens.num_rows:
            v, w = (_numbers(tokens.column(k), "<i8") for k in ("v", "w"))
            places = [np.cumsum(_unpack(x, "<u2"), dtype=np.int64) for x in cells(tokens, "o")]
            row = np.repeat(np.arange(len(places)), [len(x) for x in places])
            o, names = np.concatenate(places), np.array(cells(tokens, "slice"), np.int64)
            pv, pw, pn, rw, rn = (_numbers(own.column(k), "<i8") for k in ("v", "w", "n", "rw", "rn"))
            codes = _code(pv, pw)
            order = np.argsort(codes)
            codes, pn = codes[order], pn[order]
            wanted = _code(v, w)
            at = np.minimum(np.searchsorted(codes, wanted), max(0, len(codes) - 1))
            n = np.where(codes[at] == wanted, pn[at], 0) if len(codes) else np.zeros(len(v), np.int64)
            c, hit, hot, rare = self._word_counts(w, rw, rn), n > 0, v >= 0, w < 0
            score = np.where(hit, _log(_factor(self.d2, n) * n), _log(self.chance(c)))
            place = np.where(hot, v, 0)
            score += np.where(hot, np.where(hit, -self.norm[place], self.weight[place]), 0.0)
            base, known = np.where(rare, self.base(c), 0.0), rare & (c > 0)
            key = row << 16 | o  # ascending
            at = np.flatnonzero(np.diff(key, prepend=-1))
            known, base, score = (np.add.reduceat(x, at) for x in (known.astype(np.int64), base, score))
            cuts = np.searchsorted(key[at] >> 16, np.arange(len(names) + 1))
            parts = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            columns = {"o": o[at].astype("<u2"), "known": known.astype("<u4"), "base": base, "score": score}
            out.append(rows(len(names), slice=names, **{k: [_pack(x[p]) for p in parts] for k, x in columns.items()}))
            late = ~hot
            out.append(rows(int(late.sum()), slice=names[row[late]], at=o[late].astype(np.int32), v=v[late], hit=hit[late]))
        return pa.concat_tables(out)


def _ids_bytes(ids: pa.Array) -> bytes:
    table = pa.table({"doc_id": ids})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _model(state: dict) -> Katz:
    return plain_object(Katz, state | {"hot": plain_object(Words, state["hot"])})


def _added_up(group: pa.Table) -> pa.Table:
    """The rows of a slice from what the buckets found for it. Slices of equal content share a name and all sums."""
    texts = group.filter(group.column("ids").is_valid())
    tokens, late = group.filter(group.column("o").is_valid()), group.filter(group.column("at").is_valid())
    copies = texts.num_rows
    size = _unpack(texts.column("size")[0].as_py(), "<i8")
    known = _unpack(texts.column("known")[0].as_py(), "<i8") * copies
    base, score = (_unpack(texts.column(k)[0].as_py(), "<f8") * copies for k in ("base", "score"))
    at = _numbers(tokens.column("o"), "<u2")
    known = known + np.bincount(at, _numbers(tokens.column("known"), "<u4"), len(size)).astype(np.int64)
    base, score = (x + np.bincount(at, _numbers(tokens.column(k), "<f8"), len(size)) for k, x in (("base", base), ("score", score)))
    score = score + np.bincount(late.column("at").to_numpy(), late.column("add").to_numpy(), len(size))
    with pa.ipc.open_stream(texts.column("ids")[0].as_py()) as stream:
        ids = stream.read_all().column(0)
    out = pa.table({"doc_id": ids, "n_tokens": size, "n_known": known // copies, "base_score": base / copies, "score": score / copies})
    return pa.concat_tables([out] * copies)


def _few_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("n").to_pylist():
            n = _unpack(x, "<i8")
            k, count = np.unique(n[n <= DISCOUNTED + 1], return_counts=True)
            yield _table({"n": k, "k": count})


def held_out(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """``docs`` with the column held_out: whether the CRC of the id, as text, falls into the fold."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold)
