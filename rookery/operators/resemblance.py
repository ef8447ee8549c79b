"""Similarity join by Jaro-Winkler, exact for its threshold, over cells of strings whose letters are compared first.

Two strings of n and m characters with a Jaro similarity of at least j share at least (3 j - 1) n m / (n + m) characters
(a bound on lengths too). Jaro-Winkler adds to a common prefix of up to four, so j is what the bonus of a pair's own prefix
leaves to be had. Each string has a signature of 64 bits, one for each of its letters (a letter's second and third place
have bits of their own), and two signatures bound what their strings share; letters that fall on one bit count as shared.
A pair whose signatures speak against it costs about ten instructions on arrays, so all pairs of a block are looked at, and
few are scored: first the shared characters within reach, as sets of bits, then, where these suffice, the exchanged ones.

Pairs are made in cells: a block is cut by hashes into pieces of about ``FEW`` and ``ASKED`` strings, and each piece of
the one side meets each of the other in a task. So no key stands for a block alone; a task holds the known strings of
one cell and a batch of asked ones, and pairs in steps of ``STEP``. The number of pairs grows with the square of a block,
as the result may; strings travel as often as the other side of their block has pieces. Scores are rounded to nine
digits, since pairs of equal similarity may differ in the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.similarity import MOST, Strings, jaro_winkler_reaching
from .tables import saved

PREFIX, SCALE = 4, 0.1
EDGE = 1e-9  # on the side of more candidates
#: Known and asked strings of a cell, and pairs looked at in a step.
FEW, ASKED, STEP = 1 << 12, 1 << 15, 1 << 17


def shared(least: float, prefix: int) -> float:
    """3 j - 1 for the Jaro similarity that a Jaro-Winkler similarity needs with a common prefix."""
    return 3 * (least - SCALE * prefix) / (1 - SCALE * prefix) - 1


def needed(least: float) -> np.ndarray:
    """By common prefix and lengths up to ``MOST``: how many characters a pair must share (255: no pair is similar); 0 where
    a string is longer."""
    n, m = np.arange(MOST + 2)[:, None], np.arange(MOST + 2)[None, :]
    ways = [np.ceil(shared(least - EDGE, p) * n * m / np.maximum(n + m, 1) - EDGE) for p in range(PREFIX + 1)]
    return np.stack([np.where(np.maximum(n, m) > MOST, 0, np.where((c <= np.minimum(n, m)) & (n > 0) & (m > 0), c, 255)) for c in ways]).astype(np.uint8)


def cells(left: DataFrame, right: DataFrame, alike: list[str], initial: bool) -> DataFrame:
    """Rows (_alike, _cell, _asked, _text) of both sides, with those that may meet in one cell."""
    of = lambda c: F.struct(*alike, *([F.substring(c, 1, 1).alias("_initial")] if initial else []), F.lit(0).alias("_"))
    rows = lambda df, c: df.where(F.length(c) > 0).na.drop(subset=alike).select(F.struct(*alike, F.lit(0).alias("_")).alias("_alike"), F.to_json(of(c)).alias("_block"), F.col(c).alias("_text"))
    known, asked = rows(right, "b"), rows(left, "a")
    pieces = lambda df, most, name: df.groupBy("_block").agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(F.col(name) > 1)
    # blocks of more than one piece: at most one for each FEW strings
    hot = saved(pieces(known, FEW, "_k").join(pieces(asked, ASKED, "_a").hint("merge"), "_block", "full"), "blocks")
    none = hot.isEmpty()
    dealt = lambda df: df.withColumns({"_k": F.lit(1), "_a": F.lit(1)}) if none else df.join(F.broadcast(hot), "_block", "left").withColumns({"_k": F.coalesce("_k", F.lit(1)), "_a": F.coalesce("_a", F.lit(1))})

    def placed(df: DataFrame, own: str, other: str, number: int) -> DataFrame:
        mine, theirs = F.pmod(F.xxhash64("_text"), F.col(own)).alias("_mine"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("_theirs")
        at = dealt(df).select("_alike", "_block", "_text", mine, theirs)
        pair = ("_theirs", "_mine") if number else ("_mine", "_theirs")
        return at.select("_alike", F.concat_ws(" ", *pair, "_block").alias("_cell"), F.lit(bool(number)).alias("_asked"), "_text")

    return placed(known, "_k", "_a", 0).unionByName(placed(asked, "_a", "_k", 1))


def _steps(counts: np.ndarray) -> Iterator[slice]:
    """Runs of rows that have at most ``STEP`` pairs, unless one row has more."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
        yield slice(at, to)
        at = to


def _met(rows: pa.RecordBatch, cell: np.ndarray, table: np.ndarray, most_apart: float) -> Iterator[tuple[Strings, np.ndarray, np.ndarray]]:
    """Places in ``rows`` of asked and known strings of one cell that share enough letters."""
    is_asked = rows.column("_asked").to_numpy(zero_copy_only=False)
    known, asked = np.flatnonzero(~is_asked), np.flatnonzero(is_asked)
    first, last = np.searchsorted(cell[known], cell[asked]), np.searchsorted(cell[known], cell[asked], side="right")
    asked, first, counts = asked[last > first], first[last > first], (last - first)[last > first]
    if not len(asked):
        return
    x, most = Strings(rows.column("_text").to_pylist()), MOST + 2
    length = np.minimum(x.length, MOST + 1)
    best = np.take_along_axis(table, np.minimum(np.minimum(np.arange(most)[:, None], np.arange(most)), PREFIX)[None], 0)[0].ravel()
    sign, spare, own = x.sign[known], x.spare[known], length[known]
    for some in _steps(counts):
        n = counts[some]
        b = np.arange(n.sum()) + np.repeat(first[some] - (np.cumsum(n) - n), n)
        each = asked[some]
        common = np.bitwise_count(np.repeat(x.sign[each], n) & sign[b]) + np.minimum(np.repeat(x.spare[each], n), spare[b])
        near = np.flatnonzero(common >= best[np.repeat(length[each] * most, n) + own[b]])
        a, b, common = np.repeat(each, n)[near], known[b[near]], common[near]
        near = (common >= table[x.prefix(a, b), length[a], length[b]]) & (np.maximum(x.length[a], x.length[b]) <= most_apart * np.minimum(x.length[a], x.length[b]))
        if near.any():
            yield x, a[near], b[near]


def _joined(left: DataFrame, right: DataFrame, least: float, alike: list[str], initial: bool, score: bool) -> DataFrame:
    if not 1 < shared(least, PREFIX) or least > 1:
        raise ValueError("the bound needs a similarity above 0.8, of at most 1")
    table, most_apart = needed(least), 1 / (shared(least - EDGE, PREFIX) - 1) + EDGE  # lengths bound each other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # known strings of the cell that the last batch ended in
        for batch in batches:
            rows = batch if kept is None else pa.concat_batches([kept, batch])
            name = rows.column("_cell")
            cell = np.concatenate([[0], np.cumsum(pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False))]) if len(name) else np.zeros(0, np.int64)
            if not len(cell):
                continue
            for x, a, b in _met(rows, cell, table, most_apart):
                columns = []
                if score:
                    a, b, scores = jaro_winkler_reaching(x, a, b, least - EDGE)
                    columns = [pa.array(scores)]
                text = rows.column("_text")
                yield pa.RecordBatch.from_arrays([rows.column("_alike").take(pa.array(a)), text.take(pa.array(a)), text.take(pa.array(b)), *columns], names=["_alike", "a", "b", *(["score"] if score else [])])
            kept = rows.filter(pa.array((cell == cell[-1]) & ~rows.column("_asked").to_numpy(zero_copy_only=False)))

    rows = cells(left, right, alike, initial)
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "_cell").sortWithinPartitions("_cell", "_asked")
    types = rows.schema
    text = types["_text"].dataType
    out = StructType([types["_alike"], StructField("a", text), StructField("b", text), *([StructField("score", DoubleType())] if score else [])])
    return dealt.mapInArrow(run, out).select(*(F.col(f"_alike.{c}").alias(c) for c in alike), "a", "b", *(["score"] if score else []))


def candidates(left: DataFrame, right: DataFrame, least: float, alike: list[str] | None = None, initial: bool = False) -> DataFrame:
    """Distinct (``alike``, a, b) among which are all pairs with a Jaro-Winkler similarity of at least ``least``.

    ``left`` has (``alike``, a) and ``right`` (``alike``, b), each distinct; ``alike`` must be equal, and the first
    character too if ``initial``. Null and empty strings resemble nothing."""
    return _joined(left, right, least, alike or [], initial, False)


def similar(left: DataFrame, right: DataFrame, least: float, alike: list[str] | None = None, initial: bool = False) -> DataFrame:
    """(``alike``, a, b, score) of all pairs that reach ``least``."""
    met = _joined(left, right, least, alike or [], initial, True)
    return met.withColumn("score", F.round("score", 9)).where(F.col("score") >= least)
