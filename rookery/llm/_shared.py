"""Helpers that the corpus operators share: table access, shared scratch space, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACE_RE = r"[\x20\x09-\x0D]+"

_own_folder: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder of the cluster (spark.checkpoint.dir)."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return f"{base.rstrip('/')}/rookery/{app}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_object(kind: type, state: dict):
    """An object of plain state: broadcasts hold no objects of this package, which workers needn't have."""
    out = object.__new__(kind)
    out.__dict__ = state
    return out


def words_of(text: Column) -> Column:
    """The words of a text, in order; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large-string array with '' for null."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and where each text's words begin and end (n + 1 offsets)."""
    lists = pc.ascii_split_whitespace(plain(texts))
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        flat, ends = flat.filter(pa.array(full)), before[ends]
    return flat, ends


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of at most ``rows``, and of at most ``size`` bytes of a column unless one row has more."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = max(1, min(rows, int(np.searchsorted(ends, before + size, side="right")) - at))
            yield batch.slice(at, n)
            at += n
    pa.default_memory_pool().release_unused()  # workers outlive their tasks


def cells(column: pa.Array, kind: str) -> list[np.ndarray]:
    """The numbers in each cell of a binary column, without copies."""
    data, at = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    numbers = np.frombuffer(data, kind) if data is not None and data.size else np.empty(0, kind)
    at = at // np.dtype(kind).itemsize
    return [numbers[a:b] for a, b in zip(at, at[1:], strict=False)]


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def word_hashes(words: pa.Array, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word, with A to Z in lower case if asked for; every distinct word is hashed once."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    hashed = xxhash.xxh3_64_intdigest
    own = coded.dictionary.to_pylist()
    if lower:
        own = [w.lower() if w.isascii() else w.translate(LOWER) for w in own]
    known = np.fromiter(map(hashed, own), np.uint64, len(own))
    return known[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(hashes: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width``-word window inside one text, and the number of its text.

    A text of fewer words, but at least one, has one window: all its words.
    """
    n = np.diff(ends)
    total = len(hashes)
    rolled = np.zeros(max(total, 1), np.uint64)[:total]
    for k in range(width):
        part = np.zeros(total, np.uint64)
        part[: total - k] = hashes[k:] if k else hashes
        rolled = mix(rolled + part * np.uint64(2 * k + 3) + np.uint64(k + 1))
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(total) + width <= np.repeat(ends[1:], n)
    windows, owners = rolled[inside], owner[inside]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for j, d in enumerate(short):
            h = np.array([n[d]], np.uint64)
            for k in range(ends[d], ends[d + 1]):
                h = mix(h * np.uint64(31) + hashes[k : k + 1])
            whole[j] = h[0]
        windows, owners = np.concatenate((windows, whole)), np.concatenate((owners, short))
    return windows, owners
