"""Token counts of documents in flat token files without an index, by a scan for separators.

A token file is a run of unsigned little-endian numbers; each document ends with the end-of-document id. ``scan`` cuts
files into blocks of tokens, finds the separators of a block at once (one vector comparison), and returns the distances
between them. Documents that cross block borders are stitched by a prefix scan over one summary row per block (number
of separators before the block, position of the last one), a window over the blocks of a file.

Defined cases: neighbouring separators enclose a document of 0 tokens; tokens after the last separator of a file form a
document that is marked as not ended; an empty file has no documents; a size that is no multiple of the width of a
token is an error. ``write_token_files`` writes a null text as an empty document; repeated rows are documents of
their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe_trie
from ._shared import saved, scratch, slices

BLOCK = 1 << 20


def write_token_files(docs: DataFrame, path: str, tokenizer: str, eod: int, *, width: int = 2, file_bytes: int = 1 << 30) -> DataFrame:
    """Encodes (doc_id, text) to token files below ``path``, a folder that all executors share.

    Returns what was written, a row per document: doc_id, file, ordinal in the file. Names are unique to a task attempt
    and only what successful attempts return counts, so a lost executor leaves at most files that nothing names.
    """
    packed = docs.sparkSession.sparkContext.broadcast(bpe_trie.load_vocabulary(tokenizer))
    schema = docs.select("doc_id").schema.add("file", "string").add("ordinal", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe_trie._coder(packed.value, False)
        if len(coder.pieces) > 1 << 8 * width or eod >= 1 << 8 * width:
            raise ValueError(f"ids do not fit into {width} bytes")
        system, root = fs.FileSystem.from_uri(path)
        out, end = None, np.array([eod], f"<u{width}").tobytes()
        try:
            for part in slices(batches, 1, bpe_trie.SLICE, bpe_trie.SLICE_BYTES):
                if out is None or size >= file_bytes:
                    if out is not None:
                        out.close()
                    name, size, n = f"tokens-{uuid.uuid4().hex}.bin", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                ids = coder.encode([t or "" for t in part.column(1).to_pylist()])
                data = b"".join(np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() + end for x in ids)
                out.write(data)
                size += len(data)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name] * len(ids)), pa.array(range(n, n + len(ids)), pa.int64())], names=schema.names)
                n += len(ids)
        finally:
            if out is not None:
                out.close()

    system, root = fs.FileSystem.from_uri(path)
    system.create_dir(root, recursive=True)
    return saved(docs.select("doc_id", "text").mapInArrow(run, schema), "token-files")


def scan(files: DataFrame, path: str, eod: int, *, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, ordinal, n_tokens and ended for each document of the files (column ``file``) below ``path``."""
    kind = f"<u{width}"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = [x.size for x in system.get_file_info([f"{root}/{x}" for x in names])]
            if any(s % width for s in sizes):
                raise ValueError("a file ends inside a token")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s // width for s in sizes], pa.int64())], names=["file", "size"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, size, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = number * block
                with system.open_input_file(f"{root}/{name}") as f:
                    tokens = np.frombuffer(f.read_at(min(block, size - first) * width, first * width), kind)
                at = np.flatnonzero(tokens == eod)
                lengths = np.diff(at, prepend=-1) - 1
                last = first + int(at[-1]) if len(at) else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([size]), pa.array([number]), pa.array([len(at)], pa.int64()), pa.array([last], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))],
                    names=["file", "size", "block", "n", "last", "lengths"],
                )

    sizes = files.select("file").distinct().mapInArrow(measure, "file string, size long")
    blocks = sizes.where("size > 0").select("file", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {block}L)")).alias("block"))
    blocks = blocks.repartition(F.col("file"), F.col("block"))
    found = saved(blocks.mapInArrow(find, "file string, size long, block long, n long, last long, lengths array<bigint>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = found.select("file", "block", "size", "n", "last").withColumns({"_rank": F.coalesce(F.sum("n").over(before), F.lit(0)), "_open": F.coalesce(F.max("last").over(before), F.lit(-1))})
    whole = found.select("file", "block", F.posexplode("lengths").alias("k", "n_tokens"))
    stitched = whole.join(at.drop("size", "n", "last"), ["file", "block"])
    carried = F.when(F.col("k") == 0, F.col("block") * block - F.col("_open") - 1).otherwise(F.lit(0))
    out = stitched.select("file", (F.col("_rank") + F.col("k")).alias("ordinal"), (F.col("n_tokens") + carried).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = at.groupBy("file").agg(F.max("size").alias("s"), F.sum("n").alias("n"), F.coalesce(F.max("last"), F.lit(-1)).alias("l")).where("s - l > 1")
    return out.unionByName(rest.select("file", F.col("n").alias("ordinal"), (F.col("s") - F.col("l") - 1).alias("n_tokens"), F.lit(False).alias("ended")))


def count_tokens(docs: DataFrame, tokenizer: str, eod: int, *, width: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of every row, counted in token files that are written to the shared folder."""
    path = scratch(docs.sparkSession, "tokens")
    written = write_token_files(docs, path, tokenizer, eod, width=width)
    counted = scan(written, path, eod, width=width, block=block)
    return written.join(counted, ["file", "ordinal"], "left").select("doc_id", "n_tokens", "ended")
