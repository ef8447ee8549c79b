"""Sharded WARC writer and reader.

``write_archive`` sorts records by page id into ranges, one shard per range. The ranges come from an exact histogram of
payload bytes, not from sampling, so equal input gives equal files; bins that hold much are split until they are one id,
and the rows of one id (or none) by digest, so neither outlying ids nor null ones crowd a shard. Inside a shard, files roll at a compressed size;
every record is a gzip member of its own. Payloads are shuffled once: which rows revisit an earlier payload is worked
out on digests alone, and these decisions travel in the same range sort, in front of the rows they are about.

Commit: tasks write below ``_temporary`` under names that no other attempt uses, and return manifest rows. Only rows of
successful attempts reach the pending manifest; its files are then renamed (a repeated rename is harmless), and the
archive exists once ``_manifest`` is written.

Defined cases: a null payload is an empty one, a null url an empty one. Null page ids come last. Rows that share page id
and payload: the first by url is the response, the others revisit that page id. With ``min_revisit_bytes`` = 0 empty
payloads revisit as well. An empty table gives an archive without files. Extra columns are ignored. An archive that
exists is not written over: that is an error before any work.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import saved, scratch

BIN_BITS = 14
MANIFEST = "file string, temp string, records long, bytes long, sha256 string, first_page long, last_page long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string"


def _name(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, fields: dict[str, str | int | None], block: bytes) -> bytes:
    """One record as a gzip member; headers in a fixed order, no clock in it."""
    fields = {"WARC-Type": kind} | fields | {"WARC-Block-Digest": _digest(block), "Content-Length": len(block)}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def _page_record(page_id: int | None, url: str, payload: bytes, original: tuple | None, date: str) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Record-ID": _name(page_id, url), "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": _digest(payload), "Content-Type": "application/http; msgtype=response", "X-Page-Id": page_id, "X-Payload-Length": len(payload)}
    if original is None:
        return _record("response", fields, http + payload)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return _record("revisit", fields | {"WARC-Profile": profile, "X-Refers-To-Page-Id": original[0]}, http)


class _Roller:
    """The open file of one shard."""

    def __init__(self, root: str, file_bytes: int, date: str):
        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.file_bytes, self.date, self.shard, self.k, self.out = file_bytes, date, None, 0, None

    def add(self, shard: int, page_id: int | None, record: bytes) -> Iterator[tuple]:
        if shard != self.shard or (self.out and self.size + len(record) > self.file_bytes):
            yield from self.close()
            self.shard, self.k = shard, self.k + 1 if shard == self.shard else 0
        if self.out is None:
            self.file = f"shard-{self.shard:06d}-{self.k:05d}.warc.gz"
            self.temp = f"_temporary/{self.file}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temp}", compression=None)
            self.size, self.n, self.sha, self.first = 0, 0, hashlib.sha256(), page_id
            self._put(_record("warcinfo", {"WARC-Record-ID": _name(None, self.file), "WARC-Date": self.date, "WARC-Filename": self.file, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
        self._put(record)
        self.n, self.last = self.n + 1, page_id

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.out = None
            yield self.file, self.temp, self.n, self.size, self.sha.hexdigest(), self.first, self.last


def _ranges(light: DataFrame, shards: int, total: int) -> list[tuple[list[str], DataFrame]]:
    """Tables (keys, shard), and the keys to look a row's shard up by, coarse ones first; each row is in one table.

    Keys are leading bits of the page id; where a bin holds more than a quarter of a shard, more bits; last the digest's.
    """
    spark, most = light.sparkSession, max(1, total // (4 * shards))
    sized = light.select("page_id", _lead("digest").alias("lead"), (F.col("size") + 512).alias("n"))
    lo, hi = sized.agg(F.min("page_id"), F.max("page_id")).first()
    found: list[tuple[tuple, tuple, int, int]] = []  # what it is sorted by, its keys, bytes, its table
    bits, shift, rows, tables = BIN_BITS, 0, sized.where("page_id is not null"), []
    while lo is not None and (hi >> shift) - (lo >> shift) >= 1 << BIN_BITS:
        shift += 1
    while lo is not None:
        at = F.shiftright("page_id", shift)
        tables.append(([f"shiftright(page_id, {shift})"], "k0 long"))
        sums = rows.groupBy(at.alias("k")).agg(F.sum("n").alias("n")).collect()  # at most 2 ** BIN_BITS rows, times 2
        heavy = [k for k, n in sums if n > most]
        found += [((0, k << shift, 0), (k,), n, len(tables) - 1) for k, n in sums if n <= most]
        if not heavy:
            break
        rows = rows.join(F.broadcast(spark.createDataFrame([(k,) for k in heavy], "k long")), at == F.col("k"), "left_semi")
        if not shift:
            break
        bits = max(1, BIN_BITS - (len(heavy) - 1).bit_length())
        shift = max(0, shift - bits)
    else:
        heavy = []
    alone = rows if heavy else rows.limit(0)
    alone = alone.union(sized.where("page_id is null"))
    tables.append((["page_id", "lead"], "k0 long, k1 int"))
    for k, lead, n in alone.groupBy("page_id", "lead").agg(F.sum("n")).collect():  # 4096 rows for each heavy id
        found.append(((int(k is None), k or 0, lead), (k, lead), n, len(tables) - 1))
    shard_of: list[list[tuple]] = [[] for _ in tables]
    done = 0
    for _, keys, n, table in sorted(found, key=lambda x: x[0]):
        shard_of[table].append((*keys, min(shards - 1, done * shards // max(1, total))))
        done += n
    return [(keys, spark.createDataFrame(own, f"{kinds}, s int")) for (keys, kinds), own in zip(tables, shard_of, strict=True) if own]


def _lead(digest: str) -> Column:
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def _with_shard(rows: DataFrame, ranges: list[tuple[list[str], DataFrame]]) -> DataFrame:
    out = rows.withColumns({"lead": _lead("digest"), "shard": F.lit(None).cast("int")})
    for keys, table in ranges:
        on = [F.expr(k).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(keys)]
        out = out.join(F.broadcast(table), on, "left").withColumn("shard", F.coalesce("shard", "s")).drop("s", *(f"k{i}" for i in range(len(keys))))
    return out.drop("lead")


def write_archive(
    pages: DataFrame,
    path: str,
    *,
    min_shards: int = 48,
    shard_bytes: int = 1 << 30,
    file_bytes: int = 1 << 30,
    min_revisit_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Writes (page_id, url, html) below ``path``, a folder that all executors share; returns the manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    sha = F.sha1(F.col("html").cast("binary"))
    system, root = fs.FileSystem.from_uri(path)
    if system.get_file_info(f"{root}/_manifest").type != fs.FileType.NotFound:
        raise FileExistsError(path)
    light = saved(rows.select("page_id", sha.alias("digest"), F.octet_length("html").cast("long").alias("size")), "warc-digests")
    total = light.agg(F.coalesce(F.sum(F.col("size") + 512), F.lit(0))).first()[0]
    shards = max(min_shards, -(-total // shard_bytes))
    ranges = _ranges(light, shards, total)
    big = light.where(F.col("size") >= min_revisit_bytes)
    first = big.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    revisits = big.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("original"))).select("page_id", "digest", "original").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    both = revisits.select("page_id", F.lit(0).alias("kind"), "digest", none("string").alias("url"), none("string").alias("html"), "original")
    both = both.unionByName(rows.select("page_id", F.lit(1).alias("kind"), sha.alias("digest"), "url", "html", none("long").alias("original")))
    both = _with_shard(both, ranges)
    both = both.repartition(shards, "shard").sortWithinPartitions("shard", F.asc_nulls_last("page_id"), "kind", "digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, original, last = _Roller(path, file_bytes, date), {}, None
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        manifest: list[tuple] = []
        for batch in batches:
            for page_id, kind, digest, url, html, refers_to, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    original[page_id, digest] = (refers_to,)
                    continue
                refers = original.get((page_id, digest))
                if refers is None:
                    if (page_id, digest) == last:
                        refers = (page_id,)
                    elif len(html.encode()) >= min_revisit_bytes:
                        last = (page_id, digest)
                record = _page_record(page_id, url, html.encode(), refers, date)
                manifest += roller.add(shard, page_id, record)
                if len(original) > 64:
                    original = {k: v for k, v in original.items() if k[0] == page_id}
        manifest += roller.close()
        if manifest:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*manifest, strict=True)), strict=True)))

    system.create_dir(f"{root}/_temporary", recursive=True)
    pending = saved(both.mapInArrow(write, MANIFEST), "warc-pending")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for r in batch.to_pylist():
                final, temp = f"{root}/{r['file']}", f"{root}/{r['temp']}"
                if system.get_file_info(temp).type != fs.FileType.NotFound:
                    system.move(temp, final)
                elif system.get_file_info(final).type == fs.FileType.NotFound:
                    raise FileNotFoundError(final)
            yield batch

    pending.mapInArrow(rename, MANIFEST).drop("temp").write.parquet(f"{path}/_manifest")
    system.delete_dir(f"{root}/_temporary")  # what failed attempts left
    return spark.read.parquet(f"{path}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unzip, parts = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            parts.append(unzip.decompress(data))
            data = unzip.unused_data
            if unzip.eof:
                yield b"".join(parts)
                unzip, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the file ends inside a record")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a record and its block; raises if the block isn't what its digest says."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if _digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, block


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The page records of the archive; ``payload`` adds the html of responses (null for revisits)."""
    files = spark.read.parquet(f"{path}/_manifest").select("file")
    n = max(1, min(10_000, files.count()))
    names = [x.split()[0] for x in RECORD.split(", ")] + ["html"] * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            rows: list[tuple] = []
            with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for member in _members(stream):
                    fields, block = parse_record(member)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    whole = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
                    if whole is not None and _digest(whole) != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
                    number = lambda k, f=fields: int(f[k]) if k in f else None
                    row = (number("X-Page-Id"), fields["WARC-Target-URI"], fields["WARC-Type"], number("X-Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), number("X-Refers-To-Page-Id"), name)
                    rows.append(row + ((None if whole is None else whole.decode(),) if payload else ()))
                    if len(rows) >= 256:
                        yield _batch(rows, names)
                        rows = []
            if rows:
                yield _batch(rows, names)

    return files.repartition(n, "file").mapInArrow(read, RECORD + (", html string" if payload else ""))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(k, pa.string())) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def roundtrip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to the shared folder and reads the archive back."""
    path = scratch(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
