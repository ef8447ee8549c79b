"""PGN files under names of their own: one per event, date, chunk or tournament, or one for a whole collection.

Games are dealt by range of (file, order), so a file with many games is spread over tasks like many files are. A task writes
what it has of a file as one part under a staged name; what counts is what successful tasks return, so attempts that were
lost leave nothing but unnamed parts. Offsets of parts inside their file are a prefix sum over their sizes. A file of one
part is finished by a rename. Files of several parts are put together first: where the file system takes writes at a
position (local or mounted folders), all tasks copy their parts to their offsets at once, and a part that is in its place
is cut to nothing, so that the text lies on disk once; elsewhere one task per file streams the parts in order. Neither
holds more than ``COPY`` bytes.

All files appear when the job commits. The list of renames is written before the first one, and ``recover`` finishes what a
driver that was lost had begun. A job that fails leaves the folder as it was.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.tables import saved
from .pgn import texts_of

COPY = 8 << 20
STAGING, PENDING = "_staged-", "_pending-"
PARTS = "key string, name string, part int, staged string, first string, last string, games long, bytes long"
NAMES = [x.split()[0] for x in PARTS.split(", ")]


def folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def write_parts(rows: DataFrame, path: str, staging: str) -> DataFrame:
    """Writes sorted rows (key, name, section, headers, movetext) as parts; returns a row per part. Between games lies a blank line, two
    where the section changes; what goes before a part is left to who puts parts together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = folder(path)
        number, at, out = TaskContext.get().partitionId(), None, None
        done: list[tuple] = []

        def close() -> None:
            if out is not None:
                out.close()
                done.append((*at, number, staged, first, last, games, size))

        try:
            for batch in batches:
                keys, names, sections = (batch.column(k) for k in range(3))
                texts = texts_of(batch.column(3), batch.column(4)).to_pylist()
                starts = [0, *(pc.indices_nonzero(pc.or_(pc.not_equal(keys[1:], keys[:-1]), pc.not_equal(sections[1:], sections[:-1]))).to_numpy() + 1).tolist()] if len(texts) else []
                for start, end in zip(starts, [*starts[1:], len(texts)], strict=True):  # games of one file and section
                    key, section = keys[start].as_py(), sections[start].as_py()
                    if at is None or key != at[0]:
                        close()
                        name = names[start].as_py()
                        if "/" in name or name.startswith(("_", ".")) or not name:
                            raise ValueError(f"no name for a file: {name!r}")
                        at, staged, first, games, size = (key, name), uuid.uuid4().hex, section, 0, 0
                        out = system.open_output_stream(f"{root}/{staging}/{staged}", compression=None)
                        gap = ""
                    else:
                        gap = "\n" if section == last else "\n\n"
                    data = f"{gap}{'\n\n'.join(texts[start:end])}\n".encode()
                    out.write(data)
                    last, games, size = section, games + end - start, size + len(data)
            close()
        finally:
            if out is not None and not out.closed:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [[]] * 8, KINDS, strict=True)], names=NAMES)

    return rows.mapInArrow(run, PARTS)


KINDS = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def placed(parts: DataFrame) -> DataFrame:
    """Parts with what goes before them (``gap``, new lines), their offset, the number of parts and the name of the file:
    names that differ in case only are one file, called as its first game says."""
    own = Window.partitionBy("key").orderBy("part")
    before, whole = own.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key")
    previous = F.lag("last").over(own)
    gaps = parts.withColumn("gap", F.when(F.row_number().over(own) == 1, 0).when(F.col("first").eqNullSafe(previous), 1).otherwise(2))
    size = F.col("bytes") + F.col("gap")
    return gaps.withColumns({"offset": F.coalesce(F.sum(size).over(before), F.lit(0)), "parts": F.count("*").over(whole), "name": F.first("name").over(own)})


def named_parts(placed_parts: DataFrame) -> DataFrame:
    return placed_parts.select("key", "name", "part", "staged", "gap", "offset", "parts", "bytes")


@dataclass
class Renames(WriterCommitMessage):
    moves: dict[str, str]


class FilesWriter(DataSourceArrowWriter):
    """Finishes files of parts; its commit names them."""

    def __init__(self, options: dict):
        self.path, self.staging, self.job = options["path"], options["staging"], options["job"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Renames:
        system, root = folder(self.path)
        at, moves = f"{root}/{self.staging}", {}
        attempt, key, out = uuid.uuid4().hex, None, None
        for batch in iterator:
            for row in batch.to_pylist():
                staged = row["staged"]
                if row["parts"] > 1 and isinstance(system, fs.LocalFileSystem):
                    staged = f"whole-{uuid.uuid5(uuid.NAMESPACE_URL, row['key']).hex}"  # all its tasks write to one
                    self._place(f"{at}/{row['staged']}", f"{at}/{staged}", row)
                elif row["parts"] > 1:
                    if row["key"] != key:
                        if out is not None:
                            out.close()
                        key, whole = row["key"], f"{attempt}-{len(moves)}"
                        out = system.open_output_stream(f"{at}/{whole}", compression=None)
                    out.write(b"\n" * row["gap"])
                    with system.open_input_stream(f"{at}/{staged}", compression=None) as source:
                        while data := source.read(COPY):
                            out.write(data)
                    staged = whole
                moves[staged] = row["name"]
        if out is not None:
            out.close()
        return Renames(moves)

    def _place(self, part: str, whole: str, row: dict) -> None:
        target = os.open(whole, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            begin = row["offset"] + os.pwrite(target, b"\n" * row["gap"], row["offset"])
            at = begin
            with open(part, "rb") as source:
                while data := source.read(COPY):
                    while data:
                        n = os.pwrite(target, data, at)
                        at, data = at + n, data[n:]
            if at - begin != row["bytes"] and os.path.getsize(part):  # an empty one was put in its place by another attempt
                raise OSError(f"a part of {row['name']} has {at - begin} bytes, not {row['bytes']}")
            os.truncate(part, 0)
        finally:
            os.close(target)

    def commit(self, messages: list[Renames | None]) -> None:
        system, root = folder(self.path)
        moves = {s: n for m in messages if m is not None for s, n in m.moves.items()}
        with system.open_output_stream(f"{root}/{self.staging}/moves", compression=None) as out:
            out.write(json.dumps({"staging": self.staging, "moves": moves}).encode())
        system.move(f"{root}/{self.staging}/moves", f"{root}/{PENDING}{self.job}")  # from here on the job has taken place
        finish(system, root, f"{PENDING}{self.job}")

    def abort(self, messages: list[Renames | None]) -> None:
        system, root = folder(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


def finish(system: fs.FileSystem, root: str, pending: str) -> None:
    """Carries out a list of renames; what has been renamed already is left."""
    with system.open_input_stream(f"{root}/{pending}", compression=None) as source:
        job = json.loads(source.read())
    for staged, name in job["moves"].items():
        if system.get_file_info(f"{root}/{job['staging']}/{staged}").type == fs.FileType.NotFound:
            continue
        if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(f"{root}/{name}").type == fs.FileType.File:
            system.delete_file(f"{root}/{name}")
        system.move(f"{root}/{job['staging']}/{staged}", f"{root}/{name}")
    if system.get_file_info(f"{root}/{job['staging']}").type == fs.FileType.Directory:
        system.delete_dir(f"{root}/{job['staging']}")
    system.delete_file(f"{root}/{pending}")


def recover(path: str) -> int:
    """Finishes jobs whose driver was lost while it renamed; returns their number. Call it when no job is writing."""
    system, root = folder(path)
    found = [x.base_name for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith(PENDING)]
    for pending in found:
        finish(system, root, pending)
    return len(found)


class PgnFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgn_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(dict(self.options))


def write_files(games: DataFrame, path: str, name: Column | str, *, order: tuple[str, ...] = ("source_file", "seq"), section: Column | None = None, partitions: int | None = None) -> tuple[int, int]:
    """Writes each game to the file that ``name`` says, in the given order; returns the numbers of games and files.

    ``name`` may not be null, hold a slash, or begin with _ or a dot. ``partitions``: tasks over which the text is dealt.
    Files of these names that were there are replaced, others stay. No games write no files."""
    spark: SparkSession = games.sparkSession
    spark.dataSource.register(PgnFiles)
    job = uuid.uuid4().hex
    staging = f"{STAGING}{job}"
    label = F.col(name) if isinstance(name, str) else name
    rows = games.select(label.alias("_name"), (F.lit("") if section is None else F.coalesce(section.cast("string"), F.lit(""))).alias("_section"), *order, "headers", "movetext")
    rows = saved(rows.withColumn("_key", F.upper("_name")), "named")  # ranges are sampled from the written names
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "_key", *order).sortWithinPartitions("_key", *order)
    system, root = folder(path)
    system.create_dir(f"{root}/{staging}", recursive=True)
    try:
        parts = saved(write_parts(dealt.select(F.coalesce("_key", F.lit("")).alias("key"), F.coalesce("_name", F.lit("")).alias("name"), "_section", "headers", "movetext"), path, staging), "parts")
        total = parts.agg(F.coalesce(F.sum("games"), F.lit(0)), F.countDistinct("key")).first()
        ready = placed(parts)
        # a file's parts are placed by key in one task, and go from there to all or, to be streamed, to one
        ready = ready.repartition(n, "staged") if isinstance(system, fs.LocalFileSystem) else ready.repartition("key").sortWithinPartitions("key", "part")
        named_parts(ready).write.format("pgn_files").mode("append").options(path=path, staging=staging, job=job).save()
    except Exception:
        FilesWriter({"path": path, "staging": staging, "job": job}).abort([])
        raise
    return total[0], total[1]


def write_split(games: DataFrame, path: str, bucket: str = "bucket", **options) -> tuple[int, int]:
    """A file per bucket of a split."""
    return write_files(games, path, F.concat(F.col(bucket), F.lit(".pgn")), **options)


def write_joined(games: DataFrame, path: str, name: str, *, order: tuple[str, ...] = ("file_rank", "source_file", "seq"), section: str = "file_rank", **options) -> int:
    """One file of all games in order, such as those of ``merge``; two blank lines between sections."""
    return write_files(games, path, F.lit(name), order=order, section=F.col(section), **options)[0]
