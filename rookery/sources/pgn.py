"""PGN text as a Spark data source, and games as PGN text.

Plain files are read in byte ranges. A range begins with the first game start that follows some line of moves inside the
range, and each reader goes on past its end until it meets the start at which the next reader begins, so ranges need no
index and no two readers return one game. (A tag line after a blank line inside a comment is the one thing that misleads
this; ``splittable=false`` reads files whole.) Compressed files are read whole, and archives (.zip, .tar, .tar.gz, .tgz)
entry by entry, those that end in .pgn; their source_file is archive!entry. ``seq`` is the offset of a game.

A line or a game beyond the limits is an error; with ``mode=PERMISSIVE`` games that hold one are left out.
"""

from __future__ import annotations

import codecs
import itertools
import json
import re
import tarfile
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from rookery.sources import bz2_blocks

SCHEMA = "source_file string, seq long, headers array<struct<key:string,value:string>>, tags map<string,string>, movetext string"
PAIR = pa.struct([("key", pa.string()), ("value", pa.string())])
ARROW = pa.schema([("source_file", pa.string()), ("seq", pa.int64()), ("headers", pa.list_(PAIR)), ("tags", pa.map_(pa.string(), pa.string())), ("movetext", pa.string())])
TAG = re.compile(r"""\s*\[([^\s\]]+)\s+(?:"((?:\\.|[^"\\])*)"|'((?:\\.|[^'\\])*)'|([^\]"']*?))\s*\]\s*$""")
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*$")
PLAIN = re.compile(r'\[([A-Za-z][A-Za-z0-9_]*) "([^"\\]*)"\]\Z')  # what nearly all tags are like, and TAG takes alike
NESTING = re.compile(r"[{}();]")
#: Nearly all games: such tags, a blank line, lines that begin neither as tags nor as comments that hide a line. Then comes
#: a blank line and the next such tag, or the end.
_TAG, _MOVES = r'\[[A-Za-z][A-Za-z0-9_]* "[^"\\\r\n]*"\]\n', r"(?:[0-9A-Za-z*({.$][^\r\n]*\n)++"
USUAL = re.compile(rf"((?:{_TAG})++)\n({_MOVES})\n++(?={_TAG})".encode())
LAST = rf"((?:{_TAG})++)\n((?:[0-9A-Za-z*({{.$][^\r\n]*(?:\n|\Z))++)\n*\Z"
USUAL_END, USUAL_TEXT = re.compile(LAST.encode()), re.compile(LAST)
TAGS = re.compile(r'\[([A-Za-z0-9_]+) "([^"]*)"\]\n')
MAX_LINE, MAX_TEXT = 262_144, 10 << 20
#: Games of a batch, and bytes read at once.
BATCH, STEP = 1000, 1 << 20
#: Encodings in which bytes below 128 are ASCII, and lines can be told before they are decoded.
ASCII_LIKE = ("utf-8", "ascii", "iso8859-1", "cp1252")
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz")


def parse_tag(line: str, in_moves: bool) -> tuple[str, str] | None:
    if m := PLAIN.match(line):
        return m.groups()
    m = TAG.match(line) if line[:1] in "[" or line.lstrip()[:1] == "[" else None
    if not m or in_moves and (m[4] is not None or not NAME.match(m[1])):
        return None
    quoted = m[2] if m[2] is not None else m[3]
    return m[1], m[4].strip() if quoted is None else re.sub(r"\\([\\\"'])", r"\1", quoted)


def scan_nesting(line: str, brace: bool, depth: int) -> tuple[bool, int]:
    """Whether the line ends inside a comment, and in how many variations."""
    for c in NESTING.findall(line):
        if brace:
            brace = c != "}"
        elif c == "{":
            brace = True
        elif c == ";":
            break
        elif c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
    return brace, depth


def parse_games(lines: Iterable[tuple[int, str]], max_line: int = MAX_LINE, max_text: int = MAX_TEXT, permissive: bool = False) -> Iterator[tuple[int, list[tuple[str, str]], str]]:
    """(offset, headers, move text) from lines with their offsets. Of a repeated tag the last value stands at its first
    place. What breaks a limit is an error; where ``permissive``, its game is left out and its long lines are not kept."""
    start, headers, moves, brace, depth, size, broken = None, {}, [], False, 0, 0, False

    def done():
        while moves and not moves[-1].strip():
            moves.pop()
        return start, list(headers.values()), "\n".join(moves)

    for offset, line in lines:
        if len(line) > max_line:
            if not permissive:
                raise ValueError(f"a line of {len(line)} characters at {offset}")
            if start is None:
                start = offset
            broken, brace, depth = True, False, 0
            if not moves and line.lstrip().startswith("["):
                continue  # a tag: the game goes on with its next one
            line = "*"  # stands for moves, so that the next tag begins a game
        if line.startswith("%"):
            continue
        found = None if brace or depth else parse_tag(line, bool(moves))
        if found:
            if moves:
                if not broken:
                    yield done()
                start, headers, moves, size, broken = None, {}, [], 0, False
            if start is None:
                start = offset
            key = found[0].lower()
            headers[key] = (headers[key][0] if key in headers else found[0], found[1])
        elif line.strip() or moves:
            if start is None:
                start = offset
            brace, depth = scan_nesting(line, brace, depth)
            size += len(line) + 1
            if size > max_text:
                if not permissive:
                    raise ValueError(f"the moves of the game at {start} are too long")
                broken, moves = True, ["*"]
            if not broken:
                moves.append(line)
            elif not moves:
                moves = ["*"]
    if (headers or moves) and not broken:
        yield done()


def once_each(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Of a repeated tag the last value, at its first place."""
    if len({*"\n".join([name for name, _ in pairs]).lower().split("\n")}) == len(pairs):
        return pairs
    out = {}
    for name, value in pairs:
        key = name.lower()
        out[key] = (out[key][0] if key in out else name, value)
    return list(out.values())


def is_closed(moves: str) -> bool:
    """Whether no comment and no variation is open after some lines."""
    brace, depth = False, 0
    if NESTING.search(moves):
        for line in moves.split("\n"):
            brace, depth = scan_nesting(line, brace, depth)
    return not brace and not depth


def usual_game(text: str) -> tuple[int, list[tuple[str, str]], str] | None:
    """What ``parse_games`` finds in a text of one usual game; None for any other text."""
    m = USUAL_TEXT.match(text) if len(text) <= MAX_LINE else None
    return m and (0, once_each(TAGS.findall(m[1])), m[2].rstrip("\n"))


class Ahead:
    """A stream some bytes of which have been read already."""

    def __init__(self, data: bytes, stream):
        self.data, self.stream = data, stream

    def read(self, n: int) -> bytes:
        if not self.data:
            return self.stream.read(n)
        out, self.data = self.data[:n], self.data[n:]
        return out


def usual_games(stream, offset: int, end: int | None, encoding: str, most: int, headers_only: bool, rest: list) -> Iterator[tuple[int, list[tuple[str, str]], str]]:
    """The games of a range from ``offset``, where one begins, as long as they are usual; as ``range_lines`` and
    ``parse_games`` find them. Where one isn't, its place and a stream from there are put into ``rest``."""
    data, at, last, ripe = b"", 0, False, False
    while True:
        if end is not None and offset >= end and ripe:
            return
        m = USUAL.match(data, at)
        while m is None and not last and len(data) - at <= 2 * STEP:
            more = stream.read(STEP)
            data, at, last = data[at:] + more, 0, not more
            m = USUAL.match(data, at)
        if m is None and last:
            if at >= len(data):
                return
            m = USUAL_END.match(data, at)
        if m is None or m.end() - at > most or not is_closed(moves := m[2].decode(encoding, "replace")):
            rest.append((offset, Ahead(data[at:], stream)))
            return
        yield offset, once_each(TAGS.findall(m[1].decode(encoding, "replace"))), "" if headers_only else moves.rstrip("\n")
        ripe = end is not None and offset - at + m.start(2) + m[2].rstrip(b"\n").rfind(b"\n") + 1 >= end
        offset, at = offset + m.end() - at, m.end()


def batch_of(games: list[tuple[str, int, list[tuple[str, str]], str]], headers_only: bool = False) -> pa.RecordBatch:
    ends = pa.array([0, *itertools.accumulate(len(head) for _, _, head, _ in games)], pa.int32())
    pairs = [x for _, _, head, _ in games for x in head]
    names = [k for k, _ in pairs]
    keys, values = pa.array(names, pa.string()), pa.array([v for _, v in pairs], pa.string())
    lower = pa.array("\n".join(names).lower().split("\n") if names else [], pa.string())
    headers = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([keys, values], names=["key", "value"]))
    texts = pa.nulls(len(games), pa.string()) if headers_only else pa.array([g[3] for g in games], pa.string())
    own = [pa.array([g[0] for g in games], pa.string()), pa.array([g[1] for g in games], pa.int64())]
    return pa.RecordBatch.from_arrays([*own, headers, pa.MapArray.from_arrays(ends, lower, values), texts], schema=ARROW)


class Range:
    def __init__(self, path: str, start: int, end: int | None, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class Ranges(InputPartition):
    """Ranges that one task reads."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


#: What opening a file counts as, so that a task doesn't get too many small ones.
OPEN_BYTES = 1 << 16


def packed(ranges: list[Range], most: int) -> list[Ranges]:
    """Neighbouring ranges in tasks of at most ``most`` bytes, unless one range has more."""
    out, size = [], 0
    for r in ranges:
        own = r.size + OPEN_BYTES
        if not out or size + own > most:
            out.append([])
            size = 0
        out[-1].append(r)
        size += own
    return [Ranges(x) for x in out]


def _lines(stream, offset: int, encoding: str, most: int = MAX_LINE) -> Iterator[tuple[int, str]]:
    """Lines and their offsets. Of a line of more than ``most`` characters so much is kept that it shows."""
    rest, at, lost, bound = b"", offset, 0, 4 * most + 8
    ascii_like = codecs.lookup(encoding).name in ASCII_LIKE
    while True:
        data = stream.read(1 << 20)
        if ascii_like and data and not lost and data.isascii() and rest.isascii() and b"\r" not in data and b"\r" not in rest and len(rest) <= bound:
            *found, last = (rest + data).decode("ascii").split("\n")  # bytes and characters are alike
            for x in found:
                yield at, x
                at += len(x) + 1
            rest = last.encode()
            if len(rest) > bound:
                lost, rest = len(rest) - bound, rest[:bound]
            continue
        parts = (rest + data).split(b"\n")
        rest = b"" if not data else parts.pop()
        for k, x in enumerate(parts):
            if data or x or k < len(parts) - 1:
                yield at, x.removeprefix(b"\xef\xbb\xbf").rstrip(b"\r").decode(encoding, "replace")
            at, lost = at + lost + len(x) + 1, 0
        if not data:
            return
        if len(rest) > bound:
            lost, rest = lost + len(rest) - bound, rest[:bound]


def _entries(path: str, file) -> Iterator[tuple[str, object]]:
    """Names and streams of the PGN entries of an archive."""
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(file) as archive:
            for info in archive.infolist():
                if info.filename.lower().endswith(".pgn"):
                    yield info.filename, archive.open(info)
        return
    with tarfile.open(fileobj=file, mode="r:*") as archive:
        for info in archive:
            if info.isfile() and info.name.lower().endswith(".pgn"):
                yield info.name, archive.extractfile(info)


def range_lines(lines: Iterator[tuple[int, str]], start: int, end: int | None) -> Iterator[tuple[int, str]]:
    """The lines of the games that belong to a range."""
    begun, ripe, other, blank, said, last = start == 0, False, False, True, None, None
    for offset, line in lines:
        if begun and (end is None or offset < end):  # what was said last counts where the range ends
            yield offset, line
            last = line
            if line and not line.isspace():
                said = line
            continue
        if last is not None:
            other, blank, last = parse_tag(said, True) is None if said is not None else other, not last.strip(), None
        is_tag = parse_tag(line, True) is not None
        if is_tag and blank and other:  # a game starts here
            if end is not None and offset >= end and ripe:
                return
            begun = True
        if not is_tag and line.strip():
            other = True
            ripe = ripe or end is not None and offset >= end
        elif is_tag:
            other = False
        blank = not line.strip()
        if begun:
            yield offset, line


class PgnReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.encoding = options.get("encoding", "utf-8")
        self.headers_only = options.get("columns", "") == "headers"
        self.most = int(options.get("maxlinelength", MAX_LINE))
        self.limits = self.most, int(options.get("maxmovetext", MAX_TEXT))

    def files(self) -> list[tuple[str, int, bool]]:
        """Path, size, and whether it can be read by ranges, of each file that isn't empty."""
        split, out = self.options.get("splittable", "true") != "false", []
        for path in filter(None, self.options["path"].split("\n")):
            system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            info = system.get_file_info(root)
            found = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
            out += [(x.path, x.size, split and not x.path.lower().endswith((".gz", ".zst", *ARCHIVES))) for x in sorted(found, key=lambda x: x.path) if x.size]
        return out

    def ranges(self, path: str, size: int, start: int, end: int) -> list[Range]:
        """The part of a file from start to end in ranges; the last one of a file is open."""
        step = int(self.options.get("rangebytes", 64 << 20))
        cuts = [start, *range((start // step + 1) * step, end, step), end]
        return [Range(path, a, None if b >= size else b, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]

    def partitions(self) -> list[Ranges]:
        ranges = [r for path, size, split in self.files() for r in (self.ranges(path, size, 0, size) if split else [Range(path, 0, None, size)])]
        return packed(ranges, int(self.options.get("rangebytes", 64 << 20)))

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        for own in part.ranges if part is not None else ():  # Spark asks for one part where there is none
            yield from self._range(own)

    def _range(self, part: Range) -> Iterator[pa.RecordBatch]:
        path = self.options["path"].split("\n")[0]
        system = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
        if part.path.lower().endswith(ARCHIVES):
            with system.open_input_file(part.path) as file:
                for name, stream in _entries(part.path, file):
                    yield from self._batches(f"{part.path}!{name}", _lines(stream, 0, self.encoding, self.most))
            return
        if part.path.lower().endswith(".bz2") and self.options.get("splittable", "true") != "false":
            with system.open_input_file(part.path) as stream:
                found = bz2_blocks.lines(stream, part.start, self.encoding, self.most, part.path)
                yield from self._batches(part.path, range_lines(found, part.start, None if part.end is None else part.end << bz2_blocks.PLACE_BITS))
            return
        if part.start:
            stream = system.open_input_file(part.path)
            stream.seek(part.start - 1)
            skipped = 0
            while data := stream.read(1 << 16):
                if (at := data.find(b"\n")) >= 0:
                    skipped += at
                    break
                skipped += len(data)
            offset = part.start + skipped
            stream.seek(offset)
        else:
            stream, offset = system.open_input_stream(part.path, compression="detect"), 0
        yield from self._batched(part.path, self._found(stream, offset, part))

    def _found(self, stream, offset: int, part: Range) -> Iterator[tuple[int, list[tuple[str, str]], str]]:
        """The games of a range: usual ones at once, from the first other one on line by line."""
        if codecs.lookup(self.encoding).name not in ASCII_LIKE:
            yield from self._parsed(range_lines(_lines(stream, offset, self.encoding, self.most), part.start, part.end))
            return
        if part.start:
            first = next(range_lines(_lines(stream, offset, self.encoding, self.most), part.start, part.end), None)
            if first is None:
                return
            offset = first[0]
            stream.seek(offset)
        rest: list = []
        yield from usual_games(stream, offset, part.end, self.encoding, min(self.limits), self.headers_only, rest)
        for at, stream in rest:
            yield from self._parsed(range_lines(_lines(stream, at, self.encoding, self.most), 0, part.end))

    def _parsed(self, lines: Iterator[tuple[int, str]]) -> Iterator[tuple[int, list[tuple[str, str]], str]]:
        return parse_games(lines, *self.limits, self.options.get("mode", "FAILFAST").upper() == "PERMISSIVE")

    def _batches(self, name: str, lines: Iterator[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        return self._batched(name, self._parsed(lines))

    def _batched(self, name: str, found: Iterator[tuple[int, list[tuple[str, str]], str]]) -> Iterator[pa.RecordBatch]:
        games = []
        for at, head, text in found:
            games.append((name, at, head, text))
            if len(games) >= BATCH:
                yield batch_of(games, self.headers_only)
                games = []
        if games:
            yield batch_of(games, self.headers_only)


class PgnStream(DataSourceStreamReader):
    """Files as they land, complete, in a folder. An offset says of each file how many bytes are taken, -1 for all. With
    ``bytesPerBatch`` a batch ends inside a file that is larger, at a range's end, and the next one goes on from there,
    also after a restart: what has been planned last is noted below ``progress``, since Spark asks for the next offset
    without telling the last. Files that have left the folder leave the offset."""

    def __init__(self, options: dict):
        self.batch = PgnReader(options)
        self.most, self.progress = int(options.get("bytesperbatch", 0)), options.get("progress")
        if self.most and not self.progress:
            raise ValueError("bytesPerBatch needs a folder for progress")

    def initialOffset(self) -> dict:
        return {}

    def _planned(self) -> dict:
        if not self.progress:
            return {}
        system, root = fs.FileSystem.from_uri(self.progress) if "://" in self.progress else (fs.LocalFileSystem(), self.progress)
        if system.get_file_info(f"{root}/planned.json").type == fs.FileType.NotFound:
            return {}
        with system.open_input_stream(f"{root}/planned.json", compression=None) as f:
            return json.loads(f.read())

    def latestOffset(self) -> dict:
        done, out, left = self._planned(), {}, self.most
        step = int(self.batch.options.get("rangebytes", 64 << 20))
        for path, size, split in self.batch.files():
            taken = done.get(path, 0)
            if taken >= 0 and (left > 0 or not self.most):
                room = -(-max(left, 1) // step) * step
                end = size if not self.most or not split else min(size, (taken // step) * step + room)
                left -= end - taken
                taken = -1 if end >= size else end
            if taken:
                out[path] = taken
        return out

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        sizes, out = {path: (size, split) for path, size, split in self.batch.files()}, []
        for path, to in sorted(end.items()):
            if start.get(path, 0) < 0 or start.get(path, 0) == to:
                continue
            size, split = sizes[path]
            out += self.batch.ranges(path, size, start.get(path, 0), size if to < 0 else to) if split else [Range(path, 0, None, size)]
        if self.progress:
            system, root = fs.FileSystem.from_uri(self.progress) if "://" in self.progress else (fs.LocalFileSystem(), self.progress)
            system.create_dir(root, recursive=True)
            with system.open_output_stream(f"{root}/planned.new", compression=None) as f:
                f.write(json.dumps(end).encode())
            if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(f"{root}/planned.json").type == fs.FileType.File:
                system.delete_file(f"{root}/planned.json")
            system.move(f"{root}/planned.new", f"{root}/planned.json")
        return packed(out, int(self.batch.options.get("rangebytes", 64 << 20)))

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        return self.batch.read(part)


class PgnSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgn"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PgnReader:
        return PgnReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> PgnStream:
        return PgnStream({k.lower(): v for k, v in self.options.items()})


def read_pgn(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """Games of PGN files or folders. Paths that differ in case only are one."""
    paths = [paths] if isinstance(paths, str) else list({p.lower(): p for p in reversed(paths)}.values())[::-1]
    spark.dataSource.register(PgnSource)
    return spark.read.format("pgn").options(path="\n".join(paths), **options).load()


def text_lines(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.split("\n"):
        yield at, line.rstrip("\r")
        at += len(line) + 1


def games_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Games of batches of texts, in batches of many texts' games, since a batch for each costs more than its games."""
    games = []
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            usual = usual_game(text or "")
            for game in (usual,) if usual else parse_games(text_lines(text or "")):
                games.append((name, *game))
                if len(games) >= BATCH:
                    yield batch_of(games)
                    games = []
    if games:
        yield batch_of(games)


def parse_texts(texts: DataFrame) -> DataFrame:
    """Games of whole PGN texts (source_file, value), batch or streaming."""
    return texts.select("source_file", "value").mapInArrow(games_of, SCHEMA)


def wrap_moves(text: str, width: int = 80) -> str:
    """Lines of at most ``width`` characters; lines with a ; comment stay as they are."""
    if len(text) <= width and "\n" not in text:
        return text
    whole = re.compile(rf"(?! )(?:.{{1,{width}}}|[^ ]+)(?= |$)")  # as many words as fit, or a longer word
    out = []
    for line in text.split("\n"):
        if ";" in line or len(line) <= width:
            out.append(line)
        else:
            out += whole.findall(" ".join(line.split())) or [""]
    return "\n".join(out)


def texts_of(headers: pa.Array, moves: pa.Array) -> pa.Array:
    """Games as PGN: headers in their order, a blank line, wrapped moves. A header without a key is left out."""
    flat, lengths = headers.flatten(), headers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    key, value = flat.field("key"), flat.field("value").fill_null("")
    ends = np.concatenate([[0], np.cumsum(lengths)])
    if key.null_count:
        there = key.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(there)])[ends]
        key, value = key.filter(pa.array(there)), value.filter(pa.array(there))
    escaped = pc.replace_substring_regex(value, r'([\\"])', r"\\\1")
    lines = pc.binary_join_element_wise("[", key, ' "', escaped, '"]', "")
    head = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines), "\n")
    wrapped = pa.array([wrap_moves(t or "") for t in moves.to_pylist()], pa.string())
    out = pc.binary_join_element_wise(head, wrapped, "\n\n")
    return pc.if_else(headers.is_valid(), out, pa.scalar(None, pa.string())) if headers.null_count else out


def pgn_text() -> Column:
    """A game as PGN, from its headers and moves."""
    return F.arrow_udf(texts_of, "string")(F.col("headers"), F.col("movetext"))


def write_pgn(games: DataFrame, path: str, bucket: str | None = None) -> None:
    """Writes games as text, in input order inside each file; with ``bucket`` one folder per value."""
    rows = games.withColumn("_text", pgn_text())
    if bucket:
        rows = rows.repartition(bucket).sortWithinPartitions(bucket, "source_file", "seq").select("_text", bucket)
        rows.withColumnRenamed("_text", "value").write.partitionBy(bucket).option("lineSep", "\n\n").text(path)
    else:
        rows.sortWithinPartitions("source_file", "seq").select(F.col("_text").alias("value")).write.option("lineSep", "\n\n").text(path)
