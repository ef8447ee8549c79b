"""Compressed PGN files read in several tasks against the same files read whole."""

import bz2
import random

import pytest

from rookery.sources import bz2_blocks
from rookery.sources.pgn import read_pgn


def games(n, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        moves = " ".join(f"{i}. {rng.choice('abcdefgh')}{rng.randrange(3, 7)} N{rng.choice('abcdefgh')}{rng.randrange(3, 7)} {{{rng.random()}}}" for i in range(1, rng.randrange(2, 60)))
        out.append(f'[Event "Game {k}"]\n[Site "{"é" * rng.randrange(4)}"]\n\n{moves} *\n\n')
    return "".join(out).encode()


def rows(df):
    return [(r.tags["event"] if isinstance(r.tags, dict) else dict(r.tags)["event"], r.movetext) for r in df.orderBy("source_file", "seq").collect()]


@pytest.mark.parametrize("streams", [1, 7])
def test_ranges_of_a_bzip2_file_equal_the_whole(spark, tmp_path, streams):
    text = games(2500)
    step = len(text) // streams + 1  # streams are cut anywhere, also inside lines
    (tmp_path / "a.pgn.bz2").write_bytes(b"".join(bz2.compress(text[i : i + step], 1) for i in range(0, len(text), step)))
    (tmp_path / "plain.pgn").write_bytes(text)
    path = f"{tmp_path}/a.pgn.bz2"
    whole = rows(read_pgn(spark, f"{tmp_path}/plain.pgn"))
    assert len(whole) == 2500 and rows(read_pgn(spark, path, splittable="false")) == whole
    for size in ("1000000000", "300000", "77777"):
        df = read_pgn(spark, path, rangeBytes=size)
        assert size == "1000000000" or df.rdd.getNumPartitions() > 1
        assert rows(df) == whole


def test_places_do_not_depend_on_the_ranges(spark, tmp_path):
    (tmp_path / "a.pgn.bz2").write_bytes(bz2.compress(games(1500), 1))
    seqs = [sorted(r.seq for r in read_pgn(spark, f"{tmp_path}/a.pgn.bz2", rangeBytes=size).select("seq").collect()) for size in ("1000000000", "100000")]
    assert seqs[0] == seqs[1] and len(set(seqs[0])) == 1500


def test_blocks_at_any_bit_and_from_any_byte(tmp_path):
    rng = random.Random(1)
    text = bytes(rng.randrange(256) for _ in range(450_000)) + b"a" * 3_000_000 + b"\n"
    (tmp_path / "x.bz2").write_bytes(bz2.compress(text, 1) + bz2.compress(b"") + bz2.compress(b"end\n", 9))
    with open(tmp_path / "x.bz2", "rb") as f:
        found = list(bz2_blocks.blocks(f, 0))
        assert b"".join(x for _, x in found) == text + b"end\n" and len(found) > 5
        for start in (1, found[2][0], found[2][0] + 1, found[-1][0]):
            assert list(bz2_blocks.blocks(f, start)) == [x for x in found if x[0] >= start]


def test_damaged_files_are_errors(tmp_path):
    data = bytearray(bz2.compress(games(800), 1))
    for name, bad in (("cut", bytes(data[: len(data) // 2])), ("flipped", bytes(data[:5000]) + b"\x00\xff" + bytes(data[5002:])), ("other", b"[Event]")):
        (tmp_path / name).write_bytes(bad)
        with open(tmp_path / name, "rb") as f, pytest.raises(ValueError):
            list(bz2_blocks.blocks(f, 0))
    (tmp_path / "none").write_bytes(bz2.compress(b""))
    with open(tmp_path / "none", "rb") as f:
        assert list(bz2_blocks.lines(f, 0, "utf-8", 100)) == []
