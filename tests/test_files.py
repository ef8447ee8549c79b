"""PGN files with names of their own: one per event or tournament, joined files, failed and lost jobs."""

import json
import os
import random
import re

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from rookery.operators import collections as co
from rookery.operators import tables, tournaments
from rookery.plans import queries
from rookery.sources import pgn, pgn_files


def make(spark, games):
    rows = [(f, k, [*head.items()], {a.lower(): b for a, b in head.items()}, text) for k, (f, head, text) in enumerate(games)]
    return spark.createDataFrame(rows, pgn.SCHEMA)


def ids(path):
    return [line.split('"')[1] for line in open(path, encoding="utf-8").read().split("\n") if line.startswith("[Id ")]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_a_file_per_event(spark, tmp_path, partitions):
    events = ["Alpha Open", "alpha open", "Beta Open", "C/d: é?", None, " "]
    games = [("f", {"Id": str(k)} | ({"Event": e} if (e := events[k % 6 if k % 4 else 0]) is not None else {}), f"1. e4 {{{k}}} *") for k in range(600)]
    (tmp_path / "Beta Open.pgn").write_text("old")
    (tmp_path / "other.txt").write_text("stays")
    out = pgn_files.write_split(co.split_by_header(make(spark, games), "Event"), f"file://{tmp_path}", partitions=partitions)
    assert out == (600, 4) and sorted(os.listdir(tmp_path)) == ["Alpha Open.pgn", "Beta Open.pgn", "C_d_ é_.pgn", "Unknown.pgn", "other.txt"]
    of = lambda *names: [g[1]["Id"] for g in games if g[1].get("Event", "").strip().upper() in names]
    assert ids(tmp_path / "Alpha Open.pgn") == of("ALPHA OPEN") and ids(tmp_path / "Unknown.pgn") == of("")
    text = (tmp_path / "Beta Open.pgn").read_text()
    assert text.count("\n\n[") == len(of("BETA OPEN")) - 1 and "\n\n\n" not in text and text.endswith("*\n")


@pytest.mark.parametrize("positions", [True, False])
def test_joined_in_the_order_of_the_inputs(spark, tmp_path, positions, monkeypatch):
    """Also where a file system takes no writes at a position."""
    part = lambda a, b: make(spark, [("f", {"Id": str(k)}, "*") for k in range(a, b)])
    if not positions:
        part_of = pgn_files.FilesWriter.write

        def streamed(self, iterator):
            import pyarrow.fs as own

            from rookery.sources import pgn_files as module

            module.folder = lambda path: (own.SubTreeFileSystem("/", own.LocalFileSystem()), path.removeprefix("file://").lstrip("/"))
            return part_of(self, iterator)

        monkeypatch.setattr(pgn_files.FilesWriter, "write", streamed)
        real = pgn_files.folder
        monkeypatch.setattr(pgn_files, "folder", lambda path: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), real(path)[1].lstrip("/")))
    n = pgn_files.write_joined(co.merge([part(100, 200), part(0, 100), part(200, 201)]), f"file://{tmp_path}/out", "all.pgn", partitions=7)
    assert n == 201 and os.listdir(tmp_path / "out") == ["all.pgn"]
    assert ids(tmp_path / "out/all.pgn") == [str(k) for k in (*range(100, 200), *range(100), 200)]
    assert (tmp_path / "out/all.pgn").read_text().count("\n\n\n") == 2


def test_a_failed_task_leaves_the_folder_as_it_was(spark, tmp_path):
    (tmp_path / "a.pgn").write_text("old")
    games = make(spark, [("f", {"Event": "a"}, "*")] * 50)
    broken = F.when(F.col("seq") < 40, F.lit("a.pgn")).otherwise(F.lit("../b.pgn"))
    with pytest.raises(Exception, match="no name for a file"):
        pgn_files.write_files(games, f"file://{tmp_path}", broken)
    assert os.listdir(tmp_path) == ["a.pgn"] and (tmp_path / "a.pgn").read_text() == "old"


def test_a_lost_commit_is_finished(spark, tmp_path):
    staged = tmp_path / f"{pgn_files.STAGING}x"
    staged.mkdir()
    (staged / "1").write_text("one")
    (tmp_path / "b.pgn").write_text("two")  # renamed before the driver was lost
    (tmp_path / f"{pgn_files.PENDING}x").write_text(json.dumps({"staging": staged.name, "moves": {"1": "a.pgn", "2": "b.pgn"}}))
    assert pgn_files.recover(f"file://{tmp_path}") == 1 and pgn_files.recover(f"file://{tmp_path}") == 0
    assert sorted(os.listdir(tmp_path)) == ["a.pgn", "b.pgn"] and (tmp_path / "a.pgn").read_text() == "one"


def test_parts_of_lost_attempts_are_not_read(spark, tmp_path):
    games = make(spark, [("f", {"Event": "a", "Id": str(k)}, "*") for k in range(30)])
    staging = tmp_path / "_staged-old"
    staging.mkdir()
    (staging / "part").write_text("nothing names this")
    assert pgn_files.write_files(games, f"file://{tmp_path}", F.lit("a.pgn"), partitions=4) == (30, 1)
    assert ids(tmp_path / "a.pgn") == [str(k) for k in range(30)] and staging.is_dir()


def test_no_games_no_files(spark, tmp_path):
    assert pgn_files.write_files(make(spark, [("f", {}, "*")]).limit(0), f"file://{tmp_path}/x", F.lit("a.pgn")) == (0, 0)
    assert not [x for x in os.listdir(tmp_path / "x")] if (tmp_path / "x").exists() else True


def test_tournaments_as_files(spark, tmp_path):
    pair = lambda e, w, b, r: ("f", {"Event": e, "Site": "Rome", "Date": "2024.01.02", "Round": str(r), "White": w, "Black": b, "WhiteElo": "2500", "BlackElo": "2450", "Result": "1-0"}, "1. e4 *")
    games = [pair("Alpha Open", w, b, r) for r in range(3) for w, b in (("Ann", "Bob"), ("Cid", "Dee"))] + [pair("Small", "Ann", "Bob", 1)]
    assert tournaments.write_tournaments(make(spark, games), f"file://{tmp_path}", 2400, 3) == 1
    (name,) = os.listdir(tmp_path)
    assert name.startswith("2450-2500-alpha-open-rome-2024-") and (tmp_path / name).read_text().count("[Event ") == 6


def test_months_of_landed_payloads(spark, tmp_path):
    from rookery.sources import landed_json

    (tmp_path / "in").mkdir()
    game = lambda k: {"pgn": f'[Event "E"]\n[Id "{k}"]\n\n1. e4 *\n', "white": {"username": "a", "rating": 1}}
    for name, ids_ in {"ann-2024-01.json": [3, 1, 2], "ann-2024-02.json": [5, 4], "bob-2024-01.json": []}.items():
        (tmp_path / "in" / name).write_text(json.dumps({"games": [game(k) for k in ids_] + [{"pgn": None}, {"pgn": "  "}]}))
    payload = landed_json.read_month(spark, f"{tmp_path}/in")
    name = lambda f: F.regexp_replace(F.element_at(F.split(f, "/"), -1), r"\.json$", ".pgn")
    assert landed_json.write_months(payload, f"{tmp_path}/out", name) == (5, 2)
    assert sorted(os.listdir(tmp_path / "out")) == ["ann-2024-01.pgn", "ann-2024-02.pgn"]
    assert ids(tmp_path / "out/ann-2024-01.pgn") == ["3", "1", "2"] and ids(tmp_path / "out/ann-2024-02.pgn") == ["5", "4"]


def test_texts_share_batches():
    """a batch holds the games of many texts, as many as ``BATCH``; each game keeps its text's name."""
    texts = pa.RecordBatch.from_pydict({"source_file": [f"f{k}" for k in range(2500)], "value": [f'[Id "{k}"]\r\n\r\n1. e4 *\r\n' if k % 5 else None for k in range(2500)]})
    out = list(pgn.games_of(iter([texts.slice(0, 7), texts.slice(7)])))
    assert [len(b) for b in out] == [1000, 1000]
    assert [(f, head[0]["value"], text) for b in out for f, head, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 4)), strict=True)] == [(f"f{k}", str(k), "1. e4 *") for k in range(2500) if k % 5]


def test_plain_lines_are_read_as_any():
    """what the short ways take, the long ways take alike."""
    rng = random.Random(2)
    pieces = ["[", "]", '"', "'", "\\", "A", "a1", " ", "\t", "1", "{", "}", "(", ")", ";", "é", "x" * 30, "_"]
    for k in range(20000):
        name, value = ("".join(rng.choice(pieces) for _ in range(rng.randrange(4))) for _ in range(2))
        line = rng.choice([f'[{name} "{value}"]', f"{name}{value}", f' [{name} "{value}"] '])
        m = pgn.TAG.match(line)
        quoted = m and (m[2] if m[2] is not None else m[3])
        want = None if not m or k % 2 and (m[4] is not None or not pgn.NAME.match(m[1])) else (m[1], m[4].strip() if quoted is None else re.sub(r"\\([\\\"'])", r"\1", quoted))
        assert pgn.parse_tag(line, bool(k % 2)) == want, line
        now, out = "", []
        for word in (line + " " + name * 5 + "\u2028" + value * 9).split():
            if now and len(now) + 1 + len(word) > 40:
                out.append(now)
                now = word
            else:
                now = f"{now} {word}" if now else word
        text = line + " " + name * 5 + "\u2028" + value * 9
        assert pgn.wrap_moves(text, 40) == ("\n".join([*out, now]) if len(text) > 40 and ";" not in text else text)


def test_a_part_in_its_place_takes_no_disk(tmp_path):
    """of a file of several parts the text lies on disk once; a second attempt and a damaged part are told apart."""
    (tmp_path / "s").mkdir()
    texts = ["one\n", "two\n", "three\n"]
    for k, text in enumerate(texts):
        (tmp_path / "s" / f"p{k}").write_text(text)
    ends = [0, 5, 10]
    row = lambda k: {"key": "A", "name": "a.pgn", "part": k, "staged": f"p{k}", "gap": int(k > 0), "offset": ends[k] - (k > 0), "parts": 3, "bytes": len(texts[k])}
    writer = pgn_files.FilesWriter({"path": str(tmp_path), "staging": "s", "job": "j"})
    batches = [pa.RecordBatch.from_pylist([row(k)]) for k in (2, 0, 1)]
    (moves,) = {tuple(writer.write(iter([b])).moves) for b in batches}
    assert [(tmp_path / "s" / f"p{k}").stat().st_size for k in range(3)] == [0, 0, 0]
    assert (tmp_path / "s" / moves[0]).read_text() == "one\n\ntwo\n\nthree\n"
    writer.write(iter(batches))
    assert (tmp_path / "s" / moves[0]).read_text() == "one\n\ntwo\n\nthree\n"
    (tmp_path / "s" / "p1").write_text("tw")
    with pytest.raises(OSError, match="has 2 bytes, not 4"):
        writer.write(iter(batches))


def test_saved_tables_leave_no_shuffles(spark):
    """what was shuffled for a table is gone when it is written."""
    files = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())
    count = lambda: sum(x.getName().startswith("shuffle_") for x in files())
    before, set_to = count(), spark.conf.get(tables.CLEANUP)
    out = tables.saved(spark.range(1000).repartition(5, "id"), "shuffled")
    assert count() <= before and out.count() == 1000 and spark.conf.get(tables.CLEANUP) == set_to


def test_files_are_read_back_once(spark, tmp_path, monkeypatch):
    """games are numbered by a sort, which reads its rows twice; the files themselves are parsed once."""
    (tmp_path / "a.pgn").write_text('[GameId "7"]\n\n*\n\n[GameId "3"]\n\n*\n')
    seen, real = [], queries.co.global_index
    monkeypatch.setattr(queries.co, "global_index", lambda df, *a: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *a))
    assert sorted(map(tuple, queries._read_back(spark, str(tmp_path)).collect())) == [("a.pgn", 1, 7), ("a.pgn", 2, 3)]
    assert len(seen) == 1 and "parquet" in seen[0] and "BatchScan" not in seen[0]


def test_usual_games_are_found_at_once(tmp_path, monkeypatch):
    """games of the usual kind take no pass over their lines; from one that isn't on, all are read line by line."""
    rng, calls, real = random.Random(6), [], pgn.parse_games
    monkeypatch.setattr(pgn, "parse_games", lambda *a: calls.append(1) or real(*a))
    usual = [f'[Event "é {k}"]\n[A_1 "[x"]\n[event "b"]\n\n1. e4 {{a; }} (1. d4)\ne5 *\n\n' for k in range(30)]
    odd = ['[A "x"]\n\n1. e4 {\n\n[B "c"]\n\n} *\n\n', '[A "a\\\\"]\n\n*\n\n', '[A "x"]\n\n1. e4\n\n2. d4\n\n', '[A "x"]\n\n%no\n1. e4 *\n\n', '[A "x"]\r\n\n1. e4 *\n\n', "1. e4 *\n\n"]
    for k in range(60):
        texts = [rng.choice(usual if k < 10 or rng.random() < 0.8 else odd) for _ in range(12)]
        (tmp_path / "a.pgn").write_bytes("".join(texts).encode())
        monkeypatch.setattr(pgn, "STEP", rng.choice([5, 100, 1 << 20]) if k >= 10 else 1 << 20)
        reader = pgn.PgnReader({"path": str(tmp_path / "a.pgn"), "rangebytes": str(rng.choice([40, 150]) if k < 10 else 10_000)})
        calls.clear()
        got = [(r["seq"], [(x["key"], x["value"]) for x in r["headers"]], r["movetext"]) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
        assert not calls or k >= 10
        assert got == list(real(pgn._lines(open(tmp_path / "a.pgn", "rb"), 0, "utf-8")))
        text = texts[0]
        (batch,) = pgn.games_of(iter([pa.RecordBatch.from_pydict({"source_file": ["f"], "value": [text]})]))
        assert [(r["seq"], [(x["key"], x["value"]) for x in r["headers"]], r["movetext"]) for r in batch.to_pylist()] == list(real(pgn.text_lines(text)))


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """payloads lie in folders of their own."""
    from rookery.sources import landed_json

    spark.range(200).selectExpr("id as part", "array(named_struct('pgn', '[A \"b\"]\n\n*')) as games").write.partitionBy("part").json(f"file://{tmp_path}/in")
    tracker, before = spark.sparkContext.statusTracker(), spark.conf.get(landed_json.LISTING)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        payload = landed_json.read_month(spark, f"file://{tmp_path}/in")
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages) <= 32 and payload.count() == 200 and spark.conf.get(landed_json.LISTING) == before
