"""Small cases of the game operators: parsing, dialects, predicates, dedup, lookups, scores."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rookery.functions import headers as h
from rookery.functions import movetext as mt
from rookery.functions import similarity as si
from rookery.operators import collections as co
from rookery.operators import evaluations as ev
from rookery.operators import filters as fi
from rookery.operators import info, landed, lookups, tournaments
from rookery.operators import plies as pl
from rookery.sources import pgn

ALPHA = {"Event": "Alpha Open", "Site": "Rome", "Date": "2024.01.02", "Round": "1", "White": "Ann", "Black": "Bob", "WhiteElo": "2500", "BlackElo": "2400", "Result": "1-0", "ECO": "C20"}
MATE = "1. e4 e5 2. Qh5 Nc6 3. Bc4 Nf6 4. Qxf7# 1-0"


def make(spark, games):
    rows = [("f", k, list(head.items()), {a.lower(): b for a, b in head.items()}, text) for k, (head, text) in enumerate(games)]
    return spark.createDataFrame(rows, pgn.SCHEMA)


def test_parser_cases():
    text = '[Event "A \\"x\\""]\n[event "B"]\n[Bare value]\n\n1. e4 {[Not "tag"]\n[Event "no"]\n} e5\n\n% skipped\n2. d4 *\n[Event "C"]\n\n*\n'
    lines = [(k, x) for k, x in enumerate(text.split("\n"))]
    games = list(pgn.parse_games(lines))
    assert [g[1] for g in games] == [[("Event", "B"), ("Bare", "value")], [("Event", "C")]]
    assert games[0][2].endswith("2. d4 *") and "% skipped" not in games[0][2]
    with pytest.raises(ValueError):
        list(pgn.parse_games([(0, "x" * 300_000)]))


def test_permissive_leaves_out_the_games_beyond_limits():
    text = '[Event "A"]\n\n1. e4 *\n[Event "B"]\n[Note "' + "n" * 60 + '"]\n[Site "b"]\n\n1. c4 {a\n[Event "C"]\n\n' + "1. d4 " * 12 + '\n[Event "D"]\n\n1. e4 e5\n2. d4 d5\n3. c4 *\n[Event "E"]\n\n*\n'
    text = text.replace("{a", "a")
    lines = list(enumerate(text.split("\n")))
    kept = lambda **o: [(g[1][0][1], g[2]) for g in pgn.parse_games(lines, 50, **o)]
    assert kept(permissive=True) == [("A", "1. e4 *"), ("D", "1. e4 e5\n2. d4 d5\n3. c4 *"), ("E", "*")]
    assert [e for e, _ in kept(permissive=True, max_text=15)] == ["A", "E"]
    with pytest.raises(ValueError):
        kept()


def test_archives_give_their_entries(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    body = lambda n: f'[Event "{n}"]\n\n1. e4 *\n\n[Event "{n}{n}"]\n\n1. d4 *\n'.encode()
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/a.PGN", body("A"))
        z.writestr("readme.txt", b"no game")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for n in "bc":
            info = tarfile.TarInfo(f"{n}.pgn")
            info.size = len(body(n))
            t.addfile(info, io.BytesIO(body(n)))
    (tmp_path / "d.pgn").write_bytes(body("d"))
    rows = pgn.read_pgn(spark, str(tmp_path)).collect()
    assert sorted(r.tags["event"] for r in rows) == ["A", "AA", "b", "bb", "c", "cc", "d", "dd"]
    assert len({(r.source_file, r.seq) for r in rows}) == 8 and any(r.source_file.endswith("a.zip!x/a.PGN") for r in rows)


def test_ranges_give_the_games_of_the_whole(spark, tmp_path):
    rng = random.Random(1)
    games = []
    for k in range(300):
        head = {"Event": f"E{k}", "White": "W" * rng.randrange(1, 40), "Note": 'say "hi" \\ there'}
        games.append((head, " ".join(f"{i}. e4 e5" for i in range(rng.randrange(1, 30)))))
    pgn.write_pgn(make(spark, games).coalesce(2), str(tmp_path / "out"))
    read = lambda **o: sorted((r.headers[0].value, r.tags["note"], " ".join(r.movetext.split())) for r in pgn.read_pgn(spark, str(tmp_path / "out"), **o).collect())
    whole = read(splittable="false")
    assert whole == sorted((g["Event"], g["Note"], t) for g, t in games)
    for size in ("700", "1500", "9999"):
        assert read(rangeBytes=size) == whole


def test_zstd_and_headers_only(spark, tmp_path):
    import zstandard

    (tmp_path / "a.pgn.zst").write_bytes(zstandard.compress(b'[Event "Z"]\n\n1. e4 *\n'))
    row = pgn.read_pgn(spark, str(tmp_path / "a.pgn.zst"), columns="headers").first()
    assert (row.tags["event"], row.movetext) == ("Z", None)


def test_dialects(spark):
    text = "1. e4 {c (x} e5 (1... c5 (1... d5) 2. a3) 2. Nf3! $1 Nc6 ; rest 3. a3\n3. O-O 0-0 [x] e.p. 1/2-1/2"
    df = spark.createDataFrame([(text,), ("",), (None,)], "movetext string")
    rows = df.select(mt.book_moves(F.col("movetext")).alias("b"), mt.ply_count(F.col("movetext"), "tag").alias("t"), mt.ply_count(F.col("movetext"), "info").alias("i")).collect()
    assert rows[0].b == ["e4", "e5", "Nf3", "Nc6", "O-O", "O-O"]
    assert rows[0].t >= 6 and rows[1].b == [] and rows[2].t == 0 and rows[2].i == 0
    assert mt.stripped(["1. e4 {note} e5 (1... c5) 2. d4 $14 *"]) == ["1. e4 e5 2. d4 *"]
    plain = spark.createDataFrame([("1. e4! {n} e5?! (x) $3 *",), (" e4!\n\u00a0{n} e5 ) ",), (None,)], "t string").select(mt.unannotated(F.col("t")))
    assert [r[0] for r in plain.collect()] == ["1. e4 e5 *", "e4 e5", ""]


def test_deep_variations_leave_the_rest(spark):
    deep = lambda n: "1. e4 " + "(a " * n + ")" * n + " e5 2. Nf3 Nc6 1-0"
    df = spark.createDataFrame([(deep(6),), (deep(7),), (deep(40),), ("1. e4 " + "(a " * 9 + ")" * 8 + " e5 1-0",)], "movetext string")
    assert [r[0] for r in df.select(mt.book_moves(F.col("movetext"))).collect()] == [["e4", "e5", "Nf3", "Nc6"]] * 3 + [["e4"]]


def test_mate_only_on_the_main_line(spark):
    games = make(spark, [(ALPHA, MATE), (ALPHA, "1. e4 {Qxf7#} e5 (1... f6 2. Qh5#) *")])
    assert [r.seq for r in fi.filter_checkmates(games).collect()] == [0]
    assert fi.filter_archive(games, 1000).count() == 2  # any # counts there


def test_elo_and_variant_predicates(spark):
    head = lambda w, b, **o: ({"WhiteElo": w, "BlackElo": b, **o}, "*")
    games = make(spark, [head("2500", "2400"), head("", "2400"), head("x", "y"), head("2500", "3000"), head("2500", "2400", Variant="?"), head("2500", "2400", SetUp="1")])
    kept = lambda c: [r.seq for r in games.where(c).orderBy("seq").collect()]
    assert kept(fi.elo_range(2400, 2600)) == [0, 1, 4, 5]
    assert kept(fi.elo_range(2400, 2600, True)) == [0, 4, 5]
    assert kept(fi.elo_range()) == [0, 1, 2, 3, 4, 5]
    assert kept(fi.standard_filter()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        fi.elo_range(3, 2)


def test_deduplicate_keeps_the_first(spark):
    games = make(spark, [(ALPHA, MATE), (dict(reversed(ALPHA.items())), MATE + " "), (ALPHA | {"Round": "2"}, MATE)])
    assert sorted(r.seq for r in co.deduplicate(games).collect()) == [0, 2]


def test_greedy_keys_follow_chains(spark):
    rows = spark.createDataFrame([(0, ["a"]), (1, ["a", "b"]), (2, ["b", "c"]), (3, ["c"]), (4, ["d", "e"]), (5, ["z"])], "seq long, keys array<string>")
    known = spark.createDataFrame([("z",)], "key string")
    # 1 goes because of a, so it doesn't take b, and 2 stays
    assert sorted(r.seq for r in co.deduplicate_by_keys(rows, "keys", ["seq"], known).collect()) == [0, 2, 4]


def test_greedy_keys_settle_long_chains(spark):
    rows = spark.createDataFrame([(k, [f"k{k}", f"k{k + 1}"]) for k in range(450)], "seq long, keys array<string>")
    assert sorted(r.seq for r in co.deduplicate_by_keys(rows, "keys", ["seq"]).collect()) == list(range(0, 450, 2))


@pytest.mark.parametrize("chain", [150, 10_000])
def test_greedy_keys_pass_decisions_on(spark, monkeypatch, chain):
    """Chains, combs and random rows over ranges of the order, against plain Python."""
    monkeypatch.setattr(co, "CHAIN_KEYS", chain)
    rng = random.Random(chain)
    rows = [(k, [f"c{k}", f"c{k + 1}"]) for k in range(120)] + [(200 + k, [f"d{k}", f"d{k + 1}", "comb" if k % 40 == 39 else f"e{k}"]) for k in range(120)]
    rows += [(1000 + k, list({f"r{rng.randrange(60)}" for _ in range(rng.randrange(1, 4))} | {None} if k % 50 == 49 else {f"r{rng.randrange(90)}"})) for k in range(100)]
    taken, want = set(), []
    for k, keys in rows:
        if taken.isdisjoint(keys):
            want.append(k)
            taken |= set(keys)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, keys array<string>")
    assert sorted(r.seq for r in co.deduplicate_by_keys(df, "keys", ["seq"]).collect()) == want


def test_greedy_keys_of_null_and_none(spark):
    rows = spark.createDataFrame([(0, [None]), (1, ["a", None]), (2, []), (3, None), (4, ["a"]), (5, ["a"])], "seq long, keys array<string>")
    kept = lambda known: sorted(r.seq for r in co.deduplicate_by_keys(rows, "keys", ["seq"], known).collect())
    assert kept(None) == [0, 2, 3, 4]
    assert kept(spark.createDataFrame([(None,)], "key string")) == [2, 3, 4]


def test_two_kinds_of_keys(spark, tmp_path):
    from rookery.plans import queries

    rng = random.Random(4)
    pages = [(k, rng.choice([None, *(f"http://H/{n}/?q" for n in range(30))]), rng.choice([None, *map(str, range(30))])) for k in range(90)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    taken, want = set(), []
    for k, url, html in pages:
        own = {url and "u" + url, html and "h" + html}
        if not own & taken:
            want.append(k)
            taken |= own
    assert sorted(r.page_id for r in queries.QUERIES["multi_key_dedup_two"](spark, str(tmp_path)).collect()) == want


def test_natural_order(spark):
    names = ["Round 10", "round 2", "Round 02", "A", "9", "10", ""]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    assert [r.x for r in df.orderBy(h.natural_key(F.col("x"))).collect()] == ["", "9", "10", "A", "round 2", "Round 02", "Round 10"]


def test_splits(spark):
    games = make(spark, [(ALPHA | {"Date": d, "Site": s}, "*") for d, s in (("1994.??.??", "a/b"), ("2001.05.06", "A/B"), ("", " "))])
    buckets = lambda p: [r.bucket for r in co.split_by_date(games, p).orderBy("seq").collect()]
    assert buckets("decade") == ["199x", "200x", "xxxx"] and buckets("day") == ["1994-xx-xx", "2001-05-06", "xxxx-xx-xx"]
    assert co.split_summary(co.split_by_header(games, "Site")).first() == (3, 2)
    assert [r.bucket for r in co.split_chunks(games, 2).orderBy("seq").collect()] == ["games_chunk_0001"] * 2 + ["games_chunk_0002"]


def test_categories_and_tournaments(spark):
    pair = lambda w, b, r: (ALPHA | {"White": w, "Black": b, "WhiteElo": "2500", "BlackElo": "2450", "Round": str(r)}, "1. e4 *")
    games = make(spark, [pair(*x, r) for r in range(3) for x in (("Ann", "Bob"), ("Cid", "Dee"))])
    tagged = tournaments.tag_categories(games).first()
    assert tagged.tags["eventcategory"] == str(1 + (2475 - 2251) // 25) and [x.key for x in tagged.headers][:2] == ["Event", "EventCategory"]
    found = tournaments.qualified_tournaments(games, 2400, 3).collect()
    assert len(found) == 1 and found[0].file_name.startswith("2450-2500-alpha-open-rome-2024-")
    assert tournaments.break_tournaments(games, 2480, 3).count() == 0
    assert tournaments.name_collisions(tournaments.qualified_tournaments(games, 2400, 3)).count() == 0


def test_info(spark):
    row = info.pgn_info(make(spark, [(ALPHA, MATE), (ALPHA | {"ECO": "B", "Result": "", "Date": "2024.01.??"}, "")])).first()
    assert (row.games, row.white_wins, row.missing_results, row.eco_invalid, row.players, row.plies_max, row.missing_dates) == (2, 1, 1, 1, 2, 7, 1)


def test_openings(spark):
    book = lookups.opening_book(make(spark, [({"ECO": "B00", "Opening": "King"}, "1. e4 *"), ({"ECO": "C20"}, "1. e4 e5 *"), ({"Opening": "Open"}, "1. e4 e5 *")]))
    out = lookups.tag_openings(make(spark, [({"White": "a"}, "1. e4 e5 2. d4 *"), ({"White": "a"}, "1. e4 c5 *"), ({"White": "a"}, "1. d4 *")]), book)
    assert [(r.tags.get("eco"), r.tags.get("opening")) for r in out.orderBy("seq").collect()] == [("C20", "Open"), ("B00", "King"), (None, None)]


@pytest.mark.parametrize("most", [1000, 0])
def test_longest_prefixes_of_random_lines(spark, monkeypatch, most):
    """By the trie, and by the table that takes its place for large books."""
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", most)
    rng = random.Random(6)
    line = lambda n: [rng.choice(["e4", "e5", "d4", "Nf3", "c4"]) for _ in range(rng.randrange(1, n))]
    book = {" ".join(m): (len(m), rng.choice(["A00", None]), "o", None) for m in (line(7) for _ in range(120))}
    games = [(k, line(12) if k % 9 else rng.choice([None, [], ["??", "e4"]])) for k in range(400)]
    rows = spark.createDataFrame([(p, *v) for p, v in book.items()], "prefix string, depth int, eco string, opening string, variation string")
    out = lookups.longest_prefix(spark.createDataFrame(games, "game_id int, moves array<string>"), rows, order=("game_id",)).collect()
    best = lambda m: next((book[p] for n in range(len(m or []), 0, -1) if (p := " ".join(m[:n])) in book), (None,) * 4)
    assert {r.game_id: tuple(r[2:]) for r in out} == {k: best(m) for k, m in games} and len(out) == 400
    assert lookups.longest_prefix(spark.createDataFrame(games, "game_id int, moves array<string>"), rows.limit(0), order=("game_id",)).where("depth is not null").count() == 0


def test_no_rows_are_made_for_prefixes(spark):
    book = lookups.opening_book(make(spark, [({"ECO": "B00"}, "1. e4 *")]))
    plan = lookups.tag_openings(make(spark, [({"White": "a"}, "1. e4 *")]), book)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan and "explode" not in plan


def test_long_lines_are_not_held():
    import io

    lines = list(pgn._lines(io.BytesIO(b"a\n" + b"x" * 5_000_000 + b"\nb\n" + b"y" * 30), 0, "utf-8", 100))
    assert [at for at, _ in lines] == [0, 2, 5_000_003, 5_000_005] and [len(x) for _, x in lines][2:] == [1, 30]
    assert 100 < len(lines[1][1]) < 1_100_000


def test_ratings_and_names(spark):
    ratings = spark.createDataFrame([("lee,ann".replace(",", ""), 2020, 5, 2300), ("leeann", 2020, 7, 2310)], "name_key string, year int, month int, rating int")
    games = make(spark, [({"White": "Lee, Ann", "Black": "Bob", "Date": "2020.06.??"}, "*"), ({"White": "Ann Lee", "Black": "Bob", "Date": "2020.08.01"}, "*"), ({"White": "Ann Lee", "Black": "Bob", "Date": "2021.01.01"}, "*")])
    out = lookups.add_ratings(games, ratings).orderBy("seq").collect()
    assert [r.tags.get("whiteelo") for r in out] == ["2300", "2310", None]
    assert si.jaro_winkler_of(["dixon", "", "", "ab"], ["dicksonx", "a", "", "ab"]) == pytest.approx([0.8133, 0, 1, 1], abs=1e-4)
    assert si.clean_name_of("xx_9") is None


def test_fuzzy_names_of_misspelt_swapped_and_single(spark):
    players = spark.createDataFrame([("Magnus Carlsen",), ("Hikaru Nakamura",), ("Carl Smith",), ("Anna Smith",)], "name string")
    names = spark.createDataFrame([("Magnus Carlsson",), ("Nakamura",), ("Nakamurra",), ("Smith",), ("Hikarru, Nakamura",), ("Bob Zzz",)], "name string")
    got = {r.name: r.player for r in lookups.fuzzy_names(names, players).collect()}
    assert got == {"Magnus Carlsson": "Magnus Carlsen", "Nakamura": "Hikaru Nakamura", "Nakamurra": "Hikaru Nakamura"}
    swapped = spark.createDataFrame([("Nakamura Hikaru",)], "name string"), spark.createDataFrame([("Hikaru, Nakamura",)], "name string")
    assert lookups.fuzzy_names(*swapped).count() == 1


def test_add_ratings_ends_with_resemblance(spark):
    ratings = spark.createDataFrame([("magnuscarlsen", 2020, 6, 2863, "Magnus Carlsen")], "name_key string, year int, month int, rating int, name string")
    games = make(spark, [({"White": "Magnus Carlsson", "Black": "Bob", "Date": "2020.06.01"}, "*")])
    row = lookups.add_ratings(games, ratings).first()
    assert (row.tags.get("whiteelo"), row.tags.get("blackelo")) == ("2863", None)


def test_real_names():
    from rookery.plans.queries import REAL_NAMES

    for raw, want in REAL_NAMES.items():
        assert si.clean_name_of(raw.replace("''", "'")) == (want and want.replace("''", "'")), raw
    more = {"Lee, Ann, Marie": "Lee, Ann Marie", "Иван Smith Jones": None, "A. Lee": "Lee, A", "BC DF": None, "ab cd": None, "Bo Bo": None, "anna ANNA": "Anna, Anna", "Ann @ann": None, "Ann elo Lee": None, "🙂 Ann Lee": None, None: None, " ": None, ", Ann": None, "General of Krypton": None}
    for raw, want in more.items():
        assert si.clean_name_of(raw) == want, raw


def test_engine_versions(spark):
    releases = spark.createDataFrame([("Stockfish 16.1", dt.date(2024, 2, 24), dt.date(2024, 9, 5))], "name string, start date, end date")
    games = make(spark, [({"White": "Stockfish dev 240901", "Black": "Stockfish 15"}, "*")])
    assert lookups.normalize_engines(games, releases, 2026).first().tags == {"white": "Stockfish 16.1", "black": "Stockfish 15"}


def test_plies_of_games(spark):
    text = "{before [%eval 9]} 1. e4! {[%eval 0.3] (x} {[%eval 0.4]} ; 1... c5\n1... e5?! $2 (1... c5 {[%eval 5]} (1... d5) 2. a3) ) 2.Qh5?? $4 2... 0-0 3. exd6 e.p. Nf3?$4 Zz 4. e8=Q+ 1-0 {[%eval 1"
    games = make(spark, [({"White": "a"}, text), ({"White": "a", "FEN": "8/8 b - - 0 1"}, "1... e5 2. Nf3"), ({"White": "a"}, ""), ({"White": "a"}, None)])
    rows = [r for r in pl.plies_of(games).orderBy("seq", "ply").collect()]
    assert [r.san for r in rows if r.seq == 0] == ["e4", "e5", "Qh5", "0-0", "exd6", "Nf3", "e8=Q+"]
    assert [r.eval_white_cp for r in rows if r.seq == 0] == [40] + [None] * 6
    assert [(r.blunder, r.mistake, r.dubious) for r in rows if r.seq == 0] == [(0, 0, 0), (0, 1, 1), (2, 0, 0), (0, 0, 0), (0, 0, 0), (1, 1, 0), (0, 0, 0)]
    assert [r.is_quiet for r in rows if r.seq == 0] == [True] * 4 + [False, True, False] and rows[4].is_capture and rows[6].is_promotion and rows[6].is_check
    assert [(r.is_white, r.san) for r in rows if r.seq == 1] == [(False, "e5"), (True, "Nf3")] and {r.seq for r in rows} == {0, 1}
    assert {r.seq for r in pl.score_games(games).collect()} == {0, 1}


def test_annotated_games(spark):
    games = make(spark, [({"Result": "1-0"}, "1. e4 e5"), ({"Result": "1-0"}, "1. e4 {[%eval 0.2]} e5 {[%eval 4]} 0-1"), ({"White": "a"}, "1. e4"), ({"Result": " "}, "1. d4"), ({"Result": "*"}, "{none}")])
    out = pl.annotate_games(games, pl.plies_of(games), 8).orderBy("seq").collect()
    assert [r.movetext for r in out] == ["1. e4 e5 1-0", "1. e4 { [%eval 0.20] } e5 $4 { [%eval 4.00] } 0-1", "1. e4 *", "1. d4", "{none}"]
    assert [(r.tags.get("annotator"), r.tags.get("analysisdepth")) for r in out] == [("rookery", "8")] * 4 + [(None, None)]


def test_counters_arrive_with_the_job(spark):
    from pyspark.sql import Observation

    seen = Observation("filter")
    games = make(spark, [(ALPHA, MATE), ({"White": "a"}, "*")])
    assert fi.counted(games, seen, kept=h.elo("WhiteElo").isNotNull()).count() == 2 and seen.get == {"processed": 2, "kept": 1}


def test_evaluations(spark):
    df = spark.createDataFrame([("x [%eval 0.255] y",), ("[%eval #-3]",), ("[%eval -1.5,20]",), ("none",)], "c string")
    assert [r[0] for r in df.select(h.eval_centipawns(F.col("c"))).collect()] == [26, -99700, -150, None]
    assert df.select(h.eval_text(F.lit(-99700)), h.eval_text(F.lit(25))).first() == ("#-3", "0.25")
    fen = F.lit("r3k3/8/8/8/8/8/PP6/4K3 b - - 0 1")
    assert df.select(h.material(fen, True), h.material(fen, False), h.black_to_move(fen)).first() == (200, 500, True)


def test_elegance(spark):
    rows = [(1, p, p % 2 == 1, True, e) for p, e in ((1, 20), (2, 10), (3, 400), (4, None), (5, 30))]
    plies = spark.createDataFrame(rows, "game_id long, ply int, is_white boolean, is_quiet boolean, eval_white_cp int")
    m = ev.game_metrics(plies).first()
    assert (m.plies, m.evaluated, m.blunders, m.quiet_improvements) == (5, 4, 1, 1)
    score = ev.elegance(ev.game_metrics(plies))
    assert 0 <= score.first().score <= 100
    cases = spark.createDataFrame([("a", 0.0, 100.0), ("b", 0.0, 1.0)], "name string, min_score double, max_score double")
    got = {r.name: r.passed for r in ev.validate(cases, score.select(F.lit("a").alias("name"), "score")).collect()}
    assert got == {"a": True, "b": False}


def test_elegance_of_known_figures(spark):
    names = "game_id, plies, evaluated, forcing_share, quiet_improvements, trend_breaks, blunders, mistakes, dubiouss, mean_swing, deviation"
    kinds = ["long"] * 3 + ["double"] + ["long"] * 5 + ["double"] * 2
    schema = ", ".join(f"{n} {k}" for n, k in zip(names.split(", "), kinds, strict=True))
    m = spark.createDataFrame([(1, 100, 100, 39.0, 2, 1, 1, 2, 3, 60.0, 80.0), (2, 100, 50, 39.0, 2, 1, 1, 2, 3, 60.0, 80.0)], schema)
    got = {r.game_id: r for r in ev.elegance(m).collect()}
    # swing 60 + 25 + 20 + 15, deviation 80 + 18, 39 % forcing, 2 quiet moves in a hundred plies
    want = [100 * (1 - 75 / 235), 100 * (1 - 63 / 205), 50.0, 100 * 1.6 / 6.1]
    parts = lambda r: (r.soundness, r.coherence, r.tactics, r.quiet)
    assert parts(got[1]) == pytest.approx(want, abs=1e-3) and got[1].score == 49 and got[1].details == "S=68;C=69;T=50;Q=26;L=0"
    assert parts(got[2]) == pytest.approx([want[0] / 2, want[1] / 2, 50.0, want[3] / 2], abs=1e-3)
    given = spark.createDataFrame([(1, 1, 1, 200, 100)], "game_id long, sound int, unsound int, sound_cp int, unsound_cp int")
    r = {r.game_id: r for r in ev.elegance(m, given).collect()}[1]
    assert (r.soundness, r.quiet) == pytest.approx((100 * (1 - 110 / 235), 100 * (2 + 1.85 - 0.65 - 0.4) / 6.1), abs=1e-3)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_index_of_many_rows(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_000).alias("v")).repartition(16)
        out = co.global_index(rows, ["v"])
        assert out.agg(F.count("*"), F.sum((F.col("index") == F.col("v")).cast("int"))).first() == (1_000_000, 1_000_000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_payload_classes(spark):
    cases = {"<a href='/LOGIN'>": "AuthRequired", "\ufeff\n[Event \"x\"]": "Success", " [SITE \"x\"]": "Success", "[Event \"x\"]<HTML>": "NonPgn", "text [Event \"x\"]": "NonPgn", "[Round \"1\"]": "NonPgn", None: "NonPgn"}
    rows = spark.createDataFrame([(k,) for k in cases], "body string").select("body", fi.payload_class(F.col("body")).alias("c")).collect()
    assert {r.body: r.c for r in rows} == cases


def test_tournaments_for_one_file_are_an_error(spark):
    with pytest.raises(ValueError):
        tournaments.checked_names(spark.createDataFrame([("a", "x.pgn"), ("b", "x.pgn")], "key string, file_name string"))


def test_ply_count_tag(spark):
    games = make(spark, [({"Event": "x", "PlyCountOld": "1", "plycount": "9", "White": "a"}, "1. e4 {c} e5 (1... c5) 2. Nf3 *")])
    assert [(x.key, x.value) for x in co.add_ply_counts(games).first().headers] == [("Event", "x"), ("White", "a"), ("PlyCount", "3")]


def test_ledger_and_frontier(spark):
    rows = [(i, "Non-PGN file") for i in range(0, 105, 5)] + [(1, "success"), (6, " missing"), (11, "404")]
    ledger = spark.createDataFrame(rows, "event_id int, status string").withColumn("status", landed.ledger_status(F.col("status")))
    out = {r.event_id: r.skip for r in landed.resume(spark.createDataFrame([(1,), (6,), (11,), (200,)], "event_id int"), ledger).collect()}
    assert out == {1: "success", 6: "dead", 11: None, 200: "residue"}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "player string, opponent string")
    seeds = spark.createDataFrame([("a",)], "player string")
    assert {r.player: r.level for r in landed.frontier(edges, seeds, 2).collect()} == {"a": 0, "b": 1, "c": 2}


def test_pages(spark):
    html = '<table><tbody><tr><td>12</td><td>3</td><td><b>2020-01-02</b></td></tr><tr><td>x</td><td>1</td><td>2</td></tr></tbody></table><a href="/x/a.zip"><a href="a.zip"><a href="http://else.org/b.zip"><a href="/x/a.zip">'
    pages = spark.createDataFrame([(1, "http://my.org/x/index.html", html)], "page_id long, url string, html string")
    assert [(r.match_id, r.run_id, str(r.day)) for r in landed.match_table(pages).collect()] == [(12, 3, "2020-01-02")]
    assert [r.url for r in landed.extract_links(pages).collect()] == ["http://my.org/x/a.zip"]


def test_stream_ingest(spark, tmp_path):
    from rookery.streaming import ingest

    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.pgn").write_text('[Event "A"]\n\n1. e4 *\n\n[Event "B"]\n\n1. d4 *\n')
    for _ in range(2):
        ingest.ingest(ingest.stream_pgn(spark, str(landing)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        (landing / "b.pgn").write_text('[Event "C"]\n\n1. c4 *\n')
    assert sorted(r.tags["event"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B", "C"]


def test_stream_goes_on_inside_a_file(spark, tmp_path):
    """Every run is a restart; batches end inside files."""
    from rookery.streaming import ingest

    landing = tmp_path / "in"
    landing.mkdir()
    rng = random.Random(3)
    body = lambda names: "".join(f'[Event "{n}"]\n[White "w"]\n\n{"1. e4 e5 " * rng.randrange(1, 9)}*\n\n' for n in names)
    (landing / "a.pgn").write_text(body(range(60)))
    (landing / "b.pgn").write_text(body(range(100, 103)))
    sizes, options = [], {"rangeBytes": "300", "bytesPerBatch": "900", "progress": str(tmp_path / "at")}
    for k in range(12):
        ingest.ingest(ingest.stream_pgn(spark, str(landing), **options), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        sizes.append(spark.read.parquet(str(tmp_path / "out")).count())
        if k == 4:
            (landing / "c.pgn").write_text(body(range(200, 210)))
    got = sorted(int(r.tags["event"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [*range(60), *range(100, 103), *range(200, 210)] and 0 < sizes[0] < 60 and len(set(sizes)) > 4
