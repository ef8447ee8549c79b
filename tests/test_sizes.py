"""What grows with the tables: joins that Spark must not broadcast, work that must be done once, results of no rows."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from rookery.functions import headers as h
from rookery.operators import evaluations as ev
from rookery.operators import lookups, resemblance, tables, tournaments
from rookery.operators import plies as pl
from rookery.operators.tables import saved
from rookery.plans import queries
from rookery.sources import pgn


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ratings_are_not_broadcast(spark):
    """files of some megabytes hold ratings of millions of months."""
    ratings = tables.saved(spark.range(100).select(F.concat(F.lit("n"), "id").alias("name_key"), F.lit(2000).alias("year"), F.lit(5).alias("month"), F.lit(1).alias("rating")), "ratings")
    rows = tables.saved(spark.range(50).select("id", F.concat(F.lit("N"), "id").alias("name")), "rows")
    found = lookups.rate_asof(rows, ratings, "name", F.lit("2000.06.01"), ["id"])
    assert "BroadcastExchange" not in plan(found)
    assert found.count() == 50


def test_indexes_are_not_broadcast(spark):
    """an index has many rows for each string that its estimate counts."""
    words = tables.saved(spark.createDataFrame([("k", "anderson"), ("k", "andersen"), ("k", "berg")], "k string, b string"), "words")
    for alike in ([], ["k"]):
        met = resemblance.candidates(words.select(*alike, F.col("b").alias("a")), words.select(*alike, "b"), 0.9, alike)
        assert "BroadcastExchange" not in plan(met)
        assert {("anderson", "andersen"), ("berg", "berg")} <= {(r["a"], r["b"]) for r in met.collect()}


def test_no_tournament_qualifies(spark, tmp_path):
    """of many games of a tournament one lacks a rating, so that no file is written and none is read."""
    games = pgn.parse_texts(spark.createDataFrame([("a", '[Event "x"]\n[White "a"]\n[Black "b"]\n\n1. e4 *\n')], "source_file string, value string"))
    assert tournaments.write_tournaments(games, f"file://{tmp_path}/out", 800, 2) == 0
    back = queries._read_back(spark, f"file://{tmp_path}/out")
    assert back.collect() == [] and back.columns == ["file", "position", "game_id"]
    assert pgn.read_pgn(spark, f"file://{tmp_path}/out").count() == 0


def test_plies_are_made_without_a_shuffle(spark):
    """Nesting and numbers begin anew with each game of a batch; what a piece says is kept to its game."""
    texts = ["1. e4 (1. d4 (d5) Nf6 ( e5", ") 1. e4 ) e5 {[%eval 0.50]} {x} {[%eval #-2]} {[%eval y]} $4", None, "", "{[%eval 1.0]} $2 1... e5?? {[%eval 3", "d4 d5 1-0"]
    games = spark.createDataFrame(list(enumerate(texts)), "game_id int, movetext string").coalesce(1).withColumn("tags", F.create_map(F.lit("x"), F.lit("y")))
    out = pl.plies_of(games, ("game_id",))
    assert "Exchange" not in out._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = [(r["game_id"], r["ply"], r["san"], r["blunder"], r["mistake"], r["eval_white_cp"]) for r in out.collect()]
    assert sorted(rows) == [(0, 1, "e4", 0, 0, None), (1, 1, "e4", 0, 0, None), (1, 2, "e5", 1, 0, -99800), (4, 1, "e5", 1, 0, None), (5, 1, "d4", 0, 0, None), (5, 2, "d5", 0, 0, None)]


def test_scores_are_counted_without_a_shuffle(spark, monkeypatch):
    """F8: a game stays one row, and its score is what the general metrics make of its plies; groups may end anywhere."""
    rng, words = random.Random(8), ["e4", "d5?", "Nf3!?", "exd6??", "Qh5+", "O-O", "e8=Q#", "$4", "$2", "1.", "2...", "(", ")", "{x}", "; no\n", "1-0"]
    said = lambda: f"{{[%eval {rng.choice(EVALS) if rng.random() < 0.1 else round(rng.uniform(-4, 4), 2)}]}}"
    texts = [" ".join(w for _ in range(rng.randrange(90)) for w in (rng.choice(words), said()) if w[0] != "{" or rng.random() < 0.6) for _ in range(300)]
    rows = [(k, {"fen": "8/8 b - - 0 1"} if k % 3 == 0 else {}, t) for k, t in enumerate([None, "", "{a}", *texts])]
    games = saved(spark.createDataFrame(rows, "game_id int, tags map<string,string>, movetext string"), "games")
    want = sorted(ev.elegance(ev.game_metrics(saved(pl.plies_of(games, ("game_id",)), "plies"))).collect())
    out = pl.score_games(games, ("game_id",))
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in physical and "Window" not in physical
    assert sorted(out.collect()) == want and len(want) > 250 and len({r["score"] for r in want}) > 10
    monkeypatch.setattr(pl, "GROUP", 40)
    given = pa.array([r[2] for r in rows]), pa.array(["fen" in r[1] for r in rows])
    small = pl._metrics_of(*given), pl._plies_of(*given)
    monkeypatch.undo()
    assert small == (pl._metrics_of(*given), pl._plies_of(*given))


def test_scores_make_no_tags_that_nobody_reads(spark):
    """F8: of the tags FEN alone is read, and derived games have none."""
    for name in ("score_games", "game_plies"):
        out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert not any(c in plan(out) for c in ("c_name", "p_brand", "o_orderdate"))
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 5  # whatever a game needs to be one
    both = [queries.g.games(spark, "/root/testdata/sf0.001", asked) for asked in (None, ("Event", "WhiteElo"))]
    kept = lambda c: F.filter(c, lambda x: x["key"].isin("Event", "WhiteElo"))
    rows = [sorted(df.select("game_id", kept("headers"), h.tag("WhiteElo"), "movetext").collect(), key=lambda r: r[0]) for df in both]
    assert rows[0] == rows[1] and both[0].schema == both[1].schema and set(both[1].select(F.size("tags")).distinct().collect()) == {(1,), (2,)}


#: Evaluations as they may be written, of which some say nothing.
EVALS = ["0.255", "-0.005", "0.125", "-1.5,20", "#3", "#-3", "#+4", "#", "#-", "#0", "#-0", "#0007", "#1000", "#-99999999999", "#2147483647", "+2", "2.", ".5", ".", "-.125", "1e3", "1.2.3", "999.995", "1000", "-1000.01", "1001", "\u0663", "#\u0663", "1\u0085", "#5\u2028", "#5\u2028\u2028", "#5x", "NaN", "1d", "0.49999999999999994", "0.00499999999999999", "2.675", "--1"]


def test_evaluations_of_pieces_are_those_of_columns(spark):
    """F8: what a piece says of its evaluation is found beside its other facts."""
    comments = [f"{a}[%eval{b}{e}{c}" for e in EVALS for a in ("", "x [%eval] ") for b in (" ", "\t\n", "", "\u00a0") for c in ("]", " 20]", "")]
    got = spark.createDataFrame(list(enumerate(comments)), "k int, c string").select("k", "c", h.eval_centipawns(F.col("c"))).collect()
    assert [(c, v) for _, c, v in sorted(got)] == [(c, pl.centipawns(c)) for c in comments]
    assert pl.centipawns("[%eval " + "9" * 5000 + "]") == 100_000 == -pl.centipawns("[%eval -99999999999]") and pl.centipawns("[%eval #" + "9" * 5000 + "]") is None


def test_tags_set_in_turn_cost_a_pass_each(spark):
    games = spark.createDataFrame([([("Event", "a")],)], f"headers {h.HEADER_TYPE}")

    def plan(n: int) -> str:
        head = F.col("headers")
        for k in range(n):
            head = h.set_tag(head, f"T{k}", F.lit(str(k)))
        return games.select(head)._jdf.queryExecution().analyzed().toString()

    assert len(plan(4)) < 3 * len(plan(2))


def test_tags_do_not_travel_to_annotated_games(spark):
    games = saved(h.with_headers(spark.createDataFrame([(1, "s", 1, [("Result", "1-0")], "e4")], f"game_id int, source_file string, seq int, headers {h.HEADER_TYPE}, movetext string"), F.col("headers")), "games")
    plies = saved(spark.createDataFrame([(1, 1, True, "e4", 20)], "game_id int, ply int, is_white boolean, san string, eval_white_cp int"), "plies")
    out = pl.annotate_games(games, plies, 12, key=("game_id",))
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    left = lines[next(k for k, x in enumerate(lines) if "Join LeftOuter" in x) + 1]
    assert "movetext#" in left and ", tags#" not in left.replace("element_at(tags#", "")
    assert [(r["movetext"], r["tags"]["annotator"]) for r in out.collect()] == [("1. e4 { [%eval 0.20] } 1-0", "rookery")]


def test_openings_and_ply_counts_make_no_tags_first(spark, monkeypatch):
    seen = []
    real = lookups.with_moves
    monkeypatch.setattr(queries.lookups, "with_moves", lambda games: seen.append(games.columns) or real(games))
    queries.QUERIES["eco_longest_prefix"](spark, "/root/testdata/sf0.001")
    assert seen == [["game_id", "eco", "movetext"]]
    plan = queries.QUERIES["add_ply_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1
