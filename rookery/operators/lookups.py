"""Joins that enrich games: openings by longest prefix, ratings as of a month, releases by interval."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headers as h
from ..functions import movetext as mt
from ..functions.similarity import jaro_winkler
from .resemblance import similar
from .tables import saved

FUZZY_SURE, FUZZY_LEAST, FUZZY_GAP, LAST_NAME_LEAST = 0.97, 0.90, 0.02, 0.92
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count finds at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_moves(games: DataFrame) -> DataFrame:
    """``games`` with the moves of the main line, generated so that no later use makes them again."""
    return games.select("*", F.inline(F.array(F.struct(mt.book_moves(F.col("movetext")).alias("moves")))))


def opening_book(lines: DataFrame) -> DataFrame:
    """(prefix, depth, eco, opening, variation) from book games; of several lines on one node the last non-blank field wins."""
    filled = lambda t: F.nullif(F.trim(h.tag(t)), F.lit(""))
    moves = F.col("moves")
    rows = with_moves(lines).select(F.array_join(moves, " ").alias("prefix"), F.size(moves).alias("depth"), *(filled(t).alias(t.lower()) for t in ("ECO", "Opening", "Variation")), F.struct("source_file", "seq").alias("at"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return rows.where("depth > 0").groupBy("prefix", "depth").agg(*map(last, ("eco", "opening", "variation"))).where("coalesce(eco, opening, variation) is not null")


FOUND = "depth int, eco string, opening string, variation string"


def _walker(book: list[tuple]) -> Callable[[pa.Array], pa.Array]:
    """Walks move lists down the trie of a book (prefix, depth, eco, opening, variation), all lists of a batch a move at a
    time, and gives what the deepest book node on their way says (null: none)."""
    words = sorted({m for prefix, *_ in book for m in prefix.split(" ")})
    number, edges, says = {m: k for k, m in enumerate(words)}, {}, {}
    for row, (prefix, *_) in enumerate(book):
        node = 0
        for m in prefix.split(" "):
            node = edges.setdefault(node * len(words) + number[m], len(edges) + 1)
        says[node] = row
    keys = np.array(sorted(edges), np.int64)
    child = np.array([edges[k] for k in keys.tolist()], np.int64)
    said = np.array([says.get(k, -1) for k in range(len(edges) + 1)], np.int64)
    columns = list(zip(*book, strict=True))[1:] if book else [[]] * 4
    deepest = max(columns[0], default=0)

    def walk(moves: pa.Array) -> pa.Array:
        n = moves.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(n) - n
        ids = pc.index_in(moves.flatten(), value_set=pa.array(words, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        node, best, on = np.zeros(len(n), np.int64), np.full(len(n), -1), np.arange(len(n))
        for step in range(deepest):
            on = on[n[on] > step]
            if not len(on):
                break
            m = ids[start[on] + step]
            key = node[on] * len(words) + m
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = (m >= 0) & (keys[at] == key)
            on, at = on[there], at[there]
            node[on] = child[at]
            best[on] = np.where(said[child[at]] >= 0, said[child[at]], best[on])
        rows = pa.array(best, mask=best < 0)
        kinds = [pa.int32(), *[pa.string()] * 3]
        return pa.StructArray.from_arrays([pa.array(c, k).take(rows) for c, k in zip(columns, kinds, strict=True)], names=["depth", "eco", "opening", "variation"])

    return walk


def longest_prefix(games: DataFrame, book: DataFrame, moves: str = "moves", order: tuple[str, ...] = ("source_file", "seq")) -> DataFrame:
    """``games`` with depth, eco, opening and variation of the deepest book node on their main line (null: none).

    A book of at most ``BROADCAST_ROWS`` nodes goes to all tasks as a trie, which each game walks once: a row in, a row
    out, nothing is shuffled. A larger one stays a table, which meets as many prefixes of a game as it is deep."""
    book = saved(book.select("prefix", F.col("depth").cast("int").alias("depth"), "eco", "opening", "variation"), "book")
    rows = book.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) <= BROADCAST_ROWS:
        walk = _walker([tuple(r) for r in rows])
        return games.select("*", F.arrow_udf(walk, FOUND)(F.col(moves)).alias("_o")).select("*", "_o.*").drop("_o")
    deepest = book.agg(F.max("depth")).first()[0] or 0
    ends = F.explode(F.sequence(F.lit(1), F.least(F.size(moves), F.lit(deepest))))
    some = games.where(F.size(moves) > 0).select(*order, moves, ends.alias("_n"))
    keyed = some.select(*order, F.array_join(F.slice(moves, F.lit(1), F.col("_n")), " ").alias("prefix"))
    found = keyed.join(book, "prefix").groupBy(*order).agg(F.max_by(F.struct("depth", "eco", "opening", "variation"), "depth").alias("_o"))
    return games.join(found, list(order), "left").select("*", "_o.*").drop("_o")


def tag_openings(games: DataFrame, book: DataFrame) -> DataFrame:
    out = longest_prefix(with_moves(games), book).drop("moves")
    head = F.col("headers")
    for name in ("ECO", "Opening", "Variation"):
        head = h.set_tag(head, name, F.col(name.lower()))
    return h.with_headers(out, head).drop("depth", "eco", "opening", "variation")


def last_ratings(records: DataFrame, order: list[str]) -> DataFrame:
    """(name_key, year, month, rating) of rating records; of several for one month the last by ``order`` counts."""
    return records.groupBy("name_key", "year", "month").agg(F.max_by("rating", F.struct(*order)).alias("rating"))


def rating_months(ratings: DataFrame) -> DataFrame:
    """Ratings (name_key, year, month, rating) for every month they answer for: their own first, then the month after
    them, then the month before, within the year."""
    shift = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(d).alias("d")) for p, d in ((0, 0), (1, 1), (2, -1)))))
    out = ratings.select("name_key", "year", "month", "rating", shift.alias("s"))
    out = out.select("name_key", "year", (F.col("month") + F.col("s.d")).alias("month"), F.col("s.p").alias("p"), "rating")
    return out.where("month between 1 and 12").groupBy("name_key", "year", "month").agg(F.min_by("rating", F.struct("p", "rating")).alias("rating"))


def rate_asof(rows: DataFrame, ratings: DataFrame, name: str, date: Column, order: list[str]) -> DataFrame:
    """(order, rating) for rows with a name and a month: by the name as written, else swapped, else canonical; a key
    without a rating for the month falls through to the next."""
    c = F.col(name)
    keys = F.array(*(F.struct(F.lit(k).alias("k"), x.alias("name_key")) for k, x in enumerate((h.name_key(c), h.swapped_name_key(c), F.replace(h.canonical_name(c), F.lit(" "), F.lit(""))))))
    each = rows.withColumn("_m", h.year_month(date)).where("_m is not null").select(*order, F.col("_m.year").alias("year"), F.col("_m.month").alias("month"), F.explode(keys).alias("x"))
    each = each.select(*order, "year", "month", F.col("x.k").alias("k"), F.col("x.name_key").alias("name_key")).where("name_key is not null and name_key <> ''")
    # merged: estimates count the rows of ratings before they are exploded, and broadcast them
    return each.join(rating_months(ratings).hint("merge"), ["name_key", "year", "month"]).groupBy(*order).agg(F.min_by("rating", "k").alias("rating"))


def resolve_last_names(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """(block, last): for distinct last names (block) the most similar known one of the same initial, by Jaro-Winkler of
    at least 0.92; of equally similar ones the first by name."""
    found = similar(unknown.select(F.col("block").alias("a")), known.select(F.col("block").alias("b")), LAST_NAME_LEAST, initial=True)
    return found.groupBy(F.col("a").alias("block")).agg(F.min_by("b", F.struct(-F.col("score"), F.col("b"))).alias("last"))


def fuzzy_names(names: DataFrame, players: DataFrame) -> DataFrame:
    """(name, player) for distinct names that resemble one player clearly: within the block of their last name, by
    Jaro-Winkler, sure (0.97) or good (0.90) with a gap to the runner-up.

    A last name that no player has stands for the most similar one (``resolve_last_names``); the score is the greater of
    the name's and its swapped form's; a name of one word is its block's player if that has one only. A name meets the
    players of its block through their letters (``similar``), so a frequent last name is no single key."""
    key = lambda c: (h.last_name_key(c).alias("block"), h.canonical_name(c).alias("canon"))
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    left = names.select(F.col("name")).distinct().select("name", *key(F.col("name"))).where("block is not null")
    right = saved(players.select(F.col("name").alias("player")).distinct().select("player", *key(F.col("player"))).where("block is not null").select("player", "block", bare("canon").alias("b")), "players")
    sizes = right.groupBy("block").agg(F.count("*").alias("players"), F.min("player").alias("player"))
    near = resolve_last_names(left.select("block").distinct().join(sizes.hint("merge"), "block", "left_anti"), sizes)
    left = saved(left.join(near.hint("merge"), "block", "left").select("name", "canon", F.coalesce("last", "block").alias("block")), "names")

    forms = F.explode(F.array_compact(F.array_distinct(F.array(bare("canon"), h.swapped_name_key(F.col("canon"))))))
    asked = left.select("name", "block", forms.alias("a"))
    scored = similar(asked.select("block", "a").distinct(), right.select("block", "b").distinct(), FUZZY_LEAST - FUZZY_GAP, ["block"])
    best = asked.join(scored.hint("merge"), ["block", "a"]).groupBy("name", "block", "b").agg(F.max("score").alias("score"))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "player")
    ranked = best.join(right.hint("merge"), ["block", "b"]).select("name", "player", "score", F.row_number().over(w).alias("k"), F.lead("score").over(w).alias("next"))
    clear = (F.col("score") >= FUZZY_SURE) | (F.col("score") >= FUZZY_LEAST) & (F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 9) >= FUZZY_GAP)
    single = left.where(~F.contains("canon", F.lit(" "))).join(sizes.where("players = 1").hint("merge"), "block").join(right.hint("merge"), ["block", "player"])
    alone = single.select("name", "player", F.round(jaro_winkler(bare("canon"), F.col("b")), 6).alias("score"))
    found = ranked.where((F.col("k") == 1) & clear).select("name", "player", F.round("score", 6).alias("score"))
    return found.join(alone.hint("merge"), "name", "left_anti").unionByName(alone)


def rate_fuzzy(rows: DataFrame, ratings: DataFrame, players: DataFrame, name: str, date: Column, order: list[str]) -> DataFrame:
    """(order, rating) for rows with a month, by the player (name) whom their name resembles."""
    dated = rows.withColumn("_m", h.year_month(date)).where("_m is not null").select(*order, F.col(name).alias("name"), F.col("_m.year").alias("year"), F.col("_m.month").alias("month"))
    like = fuzzy_names(dated.where("name is not null").select("name"), players).select("name", h.name_key(F.col("player")).alias("name_key"))
    return dated.join(like.hint("merge"), "name").join(rating_months(ratings).hint("merge"), ["name_key", "year", "month"]).select(*order, "rating")


def add_ratings(games: DataFrame, ratings: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """``games`` with WhiteElo and BlackElo filled in where absent, from the rating of the month. What no key finds is
    looked up by resemblance to ``players`` (name) or the names in ``ratings``; keys alone have no last names."""
    out, order = games, ["source_file", "seq"]
    if players is None and "name" in ratings.columns:
        players = ratings.select("name")
    for side in ("White", "Black"):
        lack = out.where(h.blank(h.tag(f"{side}Elo"))).select(*order, h.tag(side).alias("_name"), h.tag("Date").alias("_date"))
        found = rate_asof(lack, ratings, "_name", F.col("_date"), order)
        if players is not None:
            rest = lack.join(found, order, "left_anti")
            found = found.unionByName(rate_fuzzy(rest, ratings, players, "_name", F.col("_date"), order))
        out = out.join(found.withColumnRenamed("rating", "_elo"), order, "left")
        out = h.with_headers(out, h.set_tag(F.col("headers"), f"{side}Elo", F.col("_elo").cast("string"))).drop("_elo")
    return out


def release_of(rows: DataFrame, day: str, releases: DataFrame) -> DataFrame:
    """``rows`` with the name of the release whose interval holds ``day`` (the earliest start if there are several).

    The release table is a few dozen rows; it is broadcast after a check, and the join is by year, so that no day meets
    all intervals."""
    years = releases.select(F.col("name").alias("release"), "start", "end", F.explode(F.sequence(F.year("start"), F.year("end"))).alias("_year"))
    days = rows.select(day).where(F.col(day).isNotNull()).distinct().withColumn("_year", F.year(day))
    met = days.join(small(years), "_year").where(F.col(day).between(F.col("start"), F.col("end")))
    best = met.groupBy(day).agg(F.min_by("release", F.struct("start", "release")).alias("release"))
    return rows.join(best, day, "left")


def cutoff_ranges(cutoffs: DataFrame) -> DataFrame:
    """(name, start, end) of versions that hold until the next one starts. A row per version."""
    w = Window.orderBy("start", "version")
    return cutoffs.select(F.col("version").alias("name"), "start", F.coalesce(F.date_sub(F.lead("start").over(w), 1), F.lit("2262-01-01").cast("date")).alias("end")).where(F.col("end") >= F.col("start"))


def version_at(rows: DataFrame, day: str, cutoffs: DataFrame, default: str) -> DataFrame:
    """``rows`` with the last version that started by ``day``."""
    out = release_of(rows, day, cutoff_ranges(cutoffs))
    return out.withColumn("version", F.coalesce("release", F.lit(default))).drop("release")


def normalize_engines(games: DataFrame, releases: DataFrame, as_of_year: int) -> DataFrame:
    """``games`` whose development builds of an engine, in White and Black, are named by their release."""
    out = games
    for side in ("White", "Black"):
        out = release_of(out.withColumn("_day", h.engine_build_date(h.tag(side), as_of_year)), "_day", releases)
        out = h.with_headers(out, h.set_tag(F.col("headers"), side, F.col("release"))).drop("release", "_day")
    return out


def rewrite_engine_match(games: DataFrame, match_id: Column, day: Column, version: Column) -> DataFrame:
    """Event, Date, White and Black of the games of one landed engine match."""
    head = h.set_tag(F.col("headers"), "Event", F.concat(F.lit("Lc0 match "), match_id.cast("string")))
    head = h.set_tag(head, "Date", F.date_format(day, "yyyy-MM-dd"))
    for side in ("White", "Black"):
        head = h.set_tag(head, side, F.concat(F.lit("Lc0 "), version))
    return h.with_headers(games, head)
