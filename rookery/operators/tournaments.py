"""Event categories and extraction of qualifying tournaments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import blank, integer, key_hash, leading_elo, player, set_tag, slug, tag, tournament_date, with_headers, year_text
from ..sources.pgn_files import write_files
from .lookups import small
from .tables import saved


def category_key() -> Column:
    """Event, site, date, section and stage without regard to case; null without an event."""
    part = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    date = F.when(blank(tag("EventDate")), tag("Date")).otherwise(tag("EventDate"))
    return F.when(~blank(tag("Event")), F.concat_ws("\u001f", *map(part, (tag("Event"), tag("Site"), date, tag("Section"), tag("Stage")))))


def keyed(games: DataFrame) -> DataFrame:
    """``games`` with the key of their event and their sides, written, so that what is counted from them reads no more.
    Their tags go, since headers have them."""
    sides = F.array(*(F.struct(F.upper(player(tag(s))).alias("player"), leading_elo(f"{s}Elo").alias("elo")) for s in ("White", "Black")))
    return saved(games.withColumns({"key": category_key(), "_sides": sides}).drop("tags"), "keyed")


def best_ratings(keyed_games: DataFrame) -> DataFrame:
    """(key, player, best) and games per key: the highest rating of each player at each event."""
    rows = keyed_games.select("key", F.explode("_sides").alias("x")).where("key is not null and x.player is not null")
    return rows.groupBy("key", F.col("x.player").alias("player")).agg(F.max("x.elo").alias("best"))


def event_categories(keyed_games: DataFrame) -> DataFrame:
    """(key, category): 1 for an average of 2251 to 2275, and so on, of events of six games and enough of them."""
    played = keyed_games.where("key is not null").groupBy("key").agg(F.count("*").alias("games"))
    rated = best_ratings(keyed_games).where("best is not null").groupBy("key").agg(F.count("*").alias("players"), F.avg("best").alias("mean"))
    both = played.join(rated, "key")
    good = "games >= 6 and players >= 2 and 2.0 * games / players >= 0.6 and mean >= 2251"
    return both.where(good).select("key", (1 + F.floor((F.col("mean") - 2251) / 25)).cast("int").alias("category"))


def tag_categories(games: DataFrame) -> DataFrame:
    """``games`` with the EventCategory tag after Event where the event has a category."""
    own = keyed(games)
    out = own.join(small(saved(event_categories(own), "categories")), "key", "left")
    return with_headers(out, set_tag(F.col("headers"), "EventCategory", F.col("category").cast("string"), after="Event")).drop("key", "category", "_sides")


def spelled_key() -> Column:
    """Event, site, and the date of the event, else the year; white space collapsed."""
    tidy = lambda c: F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit(" ")), r"\s+", " "))
    whole = F.when(~F.coalesce(tag("EventDate"), F.lit("?")).contains("?"), tournament_date(tag("EventDate")))
    return F.concat_ws("|", tidy(tag("Event")), tidy(tag("Site")), F.coalesce(whole.cast("string"), year_text(tag("Date"))))


def breaker_key() -> Column:
    """``spelled_key`` without regard to case."""
    return F.upper(spelled_key())


def qualified_tournaments(games: DataFrame, min_elo: int, min_games: int) -> DataFrame:
    """(key, games, players, least, most, file_name) of tournaments all of whose games are between rated players."""
    if min_games < 1 or min_elo < 0:
        raise ValueError("at least one game, and no negative rating")
    rating = lambda s: integer(tag(f"{s}Elo"))
    rows = games.select(
        breaker_key().alias("key"),
        F.upper(F.trim(tag("White"))).alias("w"),
        F.upper(F.trim(tag("Black"))).alias("b"),
        rating("White").alias("we"),
        rating("Black").alias("be"),
        tournament_date(tag("Date")).alias("d"),
        spelled_key().alias("spelled"),
        tag("Event").alias("event"),
        tag("Site").alias("site"),
        year_text(tag("Date")).alias("year"),
        F.struct("source_file", "seq").alias("at"),
    )
    ok = F.coalesce((F.col("we") >= min_elo) & (F.col("be") >= min_elo), F.lit(False))
    named = ~blank(F.col("w")) & ~blank(F.col("b"))
    first = lambda c: F.min_by(c, "at").alias(c)
    one = rows.groupBy("key").agg(
        F.count("*").alias("games"),
        F.bool_and(ok & named).alias("all_ok"),
        F.least(F.min("we"), F.min("be")).alias("lowest"),
        F.greatest(F.max("we"), F.max("be")).alias("highest"),
        F.min("d").alias("first_day"),
        F.max("d").alias("last_day"),
        *map(first, ("event", "site", "year", "spelled")),
    )
    one = one.where(F.col("all_ok") & (F.col("games") >= min_games))
    players = rows.select("key", F.explode(F.array("w", "b")).alias("p")).groupBy("key").agg(F.countDistinct("p").alias("players"))
    out = one.join(players, "key").where("players >= 2 and games >= greatest(1, ceil(players / 2))")
    name = F.concat_ws("-", F.col("lowest").cast("string"), F.col("highest").cast("string"), slug(F.col("event"), 80), slug(F.col("site"), 40), "year", key_hash(F.col("spelled")))  # of the key as first seen
    return out.withColumn("file_name", F.concat(name, F.lit(".pgn"))).select("key", "games", "players", "lowest", "highest", "first_day", "last_day", "file_name")


def break_tournaments(games: DataFrame, min_elo: int, min_games: int) -> DataFrame:
    """Games of qualified tournaments, with the name of their file."""
    names = checked_names(saved(qualified_tournaments(games, min_elo, min_games), "tournaments")).select("key", "file_name")
    return games.withColumn("key", breaker_key()).join(names, "key").drop("key")


def write_tournaments(games: DataFrame, path: str, min_elo: int, min_games: int) -> int:
    """A file per qualified tournament below ``path``; returns their number. No file appears unless all do."""
    return write_files(break_tournaments(games, min_elo, min_games), path, "file_name")[1]


def checked_names(tournaments: DataFrame) -> DataFrame:
    """``tournaments``; an error if two of them would go to one file, before anything is written."""
    if twice := name_collisions(tournaments).limit(5).collect():
        raise ValueError(f"several tournaments for the files {sorted(r['file_name'] for r in twice)}")
    return tournaments


def name_collisions(tournaments: DataFrame) -> DataFrame:
    return tournaments.groupBy("file_name").agg(F.countDistinct("key").alias("keys")).where("keys > 1")
