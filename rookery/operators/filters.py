"""Predicates over games and landed payloads, and the filter jobs made of them.

Predicates are Column expressions over ``tags`` and ``movetext`` (or over payload structs), so header tests run before
any text is scanned and reach the scan where the source allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import movetext as mt
from ..functions.headers import blank, elo, integer, tag


def check_range(least: int | None, most: int | None, what: str) -> None:
    """Raises ValueError for a negative bound or bounds in the wrong order."""
    if any(x is not None and x < 0 for x in (least, most)):
        raise ValueError(f"{what} must not be negative")
    if least is not None and most is not None and most < least:
        raise ValueError(f"the greatest {what} is below the least")


def _or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def elo_range(least: int | None = None, most: int | None = None, require_both: bool = False) -> Column:
    """Without bounds all games pass. Else at least one rating is known, the higher one reaches ``least``, and no known
    one exceeds ``most``; ``require_both`` asks for two ratings in the range."""
    check_range(least, most, "rating")
    if least is None and most is None:
        return F.lit(True)
    w, b = elo("WhiteElo"), elo("BlackElo")
    lo, hi = F.lit(least or 0), F.lit(most if most is not None else 2**31 - 1)
    if require_both:
        return _or_false(w.between(lo, hi) & b.between(lo, hi))
    return _or_false((F.greatest(w, b) >= lo) & (F.greatest(w, b) <= hi))


def archive_min_elo(least: int) -> Column:
    """Drops a game only if both ratings are known and one is not enough for neither: both below ``least``."""
    return ~_or_false((elo("WhiteElo") < least) & (elo("BlackElo") < least))


def both_in_band(white: Column, black: Column, least: int, most: int) -> Column:
    """Both ratings (null: 0) of a payload are in the band; both players must be there."""
    one = lambda p: p.isNotNull() & F.coalesce(p["rating"], F.lit(0)).between(least, most)
    return one(white) & one(black)


def standard_filter() -> Column:
    v = F.lower(F.trim(tag("Variant")))
    named = ~(v.isin("", "?", "unknown")) & (v.contains("standard") | v.contains("classical") | v.contains("normal"))
    plain = ~_or_false(F.trim(tag("SetUp")) == "1") & blank(tag("FEN"))
    return F.when(tag("Variant").isNotNull(), _or_false(named)).otherwise(plain)


def standard_archive() -> Column:
    return blank(tag("Variant")) | _or_false(F.lower(F.trim(tag("Variant"))).isin("standard", "chess", "from position"))


def standard_user() -> Column:
    return blank(tag("Variant")) | _or_false(F.lower(F.trim(tag("Variant"))) == "standard")


def standard_engine() -> Column:
    set_up = _or_false(F.trim(tag("SetUp")) == "1") | ~blank(tag("FEN"))
    return ~set_up & (blank(tag("Variant")) | _or_false(F.lower(F.trim(tag("Variant"))).isin("standard", "chess")))


def mate_archive() -> Column:
    return _or_false(F.lower(tag("Termination")).contains("checkmate")) | _or_false(F.col("movetext").contains("#"))


def mate_user() -> Column:
    return _or_false(F.col("movetext").contains("#"))


def not_bullet_archive() -> Column:
    return ~_or_false(F.regexp_extract(F.trim(tag("TimeControl")), r"^\d+", 0).try_cast("int") < 180)


def not_bullet_user() -> Column:
    base = F.get(F.split(F.trim(tag("TimeControl")), r"\+"), F.lit(0))
    return ~(_or_false(F.lower(tag("Event")).contains("bullet")) | _or_false(integer(base) < 180))


def not_bullet_payload(time_class: Column, time_control: Column) -> Column:
    seconds = F.when(~time_control.contains("/"), F.regexp_extract(time_control, r"^\d+", 0).try_cast("int"))
    return ~F.when(~blank(time_class), F.lower(F.trim(time_class)) == "bullet").otherwise(_or_false(seconds < 180))


def user_won(user: str) -> Column:
    same = lambda name: F.lower(F.trim(tag(name))) == user.strip().lower()
    return _or_false(same("White") & (tag("Result") == "1-0")) | _or_false(same("Black") & (tag("Result") == "0-1"))


def user_won_payload(user: str) -> Column:
    won = lambda p: _or_false((F.lower(p["username"]) == user.lower()) & (F.lower(p["result"]) == "win"))
    return won(F.col("white")) | won(F.col("black"))


def mated_payload() -> Column:
    return _or_false(F.lower(F.col("white.result")) == "checkmated") | _or_false(F.lower(F.col("black.result")) == "checkmated")


def in_month(day: Column, year: int, month: int) -> Column:
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    return _or_false(F.exists(F.array(day), lambda d: d.between(first, F.last_day(first))))


def payload_class(body: Column) -> Column:
    """AuthRequired for a login page, NonPgn for what is no game text (it begins with a tag, names an event or a site and
    has no page around it), else Success."""
    low = F.lower(F.coalesce(body, F.lit("")))
    login = low.contains("login_and_go") | low.contains("/login") | low.contains("sign in")
    page = low.contains("<html") | low.contains("<!doctype")
    game = low.rlike("^[\\uFEFF\\r\\n\\t ]*\\[") & ~page & (low.contains("[event ") | low.contains("[site "))
    return F.when(login, F.lit("AuthRequired")).when(game, F.lit("Success")).otherwise(F.lit("NonPgn"))


def games_in_payload(body: Column) -> Column:
    """Lines that begin a game."""
    return F.regexp_count(F.coalesce(body, F.lit("")), F.lit(r"(?im)^\[Event "))


def titled_tuesday(body: Column) -> Column:
    return F.coalesce(body, F.lit("")).rlike(r"(?im)^\[Event .*Titled Tuesday")


def filter_games(
    games: DataFrame,
    *,
    min_elo: int | None = None,
    max_elo: int | None = None,
    require_both: bool = False,
    standard_only: bool = False,
    checkmates_only: bool = False,
    min_plies: int | None = None,
    max_plies: int | None = None,
    strip: bool = False,
) -> DataFrame:
    """Games that pass all tests; ``strip`` takes annotations out and tells in ``modified`` where it changed anything."""
    check_range(min_plies, max_plies, "ply count")
    out = games.where(elo_range(min_elo, max_elo, require_both))
    if standard_only:
        out = out.where(standard_filter())
    if checkmates_only:
        out = out.where(mate_user()).where(mt.has_mate(F.col("movetext")))  # the cheap test first
    if min_plies is not None or max_plies is not None:
        plies = mt.ply_count(F.col("movetext"), "filter")
        out = out.where(F.exists(F.array(plies), lambda n: n.between(min_plies or 0, max_plies if max_plies is not None else 2**31 - 1)))  # counted once
    if strip:
        out = out.withColumn("_text", mt.strip(F.col("movetext")))
        out = out.withColumn("modified", F.col("_text") != F.col("movetext")).withColumn("movetext", F.col("_text")).drop("_text")
    return out


def filter_checkmates(games: DataFrame) -> DataFrame:
    return filter_games(games, checkmates_only=True)


def filter_archive(games: DataFrame, least: int) -> DataFrame:
    return games.where(archive_min_elo(least) & standard_archive() & not_bullet_archive() & mate_archive())


def filter_user_games(games: DataFrame, user: str) -> DataFrame:
    return games.where(user_won(user) & standard_user() & not_bullet_user() & mate_user())


def filter_user_payload(payload: DataFrame, user: str) -> DataFrame:
    """Kept games of landed user payloads (pgn, rules, time_class, time_control, white, black)."""
    good = ~blank(F.col("pgn")) & user_won_payload(user) & mated_payload() & (F.col("rules") == "chess")
    return payload.where(good & not_bullet_payload(F.col("time_class"), F.col("time_control")))


def filter_engine_matches(games: DataFrame, day: Column, year: int, month: int) -> DataFrame:
    return games.where(in_month(day, year, month) & standard_engine() & mate_archive())


def counted(df: DataFrame, observation, **flags: Column) -> DataFrame:
    """``df`` with counters (rows, and rows where each flag holds) that arrive with the job itself."""
    sums = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(k) for k, c in flags.items()]
    return df.observe(observation, F.count(F.lit(1)).alias("processed"), *sums)
