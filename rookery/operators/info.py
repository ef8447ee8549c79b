"""Summary of a collection of games."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import movetext as mt
from ..functions.headers import blank, eco_class, elo, info_date, player, tag, year_text
from .tables import saved

#: The tags that name a country.
COUNTRY_TAGS = ("WhiteCountry", "BlackCountry", "WhiteFederation", "BlackFederation", "WhiteFed", "BlackFed")


def info_key():
    """Event, site and year, in their own case."""
    part = lambda n: F.when(blank(tag(n)), F.lit("?")).otherwise(tag(n))
    return F.concat_ws("|", part("Event"), part("Site"), year_text(tag("Date")))


def pgn_info(games: DataFrame, dialect: str = "info") -> DataFrame:
    """One row with the counts of a collection."""
    base = games.select(
        info_key().alias("k"),
        F.replace(F.coalesce(tag("Result"), F.lit("")), F.lit(" "), F.lit("")).alias("r"),
        elo("WhiteElo").alias("we"),
        elo("BlackElo").alias("be"),
        info_date().alias("d"),
        eco_class(tag("ECO")).alias("e"),
        mt.ply_count(F.col("movetext"), dialect).alias("p"),
        F.upper(player(tag("White"))).alias("w"),
        F.upper(player(tag("Black"))).alias("b"),
        F.array_compact(F.array(*(F.upper(player(tag(t))) for t in COUNTRY_TAGS))).alias("c"),
    )
    base = saved(base, "info")  # four aggregates read a column or two each; games are parsed once
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    r, we, be = F.col("r"), F.col("we"), F.col("be")
    known = n(we.isNotNull()) + n(be.isNotNull())
    one = base.agg(
        F.count("*").alias("games"),
        n(r == "1-0").alias("white_wins"),
        n(r == "0-1").alias("black_wins"),
        n(r == "1/2-1/2").alias("draws"),
        n(r == "*").alias("star_results"),
        n(r == "").alias("missing_results"),
        n(~r.isin("1-0", "0-1", "1/2-1/2", "*", "")).alias("other_results"),
        n(r.isin("*", "")).alias("incomplete"),
        F.round((F.coalesce(F.sum(we), F.lit(0)) + F.coalesce(F.sum(be), F.lit(0))) / F.nullif(known, F.lit(0)), 6).alias("elo_avg"),
        F.least(F.min(we), F.min(be)).alias("elo_min"),
        F.greatest(F.max(we), F.max(be)).alias("elo_max"),
        n(we.isNotNull() | be.isNotNull()).alias("elo_any"),
        n(we.isNotNull() & be.isNotNull()).alias("elo_both"),
        F.min("d").alias("min_date"),
        F.max("d").alias("max_date"),
        n(F.col("d").isNull()).alias("missing_dates"),
        n(F.col("e.missing")).alias("eco_missing"),
        n(F.col("e.invalid")).alias("eco_invalid"),
        F.round(F.avg(F.when(F.col("p") > 0, F.col("p"))), 6).alias("plies_avg"),
        F.min(F.when(F.col("p") > 0, F.col("p"))).alias("plies_min"),
        F.max(F.col("p")).alias("plies_max"),
        n(F.col("p") > 0).alias("with_moves"),
        n(F.col("p") == 0).alias("without_moves"),
    )
    distinct = lambda c, name: base.select(c.alias("x")).where("x is not null").agg(F.countDistinct("x").alias(name))
    out = one.crossJoin(distinct(F.explode(F.array("w", "b")), "players"))  # one row each
    return out.crossJoin(distinct(F.col("k"), "tournaments")).crossJoin(distinct(F.explode("c"), "countries"))


def eco_letters(games: DataFrame) -> DataFrame:
    return games.select(eco_class(tag("ECO"))["letter"].alias("letter")).where("letter is not null").groupBy("letter").agg(F.count("*").alias("games"))


def eco_top(games: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent codes; ties by code."""
    codes = games.select(eco_class(tag("ECO"))["code"].alias("code")).where("code is not null")
    return codes.groupBy("code").agg(F.count("*").alias("games")).orderBy(F.desc("games"), "code").limit(k)


def tournament_completeness(games: DataFrame) -> DataFrame:
    """Games and incomplete games by tournament."""
    open_ = F.replace(F.coalesce(tag("Result"), F.lit("")), F.lit(" "), F.lit("")).isin("*", "")
    return games.groupBy(info_key().alias("tournament")).agg(F.count("*").alias("games"), F.sum(open_.cast("long")).alias("incomplete"))


def incomplete_tournaments(games: DataFrame) -> DataFrame:
    return tournament_completeness(games).agg(F.count("*").alias("tournaments"), F.coalesce(F.sum((F.col("incomplete") > 0).cast("long")), F.lit(0)).alias("incomplete_tournaments"))
