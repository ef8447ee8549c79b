"""Whole jobs: PGN files in, PGN files under their names out, with the counters of each.

Each job parses its input once, into a table of the shared folder, since most of them go over it more than once. Outputs
appear when the job commits; a target that was there is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import movetext as mt
from .operators import collections as co
from .operators import filters, lookups, tournaments
from .operators.tables import saved
from .sources import pgn_files
from .sources.pgn import read_pgn

ORDER = ("source_file", "seq")


def _games(spark: SparkSession, source: str | list[str]) -> tuple[DataFrame, int]:
    games = saved(read_pgn(spark, source), "games")
    return games, games.count()


def _write(games: DataFrame, target: str, order: tuple[str, ...] = ORDER) -> int:
    folder, _, name = target.rpartition("/")
    return pgn_files.write_files(games, folder or ".", F.lit(name), order=order)[0]


def _kept(spark: SparkSession, source: str, target: str, through: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    games, n = _games(spark, source)
    kept = _write(through(games), target)
    return {"processed": n, "kept": kept, "removed": n - kept}


def filter_file(spark: SparkSession, source: str, target: str, **options) -> dict[str, int]:
    """``filters.filter_games`` with its options."""
    return _kept(spark, source, target, lambda games: filters.filter_games(games, **options))


def checkmates_file(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    return _kept(spark, source, target, filters.filter_checkmates)


def deduplicate_file(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    return _kept(spark, source, target, co.deduplicate)


def sort_file(spark: SparkSession, source: str, target: str, criteria: list[str]) -> dict[str, int]:
    return _kept_in(spark, source, target, lambda games: co.numbered(games, criteria, "_rank"), ("_rank",))


def _kept_in(spark: SparkSession, source: str, target: str, through: Callable[[DataFrame], DataFrame], order: tuple[str, ...]) -> dict[str, int]:
    games, n = _games(spark, source)
    return {"processed": n, "kept": _write(through(games), target, order)}


def split_file(spark: SparkSession, source: str, folder: str, by: str = "Event", *, size: int = 1000, precision: str = "year") -> dict[str, int]:
    """A file per value of a header, per chunk of ``size`` games (by="chunk") or per date (by="Date")."""
    games, _ = _games(spark, source)
    split = co.split_chunks(games, size) if by == "chunk" else co.split_by_date(games, precision) if by == "Date" else co.split_by_header(games, by)
    n, files = pgn_files.write_split(split, folder)
    return {"games": n, "files": files}


def join_files(spark: SparkSession, sources: list[str], target: str) -> dict[str, int]:
    """One file of all games, in the order of the sources; paths that differ in case only are one."""
    first: dict[str, str] = {}
    for s in sources:
        first.setdefault(s.lower(), s)
    own = list(first.values())
    ranks = spark.createDataFrame([(pgn_files.folder(s)[1], k) for k, s in enumerate(own)], "source_file string, file_rank int")
    games, n = _games(spark, own)
    folder, _, name = target.rpartition("/")
    kept = pgn_files.write_joined(games.join(ranks, "source_file"), folder or ".", name)
    return {"games": kept, "files": len(own)}


def break_tournaments_file(spark: SparkSession, source: str, folder: str, min_elo: int, min_games: int) -> dict[str, int]:
    games, n = _games(spark, source)
    return {"processed": n, "files": tournaments.write_tournaments(games, folder, min_elo, min_games)}


def tag_openings_file(spark: SparkSession, source: str, book: str, target: str) -> dict[str, int]:
    lines = lookups.opening_book(read_pgn(spark, book))
    return _kept_in(spark, source, target, lambda games: lookups.tag_openings(games, lines), ORDER)


def add_ply_counts_file(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    return _kept_in(spark, source, target, co.add_ply_counts, ORDER)


def unannotate_file(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    return _kept_in(spark, source, target, lambda games: games.withColumn("movetext", mt.unannotated(F.col("movetext"))), ORDER)
