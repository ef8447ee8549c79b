"""Monthly and user payloads that have landed as JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import setting
from .pgn import parse_texts
from .pgn_files import write_files

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
PLAYER = "struct<username:string,rating:int,result:string>"
SCHEMA = f"games array<struct<url:string,uuid:string,pgn:string,time_class:string,time_control:string,rules:string,white:{PLAYER},black:{PLAYER}>>"


def read_month(spark: SparkSession, path: str) -> DataFrame:
    """A row per game of the payloads, with the file and the place in it."""
    # folders are listed by a few tasks for each core, not by one each
    with setting(spark, LISTING, str(4 * max(spark.sparkContext.defaultParallelism, 8))):
        raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.col("_metadata.file_path").alias("source_file"), F.posexplode("games").alias("seq", "g")).select("source_file", F.col("seq").cast("long"), "g.*")


def payload_games(payload: DataFrame) -> DataFrame:
    """The games in the texts of payload rows (source_file, seq, pgn), in their order; their source_file is
    file#place, so that the two stay in order. Rows without text have none."""
    place = F.concat_ws("#", "source_file", F.lpad(F.col("seq").cast("string"), 12, "0"))
    return parse_texts(payload.where(F.trim(F.coalesce("pgn", F.lit(""))) != "").select(place.alias("source_file"), F.col("pgn").alias("value")))


def write_months(payload: DataFrame, path: str, name: Callable[[Column], Column], **options) -> tuple[int, int]:
    """PGN files of the payload's games; ``name`` makes a file's name of the name of the payload file it comes from."""
    landed = F.regexp_replace("source_file", r"#\d+$", "")
    return write_files(payload_games(payload), path, name(landed), **options)
