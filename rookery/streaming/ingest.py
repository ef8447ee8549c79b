"""Incremental jobs: new PGN files through filters, and new payload games into a table without duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.collections import deduplicate_by_keys
from ..operators.tables import saved
from ..sources.pgn import PgnSource
from .key_index import KeyIndex


def stream_pgn(spark: SparkSession, landing: str, **options: str) -> DataFrame:
    """Games of files as they land, each file by byte ranges that are tasks of their own; with ``bytesPerBatch`` and
    ``progress`` a large file takes several batches. All per-game operators apply to the result."""
    spark.dataSource.register(PgnSource)
    return spark.readStream.format("pgn").options(path=landing, **options).load()


def ingest(games: DataFrame, sink: str, checkpoint: str, through: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Takes in what has landed since the last run and ends; exactly once by the file sink's log."""
    return through(games).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_new(payload: DataFrame, sink: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Streams payload games (with keys, source_file, seq) into ``sink``/games, leaving out any whose key is there.

    Each batch writes to a folder of its own number, and its keys to ``sink``/index (``KeyIndex``), so a batch that is run
    again replaces itself. What earlier batches have is found through the index, without reading it whole."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index = KeyIndex(spark, f"{sink}/index", buckets)
        of = lambda df: df.select(F.explode("keys").alias("key")).distinct()
        batch = saved(batch, "batch")
        fresh = deduplicate_by_keys(batch, "keys", ["source_file", "seq"], index.known(of(batch), number))
        fresh.write.mode("overwrite").parquet(f"{sink}/games/batch={number}")
        index.add(of(spark.read.schema(batch.schema).parquet(f"{sink}/games/batch={number}")), number)

    return payload.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
