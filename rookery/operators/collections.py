"""Operators over whole collections: sort, split, merge, deduplicate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import movetext as mt
from ..functions.headers import drop_tags, natural_key, safe_file_name, set_tag, tag, with_headers
from .tables import new_folder, saved, shared_folder

SORT_KEYS = ("Event", "Site", "Date", "Round", "White", "Black", "ECO")
CHAIN_KEYS = 1_000_000


def need_checkpoints(spark: SparkSession) -> None:
    """Lets ``checkpoint`` work where the cluster names no shared folder, as in tests."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def sort_games(games: DataFrame, criteria: list[str]) -> DataFrame:
    """Natural order that ignores case by the named headers (missing: ""), then input order; a range sort."""
    if unknown := set(criteria) - set(SORT_KEYS):
        raise ValueError(f"unknown sort keys {sorted(unknown)}")
    return games.orderBy(*(natural_key(tag(c)) for c in criteria), "source_file", "seq") if criteria else games


def global_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Numbers rows from 0 in the given order: sorted ranges are counted, then each adds what lies before it.

    The sorted rows are written with their places, since a sort that is run again may cut its ranges elsewhere."""
    ranged = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    ranged = saved(ranged, "sorted")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_mono").alias("_least"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    counts = counts.select("_part", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = ranged.join(F.broadcast(counts), "_part")
    return out.withColumn(name, F.col("_mono") - F.col("_least") + F.col("_before")).drop("_part", "_mono", "_least", "_before")


def numbered(games: DataFrame, criteria: list[str], name: str = "rank", keep: list[str] | None = None) -> DataFrame:
    """``games`` with their places from 0 in the order of ``sort_games``, computed without one task seeing all. With
    ``keep`` only these columns, source_file and seq are sorted and stay."""
    if unknown := set(criteria) - set(SORT_KEYS):
        raise ValueError(f"unknown sort keys {sorted(unknown)}")
    keyed = games.withColumns({f"_sort{k}": natural_key(tag(c)) for k, c in enumerate(criteria)})
    order = [*(f"_sort{k}" for k in range(len(criteria))), "source_file", "seq"]
    if keep is not None:
        keyed = keyed.select(*dict.fromkeys([*keep, *order]))
    return global_index(keyed, order, name).drop(*order[:-2])


def chunk_name(chunk: Column) -> Column:
    return F.format_string("games_chunk_%04d", chunk)


def split_chunks(games: DataFrame, size: int) -> DataFrame:
    """``games`` with ``bucket``: chunks of ``size`` games in input order."""
    if size < 1:
        raise ValueError("a chunk holds at least one game")
    out = global_index(games, ["source_file", "seq"], "_index")
    return out.withColumn("bucket", chunk_name(F.floor(F.col("_index") / size) + 1)).drop("_index")


def split_by_header(games: DataFrame, header: str) -> DataFrame:
    return games.withColumn("bucket", safe_file_name(F.coalesce(tag(header), F.lit("Unknown"))))


def date_bucket(date: Column, precision: str) -> Column:
    """century 19xx, decade 199x, year, month or day of a date; x stands for what is unknown."""
    d = F.replace(F.coalesce(F.nullif(F.trim(date), F.lit("")), F.lit("????.??.??")), F.lit("?"), F.lit("x"))
    parts = F.split(d, r"[./-]")
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit("xx"))
    year = F.rpad(F.get(parts, F.lit(0)), 4, "x")
    out = {"century": F.concat(F.substring(year, 1, 2), F.lit("xx")), "decade": F.concat(F.substring(year, 1, 3), F.lit("x")), "year": year, "month": F.concat_ws("-", year, at(1)), "day": F.concat_ws("-", year, at(1), at(2))}
    return out[precision]


def split_by_date(games: DataFrame, precision: str = "year") -> DataFrame:
    return games.withColumn("bucket", date_bucket(tag("Date"), precision))


def split_summary(split: DataFrame) -> DataFrame:
    """Games and files of a split; names that differ in case only are one file."""
    return split.agg(F.count("*").alias("games"), F.countDistinct(F.upper("bucket")).alias("files"))


def merge(parts: list[DataFrame]) -> DataFrame:
    """All games, with ``file_rank`` for the order of the parts."""
    if not parts:
        raise ValueError("nothing to merge")
    return reduce(DataFrame.unionByName, (p.withColumn("file_rank", F.lit(k)) for k, p in enumerate(parts)))


def month_order(file: Column) -> list[Column]:
    """Order of files by the yyyy-mm in their names; those without one last, by name."""
    month = F.nullif(F.regexp_extract(file, r"(\d{4}-\d{2})", 1), F.lit(""))
    return [month.isNull(), month, file]


def add_ply_counts(games: DataFrame) -> DataFrame:
    """``games`` with their number of plies as the last tag, PlyCount, in place of one that was there."""
    counted = games.withColumn("_plies", mt.ply_count(F.col("movetext"), "tag").cast("string"))
    return with_headers(counted, set_tag(drop_tags(F.col("headers"), "PlyCount"), "PlyCount", F.col("_plies"))).drop("_plies")


def identity_hash() -> Column:
    """SHA-256 of headers, sorted by key without regard to case, and moves."""
    pairs = F.array_sort(F.transform("headers", lambda x: F.struct(F.lower(x["key"]).alias("k"), F.concat(x["key"], F.lit(":"), x["value"]).alias("t"))))
    head = F.array_join(F.transform(pairs, lambda x: x["t"]), "|")
    return F.sha2(F.concat(head, F.lit("||"), F.array_join(mt.book_moves(F.col("movetext")), " ")), 256)


def first_of(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key. What is grouped is a key and an order, combined before the shuffle, so that a hot key
    costs one row per task."""
    first = df.select(*order, key.alias("_key")).groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(saved(first.select(F.col("_first.*")), "first"), order, "left_semi")


def deduplicate(games: DataFrame) -> DataFrame:
    """The first of equal games by (source_file, seq), which must be unique."""
    return first_of(games, identity_hash(), ["source_file", "seq"])


def _judged(rows: DataFrame) -> DataFrame:
    """Rows (_at, _key, _taken), some keys of which are taken, judged one after the other in one task: (_at) of rows that
    stay, and (_key) of all that is taken then."""
    whole = rows.groupBy("_at").agg(F.collect_list(F.struct("_key", "_taken")).alias("_keys")).repartition(1).sortWithinPartitions("_at")
    types = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: dict = {}
        for batch in batches:
            stays = []
            for own in batch.column(1).to_pylist():
                taken.update((x["_key"]["key"], x["_key"]) for x in own if x["_taken"])
                keys = {x["_key"]["key"]: x["_key"] for x in own}
                stays.append(taken.keys().isdisjoint(keys))
                if stays[-1]:
                    taken |= keys
            at = batch.column(0).filter(pa.array(stays, pa.bool_()))
            yield pa.RecordBatch.from_arrays([at, pa.nulls(len(at), key_type)], names=["_at", "_key"])
        keys = pa.array(list(taken.values()), key_type)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), at_type), keys], names=["_at", "_key"])

    at_type, key_type = to_arrow_type(types["_at"].dataType), to_arrow_type(types["_key"].dataType)
    return whole.mapInArrow(run, rows.select("_at", "_key").schema)


def _in_order(each: DataFrame, keys: int) -> DataFrame:
    """(_at) of the rows that stay, by passing decisions on in time.

    Rows are cut into ranges of their order with about ``CHAIN_KEYS`` keys. Ranges are judged in turn, a task each; what a
    range takes, or learns to be taken, it sends to the next range that has the key, as a row on disk. So each key meets
    its own ranges only, a task holds one range and its mail, and the number of rounds is that of the ranges."""
    n = -(-keys // CHAIN_KEYS)
    spark = each.sparkSession
    path = new_folder(spark, "ranges")
    each.repartitionByRange(n, "_at").withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(f"{path}/rows")
    rows = spark.read.schema(each.withColumn("_range", F.lit(0)).schema).parquet(f"{path}/rows")
    places = rows.select("_key", "_range").distinct()
    following = F.lead("_range").over(Window.partitionBy("_key").orderBy("_range"))
    places.withColumn("_next", following).where("_next is not null").write.partitionBy("_range").parquet(f"{path}/routes")
    routes = spark.read.schema(places.select("_key", F.lit(0).alias("_next"), "_range").schema).parquet(f"{path}/routes")
    mail_schema, kept = places.select("_key", F.lit(0).alias("_from"), F.lit(0).alias("_range")).schema, []
    ranges = sorted(r["_range"] for r in places.select("_range").distinct().collect())  # n numbers at most
    for k in ranges:
        own = rows.where(F.col("_range") == k).select("_at", "_key")
        mail = spark.read.schema(mail_schema).parquet(f"{path}/mail").where(F.col("_range") == k).select("_key").distinct() if kept else places.limit(0).select("_key")
        out = saved(_judged(own.join(mail.withColumn("_taken", F.lit(True)), "_key", "left").select("_at", "_key", F.coalesce("_taken", F.lit(False)).alias("_taken"))), "judged")
        news = out.where("_at is null").select("_key").join(routes.where(F.col("_range") == k).select("_key", "_next"), "_key")
        news.select("_key", F.col("_next").alias("_range")).write.partitionBy("_range").parquet(f"{path}/mail/_from={k}")
        kept.append(out.where("_at is not null").select("_at"))
    return reduce(DataFrame.union, kept)


def deduplicate_by_keys(games: DataFrame, keys: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Greedy deduplication in order: a row goes if any of its keys was taken by a kept row, or is in ``existing`` (key).

    Rows that come first on all their keys stay; rows that share a key with them go; the rest is looked at again. Nearly
    always one round settles all or most. When a round leaves more than half of its keys, rows hang in chains, and the
    rest is settled in the order of the rows (``_in_order``). So there are at most as many rounds as the number of keys
    has binary digits, and then one for each ``CHAIN_KEYS`` keys.

    Defined cases: a null among the keys is a key, equal to other nulls as in GROUP BY; a row without keys stays.
    """
    need_checkpoints(games.sparkSession)
    games = games.withColumn("_at", F.struct(*order))
    keyless = F.col(keys).isNull() | (F.size(keys) == 0)
    as_key = lambda c: F.struct(F.col(c).alias("key")).alias("_key")  # noqa: E731  # structs are equal where both hold null
    each = games.select("_at", F.explode(F.array_distinct(F.col(keys))).alias("_k")).select("_at", as_key("_k"))
    if existing is not None:
        hit = each.join(existing.select(as_key("key")).distinct(), "_key", "left_semi").select("_at").distinct()
        each = each.join(hit, "_at", "left_anti").select("_at", "_key")
    each, kept = each.checkpoint(), []
    left = each.count()
    while left:
        first = each.groupBy("_key").agg(F.min("_at").alias("_first"))
        judged = each.join(first, "_key").groupBy("_at").agg(F.bool_and(F.col("_first") == F.col("_at")).alias("_stays"))
        stays = judged.where("_stays").select("_at").checkpoint()
        kept.append(stays)
        taken = each.join(stays, "_at", "left_semi").select("_key").distinct()
        gone = each.join(taken, "_key", "left_semi").select("_at").distinct()
        each = each.join(gone, "_at", "left_anti").select("_at", "_key").checkpoint()
        before, left = left, each.count()
        if left >= before:
            raise RuntimeError(f"a round of deduplication settled none of {left} keys")
        if left * 2 > before:
            kept.append(_in_order(each, left))
            break
    alone = games.where(keyless)
    if not kept:
        return alone.drop("_at")
    return games.where(~keyless).join(reduce(DataFrame.union, kept), "_at", "left_semi").unionByName(alone).drop("_at")


def distinct_ignoring_case(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.lower(F.trim(F.col(column))).alias("_key")).agg(F.min(column).alias(column)).drop("_key")
