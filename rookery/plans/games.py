"""A games table, and plies, derived from the driver's tables; GAMES and PLIES are their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import HEADER_TYPE
from ..operators.lookups import small

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")

#: The columns of a game but for its moves, from an order, its first line and what they refer to.
HEADS = """o_orderkey AS game_id, p_type || ' ' || p_brand AS event, n_name AS site,
    CAST(year(o_orderdate) AS STRING) || '.' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '.' ||
      CASE WHEN o_orderkey % 7 = 0 THEN '??' ELSE lpad(CAST(day(o_orderdate) AS STRING), 2, '0') END AS date,
    'Round ' || CAST(o_orderkey % 23 AS STRING) AS round, c_name AS white, s_name AS black,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 2200 + 800 AS STRING) END AS white_elo,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 2200 + 800 AS STRING) END AS black_elo,
    CASE l_returnflag || l_linestatus WHEN 'RO' THEN '1-0' WHEN 'RF' THEN '0-1' WHEN 'AF' THEN '1/2-1/2' WHEN 'AO' THEN '*' WHEN 'NO' THEN '' ELSE '1-0' END AS result,
    CASE WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 17 = 0 THEN 'X1' ELSE substr('ABCDE', CAST(l_partkey % 5 + 1 AS INT), 1) || lpad(CAST(l_partkey % 100 AS STRING), 2, '0') END AS eco,
    CASE WHEN o_orderkey % 6 <> 0 THEN substr(n_name, 1, 3) END AS white_fed,
    CASE WHEN o_orderkey % 10 = 0 THEN 'Chess960' WHEN o_orderkey % 10 = 1 THEN 'Standard' WHEN o_orderkey % 10 = 2 THEN '?' END AS variant,
    CASE WHEN o_orderkey % 8 = 0 THEN CAST(60 + o_orderkey % 300 AS STRING) || '+0' WHEN o_orderkey % 8 = 1 THEN '-' END AS time_control"""

#: All but the moves; ``first`` is an order's first line by its full order.
GAMES = """
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS rn FROM lineitem),
heads AS (
  SELECT """ + HEADS + """
  FROM orders JOIN lines ON l_orderkey = o_orderkey AND rn = 1 JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN part ON p_partkey = l_partkey JOIN nation ON n_nationkey = s_nationkey),
moves AS (
  SELECT l_orderkey AS k, rn,
    CAST(rn AS STRING) || '. ' || substr('abcdefgh', CAST(l_suppkey % 8 + 1 AS INT), 1) || CAST(l_partkey % 8 + 1 AS STRING) ||
    CASE WHEN rn % 4 = 1 THEN ' {[%eval 0.25] #3}' WHEN rn % 4 = 2 THEN ' $1' ELSE '' END || CASE WHEN rn % 5 = 2 THEN ' (' || CAST(rn AS STRING) || '. a3 b6#)' ELSE '' END ||
    ' N' || substr('abcdefgh', CAST(l_partkey % 8 + 1 AS INT), 1) || CAST(l_suppkey % 8 + 1 AS STRING) || CASE WHEN l_partkey % 10 = 0 THEN '#' ELSE '' END AS t
  FROM lines)
"""
DUCK = f"WITH {GAMES}, games AS (SELECT heads.*, movetext FROM heads JOIN (SELECT k, string_agg(t, ' ' ORDER BY rn) AS movetext FROM moves GROUP BY k) m ON k = game_id)"

PLIES = """
plies AS (
  SELECT user_id AS game_id, CAST(ply AS INT) AS ply, ply % 2 = 1 AS is_white, event_type IN ('view', 'click') AS is_quiet,
    CASE WHEN event_id % 9 <> 0 THEN CAST(CAST(floor(value * 100) AS BIGINT) % 900 - 450 AS INT) END AS eval_white_cp,
    CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 ELSE 0 END AS blunder, CASE WHEN event_type = 'error' AND event_id % 5 = 1 THEN 1 ELSE 0 END AS mistake,
    CASE WHEN event_type = 'error' AND event_id % 5 = 2 THEN 1 ELSE 0 END AS dubious, 3900 - CAST(event_id % 7 AS INT) * 100 AS white_material, 3900 - CAST(event_id % 5 AS INT) * 160 AS black_material,
    substr('abcdefgh', CAST(event_id % 8 + 1 AS INT), 1) || CAST(user_id % 8 + 1 AS STRING) AS san
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ply FROM events) e)
"""


def _views(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def lines_of(lineitem: DataFrame) -> DataFrame:
    """(l_orderkey, first, movetext): the lines of each order, grouped once. ``first`` is the first by their full order."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    own = F.array_sort(F.collect_list(F.struct(*order, "l_returnflag", "l_linestatus")))
    letter = lambda c: F.substring(F.lit("abcdefgh"), (c % 8 + 1).cast("int"), 1)
    digit = lambda c: (c % 8 + 1).cast("string")

    def move(x: Column, k: Column) -> Column:
        rn, part, supplier = k + 1, x["l_partkey"], x["l_suppkey"]
        mark = F.when(rn % 4 == 1, " {[%eval 0.25] #3}").when(rn % 4 == 2, " $1").otherwise("")
        aside = F.when(rn % 5 == 2, F.concat(F.lit(" ("), rn.cast("string"), F.lit(". a3 b6#)"))).otherwise("")
        mate = F.when(part % 10 == 0, "#").otherwise("")
        return F.concat(rn.cast("string"), F.lit(". "), letter(supplier), digit(part), mark, aside, F.lit(" N"), letter(part), digit(supplier), mate)

    grouped = lineitem.groupBy("l_orderkey").agg(own.alias("own"))
    return grouped.select("l_orderkey", F.get("own", F.lit(0)).alias("first"), F.array_join(F.transform("own", move), " ").alias("movetext"))


def met(rows: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """``rows`` joined to a table of keys: broadcast if a count finds that small, else both are shuffled. The size of
    its files, by which Spark would choose, is a small part of that of its rows in the driver's memory."""
    least = small(other)
    return rows.join(other.hint("shuffle_hash") if least is other else least, on)


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived games as columns, with their moves: what GAMES says, but each line is read and shuffled once."""
    t = _views(spark, sf_dir, TABLES)
    equal = lambda a, b: F.col(a) == F.col(b)
    orders = met(t["orders"].select("o_orderkey", "o_custkey", "o_orderdate"), t["customer"].select("c_custkey", "c_name", "c_acctbal"), equal("o_custkey", "c_custkey"))
    rows = orders.drop("o_custkey", "c_custkey").hint("merge").join(lines_of(t["lineitem"]), equal("l_orderkey", "o_orderkey"))
    rows = rows.select("o_orderkey", "o_orderdate", "c_name", "c_acctbal", *(f"first.{c}" for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")), "movetext")
    rows = met(rows, t["part"].select("p_partkey", "p_type", "p_brand"), equal("p_partkey", "l_partkey"))
    suppliers = t["supplier"].join(F.broadcast(t["nation"]), equal("n_nationkey", "s_nationkey"))
    rows = met(rows, suppliers.select("s_suppkey", "s_name", "s_acctbal", "n_name"), equal("s_suppkey", "l_suppkey"))
    return spark.sql(f"SELECT {HEADS}, movetext FROM {{rows}}", rows=rows)


NAMES = {"event": "Event", "site": "Site", "date": "Date", "round": "Round", "white": "White", "black": "Black", "white_elo": "WhiteElo", "black_elo": "BlackElo", "result": "Result", "eco": "ECO", "white_fed": "WhiteFed", "variant": "Variant", "time_control": "TimeControl"}


def headed(spark: SparkSession, sf_dir: str, asked: tuple[str, ...] | None = None) -> DataFrame:
    """The derived games without tags, which are to be made of other headers. ``asked``: the headers to make, if not all."""
    named = ((c, n) for c, n in NAMES.items() if asked is None or n in asked)
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.col(c).alias("value")) for c, n in named)).cast(HEADER_TYPE)
    pairs = F.filter(pairs, lambda x: x["value"].isNotNull())
    return heads(spark, sf_dir).select("game_id", F.lit("orders").alias("source_file"), F.col("game_id").alias("seq"), pairs.alias("headers"), "movetext")


def games(spark: SparkSession, sf_dir: str, asked: tuple[str, ...] | None = None) -> DataFrame:
    """The derived games in the shape of ``read_pgn``, and game_id; with no headers and tags but those ``asked``, if given."""
    out = headed(spark, sf_dir, asked)
    tags = F.map_from_entries(F.transform("headers", lambda x: F.struct(F.lower(x["key"]), x["value"])))
    return out.select("*", F.inline(F.array(F.struct(tags.alias("tags")))))  # made once, as in with_headers


def plies(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = f"WITH {PLIES} SELECT * FROM plies".replace("FROM events)", "FROM {events})")
    return spark.sql(sql, **_views(spark, sf_dir, ("events",)))
