"""Jobs over payloads that have landed as files: ledgers, player sets, enrichment, crawl frontiers, link tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import blank, elo, set_tag, tag, with_headers
from ..functions.similarity import clean_name
from .collections import need_checkpoints

LEDGER = "timestamp_utc string, event_id int, status string, http_status int, bytes long, games int, message string, url string, output_kind string"
DEAD = ("Missing", "Gone", "NonPgn")


def ledger_status(c: Column) -> Column:
    """The status of a fetch, read without regard to case, hyphens and blanks; Error for any other text."""
    x = F.lower(F.translate(F.trim(c), "- ", ""))
    named = {"Success": ("success",), "Missing": ("missing",), "Gone": ("gone",), "NonPgn": ("nonpgn", "nonpgnfile"), "SkippedByPattern": ("skippedbypattern",)}
    out = F.lit(None).cast("string")
    for name, aliases in named.items():
        out = F.when(x.isin(*aliases), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("Error"))


def read_ledger(spark, path: str) -> DataFrame:
    raw = spark.read.schema(LEDGER).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return raw.withColumn("status", ledger_status(F.col("status")))


def dead_residues(ledger: DataFrame, modulus: int = 5, least: int = 20) -> DataFrame:
    """(residue, dead): residues of ids with many dead fetches and no success."""
    n = lambda c: F.sum(c.cast("long"))
    out = ledger.groupBy(F.pmod("event_id", F.lit(modulus)).cast("int").alias("residue")).agg(n(F.col("status").isin(*DEAD)).alias("dead"), n(F.col("status") == "Success").alias("successes"))
    return out.where((F.col("dead") >= least) & (F.col("successes") == 0)).select("residue", "dead")


def resume(candidates: DataFrame, ledger: DataFrame, modulus: int = 5) -> DataFrame:
    """``candidates`` (event_id) with the reason to skip, null where there is work: fetched, dead, or its residue is."""
    state = ledger.groupBy("event_id").agg(F.max((F.col("status") == "Success").cast("int")).alias("won"), F.max(F.col("status").isin(*DEAD).cast("int")).alias("lost"))
    out = candidates.join(state, "event_id", "left").withColumn("residue", F.pmod("event_id", F.lit(modulus)).cast("int"))
    out = out.join(F.broadcast(dead_residues(ledger, modulus)), "residue", "left")  # at most ``modulus`` rows
    reason = F.when(F.col("won") == 1, "success").when(F.col("lost") == 1, "dead").when(F.col("dead").isNotNull(), "residue")
    return out.select("event_id", reason.alias("skip"))


def unprocessed(seeds: DataFrame, processed: DataFrame, cap: int = 500_000, output_has_games: bool = True) -> DataFrame:
    """Sorted, distinct seeds (user) that were not processed; ``cap`` is the crawl's own limit."""
    key = lambda d: d.select(F.lower(F.trim("user")).alias("user")).where("user <> ''").distinct()
    left = key(seeds)
    if output_has_games:
        left = left.join(key(processed), "user", "left_anti")
    return left.orderBy("user").limit(cap)


def game_keys(payload: DataFrame) -> DataFrame:
    """``payload`` with its identity keys: uuid, url, else the Link tag, else the whole text."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    url = F.regexp_replace(low("url"), "/+$", "")
    link = F.lower(F.regexp_replace(F.regexp_extract("pgn", r'(?m)^\[Link "([^"]*)"\]', 1), "/+$", ""))
    named = F.array_compact(F.array(F.when(low("uuid") != "", F.concat(F.lit("uuid:"), low("uuid"))), F.when(url != "", F.concat(F.lit("url:"), url))))
    other = F.array(F.when(link != "", F.concat(F.lit("url:"), link)).otherwise(F.concat(F.lit("pgn:"), F.sha2(F.replace(F.col("pgn"), F.lit("\r\n"), F.lit("\n")), 256))))
    return payload.withColumn("keys", F.when(F.size(named) > 0, named).otherwise(other))


def profiles(players: DataFrame) -> DataFrame:
    """(user, real_name, fide): names are cleaned once each."""
    names = players.select("name").distinct().withColumn("real_name", clean_name(F.col("name")))
    return players.join(names, "name", "left").groupBy(F.lower(F.trim("username")).alias("user")).agg(F.max("real_name").alias("real_name"), F.max("fide").alias("fide"))


def enrich_players(games: DataFrame, known: DataFrame, require_real_names: bool = False) -> DataFrame:
    """``games`` with real names for users, and known ratings for ratings that were there."""
    # what the joins ask of tags goes with the headers, the tags themselves do not: they are made anew
    out = games.withColumns({f"_user{s}": F.lower(F.trim(tag(s))) for s in ("White", "Black")} | {f"_rated{s}": elo(f"{s}Elo").isNotNull() for s in ("White", "Black")}).drop("tags")
    for side in ("White", "Black"):
        mine = known.toDF(f"_user{side}", f"_name{side}", f"_fide{side}")
        out = out.join(mine, f"_user{side}", "left").drop(f"_user{side}")
    if require_real_names:
        out = out.where("_nameWhite is not null and _nameBlack is not null")
    head = F.col("headers")
    for side in ("White", "Black"):
        head = set_tag(head, side, F.col(f"_name{side}"))
        head = set_tag(head, f"{side}Elo", F.when(F.col(f"_rated{side}") & (F.col(f"_fide{side}") > 0), F.col(f"_fide{side}").cast("string")))
    return with_headers(out, head).drop("_nameWhite", "_fideWhite", "_nameBlack", "_fideBlack", "_ratedWhite", "_ratedBlack")


def frontier(edges: DataFrame, seeds: DataFrame, levels: int, cap: int | None = None) -> DataFrame:
    """(player, level) reached from ``seeds`` (player) over ``edges`` (player, opponent), a level at a time. The set of
    visited players stays a table; the driver sees only whether a level found anyone."""
    need_checkpoints(edges.sparkSession)
    visited = seeds.select("player").distinct().withColumn("level", F.lit(0)).checkpoint()
    last = visited
    for level in range(1, levels + 1):
        found = edges.join(last.select("player"), "player").select(F.col("opponent").alias("player")).distinct()
        last = found.join(visited, "player", "left_anti").withColumn("level", F.lit(level))
        if cap is not None:
            last = last.orderBy("player").limit(max(0, cap - visited.count()))
        last = last.checkpoint()
        if last.isEmpty():
            break
        visited = visited.union(last).checkpoint()
    return visited


def extract_links(pages: DataFrame, pattern: str = r"\.(zip|pgn)$") -> DataFrame:
    """(page_id, url, position): links of a page to files on its own host, distinct, at their first place."""
    hrefs = pages.select("page_id", F.col("url").alias("page"), F.posexplode(F.expr(r"regexp_extract_all(html, '(?i)href\\s*=\\s*[\"\']([^\"\'#]+)', 1)")).alias("position", "href"))
    host, scheme = F.regexp_extract("page", r"^(https?)://([^/?#]+)", 2), F.regexp_extract("page", r"^(https?)://", 1)
    whole = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("//"), F.concat(scheme, F.lit(":"), "href"))
    whole = whole.when(F.col("href").startswith("/"), F.concat(scheme, F.lit("://"), host, F.col("href"))).otherwise(F.concat(F.regexp_replace(F.regexp_extract("page", r"^[^?#]*", 0), r"(?<=[^/:]/)[^/]*$", ""), "href"))
    out = hrefs.select("page_id", whole.alias("url"), host.alias("host"), "position").where(F.regexp_extract("url", r"^https?://([^/?#]+)", 1) == F.col("host"))
    return out.where(F.lower("url").rlike(pattern)).groupBy("page_id", "url").agg(F.min("position").alias("position"))


#: How index pages write dates.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "MMM d, yyyy", "MMM dd, yyyy", "M/d/yyyy", "MM/dd/yyyy")


def match_table(pages: DataFrame) -> DataFrame:
    """(match_id, run_id, day) from table rows of index pages; rows that do not parse go."""
    rows = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("r"))
    cells = rows.select(F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))).alias("c"))
    number = lambda k: F.get("c", F.lit(k)).try_cast("int")
    text = F.substring_index(F.try_element_at("c", F.lit(-1)), "T", 1)
    day = F.coalesce(*(F.try_to_date(text, f) for f in DATE_FORMATS))
    return cells.where("size(c) >= 3").select(number(0).alias("match_id"), number(1).alias("run_id"), day.alias("day")).where("match_id is not null and run_id is not null and day is not null")


def eligible_payload(payload: DataFrame, least: int, most: int) -> DataFrame:
    from .filters import both_in_band

    return payload.where(both_in_band(F.col("white"), F.col("black"), least, most) & ~blank(F.col("pgn")))
