"""Column functions over game headers: lookup and rewriting of tags, dates, names, keys, codes, evaluations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_TYPE = "array<struct<key:string,value:string>>"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def tag(name: str) -> Column:
    """The value of a header, by name in any case; null if the game has none."""
    return F.element_at(F.col("tags"), F.lit(name.lower()))


def tags_of(headers: Column | str) -> Column:
    """Lower-cased key to value; of keys that differ in case only, the last wins."""
    h = F.col(headers) if isinstance(headers, str) else headers
    keys = F.transform(h, lambda x: F.lower(x["key"]))
    slow = F.aggregate(
        h,
        F.expr("cast(map() as map<string,string>)"),
        lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(x["key"])), F.create_map(F.lower(x["key"]), x["value"])),
    )
    plain = F.map_from_entries(F.transform(h, lambda x: F.struct(F.lower(x["key"]), x["value"])))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), plain).otherwise(slow)  # the map is made once where it can be


def set_tag(headers: Column, name: str, value: Column, after: str | None = None) -> Column:
    """Headers with a tag replaced in place, or added after another or last; a null value changes nothing. ``headers`` are
    made once, so that tags set in turn cost a pass each."""
    return once(headers, lambda own: F.when(value.isNull(), own).otherwise(_set(own, name, value, after)))


def _set(headers: Column, name: str, value: Column, after: str | None) -> Column:
    key = F.lower(F.lit(name))
    has = F.exists(headers, lambda x: F.lower(x["key"]) == key)
    pair = F.struct(F.lit(name).alias("key"), value.alias("value"))
    replaced = F.transform(headers, lambda x: F.when(F.lower(x["key"]) == key, F.struct(x["key"].alias("key"), value.alias("value"))).otherwise(x))
    if after is None:
        added = F.concat(headers, F.array(pair))
    else:
        at = F.array_position(F.transform(headers, lambda x: F.lower(x["key"])), F.lit(after.lower())).cast("int")
        at = F.when(at == 0, F.size(headers)).otherwise(at)
        added = F.concat(F.slice(headers, F.lit(1), at), F.array(pair), F.slice(headers, at + 1, F.greatest(F.size(headers) - at, F.lit(0))))
    return F.when(has, replaced).otherwise(added)


def drop_tags(headers: Column, prefix: str) -> Column:
    """Headers without those whose names begin with ``prefix``, in any case."""
    return F.filter(headers, lambda x: ~F.lower(x["key"]).startswith(prefix.lower()))


def with_headers(df, headers: Column):
    """``df`` with new headers, and tags to match. Tags are generated, so that later tests of tags read a map that is
    made once and don't make it again each."""
    out = df.withColumn("headers", headers).drop("tags")
    return out.select("*", F.inline(F.array(F.struct(tags_of(F.col("headers")).alias("tags")))))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def integer(c: Column) -> Column:
    """A whole number with optional sign and blanks around it, else null."""
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.expr("1") * F.trim(c).try_cast("int"))


def elo(name: str) -> Column:
    """A positive rating, else null."""
    return once(tag(name), lambda c: once(integer(c), lambda x: F.when(x > 0, x)))


def leading_elo(name: str) -> Column:
    """The positive number that a rating begins with."""
    x = F.regexp_extract(F.trim(F.coalesce(tag(name), F.lit(""))), r"^\d+", 0).try_cast("int")
    return once(x, lambda y: F.when(y > 0, y))


def full_date(c: Column) -> Column:
    """A complete calendar date with . / or - between year, month and day."""
    p = r"^\s*(\d{1,4})[./-](\d{1,2})[./-](\d{1,2})\s*$"
    part = lambda k, n: F.lpad(F.regexp_extract(c, p, k), n, "0")
    return F.when(c.rlike(p), F.try_to_date(F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)), "yyyy-MM-dd"))


def tournament_date(c: Column) -> Column:
    """A complete calendar date with a year of four digits and the same . / or - twice."""
    return F.when(c.rlike(r"^\s*\d{4}([./-])\d{1,2}\1\d{1,2}\s*$"), full_date(c))


def info_date() -> Column:
    """Date, or EventDate where there is no Date; null if anything in it is unknown."""
    raw = F.when(blank(tag("Date")), tag("EventDate")).otherwise(tag("Date"))
    return once(raw, lambda x: F.when(~x.contains("?"), full_date(x)))


def year_month(c: Column) -> Column:
    """struct(year, month) of a date whose day may be unknown."""
    parts = F.split(F.trim(c), r"[./-]")
    y, m = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    return F.when((y >= 1) & m.between(1, 12), F.struct(y.alias("year"), m.alias("month")))


def year_text(c: Column) -> Column:
    return once(F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, 4), lambda y: F.when(y.rlike(r"^\d{4}$"), y).otherwise(F.lit("????")))


def player(c: Column) -> Column:
    """A trimmed name; null if blank, ? or unknown."""
    return once(F.trim(c), lambda x: F.when(~(x.isin("", "?") | (F.lower(x) == "unknown")), x))


def safe_file_name(c: Column) -> Column:
    """A name that file systems take: reserved characters become _, no trailing dots or spaces, Unknown if blank."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1F]', "_")
    x = F.regexp_replace(F.trim(x), r"[. ]+$", "")
    return F.when(x == "", F.lit("Unknown")).otherwise(x)


def slug(c: Column, most: int) -> Column:
    x = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    x = F.regexp_replace(x, "^-+|-+$", "")
    return F.regexp_replace(F.substring(x, 1, most), "-+$", "")


def key_hash(c: Column) -> Column:
    """The first twelve bytes of SHA-256, in hex."""
    return F.substring(F.sha2(c, 256), 1, 24)


def eco_class(c: Column) -> Column:
    """struct(letter, code, missing, invalid): a lone letter counts both as its letter and as invalid."""
    x = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    letter = F.when(x.rlike("^[A-E]"), F.substring(x, 1, 1))
    code = F.when(x.rlike("^[A-E][0-9]{2}"), F.substring(x, 1, 3))
    return F.struct(letter.alias("letter"), code.alias("code"), (x == "").alias("missing"), ((x != "") & code.isNull()).alias("invalid"))


MATE = 100_000


def eval_centipawns(comment: Column) -> Column:
    """The first [%eval] of a comment in centipawns from White's side; a mate in n is 100000 - 100 n at least."""
    token = F.regexp_extract(comment, r"\[%eval\s+([^\s\],]+)", 1)
    n = F.regexp_extract(token, r"^#([+-]?\d+)$", 1).try_cast("int")
    mate = F.when(F.startswith(token, F.lit("#-")), F.lit(-1)).otherwise(F.lit(1)) * F.when(n.isNotNull(), F.lit(MATE) - 100 * F.least(F.lit(999), F.abs(n)))
    pawns = F.when(token.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.round(token.try_cast("double") * 100))
    return F.coalesce(mate, F.when(pawns.isNotNull(), F.greatest(F.lit(-MATE), F.least(F.lit(MATE), pawns.cast("int")))))


def eval_text(cp: Column) -> Column:
    """#n for a mate in less than a hundred moves, else pawns with two digits; null for null."""
    n = ((F.lit(MATE) - F.abs(cp)) / 100).cast("int")
    mate = F.concat(F.when(cp < 0, F.lit("#-")).otherwise(F.lit("#")), n.cast("string"))
    return F.when(F.abs(cp) > MATE - 10_000, mate).when(cp.isNotNull(), F.format_string("%.2f", cp / 100))


def move_quality(mover_delta: Column) -> Column:
    """The NAG of a move by what it lost its player, in centipawns."""
    return F.when(mover_delta <= -300, F.lit("$4")).when(mover_delta <= -150, F.lit("$2")).when(mover_delta <= -60, F.lit("$6"))


def band(x: Column, p10: float, p90: float, higher_is_better: bool = True) -> Column:
    """Place of x between two percentiles, 0 to 100."""
    if p90 <= p10:
        return F.lit(50.0)
    t = (x - p10) / (p90 - p10)
    t = t if higher_is_better else 1 - t
    return 100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def length_penalty(plies: Column) -> Column:
    return F.when(plies <= 160, F.lit(0.0)).otherwise(100 * (1 - 1 / (1 + F.exp(-(plies - 160) / 30.0))))


#: Centipawns of the pieces.
PIECES = {"P": 100, "N": 320, "B": 330, "R": 500, "Q": 900}


def material(fen: Column, white: bool) -> Column:
    """Centipawns of one side's pieces on the board of a FEN."""
    board = F.get(F.split(fen, " "), F.lit(0))
    count = lambda c: F.length(board) - F.length(F.replace(board, F.lit(c), F.lit("")))
    return sum((count(p if white else p.lower()) * v for p, v in PIECES.items()), F.lit(0))


def black_to_move(fen: Column) -> Column:
    return F.coalesce(F.get(F.split(F.trim(fen), r"\s+"), F.lit(1)) == "b", F.lit(False))


def engine_build_date(name: Column, as_of_year: int) -> Column:
    """The date in the name of a development build, written yyMMdd or yyyyMMdd."""
    digits = F.regexp_extract(name, r"(?i)Stockfish.*?(\b\d{6}\b|\b\d{8}\b)", 1)
    day = F.try_to_date(F.when(F.length(digits) == 6, F.concat(F.lit("20"), digits)).when(F.length(digits) == 8, digits), "yyyyMMdd")
    return F.when(F.year(day).between(2008, as_of_year + 1), day)


def name_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), "[ ,]", ""))


def _tokens(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))), " "), "")


def canonical_name(c: Column) -> Column:
    return F.array_join(_tokens(c), " ")


def swapped_name_key(c: Column) -> Column:
    """The key with the last word first: "Ann Lee" meets "Lee, Ann"."""
    t = _tokens(c)
    return F.when(F.size(t) > 1, F.concat(F.element_at(t, -1), F.array_join(F.slice(t, F.lit(1), F.size(t) - 1), "")))


def last_name_key(c: Column) -> Column:
    """What stands before a comma, else the last word."""
    before = F.when(c.contains(","), F.get(F.split(c, ","), F.lit(0)))
    return F.coalesce(F.nullif(F.array_join(_tokens(before), ""), F.lit("")), F.try_element_at(_tokens(c), F.lit(-1)))


def natural_key(c: Column) -> Column:
    """A key whose order is natural and ignores case: numbers by value, then by leading zeros, before letters."""
    runs = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(r"\d+|\D+"), F.lit(0))

    def encode(run: Column) -> Column:
        value = F.regexp_replace(run, "^0+(?=.)", "")
        number = F.concat(F.lit("0"), F.lpad(F.length(value).cast("string"), 4, "0"), value, F.lpad(F.length(run).cast("string"), 4, "0"))
        return F.when(run.rlike(r"^\d"), number).otherwise(run)

    return F.array_join(F.transform(runs, encode), "")
