"""Secret scanning with multipart credential linking, with DataFrame functions only.

Strong spans (assign, access, hex) are reported wherever they occur. Weak candidates (id: login names and client ids;
key: unlabelled high-entropy strings; endpoint: addresses of services) are ordinary text by themselves; they are
reported only when complementary parts start within ``scope`` code points of them: an id needs a secret (assign, hex
or key), a key needs an identifier (access or id), an endpoint needs both.

Linking is an interval join: parts are binned by start, each bin reduced to the least and greatest start per role, and
every candidate meets at most three such rows (its own bin and the neighbours) per role, so a text with thousands of
parts makes no pairs. Positions come from the lengths of a text's matches and of what is between them, summed in blocks
of a square root of their number; candidates that touch strong spans, and the text between spans that are redacted, come
from running maxima over the sorted parts of a text. So the work on a text with n parts grows as n log n or n ** 1.5.

Defined cases: a null text counts as empty and has no spans. Repeated rows get equal results. Columns of the input that
are not named here are left alone; internal names begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import saved

SCOPE = 200
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
IDENT = r"""(?i:\b(?:access_?key_?id|client_?id|user_?name|user|login|account))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
KEY = r"(?<![A-Za-z0-9+/=_.-])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""(?i:\b(?:https?|ftp|s3|jdbc:[a-z]{1,20}|postgres|postgresql|mysql|mongodb|redis|amqp)://)[^\s"'<>]+"""
#: Kinds in their order among spans that start alike; the first three are reported unconditionally.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
STRONG = KINDS[:3]
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "ident", "id": "ident", "endpoint": "endpoint"}
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: A written table of at most so many rows of linked spans (24 bytes each, and a key) is broadcast.
BROADCAST_ROWS = 200_000
FEW = 32


def _matches(text: Column, pattern: str, kind: str, good=None) -> Column:
    """The spans of leftmost non-overlapping matches, in code points; ``good`` tells which matches stay."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern), F.lit(1), F.size(found))
    stays = good or (lambda m: F.lit(True))
    steps = F.zip_with(between, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), stays(m).alias("stays")))
    none = F.array().cast(SPAN)

    def spans_of(steps: Column, begin: Column) -> Column:
        def step(done: Column, x: Column) -> Column:
            start = done["at"] + x["gap"]
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + x["len"]).alias("end"))
            return F.struct((start + x["len"]).alias("at"), F.concat(done["out"], F.when(x["stays"], F.array(span)).otherwise(none)).alias("out"))

        return F.aggregate(steps, F.struct(begin.alias("at"), none.alias("out")), step, lambda x: x["out"])

    def in_blocks(steps: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(steps))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(steps), width), lambda k: F.slice(steps, k, width))
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["len"]))
        begins = F.aggregate(lengths, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), spans_of))

    # bound to a name by transform, so that it is worked out once
    spans = F.flatten(F.transform(F.array(steps), in_blocks))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(none)


def _label(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` (strong spans in order) and ``_weak`` (candidates)."""
    t = F.coalesce(F.col(text), F.lit(""))
    long_enough = lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}$", 2)) >= 6
    out = docs.withColumns(
        {
            "_assign": _matches(t, ASSIGN, "assign", long_enough),
            "_access": _matches(t, ACCESS, "access"),
            "_hex": _matches(t, HEX, "hex"),
            "_weak": F.concat(_matches(t, IDENT, "id"), _matches(t, KEY, "key"), _matches(t, ENDPOINT, "endpoint")),
        }
    )
    return out.withColumn("_base", F.sort_array(F.concat("_assign", "_access", "_hex"))).drop("_assign", "_access", "_hex")


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """From (_key, _base, _weak): a row per key that has reported candidates, with them as ``_linked``. Candidates that
    touch a strong span are none."""
    roles = F.array(*(F.lit(ROLE[k]) for k in KINDS))
    some = parts.where((F.size("_weak") > 0) & (F.size("_weak") + F.size("_base") > 1))
    each = some.select("_key", F.explode(F.concat("_base", "_weak")).alias("p")).select("_key", "p.*").distinct()
    strong, by = F.col("kind") < len(STRONG), Window.partitionBy("_key")
    reached = F.max(F.when(strong, F.col("end"))).over(by.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    follows = F.min(F.when(strong, F.col("start"))).over(by.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    each = each.withColumns({"_reached": reached, "_follows": follows})
    touches = (F.col("_reached") > F.col("start")) | (F.col("_follows") < F.col("end"))
    each = each.where(strong | ~F.coalesce(touches, F.lit(False))).drop("_reached", "_follows")
    each = each.withColumns({"_role": F.get(roles, F.col("kind")), "_bin": F.floor(F.col("start") / scope)})
    near = each.groupBy("_key", "_bin", "_role").agg(F.min("start").alias("_lo"), F.max("start").alias("_hi"))
    weak = each.where(F.col("kind") >= len(STRONG)).withColumn("_bin", F.explode(F.array(*(F.col("_bin") + k for k in (-1, 0, 1)))))
    near = near.withColumnsRenamed({"_role": "_other"})
    met = weak.join(near, ["_key", "_bin"]).where((F.col("_hi") >= F.col("start") - scope) & (F.col("_lo") <= F.col("start") + scope))
    has = lambda role: F.max((F.col("_other") == role).cast("int")) == 1
    met = met.groupBy("_key", "start", "kind", "end", "_role").agg(has("secret").alias("s"), has("ident").alias("i"))
    needs = (
        F.when(F.col("_role") == "ident", F.col("s")).when(F.col("_role") == "secret", F.col("i")).otherwise(F.col("s") & F.col("i"))
    )
    return met.where(needs).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("_linked"))


def _key(text: str) -> Column:
    return F.struct(F.xxhash64(text).alias("h"), F.length(text).alias("n"))


def _with_linked(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """Left join of the reported candidates; they are broadcast only after a count of the written table."""
    linked = saved(linked, "linked-spans")
    if linked.select(F.coalesce(F.sum(F.size("_linked")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        linked = F.broadcast(linked)
    out = rows.join(linked, "_key", "left")
    return out.withColumn("_linked", F.coalesce("_linked", F.array().cast(SPAN)))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """A row per row of ``docs``: doc_id, counts of strong spans, base_sha256, n_linked, and all spans as text."""
    parts = find_parts(docs.select("doc_id", "text", _key("text").alias("_key"))).drop("text")
    parts = saved(parts, "secret-parts")
    out = _with_linked(parts.drop("_weak"), link(parts, scope))
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in STRONG),
        F.sha2(_label(F.col("_base")), 256).alias("base_sha256"),
        _label(F.sort_array(F.concat("_base", "_linked"))).alias("spans"),
        F.size("_linked").cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark``, and ``n_chars`` (if there is one) to match."""
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("text").alias("_text"), _key("text").alias("_key"))
    parts = saved(find_parts(packed.select("_key", "_text"), "_text").drop("_text").where("size(_base) + size(_weak) > 0").dropDuplicates(["_key"]), "secret-parts")
    strong = parts.select("_key", F.explode("_base").alias("p"))
    spans = strong.union(link(parts, scope).select("_key", F.explode("_linked"))).select("_key", "p.start", "p.end")
    before = F.max("end").over(Window.partitionBy("_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_from", F.coalesce(before, F.lit(0)))
    # what stays: from the end of all earlier spans to the next one, and what follows the last
    gaps = F.collect_list(F.when(F.col("_from") <= F.col("start"), F.struct(F.col("_from").alias("start"), F.lit(0).alias("kind"), F.col("start").alias("end"))))
    last = F.struct(F.max("end").alias("start"), F.lit(0).alias("kind"), F.first("_key.n").alias("end"))
    gaps = spans.groupBy("_key").agg(F.sort_array(F.concat(gaps, F.array(last))).alias("_linked"))
    out = _with_linked(packed, gaps)
    size = lambda x: x["end"] - x["start"]
    few = F.transform("_linked", lambda x: F.substring(F.col("_text"), x["start"] + 1, size(x)))
    # a substring is sought from the beginning of the text; for many of them the text is taken apart once
    chars = lambda c, x: F.array_join(F.transform(F.sequence(x["start"], x["start"] + size(x) - 1), lambda k: F.get(c, k)), "")  # noqa: E731  # slice copies its array
    many = F.flatten(F.transform(F.array(F.split("_text", F.lit(""))), lambda c: F.transform("_linked", lambda x: F.when(size(x) > 0, chars(c, x)).otherwise(""))))
    clean = F.array_join(F.when(F.size("_linked") <= FEW, few).otherwise(many), mark)
    out = out.withColumn("_clean", F.when(F.size("_linked") > 0, clean).otherwise(F.col("_text")))
    put = {"text": F.col("_clean"), "n_chars": F.when(F.size("_linked") > 0, F.length("_clean").cast("long")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in names else None}
    return out.select(*((put[c] if put.get(c) is not None else F.col("_row")[c]).alias(c) for c in names))
