"""Fill-in-middle by a piece table.

A document is a list of descriptors (buffer, start, length; code points) over two buffers that never change: its own text
and the sentinels. Cutting splits a descriptor in two, an arrangement permutes (sentinel, part) pairs, and nothing of the
text moves until ``render``. ``restored_pieces`` reads an arranged output as a third buffer, whose descriptors the inverse
permutation puts back into the order of the text. ``with_digests`` feeds descriptors to SHA-256 a block at a time, so a
hash needs no arranged copy.

Where to cut and how to arrange is decided by hash of seed and id alone, so a document is treated alike in every run and
on every machine, and repeated rows alike. There is no shuffle.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stays plain (one descriptor, no cuts);
a null id hashes as an empty one; cuts may fall on one place or at an end, their parts are then empty descriptors. Columns
other than id and text are not carried, so their names cannot clash. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import slices

TEXT, MARKS = 0, 1
PARTS = ("prefix", "middle", "suffix")
SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
MARKED = "".join(SENTINELS.values())
#: The order in which an arrangement shows the parts, each behind its sentinel.
ARRANGED = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
BLOCK = 1 << 16


def piece(buffer: int, start: Column, length: Column) -> Column:
    return F.struct(F.lit(buffer).alias("buffer"), start.cast("int").alias("start"), length.cast("int").alias("length"))


def split(whole: Column, at: Column) -> tuple[Column, Column]:
    """The descriptor of what lies before ``at``, counted from its start, and that of the rest."""
    head = F.struct(whole["buffer"].alias("buffer"), whole["start"].alias("start"), at.cast("int").alias("length"))
    tail = F.struct(whole["buffer"].alias("buffer"), (whole["start"] + at).cast("int").alias("start"), (whole["length"] - at).cast("int").alias("length"))
    return head, tail


def mark(part: str) -> Column:
    own = SENTINELS[part]
    return piece(MARKS, F.lit(MARKED.index(own)), F.lit(len(own)))


def arranged(parts: dict[str, Column], form: str) -> Column:
    return F.array(*(x for p in ARRANGED[form] for x in (mark(p), parts[p])))


def draw(seed: str, key: Column, k: int) -> Column:
    """The k-th of the 32-bit numbers that a key's hash holds."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", *, seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """key, text, n, form, prefix_chars, middle_chars and pieces (in the order of the output) of every row.

    ``plain_from``: hundredths from which a text stays plain; ``spm_below``: hundredths of the others that show the
    suffix first."""
    named = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    h = [draw(seed, F.col(key), k) for k in range(4)]
    held = F.lit(False)
    for own in SENTINELS.values():
        held = held | F.contains("text", F.lit(own))
    rows = named.withColumn("n", F.length("text").cast("long")).withColumn("_first", h[0] % (F.col("n") + 1)).withColumn("_second", h[1] % (F.col("n") + 1))
    form = F.when((F.col("n") == 0) | held | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    low, high = F.least("_first", "_second"), F.greatest("_first", "_second")
    rows = rows.select(F.col(key), "text", "n", form.alias("form"), low.alias("_low"), high.alias("_high"))
    whole = piece(TEXT, F.lit(0), F.col("n"))
    front, suffix = split(whole, F.col("_high"))
    prefix, middle = split(front, F.col("_low"))
    parts = dict(zip(PARTS, (prefix, middle, suffix), strict=True))
    pieces = F.when(F.col("form") == "plain", F.array(whole))
    for name in ARRANGED:
        pieces = pieces.when(F.col("form") == name, arranged(parts, name))
    moved = F.col("form") != "plain"
    return rows.select(F.col(key), "text", "n", "form", F.when(moved, F.col("_low")).alias("prefix_chars"), F.when(moved, F.col("_high") - F.col("_low")).alias("middle_chars"), pieces.alias("pieces"))


def render(text: Column, pieces: Column) -> Column:
    """What descriptors show."""
    shown = lambda p: F.substr(F.when(p["buffer"] == MARKS, F.lit(MARKED)).otherwise(text), p["start"] + 1, p["length"])
    return F.array_join(F.transform(pieces, shown), "")


def restored_pieces(output: Column, form: Column) -> Column:
    """Descriptors over an output that show the text it was made of: sentinels left out, parts in their first order."""
    n = F.length(output)
    out = F.when(form == "plain", F.array(piece(TEXT, F.lit(0), n)))
    for name, order in ARRANGED.items():
        at = [F.locate(SENTINELS[p], output) - 1 for p in order]
        ends = [*at[1:], n]
        found = {p: piece(TEXT, a + len(SENTINELS[p]), b - a - len(SENTINELS[p])) for p, a, b in zip(order, at, ends, strict=True)}
        out = out.when(form == name, F.array(*(found[p] for p in PARTS)))
    return out


def with_digests(df: DataFrame, *wanted: tuple[str, str, str]) -> DataFrame:
    """``df`` with SHA-256 (lowercase hex) of what descriptors show, for each (buffer column, pieces column, new name).
    Buffers and pieces themselves are left out."""
    used = {c for buffer, pieces, _ in wanted for c in (buffer, pieces)}
    rest = [c for c in df.columns if c not in used]
    given = [x for buffer, pieces, _ in wanted for x in (buffer, pieces)]
    schema = df.select(*rest).schema
    for _, _, name in wanted:
        schema = schema.add(name, "string")

    def stream(text: str, pieces: list[dict]) -> str:
        digest = hashlib.sha256()
        for p in pieces:
            source = MARKED if p["buffer"] == MARKS else text
            end = p["start"] + p["length"]
            for at in range(p["start"], end, BLOCK):
                digest.update(source[at : min(at + BLOCK, end)].encode())
        return digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, 512, 32 << 20):
            columns = part.columns[len(given) :]
            for k in range(len(wanted)):
                pairs = zip(part.column(2 * k).to_pylist(), part.column(2 * k + 1).to_pylist(), strict=True)
                columns.append(pa.array([stream(t, p) for t, p in pairs], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    own = [F.col(c).alias(f"_{k}") for k, c in enumerate(given)]
    return df.select(*own, *rest).mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, **options) -> DataFrame:
    """``cut`` with ``output``, the arranged text."""
    return cut(docs, **options).withColumn("output", render(F.col("text"), F.col("pieces")))
