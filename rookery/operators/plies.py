"""Games as plies: the moves of the main line with what their notation, marks and comments say; and games made of plies.

A text is cut into pieces (comments, parentheses, words). Nesting is a running sum of its parentheses that never falls
below zero, the number of a ply a running count of moves: sums over the pieces of whole Arrow batches, where what a piece
says is found once for each distinct one. A game stays one row until its plies, or what is counted of them, are known,
so nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers as h
from ..functions.movetext import RESULTS
from .evaluations import annotate, elegance, measured

KEY = ("source_file", "seq")
#: The only tags that plies are made of.
TAGS = ("FEN",)
PIECE = re.compile(r"\{[^}]*(?:\}|\Z)|;[^\r\n]*|[()]|[^\s(){};]+", re.ASCII)


def _marks(token: str, bare: str) -> dict[str, int]:
    """How often a move says of itself that it is bad: ?? or $4, else ?! or $6, else ? or $2."""
    glyph = "blunder" if "??" in bare else "dubious" if "?!" in bare else "mistake" if "?" in bare else ""
    return {name: len(re.findall(rf"\${k}(?![0-9])", token)) + (glyph == name) for name, k in (("blunder", 4), ("mistake", 2), ("dubious", 6))}


def plies_of(games: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, ply, is_white, san, is_capture, is_check, is_mate, is_promotion, is_quiet, blunder, mistake, dubious,
    eval_white_cp): a row per move of the main line, from 1.

    Marks and comments that follow a move belong to it; of several evaluations the last counts. Black begins where FEN
    says so. Defined cases: variations, line comments, results, numbers and other words make no ply; a comment that is
    not closed takes the rest and evaluates nothing; a null or empty text has no plies.
    """
    rows = games.select(*key, F.arrow_udf(_plies_of, f"array<struct<{PLY}>>")(*_read(games)).alias("_plies"))
    return rows.select(*key, F.inline("_plies"))


PLY = "ply int, is_white boolean, san string, is_capture boolean, is_check boolean, is_mate boolean, is_promotion boolean, is_quiet boolean, blunder int, mistake int, dubious int, eval_white_cp int"
METRICS = "plies long, evaluated long, forcing long, quiet_improvements long, trend_breaks long, blunders long, mistakes long, dubiouss long, mean_swing double, deviation double"
#: $ of Java's regular expressions, which also stands before a last line break; words hold no others.
END = r"(?=[\u0085\u2028\u2029]?\Z)"
#: Batches of games go through the steps in groups of about so many pieces.
GROUP = 1 << 18


def _read(games: DataFrame) -> tuple[Column, Column]:
    """What plies are made of: the text, and whether black begins."""
    return F.make_valid_utf8("movetext"), h.black_to_move(h.tag("FEN"))


class Moves(NamedTuple):
    """The moves of some games in order: the game and number of each, who moves, what it says (``code``: the place in
    ``facts``), its marks by name, and its evaluation where it has one."""

    games: int
    owner: np.ndarray
    number: np.ndarray
    white: np.ndarray
    code: np.ndarray
    facts: list[dict]
    marks: dict[str, np.ndarray]
    valued: np.ndarray
    value: np.ndarray

    def fact(self, name: str) -> np.ndarray:
        return np.array([f[name] for f in self.facts], bool)[self.code]


def _batched(make: Callable[[Moves], pa.Array], texts: pa.Array, black: pa.Array) -> pa.Array:
    """``make`` of the moves of each group of games."""
    begins = black.to_numpy(zero_copy_only=False).astype(bool)
    out, at = [], 0
    for pieces, lengths in _groups(texts):
        out.append(make(_moves(pieces, lengths, begins[at : at + len(lengths)])))
        at += len(lengths)
    return pa.concat_arrays(out)


def _groups(texts: pa.Array) -> Iterator[tuple[list[str], list[int]]]:
    """The pieces of groups of texts, and how many each text has; there is at least one group."""
    pieces, lengths = [], []
    for text in texts.to_pylist():
        own = PIECE.findall(text) if text else []
        if pieces and len(pieces) + len(own) > GROUP:
            yield pieces, lengths
            pieces, lengths = [], []
        pieces += own
        lengths.append(len(own))
    yield pieces, lengths


def _moves(pieces: list[str], lengths: list[int], black: np.ndarray) -> Moves:
    words = list(dict.fromkeys(pieces))
    place = dict(zip(words, range(len(words)), strict=True))
    code = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
    n = np.array(lengths, np.int64)
    owner, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    running = lambda v: np.cumsum(v) - np.concatenate(([0], np.cumsum(v)))[start][owner]  # noqa: E731  # of each game
    depth = running(np.array([(w == "(") - (w == ")") for w in words], np.int64)[code])
    below = owner * (2 * len(code) + 1)  # a later game's sums are less than all before them
    depth = depth - np.minimum(0, np.minimum.accumulate(depth - below) + below)
    facts = [_word(w) for w in words]
    column = lambda k, kind: np.array([f[k] for f in facts], kind)[code]
    on = (depth == 0) & ~np.array([w[0] in "();" for w in words], bool)[code]
    is_move = column("move", bool) & on
    ply = running(is_move.astype(np.int64))
    on &= ply > 0
    ends, heads = np.cumsum(is_move) - 1, np.flatnonzero(is_move)  # the move that a piece belongs to, and where moves stand
    own = np.flatnonzero(on & column("counts", bool))
    marks = {k: np.bincount(ends[own], column(k, np.int64)[own], len(heads)).astype(np.int32) for k in ("blunder", "mistake", "dubious")}
    heard = np.flatnonzero(on & column("said", bool))
    valued, value = np.zeros(len(heads), bool), np.zeros(len(heads), np.int64)
    valued[ends[heard]], value[ends[heard]] = True, column("cp", np.int64)[heard]  # the last stays
    number = ply[heads]
    return Moves(len(n), owner[heads], number, (number % 2 == 1) != black[owner[heads]], code[heads], facts, marks, valued, value)


def _struct(columns: list[pa.Array], fields: str) -> pa.Array:
    return pa.StructArray.from_arrays(columns, names=[x.split(" ")[0] for x in fields.split(", ")])


def _plies_of(texts: pa.Array, black: pa.Array) -> pa.Array:
    """The plies of each game from its text and whether black begins."""
    return _batched(_plies, texts, black)


def _plies(m: Moves) -> pa.Array:
    san = pa.array([f["san"] for f in m.facts], pa.string()).take(pa.array(m.code))
    flags = [pa.array(m.fact(k)) for k in ("capture", "check", "mate", "promotion", "quiet")]
    said = pa.array(m.value, pa.int32(), mask=~m.valued)
    rows = _struct([pa.array(m.number, pa.int32()), pa.array(m.white), san, *flags, *map(pa.array, m.marks.values()), said], PLY)
    cuts = np.concatenate(([0], np.cumsum(np.bincount(m.owner, minlength=m.games))))
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows)


def _metrics_of(texts: pa.Array, black: pa.Array) -> pa.Array:
    """What ``game_metrics`` counts, of each game from its text and whether black begins; no swing is null."""
    return _batched(_metrics, texts, black)


def _metrics(m: Moves) -> pa.Array:
    count = lambda owner, given: np.bincount(owner[given], minlength=m.games)
    quiet, at = m.fact("quiet"), np.flatnonzero(m.valued)
    owner, white, cp = m.owner[at], m.white[at], m.value[at]
    later = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # evaluated plies with one before them in their game
    whose, swing = owner[later], cp[later] - cp[later - 1]
    delta = np.where(white[later], swing, -swing)
    of_side = np.lexsort((white, owner))  # stable: a side's plies stay in order
    side, change = 2 * owner[of_side] + white[of_side], np.diff(cp[of_side], prepend=0)
    third = np.flatnonzero((side[2:] == side[:-2])) + 2 if len(side) > 2 else np.zeros(0, np.int64)
    d1, p1 = change[third], change[third - 1]
    turned = (np.sign(d1) * np.sign(p1) < 0) & (np.abs(d1 - p1) >= 50)
    errors = {"blunder": delta <= -300, "mistake": (delta <= -150) & (delta > -300), "dubious": (delta <= -60) & (delta > -150)}
    worst = [np.maximum(np.bincount(m.owner, m.marks[k], m.games).astype(np.int64), count(whose, e)) for k, e in errors.items()]
    n = np.bincount(whose, minlength=m.games)
    mean = lambda v: np.bincount(whose, v, m.games) / np.maximum(n, 1)
    spread = np.sqrt(mean((delta - mean(delta)[whose]) ** 2))
    counts = [np.bincount(m.owner, minlength=m.games), count(m.owner, m.valued), count(m.owner, ~quiet), count(whose, quiet[at][later] & (delta >= 150)), count(side[third] // 2, turned), *worst]
    return _struct([*(pa.array(c, pa.int64()) for c in counts), *(pa.array(v, pa.float64(), mask=n == 0) for v in (mean(np.abs(swing)), spread))], METRICS)


def _word(piece: str) -> dict:
    """What a piece says, wherever it stands: whether it is a move, counts with a move, its SAN, flags and marks."""
    comment, mark = piece.startswith("{"), re.search(r"^\$[0-9]+" + END, piece) is not None
    token = re.sub(r"^([0-9]+\.+|\.+)+", "", piece)
    bare = re.sub(r"\$[0-9]+", "", token)
    move = re.sub("[!?+#]+" + END, "", bare)
    is_move = not comment and not mark and token not in RESULTS and re.match("[KQRBNa-h]|[Oo0]-[Oo0]", move) is not None and move.lower() not in ("ep", "e.p.")
    cp = centipawns(piece[1:-1]) if comment and piece.endswith("}") else None
    out = {"move": is_move, "counts": is_move or mark, "said": cp is not None, "cp": cp or 0, "san": re.sub("[!?]+" + END, "", bare)}
    out |= {k: c in bare for k, c in (("capture", "x"), ("check", "+"), ("mate", "#"), ("promotion", "="))}
    out["quiet"] = not (out["capture"] or out["check"] or out["mate"] or out["promotion"])
    return out | _marks(token, bare)


def centipawns(comment: str) -> int | None:
    """``headers.eval_centipawns`` of one comment; pawns that no int holds are the greatest evaluation."""
    found = re.search(r"\[%eval\s+([^\s\],]+)", comment, re.ASCII)
    if found is None:
        return None
    token = found[1]
    mate = re.search(r"^#[+-]?0*(\d*)" + END, token, re.ASCII)
    if mate is not None and re.match(r"#[+-]?\d", token, re.ASCII) and len(mate[1]) <= 10 and int(mate[1] or 0) < 2**31:
        return (-1 if token.startswith("#-") else 1) * (h.MATE - 100 * min(999, int(mate[1] or 0)))
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", token, re.ASCII) is None:
        return None
    size = min(abs(float(token)) * 100, h.MATE)
    whole = math.floor(size)
    return (-1 if token.startswith("-") else 1) * (whole + (size - whole >= 0.5))


def score_games(games: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, components, score, details) of games by the evaluations in their comments; games without plies have none."""
    counted = games.select(F.struct(*key).alias("game_id"), F.arrow_udf(_metrics_of, f"struct<{METRICS}>")(*_read(games)).alias("_m"))
    metrics = counted.select("game_id", F.inline(F.array("_m"))).where("plies > 0")  # made once
    return elegance(measured(metrics)).withColumnRenamed("game_id", "_id").select("_id.*", "*").drop("_id")


def annotate_games(games: DataFrame, plies: DataFrame, depth: int, annotator: str = "rookery", key: tuple[str, ...] = KEY) -> DataFrame:
    """``games`` with moves annotated from ``plies`` (key, and what ``annotate`` needs), their result, and the tags
    Annotator and AnalysisDepth. The result is the one that ends the text, else the tag Result, else *; a blank tag adds
    none. A game without plies keeps its text and tags."""
    keyed = plies.select(F.struct(*key).alias("game_id"), *(c for c in plies.columns if c not in key))
    texts = annotate(keyed).select("game_id.*", F.col("movetext").alias("_text"))
    out = games.withColumn("_result", h.tag("Result")).drop("tags").join(texts, list(key), "left")  # tags are made anew below
    last = F.element_at(F.split(F.rtrim(F.coalesce("movetext", F.lit(""))), r"\s+"), -1)
    result = F.when(last.isin(*RESULTS), last).otherwise(F.coalesce("_result", F.lit("*")))
    done = F.col("_text").isNotNull()
    text = F.concat_ws(" ", "_text", F.when(~h.blank(result), result))
    head = h.set_tag(F.col("headers"), "Annotator", F.when(done, F.lit(annotator)))
    head = h.set_tag(head, "AnalysisDepth", F.when(done, F.lit(str(depth))))
    return h.with_headers(out.withColumn("movetext", F.when(done, text).otherwise(F.col("movetext"))), head).drop("_text", "_result")
