"""Move text: the tokeniser dialects of the single tools, ply counts, stripping, ply flags.

The dialects differ in what a variation may contain and in what counts as a move, and results depend on it, so each is a
mode of its own. Text without parentheses is cut by Spark functions in all of them. Nesting needs a counter, which the
others get in Arrow batches: the texts of a batch go from delimiter to delimiter in step, k-th delimiter with k-th
delimiter, so that Python sees arrays and no characters. Dialect "book" is made of Spark functions alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .headers import once

RESULTS = ("1-0", "0-1", "1/2-1/2", "*")
DEPTH = 6


@dataclass(frozen=True)
class Dialect:
    """What variations know of braces and line comments, whether comments know parentheses, whether [...] is left out and
    whether a ) that closes nothing stays."""

    braces: bool = False
    lines: bool = False
    parens_in_braces: bool = False
    brackets: bool = False
    loose_close: bool = False


DIALECTS = {
    "filter": Dialect(loose_close=True),
    "tag": Dialect(loose_close=True),
    "info": Dialect(braces=True, parens_in_braces=True, brackets=True, loose_close=True),
    "elegance": Dialect(braces=True, lines=True),
    "strip": Dialect(),
    "mate": Dialect(braces=True),
}

TEXT, BRACE, LINE, BRACKET = range(4)
#: Texts go through the steps in groups of about so many characters.
GROUP = 1 << 22


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each text begins and ends."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def text_of(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def depth_zero(codes: np.ndarray, ends: np.ndarray, own: Dialect, comments: bool = True, variations: bool = True, breaks: bool = False) -> np.ndarray:
    """Which code points are on the main line: in no comment, variation or bracket, and none of their delimiters, but
    with ``breaks`` the line breaks that end line comments."""
    semicolons = np.add.accumulate(codes == ord(";"), dtype=np.int64)
    used = np.isin(codes, [ord(c) for c in ("(", ")") * variations + ("{", "}") * comments + ("[", "]") * own.brackets])
    if comments and len(codes) and semicolons[-1]:
        before = np.concatenate(([0], semicolons))
        has = np.repeat(before[ends[1:]] > before[ends[:-1]], np.diff(ends))
        used |= (codes == ord(";")) | has & ((codes == 10) | (codes == 13))
    at = np.flatnonzero(used)
    first, last = np.searchsorted(at, ends[:-1]), np.searchsorted(at, ends[1:])
    order = np.argsort(first - last, kind="stable")  # texts with most delimiters first, so that those of a step lead
    first, counts = first[order], (last - first)[order]
    mode, depth = np.zeros(len(order), np.int8), np.zeros(len(order), np.int64)
    kind = codes[at]
    after, kept = np.zeros(len(at), bool), np.zeros(len(at), bool)
    for step in range(int(counts[0]) if len(counts) else 0):
        n = int(np.searchsorted(-counts, -step, side="left"))  # texts that have so many
        where = first[:n] + step
        c, m, d = kind[where], mode[:n], depth[:n]
        plain, base = m == TEXT, d == 0
        opens, closes = c == ord("("), c == ord(")")
        counted = plain | (own.parens_in_braces & (m == BRACE))
        to = m.copy()
        to[plain & (c == ord("{")) & (base | own.braces)] = BRACE
        to[plain & (c == ord(";")) & (base | own.lines)] = LINE
        to[plain & (c == ord("[")) & base] = BRACKET
        to[(m == BRACE) & (c == ord("}")) | (m == LINE) & ((c == 10) | (c == 13)) | (m == BRACKET) & (c == ord("]"))] = TEXT
        # delimiters that open and close nothing here are text
        kept[where] = plain & base & (to == TEXT) & ~opens & (~closes | own.loose_close) | breaks & (m == LINE) & (to == TEXT)
        depth[:n] = np.where(counted & opens, d + 1, np.where(counted & closes, np.maximum(d - 1, 0), d))
        mode[:n] = to
        after[where] = (to == TEXT) & (depth[:n] == 0)
    # what follows a delimiter is as it has left things; a text begins on the main line
    change = np.zeros(len(codes) + 1, np.int64)
    change[at + 1] = 1
    place = np.add.accumulate(change)[: len(codes)]  # delimiters before each code point
    fresh = place == np.repeat(np.searchsorted(at, ends[:-1]), np.diff(ends))
    shown = np.concatenate((after, [True]))[place - 1] | fresh
    shown[at] = kept
    return shown


def mainlines(texts: list[str], dialect: str) -> list[str]:
    """Move texts without comments and variations; a space stands for what is gone."""
    own, out = DIALECTS[dialect], []
    for group in _groups(texts):
        codes, ends = codes_of(group)
        shown = depth_zero(codes, ends, own)
        gone = ~shown
        starts = gone & np.concatenate(([True], shown[:-1]))
        starts[ends[:-1][ends[:-1] < len(codes)]] = gone[ends[:-1][ends[:-1] < len(codes)]]
        kept = shown | starts
        line = np.where(shown, codes, np.uint32(32))[kept]
        sizes = np.concatenate(([0], np.add.accumulate(kept, dtype=np.int64)))[ends]
        whole = text_of(line)
        out += [whole[a:b] for a, b in zip(sizes, sizes[1:], strict=False)]
    return out


def _groups(texts: list[str]) -> list[list[str]]:
    out, size = [[]], 0
    for t in texts:
        if size and size + len(t) > GROUP:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out


def _udf(fn, text: Column) -> Column:
    """``fn`` over batches of texts; null counts as empty."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(fn(text.fillna("").tolist()))

    return run(text)


def _nested(fn, text: Column, flat: Column) -> Column:
    """``flat`` where a text has no parentheses, else what ``fn`` makes of it; only the latter go to Python."""
    nests = F.coalesce(text.rlike(r"[()]"), F.lit(False))
    return F.when(nests, _udf(fn, F.when(nests, text))).otherwise(flat)


def mainline_text(text: Column, dialect: str) -> Column:
    own = DIALECTS[dialect]
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\{[^}]*(\}|$)|;[^\r\n]*[\r\n]?" + (r"|\[[^\]]*(\]|$)" if own.brackets else ""), " ")
    return _nested(lambda x: mainlines(x, dialect), text, flat)


def book_mainline(text: Column) -> Column:
    """Dialect "book" (deduplication, openings): the first opener of a comment, line comment or bracket wins; then
    variations from the inside out; an unclosed one takes the rest."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\{[^}]*(\}|$)|;[^\r\n]*|\[[^\]]*(\]|$)", " ")
    for _ in range(DEPTH):
        out = once(out, lambda x: F.when(F.contains(x, F.lit("(")), F.regexp_replace(x, r"\([^()]*\)", " ")).otherwise(x))
    return once(out, lambda x: F.when(F.contains(x, F.lit("(")), _deeper(x)).otherwise(x))


def _deeper(out: Column) -> Column:
    # what is nested deeper has at most as many levels left as openers
    left = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(out, F.lit(r"\("))))
    out = F.when(out.rlike(r"\([^()]*\)"), F.aggregate(left, out, lambda text, _: F.regexp_replace(text, r"\([^()]*\)", " "))).otherwise(out)
    return F.regexp_replace(out, r"\((?s:.)*$", " ")


def normal_tokens(text: Column) -> Column:
    """The moves of a main line: without numbers, dots, NAGs, marks; up to the first result."""
    return once(F.filter(F.split(text, r"\s+"), lambda x: (x != "") & ~x.rlike(r"^\d+\.*\z")), _normal)


def _normal(words: Column) -> Column:
    def clean(x: Column) -> Column:  # e4, Nf3, exd5: nothing to take away
        return F.when(x.rlike(r"^[A-Za-z]\w*\d\z"), x).otherwise(bare(x))

    def bare(x: Column) -> Column:
        x = F.regexp_replace(x, r"^\d+\.+", "")
        x = F.regexp_replace(x, r"\$\d*$", "")
        x = F.regexp_replace(x, r"[+#!?]+$", "")
        x = F.regexp_replace(x, r"(?i)e\.?p\.?$", "")
        x = once(x, lambda y: F.when(F.upper(y).isin("O-O-O", "0-0-0"), F.lit("O-O-O")).when(F.upper(y).isin("O-O", "0-0"), F.lit("O-O")).otherwise(y))
        return once(x, lambda y: F.when(y.rlike(r"^(\d+|[.]+|\$\d*|[!?+#]*)$"), F.lit("")).otherwise(y))

    end = F.array_position(F.transform(words, lambda x: x.isin(*RESULTS)), F.lit(True)).cast("int")
    words = F.when(end > 0, F.slice(words, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(words)
    return F.filter(F.transform(words, clean), lambda x: x != "")


def book_moves(text: Column) -> Column:
    return normal_tokens(book_mainline(text))


def filter_moves(text: Column) -> Column:
    return normal_tokens(mainline_text(text, "filter"))


def ply_count(text: Column, dialect: str) -> Column:
    """Plies by the rule of the named tool: filter, tag, info or elegance."""
    if dialect == "filter":
        return F.size(filter_moves(text))
    line = mainline_text(text, dialect)
    if dialect == "info":  # two characters at least; what closes nothing doesn't end a word
        words = F.regexp_extract_all(line, F.lit(r"[\p{L}\p{Nd}+#=-][\p{L}\p{Nd}+#=)}-]*"), F.lit(0))
        return F.size(F.filter(words, lambda x: (F.length(x) > 1) & x.rlike(r"^(\p{Lu}|[a-h]|0-0)")))
    words = F.split(line, r"\s+")
    if dialect == "tag":
        bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^(\d+\.+)?\.*", ""), r"(\$\d+)?[!?+#]*$", "")
        return F.size(F.filter(F.transform(words, bare), lambda x: x.rlike(r"^(\p{L}|0-0(-0)?$)") & ~F.lower(x).isin("ep", "e.p.")))
    last = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\d+\.(.*\.)?", ""), r"^\.+", "")
    bare = lambda x: F.regexp_replace(F.regexp_replace(last(x), r"\$\d+", ""), "[!?+#]+$", "")
    return F.size(F.filter(F.transform(words, bare), lambda x: x.rlike(r"^([KQRBNa-h]|O-O|(?i:o-o|0-0)(-[oO0])?$)") & ~F.lower(x).isin("ep", "e.p.")))


def has_mate(text: Column) -> Column:
    """A # on the main line, outside comments and variations."""
    return F.contains(mainline_text(text, "mate"), F.lit("#"))


def stripped(texts: list[str], comments: bool = True, nags: bool = True, variations: bool = True) -> list[str]:
    """Move texts without what the flags name; nothing takes its place, and runs of blanks become one."""
    out: list[str] = []
    for group in _groups(texts):
        codes, ends = codes_of(group)
        shown = depth_zero(codes, ends, DIALECTS["filter"], comments, variations, breaks=True)
        if nags and len(codes):
            digit = (codes >= 48) & (codes <= 57)
            digit[ends[:-1][ends[:-1] < len(codes)]] = False
            sign = np.maximum.accumulate(np.where(digit, 0, np.arange(len(codes))))  # what stands before a run of digits
            shown &= ~((codes[sign] == ord("$")) & shown[sign])
        sizes = np.concatenate(([0], np.add.accumulate(shown, dtype=np.int64)))[ends]
        whole = text_of(codes[shown])
        out += [re.sub(r"[^\S\r\n]+", " ", whole[a:b]).strip() for a, b in zip(sizes, sizes[1:], strict=False)]
    return out


def strip(text: Column, comments: bool = True, nags: bool = True, variations: bool = True) -> Column:
    return _udf(lambda x: stripped(x, comments, nags, variations), text)


def unannotated(text: Column) -> Column:
    """Move text without comments, variations, NAGs and glyphs; each leaves one space."""
    line = mainline_text(text, "strip")
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"\$\d+|[!?]+|\)", " "), r"[\s\u000B\u001C-\u001F\u0085\u00A0]+", " "))
