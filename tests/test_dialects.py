"""The tokeniser dialects against scanners that go from character to character."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from rookery.functions import movetext as mt
from rookery.plans import queries


def scan(text, dialect):
    """What is left of a text, a space for each stretch that isn't."""
    shown, inside, depth = [], "", 0
    for c in text:
        seen = False
        if inside == ";":
            inside = "" if c in "\r\n" else ";"
        elif inside == "[":
            inside = "" if c == "]" else "["
        elif inside == "{":
            if c == "}":
                inside = ""
            elif dialect == "info" and c in "()":
                depth = depth + 1 if c == "(" else max(0, depth - 1)
        elif c == "{" and (depth == 0 or dialect in ("info", "elegance", "mate")) or c == ";" and (depth == 0 or dialect == "elegance"):
            inside = c
        elif c == "[" and dialect == "info" and depth == 0:
            inside = c
        elif c == "(":
            depth += 1
        elif c == ")":
            seen = depth == 0 and dialect in ("filter", "tag", "info")
            depth = max(0, depth - 1)
        else:
            seen = depth == 0
        shown.append(c if seen else None)
    return "".join(" " if gone else "".join(cs) for gone, cs in itertools.groupby(shown, lambda c: c is None))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    parts = [*"{}();[]\n\r", "e4 ", "$1", "é", "x", "1.", "Nf3 ", "#", "0-0 ", "e.p. ", "*"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(10_000)] + ["", "(" * 5000 + "a" + ")" * 4999 + "b)c"]


@pytest.mark.parametrize("dialect", sorted(mt.DIALECTS))
def test_main_lines_of_random_texts(texts, dialect, monkeypatch):
    monkeypatch.setattr(mt, "GROUP", 997)
    assert mt.mainlines(texts, dialect) == [scan(t, dialect) for t in texts]


@pytest.mark.parametrize("dialect", sorted(mt.DIALECTS))
def test_columns_take_both_ways(spark, texts, dialect):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:3000])] + [(-1, None)], "k int, t string")
    got = {r.k: r.m for r in df.select("k", mt.mainline_text(F.col("t"), dialect).alias("m")).collect()}
    squeeze = lambda x: re.sub(" +", " ", x)
    assert got.pop(-1) == "" and all(squeeze(m) == squeeze(scan(texts[k], dialect)) for k, m in got.items())


def strip(text, comments, nags, variations):
    out, depth, i, n = [], 0, 0, len(text)
    while i < n:
        c = text[i]
        if comments and depth == 0 and c == "{":
            i = text.find("}", i) + 1 or n
            continue
        if comments and depth == 0 and c == ";":
            while i < n and text[i] not in "\r\n":
                i += 1
            continue
        if variations and c == "(":
            depth += 1
        elif variations and c == ")" and depth:
            depth -= 1
        elif depth == 0:
            if nags and c == "$":
                i += 1
                while i < n and text[i] in "0123456789":
                    i += 1
                continue
            out.append(c)
        i += 1
    return re.sub(r"[^\S\r\n]+", " ", "".join(out)).strip()


@pytest.mark.parametrize("flags", list(itertools.product([True, False], repeat=3)))
def test_stripping_of_random_texts(texts, flags, monkeypatch):
    monkeypatch.setattr(mt, "GROUP", 997)
    assert mt.stripped(texts, *flags) == [strip(t, *flags) for t in texts]


def info_plies(text):
    """Words of a text by the rules of the summary, one character after the other."""
    count, inside, depth, word = 0, "", 0, None

    def end(at):
        w = text[word:at] if word is not None else ""
        return int(len(w) > 1 and not re.fullmatch(r"[\d.]*|1-0|0-1", w) and (w[0].isupper() or w[0] in "abcdefgh" or w.startswith("0-0")))

    for i, c in enumerate(text):
        if inside == ";":
            inside = "" if c in "\r\n" else ";"
            continue
        if inside == "[":
            inside = "" if c == "]" else "["
            continue
        if c == "{" or c == "(" or c in "[;" and inside != "{" and depth == 0:
            count, word = count + end(i), None
            if c == "(":
                depth += 1
            else:
                inside = c
            continue
        if c == "}":
            inside = ""
            continue
        if c == ")":
            depth = max(0, depth - 1)
            continue
        if inside == "{" or depth:
            continue
        if c.isalnum() or c in "-+#=":
            word = i if word is None else word
        elif word is not None:
            count, word = count + end(i), None
    return count + end(len(text))


def test_plies_of_the_summary(spark, texts):
    known = {"1. e4 {a :) (b} e5 2. Nf3 Nc6": 1, "( {a) b } e5": 1, "e x y": 0, "e) f5": 2, "1.e4 e5 1-0": 2, "{(} e4 ) d4": 1, "0-0-0 O-O": 2, "É4": 1}
    rows = [*known, *texts[:5000]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = {r.k: r.n for r in df.select("k", mt.ply_count(F.col("t"), "info").alias("n")).collect()}
    assert [got[k] for k in range(len(known))] == list(known.values())
    assert got == {k: info_plies(t) for k, t in enumerate(rows)}


def test_ends_of_the_query(spark):
    ends = list(queries.DIALECT_ENDS)
    df = spark.createDataFrame([(k, "1. e4" + t) for k, t in enumerate(ends)], "k int, t string")
    counts = [mt.ply_count(F.col("t"), x).alias(x) for x in ("filter", "tag", "info", "elegance")] + [F.size(mt.book_moves(F.col("t"))).alias("book")]
    for r in df.select("k", *counts).collect():
        assert {x: r[x] - 1 for x in queries.DIALECTS} == queries.DIALECT_ENDS[ends[r.k]], ends[r.k]


def test_mates_behind_line_comments(spark):
    df = spark.createDataFrame([("e4 ; Qxf7#\ne5",), ("e4 (1. d4 ; x)\n Qxf7#",), ("(a {)} b) Qh7#",), ("(a {)} Qh7#",)], "t string")
    assert [r[0] for r in df.select(mt.has_mate(F.col("t"))).collect()] == [False, True, True, False]
