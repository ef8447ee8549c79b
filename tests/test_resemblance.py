"""The letter index against all pairs, and the fuzzy rules against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rookery.functions import similarity as si
from rookery.operators import lookups, resemblance


def jaro_winkler(a, b):
    """As it is told: one character after the other."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    k, theirs = len(mine), [c for c, t in zip(b, taken, strict=True) if t]
    half = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    jaro = (k / len(a) + k / len(b) + (k - half) / k) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def misspelt(rng, x):
    x = list(x)
    for _ in range(rng.randrange(1, 4)):
        k, kind = rng.randrange(len(x) + 1), rng.randrange(3)
        if kind == 0:
            x.insert(k, rng.choice("abcdefghijklmnopqrstuvwxyzé"))
        elif kind == 1 and len(x) > 1 and k < len(x):
            del x[k]
        elif k + 1 < len(x):
            x[k], x[k + 1] = x[k + 1], x[k]
    return "".join(x)


def last_names(rng, n):
    parts = ["ka", "ro", "mi", "ts", "sch", "en", "ov", "ski", "ber", "ger", "lo", "na", "ta", "vi", "da", "el", "an", "or", "un", "ch", "ü"]
    out = set()
    while len(out) < n:
        out.add("".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))))
    return sorted(out)


def test_scores(monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(0, 10)))
    pairs = [(word(), word()) for _ in range(5000)] + [("x" * 300, "x" * 299 + "y"), ("a", "b"), ("martha", "marhta")]
    monkeypatch.setattr(si, "CELLS", 500)
    assert list(si.jaro_winkler_of(*map(list, zip(*pairs, strict=True)))) == [jaro_winkler(a, b) for a, b in pairs]


@pytest.mark.parametrize("least, initial", [(0.92, True), (0.92, False), (0.88, False)])
def test_index_loses_no_pair_of_5000_names(spark, least, initial):
    rng = random.Random(int(1000 * least) + initial)
    known = last_names(rng, 5000)
    asked = sorted({misspelt(rng, rng.choice(known)) for _ in range(300)} | {"", "q"})
    want = set()
    for a in asked:
        some = [b for b in known if not initial or b[0] == a[:1]]
        want |= {(a, b) for b, s in zip(some, si.jaro_winkler_of([a] * len(some), some), strict=True) if round(s, 9) >= least}
    left, right = spark.createDataFrame([(a,) for a in asked], "a string"), spark.createDataFrame([(b,) for b in known], "b string")
    got = resemblance.similar(left, right, least, initial=initial).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    met = resemblance.candidates(left, right, least, initial=initial).count()
    pairs = sum(not initial or a[:1] == b[0] for a in asked for b in known)
    assert met < pairs / (20 if least > 0.9 else 10), (met, pairs)


def fuzzy(names, players):
    """By the rules, all pairs of a block compared."""
    words = lambda x: "".join(c if c.isalnum() else " " for c in x).lower().split()
    last = lambda x: "".join(words(x.split(",")[0])) if "," in x and words(x.split(",")[0]) else (words(x) or [None])[-1]
    blocks = defaultdict(list)
    for p in sorted(players):
        blocks[last(p)].append(p)
    out = {}
    for name in names:
        block, w = last(name), words(name)
        if block is None:
            continue
        if block not in blocks:
            near = sorted((-round(jaro_winkler(block, b), 9), b) for b in blocks if b and b[0] == block[0])
            if not near or -near[0][0] < 0.92:
                continue
            block = near[0][1]
        if len(w) < 2 and len(blocks[block]) == 1:
            out[name] = blocks[block][0]
            continue
        forms = {"".join(w)} | ({w[-1] + "".join(w[:-1])} if len(w) > 1 else set())
        scores = sorted((-max(round(jaro_winkler(f, "".join(words(p))), 9) for f in forms), p) for p in blocks[block])
        best, second = -scores[0][0], -scores[1][0] if len(scores) > 1 else 0.0
        if best >= 0.97 or best >= 0.90 and round(best - second, 9) >= 0.02:
            out[name] = scores[0][1]
    return out


def test_fuzzy_names_follow_the_rules(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "FEW", 4)
    rng = random.Random(7)
    firsts, lasts = last_names(rng, 60), last_names(rng, 120)
    hot = lasts[:2]
    players = sorted({f"{rng.choice(firsts).title()} {rng.choice(hot if rng.random() < 0.4 else lasts).title()}" for _ in range(400)})
    names = {"", "?", "Solo"}
    for _ in range(500):
        first, last = rng.choice(players).lower().split()
        if rng.random() < 0.6:
            first = misspelt(rng, first)
        if rng.random() < 0.4:
            last = misspelt(rng, last)
        names.add(rng.choice(["{0} {1}", "{1}, {0}", "{1} {0}", "{1}", "{0}  {1}."]).format(first, last))
    rows = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    got = lookups.fuzzy_names(rows([*names, *list(names)[:50]]), rows([*players, *players[:50]])).collect()
    assert {r["name"]: r.player for r in got} == fuzzy(names, players) and len(got) == len({r["name"] for r in got})


def test_no_stage_pairs_a_block(spark):
    """A block of 1,500 players meets misspelt names through its letters."""
    rng = random.Random(5)
    firsts = last_names(rng, 1500)
    right = spark.createDataFrame([("smith", f + "smith") for f in firsts], "block string, b string")
    left = spark.createDataFrame([("smith", misspelt(rng, f) + "smith") for f in firsts[:150]], "block string, a string").distinct()
    got = resemblance.similar(left, right, 0.88, ["block"]).count()
    met = resemblance.candidates(left, right, 0.88, ["block"]).count()
    assert got and met < 150 * 1500 / 4, (met, got)
    assert resemblance.similar(left, right.where(F.lit(False)), 0.88, ["block"]).count() == 0


def test_cells_lose_no_pair(spark, monkeypatch):
    """pairs of blocks that are cut into pieces, of long strings, and of many letters, against all pairs; none is made twice."""
    for name, value in {"FEW": 7, "ASKED": 5, "STEP": 50}.items():
        monkeypatch.setattr(resemblance, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    rng = random.Random(11)
    base = [*last_names(rng, 60), *(rng.choice("ab") * rng.randrange(60, 70) for _ in range(20)), *("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(9)) for _ in range(100))]
    known = sorted({(rng.choice("kkkklmé"), x) for x in base})
    asked = sorted({(rng.choice([k, "k", "no"]), misspelt(rng, x)) for k, x in known for _ in range(2)})
    try:
        for alike, initial in ((["block"], False), ([], True), ([], False)):
            a, b = (sorted({(k if alike else "", x) for k, x in side}) for side in (asked, known))
            pairs = [(k, x, y) for k, x in a for o, y in b if k == o and (not initial or x[:1] == y[0])]
            want = {(k, x, y) for (k, x, y), s in zip(pairs, si.jaro_winkler_of([p[1] for p in pairs], [p[2] for p in pairs]), strict=True) if round(s, 9) >= 0.88}
            left, right = (spark.createDataFrame(side, f"block string, {c} string").select(*alike, c) for side, c in ((a, "a"), (b, "b")))
            got = [(r.block if alike else "", r.a, r.b) for r in resemblance.similar(left, right, 0.88, alike, initial).collect()]
            assert set(got) == want and len(got) == len(want) > 50
            met = [tuple(r) for r in resemblance.candidates(left, right, 0.88, alike, initial).collect()]
            assert len(met) == len(set(met)) >= len(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs_of_a_hot_block_are_looked_at_fast(spark):
    """6,000 asked and 6,000 known strings of one block are 36 million pairs."""
    import time

    rng = random.Random(4)
    firsts = last_names(rng, 6000)
    right = spark.createDataFrame([("smith", f + "smith") for f in firsts], "block string, b string")
    left = spark.createDataFrame([("smith", f + "xsmith") for f in firsts], "block string, a string")
    began = time.time()
    assert resemblance.similar(left, right, 0.88, ["block"]).where("b = replace(a, 'x', '')").count() > 5000
    assert time.time() - began < 40
