"""Term frequencies, digest index and piece table against plain Python: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rookery.llm import digest_index, piece_table, queries, spimi

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def rows_of(rng, n):
    words = ["alpha", "Beta", "GAMMA", "délta", "épsilon", "ﬁn", "日本", "x", *("w%s" % chr(97 + k) for k in range(20))]
    out = [(0, None, None, None), (1, "", "en", "a"), (2, "1 2 3", "en", "void"), (3, "lonely words here", "xx", "only"), (4, "É é E e", "en", None), (4, "É é E e", "en", None)]
    for k in range(n):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "ß", "a", None, "Z"])
        out.append((10 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) + rng.choice(["", "\n", "\x00#9"]), lang, source))
    return out


def audit_of(rows, least, top):
    docs = [(t or "", g or "", s or "") for _, t, g, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), {(g, s) for _, g, s in docs}
    for t, g, s in docs:
        c = Counter(TERM.findall(t.translate(lower)))
        counts[g, s].update(c)
        held[g].update(c.keys())
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        own, of_lang = {s: p(counts[lang, s]) for s in sources}, p(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(own[s][t], of_lang[t]), t) for t in kept if counts[lang, s][t] and own[s][t] > of_lang[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(items[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, block, tile, segment", [(10, 96 << 20, 64 << 20, 4096), (3, 20_000, 1, 7), (1, 1, 1, 1)])
def test_audit(spark, monkeypatch, least, block, tile, segment):
    monkeypatch.setattr(spimi, "SEGMENT", segment)
    rows = rows_of(random.Random(least), 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("term", "count", "p", "sid", "shard")}).repartition(5)
    got = sorted(map(tuple, spimi.audit(docs, least=least, top=4, block_bytes=block, tile_bytes=tile, shards=3).collect()))
    assert got == audit_of(rows, least, 4)


def test_audit_of_many_sources_goes_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(spimi, "TILE", 4)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(9)), "en", f"s{rng.randrange(11)}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, spimi.audit(docs, tile_bytes=4 * 4 * 8 * 2).collect())) == audit_of(rows, 10, 10)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert spimi.audit(docs).count() == 0
    alone = spark.createDataFrame([(1, None, None, None), (2, "x" * 3_000_000, "en", "a"), (3, "y", "en", "b")], docs.schema)
    assert sorted(map(tuple, spimi.audit(alone).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_quotients_of_great_counts(spark):
    cases = [(2, 2), (3, 7), (9_000_000_000_000_000, 9_100_000_000_000_001), (10**12, 3 * 10**15), (2, 9 * 10**15)]
    df = spark.createDataFrame(cases, "c long, n long").select("c", "n", spimi.per_billion(F.col("c"), F.col("n")).alias("p"))
    assert all(r.p == 1 + 10**9 * r.c // r.n for r in df.collect())


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_exact_dedup_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, "", " ", "a", "a ", "é", "é", "x" * 200_000, "hot", "hot", "hot"]), "en", "s") for k in range(400)]
    rows += [(399, rows[399][1], "en", "s"), (None, "hot", "en", "s"), (None, "alone", "en", "s"), (None, "alone", "en", "s")]
    got = queries.op12_exact_dedup(spark, write(spark, tmp_path, rows)).collect()
    groups = defaultdict(list)
    for k, t, *_ in rows:
        groups[t or ""].append(k)
    best = {t: max((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    want = Counter((k, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for k, t, *_ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_digest_index_lasts_and_takes_deliveries(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    day = lambda *rows: spark.createDataFrame(rows, "doc_id string, text string, digest int, row int")
    index = digest_index.DigestIndex(spark, path, buckets=3, id_type="string")
    first = day(("b", "x", 1, 1), ("a", "x", 1, 1), ("c", "y", 1, 1))
    verdict = lambda df, name, own=index, **o: sorted((r.id, r.keep_id, r.kept) for r in digest_index.deduplicate(df, own, name, **o).collect())
    assert verdict(first, "mon") == [("a", "b", False), ("b", "b", True), ("c", "c", True)]
    spark.sql(f"DROP TABLE {index.table}")  # as in another session, whose catalog doesn't know it
    again = digest_index.DigestIndex(spark, path)
    assert again.buckets == 3 and sorted(again.commits()) == ["mon"]
    assert verdict(day(("z", "x", 1, 1), ("d", "Y", 1, 1), ("e", None, 1, 1)), "tue", again) == [("d", "d", True), ("e", "e", True), ("z", "b", False)]
    assert verdict(first, "mon", again) == [("a", "b", False), ("b", "b", True), ("c", "c", True)]  # a replay adds nothing
    assert again.read().count() == 4
    assert verdict(first.limit(0), "none", again) == []
    # an append without its commit row is never seen
    spark.createDataFrame([(b"q", "q", 1, "wed", "lost")], "digest binary, id string, row long, delivery string, attempt string").write.insertInto(again.table)
    assert again.read().count() == 4
    lower = digest_index.DigestIndex(spark, path + "-lower", id_type="string")
    assert verdict(day(("a", "Q", 1, 1), ("b", "q", 1, 1)), "1", lower, normal=F.lower) == [("a", "b", False), ("b", "b", True)]


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = digest_index.DigestIndex(spark, f"file://{tmp_path}/index")
    rows = digest_index.digests(spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")), delivery="1")
    index.add(rows, "1")
    new = rows.groupBy("digest").count()
    plan = new.join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def fim_of(key, text):
    text, sep = text or "", ("<P>", "<S>", "<M>")
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in sep) or h3 % 100 >= 90:
        form, out, cuts = "plain", text, (None, None)
    else:
        form, cuts = "spm" if h4 % 100 < 20 else "psm", (a, b - a)
        pre, mid, suf = text[:a], text[a:b], text[b:]
        out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return n, form, *cuts, out


def test_fill_in_middle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(piece_table, "BLOCK", 7)
    rng = random.Random(8)
    texts = [None, "", "a", "é", "🎉", "x<P>y", "<S>", "a<M", "<<S", "<P", "long " * 100_000, *("".join(rng.choice("ab<>PSMé🎉\n ") for _ in range(rng.randrange(1, 30))) for _ in range(400))]
    rows = [(k if k != 20 else None, t, "en", "s") for k, t in enumerate(texts)]
    rows.append(rows[30])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((k, *fim_of(k, t)[:4], sha(fim_of(k, t)[4]), sha(t or "")) for k, t, *_ in rows)
    got = queries.op13_fill_in_middle(spark, write(spark, tmp_path, rows)).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rendered_outputs_and_what_restores_them(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("abé<P>") for _ in range(25)), "x", 1) for k in range(200)] + [(None, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, pieces string, n int")
    out = piece_table.fill_in_middle(docs).withColumn("back", piece_table.restored_pieces(F.col("output"), F.col("form")))
    out = out.withColumn("restored", piece_table.render(F.col("output"), F.col("back")))
    for r in out.collect():
        assert r.restored == (r.text or "") and r.output == fim_of(r.doc_id, r.text)[4]
        assert all(p.length >= 0 for p in r.pieces) and sum(p.length for p in r.pieces if p.buffer == piece_table.TEXT) == r.n
    assert piece_table.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_exact_dedup", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    mine = queries.queries()[name](spark, "/root/testdata/sf0.001")
    cur = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in mine.columns]
    assert sorted(str(list(r)) for r in mine.collect()) == sorted(str([r[k] for k in at]) for r in cur.fetchall())
