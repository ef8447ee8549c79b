"""Queries of the corpus operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trie, decontam, digest_index, html_cut, katz, piece_table, probminhash, quality_rules, ring, secret_scan, spimi, token_counts, warc
from ._shared import scratch, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.roundtrip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept", "rule")


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = katz.held_out(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = katz.Katz(docs.where(~F.col("held_out")))
    out = katz.held_out(model.score(docs))
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ring.assign(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("node")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_trie.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decode=True)
    digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n_tokens", digest(F.col("ids")).alias("ids_sha256"), digest(F.col("decoded").cast("binary")).alias("decoded_sha256"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), eod=49407)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spimi.audit(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries: the upper half of the ids, so that the largest id is the first to bring its text, and the rest."""
    docs = table(spark, sf_dir, "documents")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    late = F.when(F.col("doc_id") > F.lit(middle), "1").otherwise("2")
    rows = digest_index.digests(docs, delivery=late)
    index = digest_index.DigestIndex(spark, scratch(spark, "index"))
    for delivery in ("1", "2"):
        index.add(rows.where(F.col("delivery") == delivery), delivery)
    out = index.verdicts(rows)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_table.fill_in_middle(table(spark, sf_dir, "documents"))
    out = out.withColumn("back", piece_table.restored_pieces(F.col("output"), F.col("form")))
    return piece_table.with_digests(out, ("text", "pieces", "output_sha256"), ("output", "back", "restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_quality_rules": op2_quality_rules,
        "op3_katz": op3_katz,
        "op4_secret_scans": op4_secret_scans,
        "op5_sharding": op5_sharding,
        "op6_decontamination": op6_decontamination,
        "op7_bpe": op7_bpe,
        "op8_html_extraction": op8_html_extraction,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_token_counts": op10_token_counts,
        "op11_source_divergence": op11_source_divergence,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


#: Base 32 of a digest in hex: five digits make four letters.
BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr({0}, 1 + 5 * (i // 4), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '')"
WARC_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {BASE32.format('sha1(html)')} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (html)"""


#: For pages with one article of headings and paragraphs, as the given ones are.
HTML_SQL = r"""WITH a AS (SELECT page_id, url, list_transform(regexp_split_to_array(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?(h[1-6]|p)>'),
lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM a)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t"""
DIVERGENCE_SQL = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10), g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1), n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2), ln AS (SELECT lang, sum(n) AS n FROM n GROUP BY 1),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (coalesce(n.n, 0) + 2 * v.v)::HUGEINT AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c) + 2) // (ln.n + 2 * v.v)::HUGEINT AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term, ln.n, v.v),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) x) y WHERE part = 'pair' OR rank <= 10"""
DEDUP_SQL = """SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size, sha256(coalesce(text, '')) AS text_sha256 FROM documents) d"""
FIM_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (n + 1) AS y, CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    """Of the others, SQL can express no more than parts; tests/llm holds them against brute force."""
    return {"op1_warc": WARC_SQL, "op8_html_extraction": HTML_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op12_exact_dedup": DEDUP_SQL, "op13_fill_in_middle": FIM_SQL}
