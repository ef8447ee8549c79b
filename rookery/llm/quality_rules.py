"""Quality rules learned as a decision list, with DataFrame functions only.

``text_statistics`` measures every text. ``learn`` grows a decision list by sequential covering: each rule is a
conjunction of threshold tests, grown one test at a time on two thirds of the labelled statistics by FOIL gain, pruned
on the rest, and kept while it is precise; what it covers is taken out before the next rule. The counts behind each
step are one grouped aggregation over (test bin, label). ``DecisionList.rejected_by`` is an ordered ``CASE WHEN``.

Defined cases: a null text counts as empty (all statistics 0). Labelled rows with a null label or document are not
learned from. Without labelled rows of both kinds the list is empty and its default, "keep", holds. Repeated labels
count as often as they occur. ``text_statistics`` replaces input columns of the names that it adds;
``filter_quality`` packs the input row first, so it returns exactly the input columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import saved, words_of

WINDOW = 5
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules test: ratios of the statistics, as SQL.
MEASURES = {
    "words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "double(n_dup_lines)",
    "dup_line_rate": "100 * n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of the whole text.

    Repeated windows are found inside the row: the hashes of all 5-word windows, sorted with their positions only where
    some hash occurs twice. Nothing is exploded or shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_w": words_of(F.col(text)), "_lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.aggregate("_w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.transform("_w", lambda x: F.xxhash64(x)),
        }
    ).drop("_w", "_lines")
    # words 0 and 1; then those, 2 and 3 (as a pair), and 4
    out = out.withColumn("_p", F.transform("_h", lambda x, i: F.xxhash64(x, F.get("_h", i + 1))))
    window = F.transform("_p", lambda x, i: F.xxhash64(x, F.get("_p", i + 2), F.get("_h", i + 4)))
    out = out.withColumn("_h", F.slice(window, F.lit(1), F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0)))).drop("_p")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed).otherwise(none))
    same = lambda x, at: F.coalesce(F.get("_s", at)["h"] == x["h"], F.lit(False))
    again = F.filter("_s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    out = out.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.transform("_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - x, F.lit(WINDOW))))
    covered = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    # generated, so that a filter on the statistics isn't rewritten to compute them for each of its terms
    made = F.struct(*(F.col(c) for c in STATISTICS[:-1]), covered.cast("long").alias(STATISTICS[-1]))
    return out.select(*(c for c in docs.columns if c not in STATISTICS), F.inline(F.array(made)))


def base_failed() -> Column:
    """The fixed rule under the learned ones: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass
class Rule:
    tests: list[tuple[str, str, float]] = field(default_factory=list)  # measure, "<=" or ">", threshold

    def condition(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.tests:
            x = F.expr(MEASURES[name])
            out = out & (x <= F.lit(at) if op == "<=" else x > F.lit(at))
        return out


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects the text, and a text that none covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def rejected_by(self) -> Column:
        """Number of the first rule that holds, from 1; null if none does."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.condition(), F.lit(k)).otherwise(out)
        return out


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_rules: int = 8,
    max_tests: int = 3,
    bins: int = 32,
    min_precision: float = 0.9,
    min_cover: int = 5,
    max_labels: int = 200_000,
) -> DecisionList:
    """Learns what marks label quality 0 from ``docs`` (doc_id and text or STATISTICS) and ``labels`` (doc_id, quality).

    Fitted on at most ``max_labels`` labelled rows: those of smallest hash, so it is a fixed sample of at most 17 bytes
    a row, which is why it may be broadcast. Only counts (at most measures x (bins + 1) x 2 rows a step) and
    thresholds reach the driver. Rows that fail the base rule are rejected anyway and not learned from.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(max_labels)
    measured = all(c in docs.columns for c in STATISTICS)
    rows = docs.select("doc_id", *(STATISTICS if measured else ["text"])).join(F.broadcast(known), "doc_id")
    rows = (rows if measured else text_statistics(rows)).where(~base_failed())
    rows = rows.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), *STATISTICS)
    rows = saved(rows, "labelled-statistics")
    steps = [k / bins for k in range(1, bins)]
    cuts = rows.agg(*(F.percentile_approx(F.expr(x), steps, 10_000).alias(m) for m, x in MEASURES.items())).first()
    if cuts["words"] is None:
        return DecisionList()
    edges = {m: sorted(set(cuts[m])) for m in MEASURES}
    binned = [F.expr(f"size(filter(array({','.join(f'{e!r}D' for e in edges[m])}), e -> e < {x}))").alias(m) for m, x in MEASURES.items()]
    rows = saved(rows.select("bad", "prune", *STATISTICS, *(b.alias(f"_{m}") for b, m in zip(binned, MEASURES, strict=True))), "binned-statistics")
    entries = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col(f"_{m}").alias("b")) for m in MEASURES)))

    out = DecisionList()
    left = rows
    while len(out.rules) < max_rules:
        rule = Rule()
        while len(rule.tests) < max_tests:
            inside = left.where(~F.col("prune")).where(rule.condition())
            counts = inside.select("bad", entries.alias("e")).groupBy("e.m", "e.b", "bad").count().collect()
            best = _best_test(counts, edges, min_cover)
            if best is None:
                break
            rule.tests.append(best)
        rule = _pruned(rule, left)
        n, bad = left.where(rule.condition()).agg(F.count("*"), F.sum(F.col("bad").cast("int"))).first() if rule.tests else (0, 0)
        if not rule.tests or n < min_cover or bad < min_precision * n:
            break
        out.rules.append(rule)
        left = left.where(~rule.condition())
    return out


def _best_test(counts: list, edges: dict[str, list[float]], min_cover: int) -> tuple[str, str, float] | None:
    """The test of most FOIL gain, from the counts by measure, bin and label of what the rule covers so far."""
    by: dict[str, dict[int, list[int]]] = {}
    for m, b, bad, n in counts:
        by.setdefault(m, {}).setdefault(b, [0, 0])[bool(bad)] += n
    best, most = None, 1e-9
    for m in sorted(by):
        total = [sum(x[k] for x in by[m].values()) for k in (0, 1)]
        if not all(total):
            return None
        before, below = math.log2(total[1] / sum(total)), [0, 0]
        for k, edge in enumerate(edges[m]):
            below = [below[j] + by[m].get(k, [0, 0])[j] for j in (0, 1)]
            for op, (good, bad) in (("<=", below), (">", [total[0] - below[0], total[1] - below[1]])):
                if bad and good + bad >= min_cover and (gain := bad * (math.log2(bad / (good + bad)) - before)) > most:
                    best, most = (m, op, edge), gain
    return best


def _pruned(rule: Rule, left: DataFrame) -> Rule:
    """The shortest beginning of the rule whose (bad - good) / (bad + good) is highest on the pruning rows."""
    if not rule.tests:
        return rule
    begun = [Rule(rule.tests[:k]) for k in range(1, len(rule.tests) + 1)]
    sums = [F.coalesce(F.sum(F.when(r.condition(), F.when(F.col("bad") == bad, 1))), F.lit(0)) for r in begun for bad in (True, False)]
    got = left.where("prune").agg(*(x.alias(f"x{k}") for k, x in enumerate(sums))).first()
    worth = [(got[2 * k] - got[2 * k + 1]) / max(1, got[2 * k] + got[2 * k + 1]) for k in range(len(begun))]
    return begun[max(range(len(begun)), key=lambda k: (worth[k], -k))]


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (of the learned list) and kept, a row per row of ``docs``."""
    measured = saved(text_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    learned = learn(measured, labels, **options)
    out = measured.withColumns({"base_failed": base_failed(), "rule": learned.rejected_by()})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the base rule and the learned list keep, with the columns of ``docs``."""
    names = docs.columns
    learned = learn(docs.select("doc_id", "text"), labels, **options)
    packed = text_statistics(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("text").alias("_text")), "_text")
    return packed.where(~base_failed() & learned.rejected_by().isNull()).select(*(F.col("_row")[c].alias(c) for c in names))
