"""Move-by-move evaluations: swings, trends, quality, sacrifices, elegance scores, annotation.

Everything is a window over plies of one game, (game_id, ply), so a game is never in more than one task and no task
holds more than its games.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import band, eval_text, length_penalty, move_quality

#: Default of the swing and the deviation of a game without evaluations, and the bands of the components
#: (10th and 90th percentile, whether more is better).
DEFAULT_SWING, DEFAULT_DEVIATION = 350.0, 220.0
BANDS = {"soundness": (45.0, 280.0, False), "coherence": (35.0, 240.0, False), "tactics": (22.0, 56.0, True), "quiet": (0.4, 6.5, True)}


def _game() -> Window:
    return Window.partitionBy("game_id").orderBy("ply")


def _side() -> Window:
    return Window.partitionBy("game_id", "is_white").orderBy("ply")


def swings(plies: DataFrame) -> DataFrame:
    """Evaluated plies with swing (change since the last evaluated ply) and mover_delta (seen by the side that moved)."""
    done = plies.where("eval_white_cp is not null")
    out = done.withColumn("swing", F.col("eval_white_cp") - F.lag("eval_white_cp").over(_game()))
    return out.withColumn("mover_delta", F.when(F.col("is_white"), F.col("swing")).otherwise(-F.col("swing")))


def trend_breaks(plies: DataFrame) -> DataFrame:
    """Evaluated plies with trend_break: the side's evaluation turns round by at least half a pawn."""
    d1 = F.col("eval_white_cp") - F.lag("eval_white_cp").over(_side())
    out = plies.where("eval_white_cp is not null").withColumn("_d1", d1).withColumn("_p1", F.lag("_d1").over(_side()))
    turn = (F.signum(F.col("_d1").cast("double")) * F.signum(F.col("_p1").cast("double")) < 0) & (F.abs(F.col("_d1") - F.col("_p1")) >= 50)
    return out.withColumn("trend_break", F.coalesce(turn, F.lit(False))).drop("_d1", "_p1")


def with_start(plies: DataFrame, start_fen: str | None = None) -> DataFrame:
    """``plies`` with a ply 0 per game, evaluated at 0, for the full-evaluation variants."""
    zero = plies.select("game_id").distinct()
    fields = {"ply": F.lit(0), "is_white": F.lit(False), "is_quiet": F.lit(False), "eval_white_cp": F.lit(0), "fen": F.lit(start_fen).cast("string")}
    return plies.unionByName(zero.select("game_id", *(x.alias(k) for k, x in fields.items() if k in plies.columns)), allowMissingColumns=True)


def game_metrics(plies: DataFrame, full_eval: bool = False) -> DataFrame:
    """Per game: plies, evaluated, forcing share, quiet improvements, trend breaks, errors, mean swing, deviation."""
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    flag = lambda c: F.coalesce(F.sum(c), F.lit(0)) if c in plies.columns else F.lit(0)
    base = plies.groupBy("game_id").agg(
        F.count("*").alias("plies"),
        n(F.col("eval_white_cp").isNotNull()).alias("evaluated"),
        n(~F.col("is_quiet")).alias("forcing"),
        *(flag(c).alias(f"a_{c}") for c in ("blunder", "mistake", "dubious")),
    )
    source = with_start(plies) if full_eval else plies
    d = F.col("mover_delta")
    moved = swings(source).where("ply > 0").groupBy("game_id").agg(
        n(F.col("is_quiet") & (d >= 150)).alias("quiet_improvements"),
        n(d <= -300).alias("e_blunder"),
        n((d <= -150) & (d > -300)).alias("e_mistake"),
        n((d <= -60) & (d > -150)).alias("e_dubious"),
        F.avg(F.abs("swing")).alias("mean_swing"),
        F.stddev_pop("mover_delta").alias("deviation"),
    )
    turned = trend_breaks(source).groupBy("game_id").agg(n(F.col("trend_break")).alias("trend_breaks"))
    out = base.join(moved, "game_id", "left").join(turned, "game_id", "left")
    errors = [F.greatest(F.lit(0) if full_eval else F.col(f"a_{c}"), F.coalesce(f"e_{c}", F.lit(0))).alias(f"{c}s") for c in ("blunder", "mistake", "dubious")]
    return measured(out.select("*", *errors))


def measured(counts: DataFrame) -> DataFrame:
    """Metrics of counts per game; where there is none, or no swing, the default."""
    return counts.select(
        "game_id",
        "plies",
        "evaluated",
        (100.0 * F.col("forcing") / F.col("plies")).alias("forcing_share"),
        F.coalesce("quiet_improvements", F.lit(0)).alias("quiet_improvements"),
        F.coalesce("trend_breaks", F.lit(0)).alias("trend_breaks"),
        "blunders",
        "mistakes",
        "dubiouss",
        F.coalesce("mean_swing", F.lit(DEFAULT_SWING)).alias("mean_swing"),
        F.coalesce("deviation", F.lit(DEFAULT_DEVIATION)).alias("deviation"),
    )


def elegance(metrics: DataFrame, sacrificed: DataFrame | None = None) -> DataFrame:
    """Components soundness, coherence, tactics, quiet, length and the score 0.25 S + 0.20 C + 0.20 T + 0.30 Q - 0.05 L;
    with evaluations for less than four fifths of the plies, S, C and Q count less.

    S is the band of the mean swing and 25, 10 and 5 for each blunder, mistake and dubious move; C that of the deviation
    and 18 for each break of the trend; T of the forcing share; Q of quiet improvements per hundred plies. With
    ``sacrificed`` (see ``sacrifices``), unsound pawns cost soundness, and sound ones add to Q what unsound ones take."""
    b = lambda name, x: band(x, *BANDS[name])
    swing = F.col("mean_swing") + 25 * F.col("blunders") + 10 * F.col("mistakes") + 5 * F.col("dubiouss")
    calm = 100.0 * F.col("quiet_improvements") / F.col("plies")
    if sacrificed is not None:
        metrics = metrics.join(sacrificed, "game_id", "left").na.fill(0, ["sound", "unsound", "sound_cp", "unsound_cp"])
        won, lost = F.col("sound_cp") / 100.0, F.col("unsound_cp") / 100.0
        swing = swing + 35 * lost
        calm = F.greatest(F.lit(0.0), calm + (0.75 * won + 0.35 * F.col("sound")) - (0.4 * lost + 0.25 * F.col("unsound")))
    share = F.col("evaluated") / F.col("plies")
    factor = F.when(share < 0.8, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - 0.2) / 0.6))).otherwise(F.lit(1.0))
    s = factor * b("soundness", swing)
    c = factor * b("coherence", F.col("deviation") + 18 * F.col("trend_breaks"))
    t = b("tactics", F.col("forcing_share"))
    q = factor * b("quiet", calm)
    parts = {"soundness": s, "coherence": c, "tactics": t, "quiet": q, "length_cost": length_penalty(F.col("plies"))}
    out = metrics.select("game_id", *(F.round(x, 4).alias(k) for k, x in parts.items()))
    total = 0.25 * F.col("soundness") + 0.2 * F.col("coherence") + 0.2 * F.col("tactics") + 0.3 * F.col("quiet") - 0.05 * F.col("length_cost")
    out = out.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))))
    show = lambda k, x: F.concat(F.lit(f"{k}="), F.round(x).cast("int").cast("string"))
    return out.withColumn("details", F.concat_ws(";", *(show(k, F.col(x)) for k, x in zip("SCTQL", parts, strict=True))))


def run_averages(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("games"), *(F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("score", "soundness", "coherence", "tactics", "quiet")))


def validate(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """Cases (name, min_score, max_score) against the average of their scores (name, score): passed and a message."""
    mean = scores.groupBy("name").agg(F.avg("score").alias("avg_score"))
    out = cases.join(mean, "name", "left").withColumn("avg_score", F.round("avg_score", 4))
    low, high = F.col("avg_score") < F.col("min_score"), F.col("avg_score") > F.col("max_score")
    message = F.when(F.col("avg_score").isNull(), "no games").when(low, "below the least score").when(high, "above the greatest score").otherwise("ok")
    return out.select("name", "avg_score", message.alias("message"), (message == "ok").alias("passed"))


def sacrifices(plies: DataFrame, white_material: str = "white_material", black_material: str = "black_material") -> DataFrame:
    """Per game: sound and unsound sacrifices and their centipawns. A side that is at least a pawn's worth down after a
    ply is sound if its evaluation fell no further, and stands no lower, than the size allows."""
    lost_w = F.lag(white_material).over(_game()) - F.col(white_material)
    lost_b = F.lag(black_material).over(_game()) - F.col(black_material)
    out = plies.withColumns({"_w": lost_w, "_b": lost_b, "_before": F.lag("eval_white_cp").over(_game())})
    white = F.col("_w") >= 100
    lost = F.when(white, F.col("_w")).when(F.col("_b") >= 100, F.col("_b"))
    sign = F.when(white, F.lit(1)).otherwise(F.lit(-1))
    drop, stands = sign * (F.col("eval_white_cp") - F.col("_before")), sign * F.col("eval_white_cp")
    limit = lambda a, b, c: F.when(lost >= 500, a).when(lost >= 300, b).otherwise(c)
    sound = (drop >= limit(-140, -120, -90)) & (stands >= limit(-220, -180, -140))
    out = out.withColumns({"_lost": lost, "_sound": sound}).where("_lost is not null and _sound is not null")
    n = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    s = F.col("_sound")
    return out.groupBy("game_id").agg(n(s, 1).alias("sound"), n(~s, 1).alias("unsound"), n(s, F.col("_lost")).alias("sound_cp"), n(~s, F.col("_lost")).alias("unsound_cp"))


def annotate(plies: DataFrame) -> DataFrame:
    """(game_id, movetext): moves with numbers, the NAG of what each lost against the ply before, and its evaluation."""
    rows = swings(with_start(plies)).select("game_id", "ply", "mover_delta").where("ply > 0")
    out = plies.join(rows, ["game_id", "ply"], "left")
    number = F.when(F.col("is_white"), F.concat(((F.col("ply") + 1) / 2).cast("int").cast("string"), F.lit(".")))
    remark = F.when(F.col("eval_white_cp").isNotNull(), F.concat(F.lit("{ [%eval "), eval_text(F.col("eval_white_cp")), F.lit("] }")))
    text: Column = F.concat_ws(" ", number, F.col("san"), move_quality(F.col("mover_delta")), remark)
    return out.groupBy("game_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ply", text.alias("t")))), lambda x: x["t"]), " ").alias("movetext"))
