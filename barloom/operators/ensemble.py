"""The panel of forecasters: calibration with a hold-out gate, agreement, weights, confidence, publication.

Everything is a join or an aggregate by point, model or slice; a hold-out is cut by
position in time, which is counted by time first, so that no group of a model's whole
history is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numbers import clip, let
from barloom.operators.evaluation import CLASSES, calibration_error, isotonic, on_curve, reliability
from barloom.operators.models import most_likely, uniform

POINT = ("asset", "source", "timeframe", "as_of")
#: Rows to fit from, share that fits, rows to judge, gain that a curve must bring.
FIT_ROWS, FIT_SHARE, HOLD_ROWS, FIT_GAIN = 120, 0.6, 20, 0.005
#: Highest confidence, floor of publication, edge of a call, rows for full trust in a sample and in a regime.
TOP, FLOOR, EDGE, SAMPLE, FAMILIAR = 0.85, 0.35, 0.08, 400, 100
#: What a super-prediction needs.
FAMILIES, PANEL, CONSENSUS, SURE, QUALITY = 6, 8, 0.75, 0.65, 0.85
FACTORS = ("skill", "calibration", "agreement", "data_quality", "sample", "regime_familiarity")


def sliced(forecasts: DataFrame, by: str = "regime") -> DataFrame:
    """forecasts twice: in the slice `all` and in that of their regime."""
    return forecasts.withColumn("slice", F.explode(F.array(F.lit("all"), F.col(by))))


def skill_weights(report: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """model, slice, weight and samples of each slice of an evaluation (by, model, slice, n, skill, beats_baseline); weight is null where the slice failed its gate."""
    return report.select(*by, "model", "slice", F.when(F.col("beats_baseline") & (F.col("skill") >= 0.01), F.round("skill", 5)).alias("weight"), F.col("n").alias("samples"))


def _mapped(p: Column, curves: Column) -> Column:
    """p through the curves of its classes, and renormalised; p itself if that leaves nothing."""
    q = F.struct(*(on_curve(curves[k]["xs"], curves[k]["ys"], clip(p[k], 0, 1)).alias(k) for k in CLASSES))
    shares = lambda q: let(q["up"] + q["flat"] + q["down"], lambda total: F.when(total > 0, F.struct(*((q[k] / total).alias(k) for k in CLASSES))).otherwise(p))
    return let(q, shares)


def calibration_records(forecasts: DataFrame, least: int = FIT_ROWS, gain: float = FIT_GAIN, by: tuple[str, ...] = ()) -> DataFrame:
    """Of each model and slice, of each `by`: rows, error of the held-out rest before and after the curves fitted on the first FIT_SHARE, whether they are kept, up to when they know.

    forecasts: model, regime, asset, as_of, p, confidence, truth; abstentions (no confidence) are left out.
    """
    key = (*by, "model", "slice")
    rows = sliced(forecasts.where("confidence > 0")).select(*dict.fromkeys((*key, "asset")), "as_of", "p", "truth")
    times = rows.groupBy(*key, "as_of").agg(F.count("*").alias("_m"))
    order = Window.partitionBy(*key).orderBy("as_of")
    times = times.select(*key, "as_of", (F.sum("_m").over(order) - F.col("_m")).alias("_before"), F.sum("_m").over(Window.partitionBy(*key)).alias("n"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy(*key, "as_of").orderBy("asset")) - 1
    rows = rows.join(times, [*key, "as_of"]).withColumn("_at", at).withColumn("_cut", F.greatest(F.lit(1), F.floor(F.col("n") * FIT_SHARE)))
    # What a model states repeats: from here on one row a slice, side of the cut, statement and truth.
    rows = rows.groupBy(*key, "n", "_cut", (F.col("_at") < F.col("_cut")).alias("_fits"), "p", "truth").agg(F.count("*").alias("_rows"), F.max("as_of").alias("as_of"))
    fit, rest = rows.where("_fits"), rows.where("NOT _fits")
    sizes = rows.groupBy(*key).agg(F.first("n").alias("samples"), F.coalesce(F.sum(F.when(~F.col("_fits"), F.col("_rows"))), F.lit(0)).alias("holdout"), F.max(F.when(F.col("_fits"), F.col("as_of"))).alias("fitted_through"))
    sizes = sizes.withColumn("_ok", (F.col("samples") >= least) & (F.col("holdout") >= HOLD_ROWS))
    enough = sizes.where("_ok").select(*key)
    # A curve needs ten pairs and two different statements to have a shape.
    curves = isotonic(fit.join(enough, list(key), "left_semi"), key, "_rows").where("size(xs) >= 2")
    wide = curves.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("outcome", F.struct("xs", "ys")))).alias("curves"))
    judged = rest.join(enough, list(key), "left_semi").join(wide, list(key), "left")
    before = calibration_error(reliability(judged, key, weight="_rows"), key, 5).withColumnRenamed("ece", "ece_before")
    after = calibration_error(reliability(judged.withColumn("p", _mapped(F.col("p"), F.col("curves"))), key, weight="_rows"), key, 5).withColumnRenamed("ece", "ece_after")
    out = sizes.join(before, list(key), "left").join(after, list(key), "left").join(wide, list(key), "left")
    better = F.round(F.col("ece_before") - F.col("ece_after"), 5)
    return out.select(*key, "samples", F.when(F.col("_ok"), F.col("holdout")).otherwise(0).alias("holdout"), "ece_before", "ece_after", better.alias("improvement"), F.coalesce(better >= gain, F.lit(False)).alias("improved"), F.when(F.col("_ok"), F.col("fitted_through")).alias("fitted_through"), "curves")


def calibrated(forecasts: DataFrame, records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """forecasts with p mapped by their regime's record, else by that over all; and record (one applied or was measured), improvement, in_regime (a kept one of the regime applied).

    A record never maps a forecast from before it was fitted: that would calibrate the past with its future.
    """
    of = records.select(*by, "model", F.col("slice").alias("_s"), F.struct("improved", "improvement", "fitted_through", "curves").alias("_r"))
    df = forecasts.join(of.withColumnsRenamed({"_s": "regime", "_r": "_own"}), [*by, "model", "regime"], "left")
    df = df.join(of.where("_s = 'all'").select(*by, "model", F.col("_r").alias("_all")), [*by, "model"], "left")
    df = df.withColumn("_c", F.coalesce("_own", "_all"))
    known, kept = F.col("_c").isNotNull(), F.coalesce(F.col("_c.improved"), F.lit(False))
    early = kept & (F.col("as_of") <= F.col("_c.fitted_through"))
    uses = kept & ~early
    out = df.withColumn("p", F.when(uses, _mapped(F.col("p"), F.col("_c.curves"))).otherwise(F.col("p")))
    out = out.withColumn("record", known & ~early).withColumn("improvement", F.when(uses, F.col("_c.improvement")))
    return out.withColumn("in_regime", uses & F.coalesce(F.col("_own.improved"), F.lit(False))).withColumn("regime_record", F.coalesce(F.col("_own.improved"), F.lit(False))).drop("_own", "_all", "_c")


def factors(skill: Column, weighted: Column, record: Column, in_regime: Column, improvement: Column, consensus: Column, effective: Column, members: Column, quality: Column, samples: Column, regime_samples: Column) -> dict[str, Column]:
    """The six factors of a confidence, each measured, none stated by a model itself."""
    return {
        "skill": F.when(~weighted | (skill <= 0), 0.0).otherwise(clip(0.4 + F.least(F.lit(0.6), skill / 0.05 * 0.6), 0, 1)),
        "calibration": F.when(~record, 0.0).when(~in_regime, 0.45).otherwise(clip(0.7 + F.least(F.lit(0.3), F.greatest(F.lit(0.0), improvement) / 0.02 * 0.3), 0, 1)),
        "agreement": F.when((members <= 0) | (effective <= 0), 0.0).otherwise(clip(consensus * F.least(F.lit(1.0), effective / F.greatest(F.lit(1.0), members * 0.5)), 0, 1)),
        "data_quality": clip(quality, 0, 1),
        "sample": clip(samples / SAMPLE, 0, 1),
        "regime_familiarity": clip(regime_samples / FAMILIAR, 0, 1),
    }


def confidence(parts: dict[str, Column]) -> Column:
    """The product without the data's quality, capped at TOP, times the quality: bad data lowers every value."""
    core = parts["skill"] * parts["calibration"] * parts["agreement"] * parts["sample"] * parts["regime_familiarity"]
    return F.round(F.least(F.lit(TOP), core) * parts["data_quality"], 4)


def limiting(parts: dict[str, Column]) -> Column:
    """The name of the smallest factor, the first of equals."""
    return F.array_min(F.array(*(F.struct(parts[n].alias("value"), F.lit(i).alias("at"), F.lit(n).alias("name")) for i, n in enumerate(FACTORS))))["name"]


def independence_table(inputs: DataFrame) -> DataFrame:
    """model and independence, 1 / (1 + the overlaps (Jaccard) with all other models), of inputs (model, input); a model without inputs overlaps with none."""
    own = inputs.groupBy("model").agg(F.collect_set("input").alias("own"))
    pairs = own.alias("a").join(own.alias("b"), F.col("a.model") != F.col("b.model"))  # one row a model
    overlap = F.when(F.size("b.own") + F.size("a.own") > 0, F.size(F.array_intersect("a.own", "b.own")) / F.greatest(F.lit(1), F.size(F.array_union("a.own", "b.own")))).otherwise(0.0)
    return pairs.groupBy(F.col("a.model").alias("model")).agg(F.round(1 / (1 + F.sum(overlap)), 4).alias("independence"))


def panel(forecasts: DataFrame, weights: DataFrame, records: DataFrame, independence: DataFrame, min_edge: float = 0.04, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a point (POINT): the pooled p, agreement, contributions, factors, confidence, why it is suppressed, evidence, invalidation.

    forecasts: POINT, model, regime, p, confidence, threshold, close, data_quality. weights: skill_weights. by: columns that
    forecasts, weights and records have, of which each value was fitted by itself.
    """
    w = weights.select(*by, "model", F.col("slice").alias("_s"), F.struct("weight", "samples").alias("_w"))
    df = calibrated(forecasts, records, by)
    df = df.join(w.withColumnsRenamed({"_s": "regime", "_w": "_own"}), [*by, "model", "regime"], "left").join(w.where("_s = 'all'").select(*by, "model", F.col("_w").alias("_all")), [*by, "model"], "left")
    df = df.join(independence, "model", "left").withColumn("_i", F.coalesce("independence", F.lit(1.0)))
    # A slice that failed its gate has no weight, and then the pooled slice counts, if that passed.
    df = df.withColumn("_skill", F.coalesce(F.col("_own.weight"), F.col("_all.weight"), F.lit(0.0))).withColumn("_n", F.coalesce(F.nullif(F.col("_own.samples"), F.lit(0)), F.col("_all.samples"), F.lit(0)))
    df = df.withColumn("_edge", F.col("p.up") - F.col("p.down")).withColumn("_share", F.when((F.col("confidence") > 0) & (F.col("_skill") > 0), F.round(F.col("_skill") * F.col("_i"), 6)))
    df = df.withColumn("_vote", F.when((F.col("confidence") <= 0) | (F.abs("_edge") < min_edge), None).otherwise(F.when(F.col("_edge") > 0, "up").otherwise("down")))
    side = lambda d, x: F.sum(F.when(F.col("_vote") == d, x).otherwise(0.0))
    g = df.groupBy(*dict.fromkeys((*by, *POINT, "regime"))).agg(
        F.count("*").alias("members"), F.count("_vote").alias("votes"), side("up", F.col("_i")).alias("up_weight"), side("down", F.col("_i")).alias("down_weight"),
        F.count(F.when(F.col("_vote") == "up", 1)).alias("up_votes"), F.count(F.when(F.col("_vote") == "down", 1)).alias("down_votes"),
        F.coalesce(F.sum("_share"), F.lit(0.0)).alias("weight"), F.count("_share").alias("contributors"), F.max("_skill").alias("best_skill"), F.max("_n").alias("samples"),
        F.max(F.col("record").cast("int")).alias("_record"), F.max(F.col("in_regime").cast("int")).alias("_in_regime"), F.max("improvement").alias("_better"),
        F.count(F.when(F.col("_share").isNotNull() & F.col("regime_record"), 1)).alias("_rec_share"), F.count(F.when(F.col("_vote").isNotNull() & F.col("regime_record"), 1)).alias("_rec_vote"),
        *(F.sum(F.col(f"p.{k}") * F.col("_share")).alias(f"_{k}") for k in CLASSES), F.max("threshold").alias("threshold"), F.max("close").alias("close"), F.min("data_quality").alias("data_quality"),
        F.array_sort(F.collect_list(F.when(F.col("_share").isNotNull(), F.struct((-F.col("_share")).alias("o"), "model", F.col("_edge").alias("edge"))))).alias("_by"),
        F.array_sort(F.collect_list(F.when(F.col("_vote").isNotNull(), F.struct("model", F.col("_vote").alias("vote"))))).alias("_votes"), F.array_sort(F.collect_list(F.when(F.col("_vote").isNull(), F.col("model")))).alias("abstained"),
    )
    seen = weights.groupBy(*by, F.col("slice").alias("regime")).agg(F.max("samples").alias("_regime_samples"))
    g = g.join(seen, [*by, "regime"], "left")
    total, up, down = F.round(F.col("up_weight") + F.col("down_weight"), 4), F.col("up_weight"), F.col("down_weight")
    g = g.withColumn("majority", F.when((up > 0) & (up > down + 1e-9), "up").when((down > 0) & (down > up + 1e-9), "down"))
    g = g.withColumn("effective", F.when(F.col("majority").isNotNull(), F.round(F.greatest(up, down), 4)).otherwise(0.0))
    g = g.withColumn("agreeing", F.when(F.col("majority").isNotNull(), F.when(F.col("majority") == "up", F.col("up_votes")).otherwise(F.col("down_votes"))).otherwise(F.lit(0)))
    g = g.withColumn("consensus", F.when(total > 0, F.round(F.col("effective") / total, 4)).otherwise(0.0))
    g = g.withColumn("dissenting", F.transform(F.filter("_votes", lambda v: F.col("majority").isNull() | (v["vote"] != F.col("majority"))), lambda v: v["model"]))
    g = g.withColumn("split", (F.size("dissenting") > 0) & (F.col("consensus") < 0.7))
    c = F.col
    parts = factors(c("best_skill"), c("weight") > 0, c("_record") > 0, c("_in_regime") > 0, F.coalesce("_better", F.lit(0.0)), c("consensus"), c("effective"), c("members"), c("data_quality"), c("samples"), F.coalesce("_regime_samples", F.lit(0)))
    g = g.withColumn("factors", F.struct(*(parts[n].alias(n) for n in FACTORS)))
    parts = {n: F.col(f"factors.{n}") for n in FACTORS}
    g = g.withColumn("value", confidence(parts)).withColumn("limited_by", limiting(parts)).withColumn("calibrated", F.when(c("contributors") > 0, c("_rec_share")).otherwise(c("_rec_vote")))
    pooled = F.struct(*((c(f"_{k}") / c("weight")).alias(k) for k in CLASSES))
    reasons = F.filter(F.array(F.when(c("split"), "models disagree"), F.when(c("value") < FLOOR, F.concat(F.lit("confidence below the floor, limited by "), "limited_by"))), F.isnotnull)
    reasons = F.when(c("weight") <= 0, F.array(F.lit("no member has demonstrated skill"))).otherwise(reasons)
    g = g.withColumn("suppressed_because", reasons).withColumn("_open", F.size("suppressed_because") == 0)
    g = g.withColumn("p", F.when(c("_open"), pooled).otherwise(uniform())).withColumn("confidence", F.when(c("_open"), c("value")).otherwise(0.0))
    g = g.withColumn("published", c("_open") & (c("confidence") >= FLOOR) & (F.abs(c("p.up") - c("p.down")) >= EDGE))
    g = g.withColumn("evidence", F.when(c("_open"), F.slice(F.transform("_by", lambda x: F.struct(x["model"].alias("model"), (-x["o"]).alias("weight"), x["edge"].alias("edge"))), 1, 5)))
    g = g.withColumn("dissenters", F.slice("dissenting", 1, 4)).withColumn("abstainers", F.slice("abstained", 1, 6))
    return g.withColumn("invalidation", F.when(c("_open"), invalidation(c("p"), c("close"), c("threshold"), c("regime")))).drop("_record", "_in_regime", "_better", "_rec_share", "_rec_vote", "_by", "_votes", "_open", "_regime_samples", *(f"_{k}" for k in CLASSES))


def invalidation(p: Column, price: Column, threshold: Column, regime: Column) -> Column:
    """What would prove a call wrong: a price level if it has a direction, then three general conditions."""
    side = most_likely(p)
    level = F.when((price > 0) & (side == "up"), price * (1 - threshold / 100)).when((price > 0) & (side == "down"), price * (1 + threshold / 100))
    general = [F.format_string("a close beyond %.2f%% against %s", threshold, side), F.concat(F.lit("a regime change away from "), regime), F.lit("data quality below 0.8")]
    return F.filter(F.array(F.when(level.isNotNull(), F.format_string("price crossing %.2f", level)), *general), F.isnotnull)


def gate(points: DataFrame) -> DataFrame:
    """panel rows with checks (name, passed) and passed: all nine conditions of a super-prediction."""
    conditions = {
        "panel size": F.col("members") >= PANEL,
        "families agreeing": F.col("agreeing") >= FAMILIES,
        "independent agreement": F.col("effective") >= FAMILIES,
        "no material dissent": ~F.col("split") & (F.col("consensus") >= CONSENSUS),
        "calibrated in this regime": F.col("calibrated") >= FAMILIES,
        "demonstrated skill": F.col("contributors") > 0,
        "confidence": F.col("value") >= SURE,
        "data quality": F.col("data_quality") >= QUALITY,
        "ensemble published": F.col("published"),
    }
    checks = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in conditions.items()))
    return points.withColumn("checks", checks).withColumn("passed", F.forall("checks", lambda c: c["passed"]))


def response(points: DataFrame) -> DataFrame:
    """What a reader gets of each point: a directional call with its confidence and invalidation, or that evidence is insufficient, and why; a call that breaks its own rules fails."""
    call = F.struct(most_likely(F.col("p")).alias("direction"), "p", "confidence", "invalidation")
    sound = (F.size("invalidation") > 0) & (F.col("confidence") >= FLOOR) & (F.abs(F.col("p.up") + F.col("p.flat") + F.col("p.down") - 1) < 1e-6)
    checked = F.when(sound, call).otherwise(F.raise_error(F.lit("a call without confidence, invalidation or a distribution")))
    why = F.coalesce(F.get("suppressed_because", 0), F.lit("below threshold"))
    return points.select(*POINT, F.when(F.col("published"), "call").otherwise("insufficient evidence").alias("form"), F.when(F.col("published"), checked).alias("call"), F.when(~F.col("published"), why).alias("reason"))
