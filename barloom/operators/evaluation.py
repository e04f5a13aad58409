"""Scores of forecasts, calibration, the ledger, and what is learned from it.

Everything is grouped sums but for the isotonic fit, which folds a group's pairs of
stated and observed; a group is one model, regime and class, whose pairs are binned to
four decimals first, so it never holds more than 10,001 rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numbers import let, normal_tail, wilson
from barloom.operators.models import brier, log_loss, most_likely
from barloom.operators.patterns import benjamini_hochberg

BASELINE = "baseline_climatology"
SCOPE = ("asset", "source", "timeframe")
CLASSES = ("up", "flat", "down")


def scored(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumn("brier", brier(F.col("p"), F.col("truth"))).withColumn("log_loss", log_loss(F.col("p"), F.col("truth"))).withColumn("correct", most_likely(F.col("p")) == F.col("truth"))


def paired_p(n: Column, mean: Column, variance: Column) -> Column:
    """One-sided p that a mean difference is above zero; 1 below five pairs."""
    z = mean / F.sqrt(variance / n)
    return F.when(n < 5, 1.0).when(variance <= 0, F.when(mean <= 0, 1.0).otherwise(0.0)).otherwise(normal_tail(z))


def against_baseline(scores: DataFrame, baseline: str = BASELINE, on: tuple[str, ...] = (*SCOPE, "as_of"), slices: tuple[str, ...] = ("regime",), recent: int | None = None, rate: float = 0.05, key: tuple[str, ...] = ()) -> DataFrame:
    """Of each model, over all and by slice: n, Brier of both, skill, p, significance over the whole family, beats_baseline.

    With a key, which `on` must have, each of its values is an evaluation and a family of its own.
    """
    base = scores.where(F.col("model") == baseline).select(*on, F.col("brier").alias("base_brier"))
    pairs = scores.where(F.col("model") != baseline).join(base, list(on))
    pairs = pairs.withColumn("slice", F.explode(F.array(F.lit("all"), *(F.col(s) for s in slices)))).withColumn("d", F.col("base_brier") - F.col("brier"))
    if recent:
        w = Window.partitionBy(*key, "model", "slice").orderBy(F.desc("as_of"), *on)
        pairs = pairs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= recent)
    g = pairs.groupBy(*key, "model", "slice").agg(F.count("*").alias("n"), F.avg("brier").alias("brier"), F.avg("base_brier").alias("base_brier"), F.avg("log_loss").alias("log_loss"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("d").alias("_m"), F.var_samp("d").alias("_v"))
    g = g.where("n >= 5").withColumn("skill", F.when(F.col("base_brier") > 0, 1 - F.col("brier") / F.col("base_brier")).otherwise(0.0)).withColumn("p_value", paired_p(F.col("n"), F.col("_m"), F.col("_v")))
    g = benjamini_hochberg(g, "p_value", rate, key).drop("_m", "_v")
    return g.withColumn("beats_baseline", (F.col("n") >= 30) & (F.col("skill") > 0.01) & F.col("significant"))


def learned_weights(scores: DataFrame, key: tuple[str, ...] = ("asset", "timeframe"), previous: DataFrame | None = None, least: int = 40, shrink: int = 100, blend: float = 0.3, recent: int = 400) -> DataFrame:
    """weight of each model, key and slice (all, regime) that passed the gate: skill of its `recent` newest pairs shrunk by their number, blended with the scope's mean where two or more qualify.

    The family of the step-up test is all slices together: one row a model, key and regime. previous has model, key, slice and weight.
    """
    on = [*dict.fromkeys((*key, *SCOPE, "as_of"))]
    base = scores.where(F.col("model") == BASELINE).select(*on, F.col("brier").alias("base_brier"))
    pairs = scores.where(F.col("model") != BASELINE).join(base, on).withColumn("slice", F.explode(F.array(F.lit("all"), F.col("regime"))))
    cell = ("model", *key, "slice")
    pairs = pairs.withColumn("_k", F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("as_of"), *on))).where(F.col("_k") <= recent).withColumn("_d", F.col("base_brier") - F.col("brier"))
    g = pairs.groupBy(*cell).agg(F.count("*").alias("n"), F.avg("brier").alias("brier"), F.avg("base_brier").alias("base_brier"), F.avg("_d").alias("_m"), F.var_samp("_d").alias("_v"))
    g = g.withColumn("skill", F.round(F.when(F.col("base_brier") > 0, 1 - F.col("brier") / F.col("base_brier")).otherwise(0.0), 6)).withColumn("p_value", F.round(paired_p(F.col("n"), F.col("_m"), F.col("_v")), 6))
    g = benjamini_hochberg(g, "p_value").drop("_m", "_v")
    ok = (F.col("n") >= least) & (F.col("skill") > 0.01) & F.col("significant")
    g = g.withColumn("_w", F.when(ok, F.round(F.col("skill") * F.col("n") / (F.col("n") + shrink), 6)).otherwise(0.0))
    w = Window.partitionBy(*key, "slice")
    many, mean = F.count(F.when(F.col("_w") > 0, 1)).over(w), F.avg(F.when(F.col("_w") > 0, F.col("_w"))).over(w)
    g = g.withColumn("weight", F.when((F.col("_w") > 0) & (many >= 2), F.round(F.col("_w") * (1 - blend) + mean * blend, 6)).otherwise(F.col("_w"))).drop("_w")
    reason = F.when(F.col("weight") > 0, None).when(F.col("n") < least, "too few samples").when(F.col("skill") <= 0.01, "no skill").when(~F.col("significant"), "not significant").otherwise("shrunk to zero")
    g = g.withColumn("gated_by", reason)
    if previous is None:
        return g
    old = previous.select(*cell, F.col("weight").alias("previous_weight"))
    return g.join(old, list(cell), "left").withColumn("previous_weight", F.coalesce("previous_weight", F.lit(0.0))).withColumn("delta", F.round(F.col("weight") - F.col("previous_weight"), 6))


def outcome_slices(outcomes: DataFrame) -> DataFrame:
    """Of each model over all, by asset, timeframe, horizon, regime and volatility: count, Brier, log loss, accuracy, class shares, mean probability of the truth, has_evidence.

    outcomes: model, asset, timeframe, horizon, regime, volatility_bucket, brier, log_loss, correct, truth, probability_of_truth.
    """
    dims = {"overall": F.lit("all"), "asset": F.col("asset"), "timeframe": F.col("timeframe"), "horizon": F.concat(F.col("horizon").cast("string"), F.lit(" bars")), "regime": F.col("regime"), "volatility": F.col("volatility_bucket")}
    long = outcomes.withColumn("_d", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value")) for d, v in dims.items()))))
    share = lambda k: F.round(F.count(F.when(F.col("truth") == k, 1)) / F.count("*"), 4).alias(k)
    g = long.groupBy("model", F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value")).agg(
        F.count("*").alias("n"), F.round(F.avg("brier"), 5).alias("brier"), F.round(F.avg("log_loss"), 5).alias("log_loss"), F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"),
        share("up"), share("flat"), share("down"), F.round(F.avg("probability_of_truth"), 4).alias("mean_probability_of_truth"),
    )
    return g.withColumn("has_evidence", F.col("n") >= 30)


def best_slices(slices: DataFrame) -> DataFrame:
    """Of each dimension the model and value with the lowest Brier score among the slices with evidence."""
    ok = slices.where("has_evidence")
    return ok.groupBy("dimension").agg(F.min(F.struct("brier", "model", "value", "n")).alias("b")).select("dimension", "b.model", "b.value", "b.brier", "b.n")


def verdict(n_outcomes: Column, weights: Column, least: int = 60) -> Column:
    """What a round of learning came to."""
    return F.when(n_outcomes < least, "no evidence").when(weights > 0, "learned").otherwise("learned nothing")


def reliability(forecasts: DataFrame, key: tuple[str, ...] = ("model",), bins: int = 10, weight: str | None = None) -> DataFrame:
    """count, mean stated, observed share and its interval by key, class and bin; weight names a column that says how many forecasts a row is."""
    n = F.lit(1) if weight is None else F.col(weight)
    long = forecasts.select(*key, "truth", n.alias("w"), F.explode(F.array(*(F.struct(F.lit(k).alias("outcome"), F.col(f"p.{k}").alias("stated")) for k in CLASSES))).alias("x"))
    long = long.select(*key, "x.*", "w", (F.col("truth") == F.col("x.outcome")).cast("int").alias("hit"))
    out = long.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("stated") * bins)).cast("int")).groupBy(*key, "outcome", "bin").agg(F.sum("w").alias("n"), (F.sum(F.col("stated") * F.col("w")) / F.sum("w")).alias("mean_stated"), F.sum(F.col("hit") * F.col("w")).alias("hits"))
    out = out.withColumn("observed", F.col("hits") / F.col("n")).withColumn("_i", wilson(F.col("hits"), F.col("n")))
    return out.select(*key, "outcome", "bin", "n", "mean_stated", "hits", "observed", F.col("_i.low").alias("low"), F.col("_i.high").alias("high"))


def calibration_error(bins: DataFrame, key: tuple[str, ...] = ("model",), places: int = 9) -> DataFrame:
    """Expected calibration error of each key: per class the bins' gaps weighted by count, averaged over the classes."""
    by = bins.groupBy(*key, "outcome").agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_stated") - F.col("observed"))) / F.sum("n"), places).alias("ece"))
    return by.groupBy(*key).agg(F.round(F.sum("ece") / len(CLASSES), places).alias("ece"))


def pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The isotonic fit of y on ascending x with weights w: neighbours that fall are pooled."""
    value: list[float] = []
    mass: list[float] = []
    size: list[int] = []
    for a, b in zip(y, w, strict=True):
        value.append(float(a))
        mass.append(float(b))
        size.append(1)
        while len(value) > 1 and value[-2] > value[-1]:
            b2, v2, n2 = mass.pop(), value.pop(), size.pop()
            value[-1] = (value[-1] * mass[-1] + v2 * b2) / (mass[-1] + b2)
            mass[-1] += b2
            size[-1] += n2
    return np.repeat(value, size)


def isotonic(forecasts: DataFrame, key: tuple[str, ...] = ("model", "slice"), weight: str | None = None) -> DataFrame:
    """xs and ys of the fitted curve of each key and class; weight as in reliability."""
    n = F.lit(1) if weight is None else F.col(weight)
    long = forecasts.select(*key, "truth", n.cast("double").alias("w"), F.explode(F.array(*(F.struct(F.lit(k).alias("outcome"), F.round(F.col(f"p.{k}"), 4).alias("x")) for k in CLASSES))).alias("c"))
    long = long.select(*key, "c.outcome", "c.x", "w", (F.col("truth") == F.col("c.outcome")).cast("double").alias("y"))
    binned = long.groupBy(*key, "outcome", "x").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y"), F.sum("w").alias("w"))

    def fit(group: pa.Table) -> pa.Table:
        x, y, w = (group.column(c).to_numpy() for c in ("x", "y", "w"))
        order = np.argsort(x, kind="stable")
        head = {k: group.column(k).slice(0, 1) for k in (*key, "outcome")}
        return pa.table(head | {"xs": [x[order].tolist()], "ys": [pooled(x[order], y[order], w[order]).tolist()]})

    kinds = ", ".join(f"`{k}` {binned.schema[k].dataType.simpleString()}" for k in (*key, "outcome"))
    return binned.groupBy(*key, "outcome").applyInArrow(fit, f"{kinds}, xs array<double>, ys array<double>")


def on_curve(xs: Column, ys: Column, x: Column) -> Column:
    """Linear between the curve's points, level beyond its ends; x itself without a curve."""

    def between(k):
        x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
        return F.when(k == 0, F.get(ys, F.lit(0))).when(k == F.size(xs), y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))

    return F.when(xs.isNull() | (F.size(xs) == 0), x).otherwise(let(F.size(F.filter(xs, lambda q: q <= x)), between))


def hashed(forecasts: DataFrame, horizon: int, version: str = "1") -> DataFrame:
    """forecasts as ledger rows: prediction_id from what is forecast, content_hash over everything that must not change."""
    when = F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    what = F.concat_ws("|", "model", F.upper("asset"), "timeframe", F.lit(str(horizon)), when)
    nine = [F.format_string("%.9f", F.col(c)) for c in ("p.up", "p.flat", "p.down", "confidence", "threshold")]
    body = F.concat_ws("|", "model", F.lit(version), F.upper("asset"), "timeframe", F.lit(str(horizon)), when, *nine)
    return forecasts.withColumn("prediction_id", F.substring(F.sha2(what, 256), 1, 40)).withColumn("content_hash", F.sha2(body, 256)).withColumn("horizon", F.lit(horizon)).withColumn("version", F.lit(version))


def verified(ledger: DataFrame) -> DataFrame:
    """ledger with intact: whether the stored hash is that of the row."""
    when = F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    nine = [F.format_string("%.9f", F.col(c)) for c in ("p.up", "p.flat", "p.down", "confidence", "threshold")]
    body = F.concat_ws("|", "model", "version", F.upper("asset"), "timeframe", F.col("horizon").cast("string"), when, *nine)
    return ledger.withColumn("intact", F.col("content_hash") == F.sha2(body, 256))


def resolve(ledger: DataFrame, bars: DataFrame, timeframe: str, now: str) -> DataFrame:
    """Outcomes of the due, intact rows of a ledger whose exit bar is known: the last bar closed by the due time, not older than one bar."""
    from barloom.functions.grid import seconds
    from barloom.operators.asof import last_before

    s = seconds(timeframe)
    due = verified(ledger).where("intact").withColumn("resolves_at", F.timestamp_add("SECOND", ((F.col("horizon") + 1) * s).cast("int"), F.col("as_of")))
    due = due.where(F.col("resolves_at") + F.expr(f"INTERVAL {s} SECONDS") <= F.lit(now).cast("timestamp_ntz"))
    exits = bars.where("is_final").select("asset", "source", "timeframe", (F.col("open_time") + F.expr(f"INTERVAL {s} SECONDS")).alias("closed"), F.col("close").alias("exit_price"))
    met = last_before(due, exits, ["asset", "source", "timeframe"], "resolves_at", "closed", ["exit_price"], tolerance=f"{s} SECONDS").where("exit_price IS NOT NULL")
    from barloom.operators.models import outcome

    move = (F.col("exit_price") - F.col("reference_price")) / F.col("reference_price") * 100
    out = met.withColumn("move_pct", move).withColumn("truth", outcome(move, F.col("threshold")))
    return scored(out)


def correlation(returns: DataFrame, ts: str = "open_time", key: str = "asset", value: str = "ret", least: int = 30) -> DataFrame:
    """Pearson correlation of every unordered pair of keys over the times that both have; 0 with fewer than `least`. A join on time, then sums."""
    a = returns.select(F.col(key).alias("a"), F.col(ts).alias("t"), F.col(value).alias("x")).where("x IS NOT NULL")
    b = a.select(F.col("a").alias("b"), "t", F.col("x").alias("y"))
    return a.join(b, "t").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("_r")).select("a", "b", "n", F.when((F.col("n") < least) | F.isnan("_r"), 0.0).otherwise(F.coalesce("_r", F.lit(0.0))).alias("correlation"))
