"""Market state: evidence of one timeframe, and the hierarchy of timeframes.

A classifier turns a row of features into four arrays of evidence (label,
contribution, weight); everything after that is sums over arrays. The hierarchy
aggregates the rows of an asset and moment into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.grid import TIMEFRAMES
from barloom.functions.numbers import clip, squash

#: Weights of the evidence groups, directions with their scores and lower bounds.
GROUPS = {"trend": 0.40, "momentum": 0.30, "structure": 0.20, "volume": 0.10}
DIRECTIONS = {"strong_down": -1.0, "down": -0.6, "weak_down": -0.25, "neutral": 0.0, "weak_up": 0.25, "up": 0.6, "strong_up": 1.0}
CUTS = (0.12, 0.35, 0.65)
CONFIDENCE_CAP = 0.90
ADX_TREND, ADX_STRONG = 25.0, 40.0
LOW_VOLATILITY, HIGH_VOLATILITY = 35.0, 110.0
VOTE = 0.05

_EVIDENCE = "array<struct<label:string,contribution:double,weight:double>>"


def _evidence(*items: tuple[str, Column, Column | float, Column]) -> Column:
    """Array of the items (label, contribution, weight, whether it applies)."""
    made = [F.when(on, F.struct(F.lit(label).alias("label"), clip(x, -1, 1).alias("contribution"), (w if isinstance(w, Column) else F.lit(float(w))).alias("weight"))) for label, x, w, on in items]
    return F.filter(F.array(*made), lambda e: e.isNotNull()).cast(_EVIDENCE)


def direction(score: Column) -> Column:
    a, b, c = CUTS
    return F.when(score >= c, "strong_up").when(score >= b, "up").when(score >= a, "weak_up").when(score <= -c, "strong_down").when(score <= -b, "down").when(score <= -a, "weak_down").otherwise("neutral")


def direction_score(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for p in DIRECTIONS.items() for x in p))[name]


def groups(columns: list[str]) -> dict[str, Column]:
    """The evidence of each group over the feature columns there are; absent or null features give none."""
    f = {c: F.col(c) for c in columns}
    c = lambda name: f.get(name, F.lit(None).cast("double"))
    has = lambda *names: reduce(lambda a, b: a & b, (c(n).isNotNull() for n in names))
    close = c("close")
    priced = has("close") & (close > 0)
    trend = [(f"price vs {n}", squash((close - c(n)) / c(n) * 100, 4), w, priced & has(n) & (c(n) > 0)) for n, w in (("ema_21", 1.0), ("sma_50", 1.2), ("sma_200", 1.5))]
    fast, mid, slow = c("ema_21"), c("sma_50"), c("sma_200")
    stack = F.when((fast > mid) & (mid > slow), 0.8).when((fast < mid) & (mid < slow), -0.8).otherwise(0.0)
    trend.append(("stack of averages", stack, F.when(stack != 0, 1.5).otherwise(0.5), priced & has("ema_21", "sma_50", "sma_200")))
    spread = (c("plus_di") - c("minus_di")) / F.greatest(c("plus_di") + c("minus_di"), F.lit(1e-9))
    strong = c("adx") >= ADX_TREND
    force = F.least(F.lit(1.0), (c("adx") - ADX_TREND) / (ADX_STRONG - ADX_TREND) * 0.5 + 0.5)
    trend.append(("directional index", F.when(strong, spread * force).otherwise(0.0), F.when(strong, 1.3).otherwise(0.8), priced & has("adx", "plus_di", "minus_di")))
    rsi = c("rsi_14")
    macd = has("macd", "macd_signal", "macd_histogram")
    momentum = [
        ("rsi", squash(rsi - 50, 20), 1.2, has("rsi_14")),
        ("stretched", F.when(rsi >= 75, -0.25).otherwise(0.25), 0.6, has("rsi_14") & ((rsi >= 75) | (rsi <= 25))),
        ("macd vs signal", squash(c("macd_histogram") / F.coalesce(F.when(close != 0, close), F.lit(1.0)) * 100, 0.35), 1.2, macd),
        ("macd sign", F.when(c("macd") > 0, 0.4).otherwise(-0.4), 0.8, macd),
        ("rate of change", squash(c("roc_10"), 3), 1.0, has("roc_10")),
        ("stochastic", squash(c("stoch_k") - 50, 30), 0.7, has("stoch_k")),
    ]
    low, high = c("support"), c("resistance")
    ranged = has("close", "support", "resistance") & (high > low)
    b = c("bb_percent_b")
    structure = [
        ("swing structure", c("structure_trend") * 0.85, 1.5, has("structure_trend")),
        ("position in range", squash((0.5 - (close - low) / (high - low)) * 2, 1) * 0.5, 0.8, ranged),
        ("no resistance overhead", F.lit(0.3), 0.7, has("close", "support") & high.isNull()),
        ("no support beneath", F.lit(-0.3), 0.7, has("close", "resistance") & low.isNull()),
        ("bands", F.when(b > 1, 0.5).when(b < 0, -0.5).otherwise((b - 0.5) * 0.8), F.when((b > 1) | (b < 0), 0.9).otherwise(0.7), has("bb_percent_b")),
        ("price vs vwap", squash(c("vwap_distance_pct"), 2) * 0.6, 0.8, has("vwap_distance_pct")),
    ]
    volume = [
        ("on-balance volume", squash(c("obv_change_20") / (c("volume") * 20), 0.5), 1.0, has("obv_change_20", "volume") & (c("volume") > 0)),
        ("last bar", squash(c("change_pct"), 1.5) * 0.5, 0.6, has("change_pct")),
    ]
    return {"trend": _evidence(*trend), "momentum": _evidence(*momentum), "structure": _evidence(*structure), "volume": _evidence(*volume)}


def _sum(xs: Column, of) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, e: a + of(e))


def group_score(xs: Column) -> Column:
    w = _sum(xs, lambda e: e["weight"])
    return F.when(w > 0, _sum(xs, lambda e: e["contribution"] * e["weight"]) / w).otherwise(0.0)


def coherence(xs: Column) -> Column:
    """How far the voting evidence of a group agrees; one voter agrees with itself, none is worth half."""
    votes = F.filter(xs, lambda e: F.abs(e["contribution"]) > VOTE)
    return F.when(F.size(votes) == 0, 0.5).when(F.size(votes) == 1, 1.0).otherwise(F.abs(_sum(votes, lambda e: F.signum(e["contribution"]) * e["weight"])) / _sum(votes, lambda e: e["weight"]))


def classify(features: DataFrame, quality: Column | None = None) -> DataFrame:
    """features with score, direction, strength, confidence, evidence and counter_evidence of each row's timeframe."""
    names = list(GROUPS)
    df = features.select("*", *(g.alias(f"_{n}") for n, g in groups(features.columns).items()))
    q = F.lit(1.0) if quality is None else quality
    on = {n: F.when(F.size(f"_{n}") > 0, GROUPS[n]).otherwise(0.0) for n in names}
    total = reduce(lambda a, b: a + b, on.values())
    raw = reduce(lambda a, b: a + b, (on[n] * group_score(F.col(f"_{n}")) for n in names)) / total
    agree = reduce(lambda a, b: a + b, (on[n] * coherence(F.col(f"_{n}")) for n in names)) / total
    df = df.withColumn("_raw", F.when(total > 0, raw)).withColumn("_agree", F.when(total > 0, agree)).withColumn("_cover", total / sum(GROUPS.values()))
    size = F.abs("_raw")
    strength = F.when(F.col("adx").isNull(), size).otherwise(0.6 * clip((F.col("adx") - 10) / 40, 0, 1) + 0.4 * size) if "adx" in features.columns else size
    trust = CONFIDENCE_CAP * F.col("_agree") * F.col("_cover") * F.least(F.lit(1.0), 0.35 + 1.6 * size) * clip(q, 0, 1)
    side = F.signum(direction_score(direction(F.col("_raw"))))
    every = F.concat(*(F.col(f"_{n}") for n in names))
    strongest = lambda xs, n: F.slice(F.array_sort(xs, lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).otherwise(0)), 1, n)
    mine = F.when(side == 0, every).otherwise(F.filter(every, lambda e: e["contribution"] * side > VOTE))
    against = F.filter(every, lambda e: e["contribution"] * side < -VOTE)
    zero = lambda x: F.bround(F.coalesce(x, F.lit(0.0)), 4)
    return df.select(
        *features.columns,
        zero(F.col("_raw")).alias("score"),
        F.coalesce(direction(F.col("_raw")), F.lit("neutral")).alias("direction"),
        zero(strength).alias("strength"),
        zero(clip(trust, 0, CONFIDENCE_CAP)).alias("confidence"),
        strongest(mine, 8).alias("evidence"),
        strongest(against, 5).alias("counter_evidence"),
    )


def rank_weight(timeframe: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for i, t in enumerate(TIMEFRAMES) for x in (t, i)))
    return 1 + 0.6 * ranks[timeframe]


def described(states: Column, net: Column) -> Column:
    """The members of a group, slowest first, and where they lean in sum if there are several."""
    members = F.array_join(F.transform(F.reverse(states), lambda s: F.concat(s["timeframe"], F.lit(" "), s["direction"])), ", ")
    lean = F.when(net > 0, "net bullish").when(net < 0, "net bearish").otherwise("net flat")
    return F.when(F.size(states) == 0, "none").when(F.size(states) == 1, members).otherwise(F.concat(members, F.lit(" — "), lean))


def interpretation(name: Column, alignment: Column, regime: Column, bias: Column, high: Column, low: Column) -> Column:
    """One sentence that a reader can check against the chart. The texts are fixed values."""
    say = lambda text, *xs: F.format_string(text, *xs)
    return (
        F.when(alignment == "insufficient_evidence", say("%s has no usable timeframe.", name))
        .when(alignment == "pullback_in_uptrend", say("%s is in a pullback within a larger uptrend: higher timeframes [%s] are net constructive while lower timeframes [%s] are correcting. This is a short-term retracement inside a bullish structure, not a bearish market.", name, high, low))
        .when(alignment == "rally_in_downtrend", say("%s is rallying inside a larger downtrend: higher timeframes [%s] are net negative while lower timeframes [%s] are bouncing. This is a counter-trend move, not a confirmed recovery.", name, high, low))
        .when(alignment == "possible_reversal", say("%s may be turning: the higher-timeframe trend [%s] is losing strength while lower timeframes [%s] have already reversed. Treat this as an unconfirmed transition, not an established trend in either direction.", name, high, low))
        .when(alignment == "aligned_bullish", say("%s is bullish across the hierarchy [%s; %s] in a %s regime. Timeframes corroborate each other.", name, high, low, regime))
        .when(alignment == "aligned_bearish", say("%s is bearish across the hierarchy [%s; %s] in a %s regime. Timeframes corroborate each other.", name, high, low, regime))
        .when(alignment == "rangebound", say("%s has no clear directional structure on any timeframe [%s; %s]. Rangebound conditions.", name, high, low))
        .otherwise(say("%s shows conflicting signals without a clean hierarchy [%s; %s]. Bias reads %s, but the timeframes do not corroborate it — treat directional conclusions with caution.", name, high, low, bias))
    )


def build(features: DataFrame, asked: DataFrame, trust: DataFrame | None = None) -> DataFrame:
    """The state of each asked (asset, as_of) from the newest features of each timeframe that were known by then, and the trust in them.

    features: asset, timeframe, known (when its bar closed) and the columns of a feature vector, of all timeframes together. trust:
    asset, timeframe, ts, score, as of the same moment; 1 before the first. Only the rows that are asked for are classified.
    """
    from barloom.operators.asof import last_before

    frames = features.select("timeframe").distinct()
    points = asked.select("asset", "as_of").distinct().crossJoin(F.broadcast(frames))  # a row for each timeframe of the grid
    values = [c for c in features.columns if c not in ("asset", "timeframe", "known")]
    rows = last_before(points, features.withColumn("_known", F.col("known")), ["asset", "timeframe"], "as_of", "known", [*values, "_known"]).where("_known IS NOT NULL").drop("_known")
    if trust is not None:
        rows = last_before(rows, trust.select("asset", "timeframe", "ts", "score"), ["asset", "timeframe"], "as_of", "ts", ["score"]).withColumnRenamed("score", "_trust")
    quality = F.coalesce("_trust", F.lit(1.0)) if trust is not None else F.lit(1.0)
    states = classify(rows.withColumn("trust", quality), F.col("trust")).withColumn("volatility_pct", F.col("realised_vol_20"))
    return hierarchy(states, quality="trust")


def compact(features: DataFrame) -> DataFrame:
    """features with bias_score, agreement, alignment and confidence of one timeframe, from its averages and structure; null without them."""
    c, slope = F.col, lambda name, by: clip((F.col("close") - F.col(name)) / F.col(name) * by, -1, 1)
    trend = F.coalesce(c("structure_trend"), F.lit(0.0))
    known = (c("close") != 0) & (c("ema_21") != 0) & (c("sma_200") != 0)
    bias = F.when(c("sma_200") > 0, slope("sma_200", 10) * 0.5).otherwise(0.0) + F.when(c("ema_21") > 0, slope("ema_21", 20) * 0.3).otherwise(0.0) + trend * 0.2
    agreement = F.when((bias > 0) == (trend >= 0), 1.0).otherwise(0.4)
    alignment = F.when((bias > 0.15) & (trend >= 0), "aligned_bullish").when((bias < -0.15) & (trend <= 0), "aligned_bearish").when(F.abs(bias) > 0.15, "conflicted").otherwise("rangebound")
    new = {"bias_score": F.round(clip(bias, -1, 1), 4), "agreement": agreement, "alignment": alignment, "confidence": F.lit(0.5)}
    return features.withColumns({n: F.when(known, x) for n, x in new.items()})


def hierarchy(states: DataFrame, key: tuple[str, ...] = ("asset", "as_of"), quality: str | None = None) -> DataFrame:
    """Bias, agreement, alignment, regime, confidence and conflicts of each key, over its usable timeframes (confidence >= 0.25).

    states has timeframe, direction, score, strength, confidence and volatility_pct. The slower half of the timeframes is structural.
    """
    one = F.struct(rank_weight(F.col("timeframe")).alias("w"), F.col("timeframe"), F.col("direction"), direction_score(F.col("direction")).alias("d"), "score", "strength", "confidence", "volatility_pct")
    q = F.avg(quality) if quality else F.lit(1.0)
    usable = F.filter(F.array_sort(F.collect_list(one)), lambda s: s["confidence"] >= 0.25)
    g = states.groupBy(*key).agg(usable.alias("s"), q.alias("q"))
    n = F.size("s")
    fast = F.floor(n / 2).cast("int")
    g = g.withColumn("low", F.slice("s", 1, fast)).withColumn("high", F.slice("s", fast + 1, n))
    mean = lambda xs, of: F.when(F.size(xs) > 0, _sum(xs, of) / F.size(xs))
    weight = lambda s: s["w"] * F.greatest(F.lit(0.1), s["confidence"])
    bias = F.when(n > 0, _sum(F.col("s"), lambda s: s["score"] * weight(s)) / _sum(F.col("s"), weight)).otherwise(0.0)
    votes = F.filter("s", lambda s: s["d"] != 0)
    agreement = F.when(n == 0, 0.0).when(n == 1, 1.0).when(F.size(votes) == 0, 0.0).otherwise(F.abs(_sum(votes, lambda s: F.signum(s["d"]) * s["w"])) / _sum(votes, lambda s: s["w"]))
    net = lambda xs, by: F.when(F.size(xs) == 0, 0.0).otherwise(_sum(xs, lambda s: s["d"] * by(s)) / _sum(xs, by))
    sign = lambda x: F.when(x > 0.10, 1).when(x < -0.10, -1).otherwise(0)
    g = g.withColumn("bias_score", bias).withColumn("bias", direction(bias)).withColumn("agreement", agreement)
    g = g.withColumn("hs", sign(net(F.col("high"), lambda s: s["w"]))).withColumn("ls", sign(net(F.col("low"), lambda s: 1 / s["w"])))
    fading = (mean(F.col("high"), lambda s: s["strength"]) < 0.4) | (mean(F.col("high"), lambda s: s["confidence"]) < 0.45)
    hs, ls = F.col("hs"), F.col("ls")
    alignment = (
        F.when((hs == 0) & (ls == 0), "rangebound")
        .when((hs > 0) & (ls >= 0), F.when(F.col("agreement") > 0.6, "aligned_bullish").otherwise("conflicted"))
        .when((hs < 0) & (ls <= 0), F.when(F.col("agreement") > 0.6, "aligned_bearish").otherwise("conflicted"))
        .when((hs > 0) & (ls < 0), F.when(fading, "possible_reversal").otherwise("pullback_in_uptrend"))
        .when((hs < 0) & (ls > 0), F.when(fading, "possible_reversal").otherwise("rally_in_downtrend"))
        .otherwise("conflicted")
    )
    g = g.withColumn("alignment", alignment)
    known = F.filter("s", lambda s: s["volatility_pct"].isNotNull())
    vol, force = mean(known, lambda s: s["volatility_pct"]), F.coalesce(mean(F.col("s"), lambda s: s["strength"]), F.lit(0.0))
    side = direction_score(F.col("bias"))
    is_ = lambda x: F.col("alignment") == x
    named = F.create_map(*(F.lit(x) for p in {"strong_up": "strong_bull", "up": "bull", "weak_up": "weak_bull", "neutral": "neutral", "weak_down": "weak_bear", "down": "bear", "strong_down": "strong_bear"}.items() for x in p))
    regime = (
        F.when(vol >= HIGH_VOLATILITY, F.when((side < 0) & (force > 0.5), "capitulation").when((side > 0) & is_("rally_in_downtrend"), "recovery").otherwise("high_volatility"))
        .when((vol <= LOW_VOLATILITY) & (F.abs(side) < 0.35), F.when(is_("pullback_in_uptrend"), "accumulation").when(is_("rally_in_downtrend"), "distribution").otherwise("low_volatility"))
        .when(is_("possible_reversal"), F.when(side > 0, "recovery").otherwise("distribution"))
        .otherwise(named[F.col("bias")])
    )
    trust = _sum(F.col("s"), lambda s: s["confidence"] * s["w"]) / _sum(F.col("s"), lambda s: s["w"]) * (0.55 + 0.45 * F.col("agreement"))
    trust = trust * F.when(is_("conflicted"), 0.6).otherwise(1.0) * F.when(n < 2, 0.75).otherwise(1.0) * clip(F.col("q"), 0, 1)
    against = F.flatten(F.transform("high", lambda h: F.transform(F.filter("low", lambda x: F.signum(h["d"]) * F.signum(x["d"]) < 0), lambda x: F.concat(h["timeframe"], F.lit(" is "), h["direction"], F.lit(" while "), x["timeframe"], F.lit(" is "), x["direction"]))))
    told = F.when(n > 0, F.col("alignment")).otherwise("insufficient_evidence")
    label = F.when(n > 0, regime).otherwise("unknown")
    words = interpretation(F.col(key[0]), told, label, F.col("bias"), described(F.col("high"), hs), described(F.col("low"), ls))
    return g.select(
        *key, n.alias("timeframes"), F.col("bias_score"), "bias", "agreement", told.alias("alignment"), label.alias("regime"), words.alias("interpretation"),
        F.when(n > 0, clip(trust, 0, 1)).otherwise(0.0).alias("confidence"), F.slice(against, 1, 6).alias("conflicts"),
    )
