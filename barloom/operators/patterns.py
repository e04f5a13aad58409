"""Pattern detection on bars, and whether a pattern tells more than the market's own rate.

Detectors are expressions over frames of one sort; a scan of all of them over all bars
is one pass, where each bar sees its own past only. Outcomes look strictly forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numbers import mad_scale, two_proportion_p, wilson

KEY = ("asset", "source", "timeframe")
#: Patterns and the conventional reading of each.
READING = {
    "breakout_up": "bullish",
    "breakout_down": "bearish",
    "fakeout_up": "bearish",
    "fakeout_down": "bullish",
    "liquidity_sweep_high": "bearish",
    "liquidity_sweep_low": "bullish",
    "compression": "neutral",
    "expansion": "neutral",
    "accumulation": "bullish",
    "distribution": "bearish",
    "trend_continuation_up": "bullish",
    "trend_continuation_down": "bearish",
    "bullish_divergence": "bullish",
    "bearish_divergence": "bearish",
    "momentum_exhaustion_up": "bearish",
    "momentum_exhaustion_down": "bullish",
    "volume_anomaly": "neutral",
    "structure_break_up": "bullish",
    "structure_break_down": "bearish",
}
WARMUP = 80
HORIZONS = (3, 12, 48)
#: How many average ranges a neutral pattern's move must exceed.
MOVEMENT = 1.5


def swings(bars: DataFrame, side: int = 2, key=KEY) -> DataFrame:
    """bars with swing_high and swing_low: the strict extreme of the bars up to `side` away. False where bars are missing on a side."""
    order = Window.partitionBy(*key).orderBy("open_time")
    around = order.rowsBetween(-side, side)
    full = F.count("*").over(around) == 2 * side + 1
    times = lambda x: F.size(F.filter(F.collect_list(x).over(around), lambda y: y == F.col(x)))
    high = full & (F.col("high") == F.max("high").over(around)) & (times("high") == 1)
    low = full & (F.col("low") == F.min("low").over(around)) & (times("low") == 1)
    return bars.withColumn("swing_high", high).withColumn("swing_low", low)


def local_rsi(closes: Column, upto: Column, n: int = 14) -> Column:
    """Wilder's RSI at position `upto` (from 0) of an array of closes, seeded at its start; null before position n."""
    changes = F.transform(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda i: F.get(closes, i) - F.get(closes, i - 1))
    start = F.struct(F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"), F.lit(0).alias("i"))

    def step(a, d):
        gain, loss, i = F.greatest(d, F.lit(0.0)), F.greatest(-d, F.lit(0.0)), a["i"] + 1
        mean = lambda old, x: F.when(i <= n, old + x / n).otherwise(old + (x - old) / n)
        return F.struct(mean(a["gain"], gain).alias("gain"), mean(a["loss"], loss).alias("loss"), i.alias("i"))

    rsi = F.aggregate(changes, start, step, lambda a: F.when(a["loss"] == 0, 100.0).otherwise(100 - 100 / (1 + a["gain"] / F.greatest(a["loss"], F.lit(1e-12)))))
    return F.when(upto >= n, rsi)


def detect(bars: DataFrame, warmup: int = WARMUP, key=KEY, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """key, open_time, bar (position from 0), close, kind, direction and quality of every detection from the warm-up on.

    kinds: only these, and only the frames that they need.
    """
    order = Window.partitionBy(*key).orderBy("open_time")
    frame = lambda n, end=0: order.rowsBetween(end - n + 1, end)
    last = F.lag("close").over(order)
    base = swings(bars, 2, key).withColumn("bar", F.row_number().over(order) - 1)
    base = base.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)))
    base = base.withColumn("up_volume", F.when(F.col("close") > last, F.col("volume")).otherwise(0.0)).withColumn("down_volume", F.when(F.col("close") < last, F.col("volume")).otherwise(0.0))
    point = lambda flag, price: F.when(F.col(flag), F.struct("bar", F.col(price).alias("price")))
    w = base.select(
        *key, "open_time", "bar", "open", "high", "low", "close", "volume", last.alias("last"),
        F.max("high").over(frame(20, -1)).alias("top"), F.min("low").over(frame(20, -1)).alias("bottom"),
        F.percentile("volume", F.lit(0.5)).over(frame(20, -1)).alias("centre"), F.avg("volume").over(frame(20, -1)).alias("mean_volume"), F.collect_list("volume").over(frame(20, -1)).alias("volumes"),
        *(F.avg("tr").over(frame(n)).alias(f"range_{n}") for n in (5, 10, 14, 50)),
        F.max("high").over(frame(30)).alias("top_30"), F.min("low").over(frame(30)).alias("bottom_30"), F.lag("close", 29).over(order).alias("close_30"),
        F.sum("up_volume").over(frame(29)).alias("up_30"), F.sum("down_volume").over(frame(29)).alias("down_30"),
        F.avg("close").over(frame(20)).alias("fast"), F.avg("close").over(frame(50)).alias("slow"),
        F.min("low").over(frame(3, -1)).alias("low_3"), F.max("high").over(frame(3, -1)).alias("high_3"),
        F.collect_list("close").over(frame(60)).alias("closes"),
        F.collect_list(point("swing_high", "high")).over(order.rowsBetween(-57, -2)).alias("highs_60"), F.collect_list(point("swing_low", "low")).over(order.rowsBetween(-57, -2)).alias("lows_60"),
        F.collect_list(point("swing_high", "high")).over(order.rowsBetween(-77, -2)).alias("highs_80"), F.collect_list(point("swing_low", "low")).over(order.rowsBetween(-77, -2)).alias("lows_80"),
    )
    w = w.where(F.col("bar") >= warmup - 1)
    w = w.withColumn("volume_ratio", F.when(F.col("mean_volume") > 0, F.col("volume") / F.col("mean_volume")).otherwise(1.0))
    w = w.withColumn("scale", mad_scale(F.col("volumes"), F.col("centre")))
    closes_40 = F.slice("closes", 21, 40)
    w = w.withColumn("rsi_now", local_rsi(closes_40, F.lit(39))).withColumn("rsi_before", local_rsi(closes_40, F.lit(36)))
    c = F.col
    found = []

    def add(kind, when, quality):
        if kinds is None or kind in kinds:
            found.append(F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(READING[kind]).alias("direction"), F.least(F.lit(1.0), quality).alias("quality"))))

    loud = c("volume_ratio") > 1.2
    for kind, beyond, margin in (("breakout_up", c("close") > c("top"), (c("close") - c("top")) / c("top") * 100), ("breakout_down", c("close") < c("bottom"), (c("bottom") - c("close")) / c("bottom") * 100)):
        add(kind, beyond & loud, 0.4 + margin * 0.2 + (c("volume_ratio") - 1.2) * 0.3)
    span, mean = c("high") - c("low"), c("range_14")
    above, below = (c("high") > c("top")) & (c("close") < c("top")), (c("low") < c("bottom")) & (c("close") > c("bottom"))
    sides = ((above, (c("high") - c("top")) / mean, (c("high") - c("close")) / span), (below, (c("bottom") - c("low")) / mean, (c("close") - c("low")) / span))
    fakes = [(mean > 0) & (span > 0) & breach & (deep >= 0.15) & (back >= 0.4) for breach, deep, back in sides]
    add("fakeout_up", fakes[0], 0.35 + sides[0][1] * 0.3 + sides[0][2] * 0.3)
    add("fakeout_down", fakes[1] & ~F.coalesce(fakes[0], F.lit(False)), 0.35 + sides[1][1] * 0.3 + sides[1][2] * 0.3)
    wicks = ((c("high") - F.greatest("open", "close")) / mean, (F.least("open", "close") - c("low")) / mean)
    swept = [(mean > 0) & breach & (wick > 0.8) for breach, wick in zip((above, below), wicks, strict=True)]
    add("liquidity_sweep_high", swept[0], 0.45 + wicks[0] * 0.2)
    add("liquidity_sweep_low", swept[1] & ~F.coalesce(swept[0], F.lit(False)), 0.45 + wicks[1] * 0.2)
    tight, wide = c("range_10") / c("range_50"), c("range_5") / c("range_50")
    add("compression", (c("range_10") > 0) & (tight <= 0.6), 0.4 + (0.6 - tight))
    add("expansion", (c("range_50") > 0) & (wide >= 1.8), 0.4 + (wide - 1.8) * 0.2)
    z = F.when(c("scale") > 0, (c("volume") - c("centre")) / c("scale")).when(c("volume") >= c("centre") * 3, 4 + (c("volume") / c("centre") - 3))
    add("volume_anomaly", (c("centre") > 0) & (z >= 4), 0.4 + (z - 4) * 0.05)
    width, net = (c("top_30") - c("bottom_30")) / c("bottom_30") * 100, (c("close") - c("close_30")) / c("close_30") * 100
    lean = (c("up_30") - c("down_30")) / (c("up_30") + c("down_30"))
    calm = (c("bottom_30") > 0) & (width <= 12) & (F.abs(net) <= width * 0.35) & (F.abs(lean) >= 0.25)
    add("accumulation", calm & (lean > 0), 0.4 + F.abs(lean))
    add("distribution", calm & (lean < 0), 0.4 + F.abs(lean))

    bears = bulls = None
    for kind, points, sign in (("bearish_divergence", "highs_60", 1), ("bullish_divergence", "lows_60", -1)):
        one, two = F.try_element_at(c(points), F.lit(-2)), F.try_element_at(c(points), F.lit(-1))
        start = c("bar") - 59
        gap = sign * (local_rsi(c("closes"), one["bar"] - start) - local_rsi(c("closes"), two["bar"] - start))
        hit = (two["bar"] - start >= 56) & (sign * (two["price"] - one["price"]) > 0) & (gap > 3)
        if sign > 0:
            bears = hit
        else:
            bulls = hit & ~F.coalesce(bears, F.lit(False))
        add(kind, bears if sign > 0 else bulls, 0.4 + gap * 0.03)
    turn = c("rsi_before") - c("rsi_now")
    add("momentum_exhaustion_up", (c("rsi_now") >= 70) & (turn > 4), 0.4 + turn * 0.03)
    add("momentum_exhaustion_down", (c("rsi_now") <= 30) & (turn < -4), 0.4 - turn * 0.03)
    apart = F.when(c("slow") != 0, (c("fast") - c("slow")) / c("slow") * 100).otherwise(0.0)
    add("trend_continuation_up", (apart >= 1) & (c("low_3") < c("fast")) & (c("close") > c("fast")) & (c("close") > c("last")), 0.4 + apart * 0.05)
    add("trend_continuation_down", (apart <= -1) & (c("high_3") > c("fast")) & (c("close") < c("fast")) & (c("close") < c("last")), 0.4 + F.abs(apart) * 0.05)
    h = [F.try_element_at(c("highs_80"), F.lit(k)) for k in (-3, -2, -1)]
    lows = [F.try_element_at(c("lows_80"), F.lit(k)) for k in (-2, -1)]
    fresh = (F.size("highs_80") >= 3) & (F.size("lows_80") >= 3) & (h[2]["bar"] >= c("bar") - 4)
    add("structure_break_up", fresh & (h[0]["price"] > h[1]["price"]) & (h[2]["price"] > h[1]["price"]) & (lows[1]["price"] > lows[0]["price"]), F.lit(0.6))
    add("structure_break_down", fresh & (h[0]["price"] < h[1]["price"]) & (h[2]["price"] < h[1]["price"]) & (lows[1]["price"] < lows[0]["price"]), F.lit(0.6))
    return w.select(*key, "open_time", "bar", "close", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def outcomes(bars: DataFrame, horizon: int, key=KEY) -> DataFrame:
    """bars with bar, move_pct, best and worst price, favourable_pct and adverse_pct of the next `horizon` bars, and mean_range, the past 14 true ranges. Null past the end."""
    order = Window.partitionBy(*key).orderBy("open_time")
    ahead = order.rowsBetween(1, horizon)
    last, end = F.lag("close").over(order), F.lead("close", horizon).over(order)
    tr = bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))).withColumn("bar", F.row_number().over(order) - 1)
    tr = tr.withColumn("tr", F.when(F.col("bar") > 0, F.col("tr")))
    out = tr.withColumn("move_pct", F.when(F.col("close") > 0, (end - F.col("close")) / F.col("close") * 100))
    out = out.withColumn("best", F.max("high").over(ahead)).withColumn("worst", F.min("low").over(ahead)).withColumn("mean_range", F.coalesce(F.avg("tr").over(order.rowsBetween(-13, 0)), F.lit(0.0)))
    pct = lambda x: (F.col(x) - F.col("close")) / F.col("close") * 100
    return out.withColumn("favourable_pct", pct("best")).withColumn("adverse_pct", pct("worst")).drop("tr")


def resolved(direction: Column) -> Column:
    """Whether the outcome columns bear a direction out; null if that can't be said."""
    moved = F.when(F.col("mean_range") > 0, F.greatest(F.col("favourable_pct"), F.abs("adverse_pct")) > F.col("mean_range") / F.col("close") * 100 * MOVEMENT)
    return F.when(F.col("move_pct").isNotNull(), F.when(direction == "bullish", F.col("move_pct") > 0).when(direction == "bearish", F.col("move_pct") < 0).otherwise(moved))


def thinned(marks: DataFrame, by: tuple[str, ...], least: int, at: str = "bar") -> DataFrame:
    """by and at of the rows of marks that are at least so far from the last one kept, from the first on; one Arrow group for each by."""
    import numpy as np
    import pyarrow as pa

    def kept(group: pa.Table) -> pa.Table:
        x = np.unique(group.column(at).to_numpy())
        take, i = [], 0
        while i < len(x):
            take.append(x[i])
            i = int(np.searchsorted(x, x[i] + least))
        return pa.table({**{c: pa.repeat(group.column(c)[0], len(take)) for c in by}, at: pa.array(np.array(take, np.int64))})

    lean = marks.select(*by, F.col(at).cast("long").alias(at))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema)
    return lean.groupBy(*by).applyInArrow(kept, schema)


def benjamini_hochberg(df: DataFrame, p: str = "p_value", rate: float = 0.05, family: tuple[str, ...] = ()) -> DataFrame:
    """df with significant: rejected by the step-up procedure over each family. A family is the rows of a table of tests, one a hypothesis."""
    w = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    ranked = df.withColumn("_k", F.rank().over(w.orderBy(p))).withColumn("_n", F.count("*").over(w)).withColumn("_ties", F.count("*").over(w.partitionBy(*family, p) if family else Window.partitionBy(p)))
    top = F.max(F.when(F.col(p) <= (F.col("_k") + F.col("_ties") - 1) / F.col("_n") * rate, F.col(p))).over(w)
    return ranked.withColumn("significant", F.coalesce(F.col(p) <= top, F.lit(False))).drop("_k", "_n", "_ties")


def evaluate(bars: DataFrame, detections: DataFrame, horizons: tuple[int, ...] = HORIZONS, key=KEY) -> DataFrame:
    """Of each series, kind and horizon: occurrences, rate with its interval, baseline, edge, p, significance over the series' tests, informative."""
    every = None
    for h in horizons:
        o = outcomes(bars, h, key)
        base = o.where(F.col("bar") % h == 0)
        rate = base.groupBy(*key).agg(*(x for d in ("bullish", "bearish", "neutral") for x in (F.count(resolved(F.lit(d))).alias(f"{d}_n"), F.count(F.when(resolved(F.lit(d)), 1)).alias(f"{d}_s"))))
        kept = thinned(detections, (*key, "kind", "direction"), h)
        hits = kept.join(o.select(*key, "bar", "close", "move_pct", "favourable_pct", "adverse_pct", "mean_range"), [*key, "bar"]).withColumn("ok", resolved(F.col("direction"))).where("ok IS NOT NULL")
        stats = hits.groupBy(*key, "kind", "direction").agg(F.count("*").alias("occurrences"), F.count(F.when(F.col("ok"), 1)).alias("successes"), F.avg("move_pct").alias("mean_move_pct"), F.percentile("move_pct", F.lit(0.5)).alias("median_move_pct"))
        pick = lambda x: F.coalesce(*(F.when(F.col("direction") == d, F.col(f"{d}_{x}")) for d in ("bullish", "bearish", "neutral")))
        part = stats.where("occurrences >= 5").join(rate, list(key)).select(*key, "kind", F.lit(h).alias("horizon"), "direction", "occurrences", "successes", "mean_move_pct", "median_move_pct", pick("s").alias("base_successes"), pick("n").alias("base_trials"))
        every = part if every is None else every.unionByName(part)
    s, n, bs, bn = (F.col(x) for x in ("successes", "occurrences", "base_successes", "base_trials"))
    out = every.withColumn("rate", s / n).withColumn("baseline", F.when(bn > 0, bs / bn).otherwise(0.5)).withColumn("edge", F.col("rate") - F.col("baseline")).withColumn("interval", wilson(s, n)).withColumn("p_value", two_proportion_p(s, n, bs, bn))
    out = benjamini_hochberg(out, family=tuple(key))  # the tests of one series' scan
    apart = (F.col("interval.low") > F.col("baseline")) | (F.col("interval.high") < F.col("baseline"))
    return out.withColumn("informative", (n >= 30) & F.col("significant") & apart).select(*[c for c in out.columns if c != "interval"], F.col("interval.low").alias("low"), F.col("interval.high").alias("high"), "informative")


def chains(detections: DataFrame, length: int = 2, within: int = 12, key=KEY) -> DataFrame:
    """Sequences of consecutive detections of a series, each gap in (0, within] bars: chain (kinds) and bar of the last one."""
    order = Window.partitionBy(*key).orderBy("bar", "kind")
    steps = detections.select(*key, "bar", *(F.lag("kind", i).over(order).alias(f"k{i}") for i in range(length)), *(F.lag("bar", i).over(order).alias(f"b{i}") for i in range(length)))
    close = F.lit(True)
    for i in range(length - 1):
        close = close & ((F.col(f"b{i}") - F.col(f"b{i + 1}")).between(1, within))
    return steps.where(close).select(*key, F.array(*(F.col(f"k{i}") for i in reversed(range(length)))).alias("chain"), "bar")


def chain_statistics(bars: DataFrame, detections: DataFrame, lengths: tuple[int, ...] = (2, 3), horizons: tuple[int, ...] = (12, 48), within: int = 12, least: int = 25, key=KEY) -> DataFrame:
    """Of each series, chain and horizon: how often the close was higher after thinned occurrences than after any moment, tested over all chains of the series.

    detections has key, bar and kind. A chain is tested if it occurred `least` times and five thinned occurrences have an outcome.
    """
    order = Window.partitionBy(*key).orderBy("open_time")
    every = None
    for n in lengths:
        part = chains(detections, n, within, key).select(*key, F.array_join("chain", ">").alias("chain"), "bar")
        every = part if every is None else every.unionByName(part)
    often = every.groupBy(*key, "chain").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*key, "chain")
    every = every.join(often, [*key, "chain"], "left_semi").distinct()
    out = None
    for h in horizons:
        move = bars.select(*key, "open_time", "close", (F.row_number().over(order) - 1).alias("bar"), F.lead("close", h).over(order).alias("_end"))
        move = move.where("close > 0 AND _end IS NOT NULL").select(*key, "bar", ((F.col("_end") - F.col("close")) / F.col("close") * 100).alias("ret"))
        base = move.where(F.col("bar") % h == 0).groupBy(*key).agg(F.count("*").alias("bn"), F.count(F.when(F.col("ret") > 0, 1)).alias("bs"))
        met = every.join(move, [*key, "bar"])
        kept = met.join(thinned(met, (*key, "chain"), h), [*key, "chain", "bar"], "left_semi")
        g = kept.groupBy(*key, "chain").agg(F.count("*").alias("occurrences"), F.count(F.when(F.col("ret") > 0, 1)).alias("rose"), F.sort_array(F.collect_list("ret")).alias("_r")).where("occurrences >= 5")
        part = g.join(base, list(key)).select(*key, "chain", F.lit(h).alias("horizon"), "occurrences", (F.col("rose") / F.col("occurrences")).alias("rate"), F.when(F.col("bn") > 0, F.col("bs") / F.col("bn")).otherwise(0.5).alias("baseline"), two_proportion_p(F.col("rose"), F.col("occurrences"), F.col("bs"), F.col("bn")).alias("p_value"), F.get("_r", F.floor(F.size("_r") / 2).cast("int")).alias("median_return_pct"))
        out = part if out is None else out.unionByName(part)
    return benjamini_hochberg(out, family=tuple(key))


def transitions(states: DataFrame, key: tuple[str, ...], ts: tuple[str, ...], state: str = "state", least: int = 20) -> DataFrame:
    """state, next_state, n, total, probability and its interval over changes of state, for states left at least `least` times."""
    w = Window.partitionBy(*key).orderBy(*ts)
    pairs = states.select(F.col(state).alias("state"), F.lead(state).over(w).alias("next_state")).where("state <> next_state")
    n = pairs.groupBy("state", "next_state").agg(F.count("*").alias("n"))
    total = n.groupBy("state").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    out = n.join(total, "state").withColumn("probability", F.col("n") / F.col("total")).withColumn("_i", wilson(F.col("n"), F.col("total")))
    return out.select("state", "next_state", "n", "total", "probability", F.col("_i.low").alias("low"), F.col("_i.high").alias("high"))
