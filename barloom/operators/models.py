"""Forecasters: per bar and model a distribution over up, flat and down, and a confidence.

Each forecaster is an expression over frames that end at the bar it speaks for, so a
walk-forward run over a whole history is one pass, and no forecast can see ahead. The
climatology counts completed horizons, which needs the history of each point: points
are compared with it in blocks of the same series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numbers import clip, median

KEY = ("asset", "source", "timeframe")
WARMUP = 200
#: The inputs of each model.
INPUTS = {
    "baseline_climatology": ("price",), "baseline_persistence": ("price",), "baseline_uniform": (), "technical": ("features",), "timeseries": ("price",),
    "similarity": ("features", "price"), "regime": ("state",), "sentiment": ("news",), "crossasset": ("peers",), "orderflow": ("funding", "open_interest"), "sequence": ("patterns",),
}


def from_edge(edge: Column, flat: float = 0.34) -> Column:
    up = (1 - flat) * (0.5 + clip(edge, -1, 1) / 2)
    return F.struct(up.alias("up"), F.lit(flat).alias("flat"), (1 - flat - up).alias("down"))


def normalised(up: Column, flat: Column, down: Column) -> Column:
    total = up + flat + down
    return F.when(total > 0, F.struct((up / total).alias("up"), (flat / total).alias("flat"), (down / total).alias("down")))


def uniform() -> Column:
    return F.struct(F.lit(1 / 3).alias("up"), F.lit(1 / 3).alias("flat"), F.lit(1 / 3).alias("down"))


def outcome(move: Column, threshold: Column) -> Column:
    return F.when(move > threshold, "up").when(move < -threshold, "down").when(move.isNotNull(), "flat")


def most_likely(d: Column) -> Column:
    """Ties go to up, then flat."""
    return F.when((d["up"] >= d["flat"]) & (d["up"] >= d["down"]), "up").when(d["flat"] >= d["down"], "flat").otherwise("down")


def entropy(d: Column) -> Column:
    bits = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    return bits(d["up"]) + bits(d["flat"]) + bits(d["down"])


def brier(d: Column, truth: Column) -> Column:
    return sum((F.pow(d[k] - (truth == k).cast("double"), 2) for k in ("flat", "down")), F.pow(d["up"] - (truth == "up").cast("double"), 2))


def probability(d: Column, truth: Column) -> Column:
    return F.when(truth == "up", d["up"]).when(truth == "flat", d["flat"]).when(truth == "down", d["down"])


def log_loss(d: Column, truth: Column) -> Column:
    return -F.log(F.greatest(probability(d, truth), F.lit(1e-12)))


def volatility_bucket(pct: Column) -> Column:
    return F.when(pct < 0.15, "very_low").when(pct < 0.30, "low").when(pct < 0.55, "normal").when(pct < 1.00, "high").otherwise("very_high")


def contexts(bars: DataFrame, horizon: int, key=KEY) -> DataFrame:
    """bars with bar, ret (percent), threshold, typical move and the realised return of the next `horizon` bars."""
    order = Window.partitionBy(*key).orderBy("open_time")
    last = F.lag("close").over(order)
    df = bars.withColumn("bar", F.row_number().over(order) - 1).withColumn("ret", F.when(last > 0, (F.col("close") - last) / last * 100))
    moves = F.percentile(F.abs("ret"), F.lit(0.5)).over(order.rowsBetween(-98, 0))
    typical = F.when(F.col("bar") >= 9, moves)
    df = df.withColumn("typical", typical).withColumn("threshold", F.when(typical.isNull(), 0.5).otherwise(F.greatest(F.lit(0.05), typical * 0.6 * horizon**0.5)))
    return df.withColumn("realised", F.when(F.col("close") > 0, (F.lead("close", horizon).over(order) - F.col("close")) / F.col("close") * 100))


def expected_volatility(bars: DataFrame, horizon: int, key=KEY) -> DataFrame:
    """bars with expected_volatility: the median absolute move (percent) of the last 100 over a horizon, which grows with its root; 0 before five moves."""
    order = Window.partitionBy(*key).orderBy("open_time")
    last = F.lag("close").over(order)
    df = bars.withColumn("_r", F.when(last > 0, F.abs((F.col("close") - last) / last * 100)))
    frame = order.rowsBetween(-99, 0)
    typical = F.when(F.count("_r").over(frame) >= 5, F.percentile("_r", F.lit(0.5)).over(frame)).otherwise(0.0)
    return df.withColumn("expected_volatility", typical * max(1, horizon) ** 0.5).drop("_r")


def coarse_regime(bars: DataFrame, window: int = 100, key=KEY) -> DataFrame:
    """bars with drift (in units of noise) and regime: trend by 0.5 of noise, volatility by a typical move of 0.4 percent."""
    order = Window.partitionBy(*key).orderBy("open_time")
    last = F.lag("close").over(order)
    df = bars.withColumn("_r", F.abs(F.col("close") - last) / last)
    sized = df.withColumn("_n", F.count("*").over(order.rowsBetween(1 - window, 0))).withColumn("_m", F.sort_array(F.collect_list("_r").over(order.rowsBetween(2 - window, 0)))).withColumn("_first", F.first("close").over(order.rowsBetween(1 - window, 0)))
    typical = F.get("_m", F.floor(F.size("_m") / 2).cast("int"))
    drift = (F.col("close") - F.col("_first")) / F.col("_first") / (typical * F.sqrt("_n"))
    trend = F.when(F.abs("drift") < 0.5, "range").when(F.col("drift") > 0, "uptrend").otherwise("downtrend")
    out = sized.withColumn("typical_move", typical).withColumn("drift", F.when((F.col("_n") >= 20) & (typical > 0), drift))
    return out.withColumn("regime", F.when(F.col("drift").isNull(), "unknown").otherwise(F.concat(trend, F.when(F.col("typical_move") > 0.004, "_high_vol").otherwise("_low_vol")))).drop("_r", "_n", "_m", "_first")


def points(bars: DataFrame, horizon: int, warmup: int = WARMUP, key=KEY) -> DataFrame:
    """The contexts of every `horizon`-th bar from the warm-up on: their outcomes don't overlap."""
    return contexts(bars, horizon, key).where((F.col("bar") >= warmup) & ((F.col("bar") - warmup) % horizon == 0))


def climatology(bars: DataFrame, at: DataFrame, horizon: int, key=KEY) -> DataFrame:
    """at with the Laplace-smoothed frequencies of the completed, non-overlapping horizons before each point, under its own threshold.

    A series' outcomes and points pass once in time order: a point looks up where its
    thresholds fall among the sorted outcomes so far.
    """
    import numpy as np
    import pyarrow as pa

    past = contexts(bars, horizon, key).where((F.col("bar") % horizon == 0) & F.col("realised").isNotNull())
    past = past.select(*key, (F.col("bar") + horizon).cast("long").alias("t"), F.lit(0).alias("asks"), F.col("realised").alias("x"))
    both = past.unionByName(at.select(*key, F.col("bar").cast("long").alias("t"), F.lit(1).alias("asks"), F.col("threshold").alias("x")))

    def counted(group: pa.Table) -> pa.Table:
        from bisect import bisect_left, bisect_right, insort

        t, asks, x = (group.column(c).to_numpy() for c in ("t", "asks", "x"))
        seen: list[float] = []
        out = []
        for i in np.lexsort((asks, t)):
            if asks[i]:
                down = bisect_left(seen, -x[i])
                out.append((t[i], len(seen) - bisect_right(seen, x[i]), down, len(seen)))
            else:
                insort(seen, float(x[i]))
        rows = np.array(out, np.int64).reshape(-1, 4)
        return pa.table({**{c: pa.repeat(group.column(c)[0], len(rows)) for c in key}, **{c: pa.array(rows[:, k]) for k, c in enumerate(("bar", "_up", "_down", "_n"))}})

    kinds = ", ".join(f"`{c}` {at.schema[c].dataType.simpleString()}" for c in key)
    counts = both.groupBy(*key).applyInArrow(counted, f"{kinds}, bar long, _up long, _down long, _n long").dropDuplicates([*key, "bar"])
    df = at.join(counts, [*key, "bar"], "left").withColumn("_flat", F.col("_n") - F.col("_up") - F.col("_down"))
    d = normalised((F.col("_up") + 1).cast("double"), (F.col("_flat") + 1).cast("double"), (F.col("_down") + 1).cast("double"))
    ok = F.coalesce(F.col("_n") >= 30, F.lit(False))
    return df.withColumn("p", F.when(ok, d).otherwise(uniform())).withColumn("confidence", F.when(ok, 0.30).otherwise(0.0)).drop("_up", "_flat", "_down", "_n")


def persistence(ctx: DataFrame, horizon: int, key=KEY) -> DataFrame:
    order = Window.partitionBy(*key).orderBy("open_time").rowsBetween(1 - horizon, 0)
    df = ctx.withColumn("_move", F.sum("ret").over(order))
    return df.withColumn("p", from_edge(clip(F.col("_move") / (F.col("threshold") * 2), -1, 1) * 0.6)).withColumn("confidence", F.lit(0.30)).drop("_move")


def timeseries(ctx: DataFrame, horizon: int, key=KEY) -> DataFrame:
    """Lag-one autocorrelation and drift of the last 200 returns, carried forward."""
    order = Window.partitionBy(*key).orderBy("open_time")
    df = ctx.withColumn("_xs", F.collect_list("ret").over(order.rowsBetween(-199, 0)))
    df = df.withColumn("_mean", F.avg("ret").over(order.rowsBetween(-199, 0)))
    dev = F.transform("_xs", lambda x: x - F.col("_mean"))
    df = df.withColumn("_dev", dev)
    lagged = F.zip_with(F.slice("_dev", 2, 199), F.slice("_dev", 1, F.greatest(F.size("_dev") - 1, F.lit(0))), lambda a, b: a * b)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    rho = total(lagged) / total(F.transform("_dev", lambda x: x * x))
    df = df.withColumn("_rho", F.when(F.size("_xs") >= 100, rho))
    edge = F.tanh((F.col("ret") * F.col("_rho") + F.col("_mean")) * horizon / F.greatest(F.col("threshold"), F.lit(1e-9)))
    weak, strong = from_edge(edge * 0.2), from_edge(edge * 0.45)
    half = F.struct(*((uniform()[k] * 0.5 + weak[k] * 0.5).alias(k) for k in ("up", "flat", "down")))
    faint = F.abs("_rho") < 0.03
    df = df.withColumn("p", F.when(F.col("_rho").isNull(), uniform()).when(faint, half).otherwise(strong))
    df = df.withColumn("confidence", F.when(F.col("_rho").isNull(), 0.0).when(faint, 0.15).otherwise(0.20 + F.least(F.lit(0.35), F.abs("_rho") * 3)))
    return df.withColumn("rho", F.col("_rho")).drop("_xs", "_mean", "_dev", "_rho")


def technical(features: DataFrame) -> DataFrame:
    """features (close, averages, rsi_14, macd_histogram, adx) with p and confidence."""
    c = F.col
    parts = [F.when(c(n) > 0, F.tanh((c("close") - c(n)) / c(n) * 25) * w) for n, w in (("ema_21", 0.8), ("sma_50", 1.0), ("sma_200", 1.2))]
    parts += [F.tanh((c("rsi_14") - 50) / 20) * 0.8, F.when(c("close") > 0, F.tanh(c("macd_histogram") / c("close") * 250) * 0.8)]
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    edge = clip(F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known), -1, 1)
    sure = 0.25 + 0.35 * clip((F.coalesce(c("adx"), F.lit(20.0)) - 15) / 30, 0, 1)
    some = F.size(known) > 0
    return features.withColumn("p", F.when(some, from_edge(edge * 0.5)).otherwise(uniform())).withColumn("confidence", F.when(some, sure).otherwise(0.0))


def cross_asset(ctx: DataFrame, horizon: int, key=KEY, moment: tuple[str, ...] = ("timeframe", "open_time")) -> DataFrame:
    """The median move of the other assets at the same moment against the own one.

    A moment's moves are sorted once; without an asset's own one their median lies among
    the few in the middle, which are all that its rows get.
    """
    order = Window.partitionBy(*key).orderBy("open_time")
    old = F.lag("close", horizon).over(order)
    df = ctx.withColumn("_own", F.when(old > 0, (F.col("close") - old) / old * 100))
    every = df.where("_own IS NOT NULL").groupBy(*moment).agg(F.array_sort(F.collect_list(F.struct(F.col("_own").alias("x"), "asset"))).alias("_all"))
    first = F.greatest(F.lit(0), F.floor(F.size("_all") / 2).cast("int") - 1)
    every = every.select(*moment, F.size("_all").alias("_n"), first.alias("_a"), F.slice("_all", first + 1, 3).alias("_mid"))
    df = df.join(every, list(moment), "left")
    own = F.struct(F.col("_own").alias("x"), "asset")
    others = F.when(F.col("_own").isNull(), 0).otherwise(1)
    left = F.col("_n") - others  # as many peers
    at = lambda k: F.get(F.col("_mid"), (k - F.col("_a") + F.when(F.col("_own").isNotNull() & (own <= F.get(F.col("_mid"), (k - F.col("_a")).cast("int"))), 1).otherwise(0)).cast("int"))["x"]
    mid = F.floor(left / 2)
    peers = F.when(left < 1, None).when(left % 2 == 1, at(mid)).otherwise((at(mid - 1) + at(mid)) / 2)
    gap = peers - F.col("_own")
    edge = F.tanh(gap / F.greatest(F.col("threshold"), F.lit(1e-9)))
    ok = gap.isNotNull()
    sure = 0.18 + F.least(F.lit(0.25), F.abs(gap) / F.greatest(F.col("threshold") * 3, F.lit(1e-9)))
    return df.withColumn("p", F.when(ok, from_edge(edge * 0.4)).otherwise(uniform())).withColumn("confidence", F.when(ok, sure).otherwise(0.0)).drop("_own", "_n", "_a", "_mid")


def order_flow(rates: DataFrame, key: tuple[str, ...] = ("asset",), ts: str = "ts") -> DataFrame:
    """Contrarian to funding: rates (key, ts, rate) with p and confidence from the robust z of the last 60; abstains below 1.5."""
    w = Window.partitionBy(*key).orderBy(ts).rowsBetween(-59, 0)
    df = rates.withColumn("_xs", F.collect_list("rate").over(w)).withColumn("_c", F.percentile("rate", F.lit(0.5)).over(w))
    scale = median(F.transform("_xs", lambda x: F.abs(x - F.col("_c")))) * 1.4826
    df = df.withColumn("z", F.when((F.size("_xs") >= 10) & (scale > 0), (F.col("rate") - F.col("_c")) / scale))
    ok = F.coalesce(F.abs("z") >= 1.5, F.lit(False))
    return df.withColumn("p", F.when(ok, from_edge(-F.tanh(F.col("z") / 3) * 0.4)).otherwise(uniform())).withColumn("confidence", F.when(ok, 0.18 + F.least(F.lit(0.25), (F.abs("z") - 1.5) / 6)).otherwise(0.0)).drop("_xs", "_c")


def built(df: DataFrame, quality: Column | None = None) -> DataFrame:
    """Forecasts (p, confidence, threshold) as they are recorded: confidence within 0 and 1, times the data's quality, to four places, and the move that the edge expects."""
    sure = clip(F.col("confidence"), 0, 1)
    sure = sure if quality is None else sure * clip(quality, 0, 1)
    return df.withColumn("confidence", F.round(sure, 4)).withColumn("expected_move_pct", F.round((F.col("p.up") - F.col("p.down")) * F.col("threshold"), 4))


def _blend(a: Column, b: Column, share: float) -> Column:
    return F.struct(*((a[k] * (1 - share) + b[k] * share).alias(k) for k in ("up", "flat", "down")))


def regime_model(states: DataFrame) -> DataFrame:
    """states (bias_score, agreement, alignment, confidence) with p and confidence; the bias counts as far as the timeframes agree, and hardly where they conflict."""
    edge = F.col("bias_score") * (0.4 + 0.6 * F.col("agreement"))
    torn = F.col("alignment").isin("conflicted", "possible_reversal")
    p = F.when(torn, _blend(uniform(), from_edge(edge * 0.2), 0.4)).otherwise(from_edge(edge * 0.55))
    return states.withColumn("p", p).withColumn("confidence", F.when(torn, 0.15).otherwise(0.20 + 0.4 * F.col("confidence")))


def sentiment_model(moods: DataFrame, most: float = 0.25) -> DataFrame:
    """moods (sentiment: the stories' mean weighted by importance and confidence, null without any) with p and a low confidence."""
    some, x = F.col("sentiment").isNotNull(), F.col("sentiment")
    return moods.withColumn("p", F.when(some, from_edge(F.tanh(x * 1.5) * 0.35)).otherwise(uniform())).withColumn("confidence", F.when(some, F.least(F.lit(most), 0.10 + F.abs(x) * 0.3)).otherwise(0.0))


def sequence_model(detections: DataFrame, measured: DataFrame, key: tuple[str, ...], on: tuple[str, ...]) -> DataFrame:
    """One row a key: p from the summed edges of the detections (key, on) that were measured (on, edge) to have one; a key whose detections have none abstains."""
    met = detections.join(measured.where("edge <> 0").select(*on, "edge"), list(on), "left")
    g = met.groupBy(*key).agg(F.sum("edge").alias("_e"), F.count("edge").alias("measured"))
    some = F.col("measured") > 0
    return g.withColumn("p", F.when(some, from_edge(F.tanh(F.col("_e") * 3) * 0.5)).otherwise(uniform())).withColumn("confidence", F.when(some, 0.20 + F.least(F.lit(0.3), F.col("measured") * 0.1)).otherwise(0.0)).drop("_e")


def similarity_model(verdicts: DataFrame) -> DataFrame:
    """verdicts of analogues (n, up_rate, baseline) with p: how much more often similar moments rose than any; at least twenty of them."""
    some = F.col("n") >= 20
    edge = F.tanh((F.col("up_rate") - F.col("baseline")) * 4)
    return verdicts.withColumn("p", F.when(some, from_edge(edge * 0.6)).otherwise(uniform())).withColumn("confidence", F.when(some, 0.20 + F.least(F.lit(0.35), F.col("n") / 400)).otherwise(0.0))


def similar(bars: DataFrame, ctx: DataFrame, keep: Column, horizon: int, key=KEY, timeframe: str = "1h", least: int = 400) -> DataFrame:
    """What followed similar moments, from the series' bar `least` on; abstains where there are too few of them."""
    from barloom.operators import similarity
    from barloom.operators.indicators import recursive, windowed

    f = recursive(windowed(bars, timeframe, key), key).withColumn("bar", F.col("bars_seen") - 1)
    at = ctx.where(keep)
    asked = at.where(F.col("bar") >= least - 1).select(*key, "bar")
    found = similarity.verdicts(similarity.analogues(f, asked, horizon, key=key), bars, horizon, key=key)
    said = similarity_model(found.select(*key, F.col("asked").alias("bar"), "n", "up_rate", F.coalesce("base_rate", F.lit(0.5)).alias("baseline")))
    out = at.join(said.select(*key, "bar", F.col("p").alias("_p"), F.col("confidence").alias("_sure")), [*key, "bar"], "left")
    return out.withColumn("p", F.coalesce("_p", uniform())).withColumn("confidence", F.coalesce("_sure", F.lit(0.0))).drop("_p", "_sure")


def as_known(said: DataFrame, ctx: DataFrame, keep: Column, timeframe: str = "1h") -> DataFrame:
    """What a forecaster of other inputs (asset, ts, p, confidence) last said by the close of each bar of ctx where `keep` holds; abstains before its first."""
    from barloom.functions.grid import close_time
    from barloom.operators.asof import last_before

    at = ctx.where(keep).withColumn("_close", close_time(F.col("open_time"), timeframe))
    out = last_before(at, said.select("asset", F.col("ts").alias("_ts"), F.col("p").alias("_p"), F.col("confidence").alias("_sure")), ["asset"], "_close", "_ts", ["_p", "_sure"])
    return out.withColumn("p", F.coalesce("_p", uniform())).withColumn("confidence", F.coalesce("_sure", F.lit(0.0))).drop("_p", "_sure", "_close")


def forecasters(bars: DataFrame, ctx: DataFrame, keep: Column, horizon: int, key=KEY, timeframe: str = "1h", moment: tuple[str, ...] = ("timeframe", "open_time")) -> dict[str, DataFrame]:
    """Of each forecaster that reads bars, what it says where `keep` holds: the columns of ctx (contexts of bars), p and confidence."""
    from barloom.operators.indicators import recursive, windowed

    return {
        "baseline_climatology": climatology(bars, ctx.where(keep), horizon, key),
        "baseline_persistence": persistence(ctx, horizon, key).where(keep),
        "baseline_uniform": ctx.where(keep).withColumn("p", uniform()).withColumn("confidence", F.lit(0.0)),
        "technical": technical(recursive(windowed(ctx, timeframe, key), key)).where(keep),
        "timeseries": timeseries(ctx, horizon, key).where(keep),
        "crossasset": cross_asset(ctx, horizon, key, moment).where(keep),
    }


def walk_forward(bars: DataFrame, horizon: int, warmup: int = WARMUP, key=KEY, timeframe: str = "1h", others: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row a model and evaluation point of bars of one timeframe: key, as_of, model, p, confidence, threshold, realised, truth, regime.

    The models that read bars, analogues among them, and `others` by name: what models of funding, states, moods or patterns
    said when (asset, ts, p, confidence), each as of the point.
    """
    ctx = coarse_regime(contexts(bars, horizon, key), key=key).withColumn("regime", F.col("regime"))
    keep = (F.col("bar") >= warmup) & ((F.col("bar") - warmup) % horizon == 0)
    said = forecasters(bars, ctx, keep, horizon, key, timeframe) | {"similarity": similar(bars, ctx, keep, horizon, key, timeframe)}
    said |= {name: as_known(df, ctx, keep, timeframe) for name, df in (others or {}).items()}
    out = None
    for name, df in said.items():
        part = df.where("realised IS NOT NULL").select(*key, F.col("open_time").alias("as_of"), F.lit(name).alias("model"), "p", F.col("confidence").cast("double").alias("confidence"), "threshold", "realised", "regime", "typical")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("truth", outcome(F.col("realised"), F.col("threshold")))
