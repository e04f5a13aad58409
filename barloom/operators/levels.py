"""Market structure: swing levels, support and resistance, trend, volume profile, retracements.

An analysis looks back over LOOKBACK bars and is made at every STEP-th bar; `carried`
gives the bars between the last one. A look-back is an array column of bounded length, so the
whole is expressions over arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numbers import let
from barloom.operators.patterns import swings

KEY = ("asset", "source", "timeframe")
LOOKBACK, STEP = 120, 5
NEAR_PCT = 0.5
BINS = 24
VALUE_AREA = 0.70
#: Retracement shares.
RETRACEMENTS = (0.236, 0.382, 0.5, 0.618, 0.786)


def clusters(points: Column) -> Column:
    """Levels of an array of (price, bar): points within NEAR_PCT of a cluster's lowest member join it, at a lowest price of 0 only points at 0; two touches make a level. Most touched first."""
    kind = "array<struct<first:double,total:double,n:int,seen_from:int,seen_to:int>>"
    s = F.array_sort(F.transform(points, lambda p: F.struct(p["price"].alias("price"), p["bar"].cast("int").alias("bar"))))

    def step(acc, p):
        last = F.try_element_at(acc, F.lit(-1))
        near = F.when(last["first"] == 0, p["price"] == 0).otherwise(F.abs(p["price"] - last["first"]) / last["first"] * 100 <= NEAR_PCT)
        joins = last.isNotNull() & near
        grown = F.struct(last["first"].alias("first"), (last["total"] + p["price"]).alias("total"), (last["n"] + 1).alias("n"), F.least(last["seen_from"], p["bar"]).alias("seen_from"), F.greatest(last["seen_to"], p["bar"]).alias("seen_to"))
        new = F.struct(p["price"].alias("first"), p["price"].alias("total"), F.lit(1).alias("n"), p["bar"].alias("seen_from"), p["bar"].alias("seen_to"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(new))).cast(kind)

    found = F.aggregate(s, F.array().cast(kind), step)
    levels = F.transform(F.filter(found, lambda c: c["n"] >= 2), lambda c: F.struct((-c["n"]).alias("o"), (c["total"] / c["n"]).alias("price"), c["n"].alias("touches"), c["seen_from"].alias("seen_from"), c["seen_to"].alias("seen_to")))
    return F.transform(F.array_sort(levels), lambda c: F.struct(c["price"].alias("price"), c["touches"].alias("touches"), c["seen_from"].alias("seen_from"), c["seen_to"].alias("seen_to")))


def profile(frame: Column) -> Column:
    """Volume by BINS equal price bins of an array of (high, low, volume), each bar's volume spread evenly over the bins it touches."""
    ends = F.struct(F.array_min(F.transform(frame, lambda b: b["low"])).alias("low"), F.array_max(F.transform(frame, lambda b: b["high"])).alias("high"))

    def binned(e):
        width = (e["high"] - e["low"]) / BINS
        bin_of = lambda x: F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((x - e["low"]) / width))).cast("int")
        spans = F.transform(frame, lambda b: F.struct(bin_of(b["low"]).alias("a"), bin_of(b["high"]).alias("z"), b["volume"].alias("v")))

        def shares(ss):
            share = lambda i: F.aggregate(ss, F.lit(0.0), lambda acc, x: acc + F.when((x["a"] <= i) & (x["z"] >= i), x["v"] / (x["z"] - x["a"] + 1)).otherwise(0.0))
            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.struct((e["low"] + width * i).alias("low"), (e["low"] + width * (i + 1)).alias("high"), share(i).alias("volume")))

        return F.when(width > 0, let(spans, shares))

    return let(ends, binned)


def value_area(bins: Column) -> Column:
    """Struct (poc, low, high): the price of the fullest bin (lowest on ties) and the area around it that holds VALUE_AREA of the volume, growing to the fuller side, upwards on ties."""
    start = F.struct(F.aggregate(bins, F.lit(0.0), lambda a, b: a + b["volume"]).alias("total"), F.array_max(F.transform(bins, lambda b: b["volume"])).alias("top"))

    def around(m):
        poc = (F.array_position(F.transform(bins, lambda b: b["volume"]), m["top"]) - 1).cast("int")

        def step(s, _):
            up = F.coalesce(F.get(bins, s["z"] + 1)["volume"], F.lit(-1.0))
            down = F.when(s["a"] > 0, F.get(bins, s["a"] - 1)["volume"]).otherwise(-1.0)
            rise = up >= down
            grown = F.struct(F.when(rise, s["a"]).otherwise(s["a"] - 1).alias("a"), F.when(rise, s["z"] + 1).otherwise(s["z"]).alias("z"), (s["v"] + F.greatest(up, down)).alias("v"))
            return F.when((s["v"] >= VALUE_AREA * m["total"]) | (F.greatest(up, down) < 0), s).otherwise(grown)

        first = F.struct(poc.alias("a"), poc.alias("z"), m["top"].alias("v"))
        area = F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), first, step)
        mid = F.get(bins, poc)
        return F.when(m["total"] > 0, let(area, lambda x: F.struct(((mid["low"] + mid["high"]) / 2).alias("poc"), F.get(bins, x["a"])["low"].alias("low"), F.get(bins, x["z"])["high"].alias("high"))))

    return let(start, around)


def carried(bars: DataFrame, analysis: DataFrame, key=KEY) -> DataFrame:
    """Every bar with the newest analysis (structure) up to it, distances in percent from its own close; null before the first."""
    order = Window.partitionBy(*key).orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    cols = ("trend", "support", "resistance", "poc", "value_low", "value_high")
    df = bars.select(*key, "open_time", "close").join(analysis.select(*key, "open_time", F.struct(*cols).alias("_s")), [*key, "open_time"], "left")
    df = df.withColumn("_s", F.last("_s", ignorenulls=True).over(order)).select(*key, "open_time", "close", "_s.*")
    away = lambda c: F.when(F.col("close") != 0, (F.col(c) - F.col("close")) / F.col("close") * 100).otherwise(0.0)
    return df.withColumn("support_pct", away("support")).withColumn("resistance_pct", away("resistance"))


def structure(bars: DataFrame, key=KEY) -> DataFrame:
    """Of every STEP-th bar with a full look-back: trend (1, 0, -1), levels, support, resistance with distances in percent, poc, value area, retracements."""
    order = Window.partitionBy(*key).orderBy("open_time")
    back = order.rowsBetween(1 - LOOKBACK, 0)
    inner = order.rowsBetween(3 - LOOKBACK, -2)
    df = swings(bars, 2, key).withColumn("bar", F.row_number().over(order) - 1)
    point = lambda flag, price: F.when(F.col(flag), F.struct(F.col(price).alias("price"), "bar"))
    df = df.select(
        *key, "open_time", "bar", "close", F.collect_list(F.struct("high", "low", "volume")).over(back).alias("frame"),
        F.collect_list(point("swing_high", "high")).over(inner).alias("highs"), F.collect_list(point("swing_low", "low")).over(inner).alias("lows"),
    )
    df = df.where((F.col("bar") >= LOOKBACK - 1) & (F.col("bar") % STEP == STEP - 1))
    two = lambda c: (F.try_element_at(F.col(c), F.lit(-2))["price"], F.try_element_at(F.col(c), F.lit(-1))["price"])
    (h1, h2), (l1, l2) = two("highs"), two("lows")
    trend = F.when((h2 > h1) & (l2 > l1), 1).when((h2 <= h1) & (l2 <= l1), -1).otherwise(0)
    df = df.withColumn("trend", F.when((F.size("highs") >= 2) & (F.size("lows") >= 2), trend).otherwise(0)).withColumn("_l", clusters(F.concat("highs", "lows"))).withColumn("_b", profile(F.col("frame")))
    df = df.select("*", F.inline(F.array(F.struct(F.col("_l").alias("levels"), F.col("_b").alias("bins")))))  # built once, not for each reference
    df = df.withColumn("area", value_area(F.col("bins")))
    prices = F.transform("levels", lambda x: x["price"])
    df = df.withColumn("support", F.array_max(F.filter(prices, lambda x: x < F.col("close")))).withColumn("resistance", F.array_min(F.filter(prices, lambda x: x > F.col("close"))))
    away = lambda c: F.when(F.col("close") != 0, (F.col(c) - F.col("close")) / F.col("close") * 100).otherwise(0.0)
    top, bottom = F.array_max(F.transform("highs", lambda x: x["price"])), F.array_min(F.transform("lows", lambda x: x["price"]))
    down = F.col("trend") < 0
    fib = F.when(top > bottom, F.array(*(F.struct(F.lit(r).alias("share"), F.when(down, bottom + (top - bottom) * r).otherwise(top - (top - bottom) * r).alias("price")) for r in RETRACEMENTS)))
    return df.select(*key, "open_time", "bar", "close", "trend", "levels", "support", "resistance", away("support").alias("support_pct"), away("resistance").alias("resistance_pct"), F.col("area.poc").alias("poc"), F.col("area.low").alias("value_low"), F.col("area.high").alias("value_high"), fib.alias("retracements"))


def vector(bars: DataFrame, timeframe: str, least: int = 200, key=KEY) -> DataFrame:
    """The whole feature vector of each final bar once its series has `least`: indicators, range and change, and the newest structure (structure_trend, support, resistance and distances)."""
    from barloom.operators.indicators import recursive, windowed

    bars = bars.where("is_final") if "is_final" in bars.columns else bars
    f = recursive(windowed(bars, timeframe, key), key)
    pct = lambda a, b: F.when(b > 0, (a - b) / b * 100).otherwise(0.0)
    f = f.withColumn("range_pct", pct(F.col("high"), F.col("low"))).withColumn("change_pct", pct(F.col("close"), F.col("open")))
    s = carried(bars, structure(bars, key), key).drop("close").withColumn("structure_trend", F.col("trend").cast("double")).drop("trend")
    return f.join(s, [*key, "open_time"]).where(F.col("bars_seen") >= least)
