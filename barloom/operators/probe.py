"""Look-ahead probed by experiment: forecasts from copies of history that differ on one side of a moment.

At each of a few moments every series is copied three times, around the moment only: as
it is, with everything after the moment made implausible, and with everything before it.
The copies are series of their own, so a forecaster runs over all of them in one plan,
as it runs over history. One that changes with the future leaks; one that doesn't change
with the past says nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.grid import plus, seconds
from barloom.operators import models
from barloom.operators.backtest import prediction_distance, probe_points

KEY = ("asset", "source", "timeframe")
SIDES = ("as_is", "after", "before")
#: How bars and values are made implausible.
FACTOR, WICK = 3.0, 0.01
#: Bars of a copy before and after its moment.
BEFORE, AFTER = 450, 60
COPY = ("probe", "side")


def probe_times(bars: DataFrame, horizon: int, most: int = 25, warmup: int = 400, timeframe: str = "1h", key: tuple[str, ...] = KEY) -> DataFrame:
    """(probe, at) of at most `most` moments: when the bars close that are spread over the longest series, the first of equally long ones."""
    longest = bars.groupBy(*key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *key).limit(1)
    points = probe_points(longest, horizon, most, warmup, key)
    own = bars.join(F.broadcast(longest.select(*key)), list(key), "left_semi")  # one row
    own = own.select(*key, "open_time", (F.row_number().over(Window.partitionBy(*key).orderBy("open_time")) - 1).alias("at"))
    return own.join(points, [*key, "at"]).select("probe", plus(F.col("open_time"), timeframe).alias("at"))


def copied(rows: DataFrame, times: DataFrame, known: Column, timeframe: str = "1h", before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """rows (known: when each is) around each moment, once a side, with probe, side, at and wild: whether the row is on the side that is corrupted.

    times has a row a probe, so few that each row is compared with all of them.
    """
    span = lambda n: F.expr(f"INTERVAL {seconds(timeframe) * n} SECONDS")
    near = (known > F.col("at") - span(before)) & (known <= F.col("at") + span(after))
    sides = rows.join(F.broadcast(times), near).withColumn("side", F.explode(F.array(*map(F.lit, SIDES))))
    return sides.withColumn("wild", ((F.col("side") == "after") & (known > F.col("at"))) | ((F.col("side") == "before") & (known <= F.col("at"))))


def corrupted_bars(copies: DataFrame) -> DataFrame:
    """copies of bars with prices and volumes of wild ones three times as high and their moves turned round; still valid bars."""
    open_ = F.col("open") * FACTOR
    turned = open_ * 2 - F.col("close") * FACTOR
    close = F.when(turned > 0, turned).otherwise(open_ * 0.5)
    new = {"open": open_, "close": close, "high": F.greatest(open_, close) * (1 + WICK), "low": F.least(open_, close) * (1 - WICK), "volume": F.col("volume") * FACTOR}
    if "quote_volume" in copies.columns:
        new["quote_volume"] = F.col("quote_volume") * FACTOR
    return copies.withColumns({c: F.when(F.col("wild"), x).otherwise(F.col(c)) for c, x in new.items()}).drop("wild")


def corrupted_values(copies: DataFrame, *columns: str) -> DataFrame:
    """copies of features or other series with the wild ones' values set to -3 times what they are."""
    return copies.withColumns({c: F.when(F.col("wild"), F.col(c) * -FACTOR).otherwise(F.col(c)) for c in columns}).drop("wild")


def bar_forecasts(bars: DataFrame, times: DataFrame, horizon: int, timeframe: str = "1h", key: tuple[str, ...] = KEY, before: int = BEFORE, altered: Callable[[DataFrame, tuple[str, ...]], DataFrame] | None = None) -> DataFrame:
    """What each forecaster that reads bars says at each moment, on each side: key, probe, side, model, p, confidence. Peers are corrupted too.

    altered(copies, key) may change what the forecasters are given: a way to plant a leak.
    """
    copies = corrupted_bars(copied(bars, times, plus(F.col("open_time"), timeframe), timeframe, before))
    series = (*key, *COPY)
    copies = altered(copies, series) if altered else copies
    ctx = models.contexts(copies, horizon, series)
    said = models.forecasters(copies, ctx, plus(F.col("open_time"), timeframe) == F.col("at"), horizon, series, timeframe, ("timeframe", "open_time", *COPY))
    return _together(said, series)


def feature_forecasts(bars: DataFrame, times: DataFrame, timeframe: str = "1h", key: tuple[str, ...] = KEY, altered: Callable[[DataFrame, tuple[str, ...]], DataFrame] | None = None) -> DataFrame:
    """What the technical forecaster says of features that were computed and stored once, and are corrupted themselves."""
    from barloom.operators.indicators import recursive, windowed

    stored = recursive(windowed(bars, timeframe, key), key).select(*key, "open_time", "close", "ema_21", "sma_50", "sma_200", "rsi_14", "macd_histogram", "adx")
    copies = corrupted_values(copied(stored, times, plus(F.col("open_time"), timeframe), timeframe, before=1 if altered is None else BEFORE), "close", "ema_21", "sma_50", "sma_200", "rsi_14", "macd_histogram", "adx")
    series = (*key, *COPY)
    copies = altered(copies, series) if altered else copies
    return _together({"technical of stored features": models.technical(copies.where(plus(F.col("open_time"), timeframe) == F.col("at")))}, series)


def rate_forecasts(rates: DataFrame, times: DataFrame, timeframe: str = "1h", altered: Callable[[DataFrame, tuple[str, ...]], DataFrame] | None = None) -> DataFrame:
    """What the order-flow forecaster says at each moment of rates (asset, ts, rate), which are corrupted."""
    series = ("asset", *COPY)
    copies = corrupted_values(copied(rates, times, F.col("ts"), timeframe), "rate")
    copies = altered(copies, series) if altered else copies
    newest = Window.partitionBy(*series).orderBy(F.desc("ts"))
    said = models.order_flow(copies, series).where("ts <= at").withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    return _together({"orderflow": said}, series)


def _together(said: dict[str, DataFrame], series: tuple[str, ...]) -> DataFrame:
    out = None
    for name, df in said.items():
        part = df.select(*series, F.lit(name).alias("model"), "p", F.col("confidence").cast("double").alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out


def responses(said: DataFrame) -> DataFrame:
    """model, asset, probe, future and past: how far a forecast moves when what comes after, or before, its moment is corrupted. Moments without all three forecasts drop out."""
    of = lambda side: F.max(F.when(F.col("side") == side, F.struct("p", "confidence"))).alias(side)
    one = said.groupBy(*(c for c in said.columns if c not in ("side", "p", "confidence"))).agg(*map(of, SIDES)).dropna(subset=list(SIDES))
    away = lambda side: prediction_distance(F.col("as_is")["p"], F.col(side)["p"], F.col("as_is")["confidence"], F.col(side)["confidence"])
    return one.select("model", "asset", "probe", away("after").alias("future"), away("before").alias("past"))
