"""Technical indicators by series, ordered by open_time.

What a frame can express is one select of window columns over one sort. The
recursive averages (seeded by a plain mean, then exponential) are a fold over each
series: one Arrow group a series, read once for all of them. A series is a key's
time line, whose length is bounded by time and not by the number of series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.functions.grid import bars_per_year

KEY = ("asset", "source", "timeframe")
WARMUP = 200


def _frame(n: int, key=KEY):
    return Window.partitionBy(*key).orderBy("open_time").rowsBetween(1 - n, 0)


def _full(n: int, x: Column, key=KEY) -> Column:
    """x once the frame has n rows."""
    return F.when(F.count("*").over(_frame(n, key)) == n, x)


def windowed(bars: DataFrame, timeframe: str, key=KEY) -> DataFrame:
    """bars with all indicators that are functions of a frame."""
    order = Window.partitionBy(*key).orderBy("open_time")
    day = Window.partitionBy(*key, F.to_date("open_time")).orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    last = F.lag("close").over(order)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    flow = F.when(last.isNull(), F.lit(0.0)).when(F.col("close") > last, F.col("volume")).when(F.col("close") < last, -F.col("volume")).otherwise(0.0)
    step = bars.select(
        "*",
        F.when((last > 0) & (F.col("close") > 0), F.log(F.col("close") / last)).alias("_log"),
        flow.alias("_flow"),
        F.coalesce(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)), F.col("high") - F.col("low")).alias("true_range"),
        F.sum(typical * F.col("volume")).over(day).alias("_pv"),
        F.sum("volume").over(day).alias("_v"),
        F.avg("close").over(_frame(20, key)).alias("_mean"),
        F.stddev_pop("close").over(_frame(20, key)).alias("_sd"),
        F.min("low").over(_frame(14, key)).alias("_low"),
        F.max("high").over(_frame(14, key)).alias("_high"),
    )
    whole = order.rowsBetween(Window.unboundedPreceding, 0)
    old = F.lag("close", 10).over(order)
    vwap = F.when(F.col("_v") > 0, F.col("_pv") / F.col("_v"))
    k = _full(14, F.when(F.col("_high") > F.col("_low"), (F.col("close") - F.col("_low")) / (F.col("_high") - F.col("_low")) * 100).otherwise(50.0), key)
    width = 4 * F.col("_sd")
    out = step.select(
        *bars.columns,
        "true_range",
        F.row_number().over(order).alias("bars_seen"),
        *(_full(n, F.avg("close").over(_frame(n, key)), key).alias(f"sma_{n}") for n in (20, 50, 200)),
        F.when(F.count("_log").over(_frame(20, key)) == 20, F.stddev_pop("_log").over(_frame(20, key)) * (bars_per_year(timeframe) ** 0.5) * 100).alias("realised_vol_20"),
        _full(20, F.col("_mean"), key).alias("bb_mid"),
        _full(20, F.col("_mean") + 2 * F.col("_sd"), key).alias("bb_upper"),
        _full(20, F.col("_mean") - 2 * F.col("_sd"), key).alias("bb_lower"),
        _full(20, F.when(width > 1e-9, (F.col("close") - F.col("_mean") + 2 * F.col("_sd")) / width).otherwise(0.5), key).alias("bb_percent_b"),
        _full(20, width / F.col("_mean") * 100, key).alias("bb_bandwidth"),
        k.alias("_k"),
        F.sum("_flow").over(whole).alias("obv"),
        vwap.alias("vwap"),
        F.when(vwap > 0, (F.col("close") - vwap) / vwap * 100).alias("vwap_distance_pct"),
        F.when(old > 0, (F.col("close") - old) / old * 100).alias("roc_10"),
    )
    ready = F.count("_k").over(_frame(3, key)) == 3
    return out.select(
        *(c for c in out.columns if c != "_k"),
        F.when(ready, F.col("_k")).alias("stoch_k"),
        F.when(ready, F.avg("_k").over(_frame(3, key))).alias("stoch_d"),
        F.when(F.col("bars_seen") > 20, F.col("obv") - F.lag("obv", 20).over(order)).alias("obv_change_20"),
    )


def seeded(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """The recursive average of x, whose first value is the plain mean of n values; leading nulls are passed over."""
    out = np.full(len(x), np.nan)
    known = np.flatnonzero(~np.isnan(x))
    if len(known) < n:
        return out
    at = known[n - 1]
    value = x[known[:n]].mean()
    out[at] = value
    for i in known[n:]:
        value += alpha * (x[i] - value)
        out[i] = value
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return seeded(x, n, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return seeded(x, n, 1 / n)


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    change = np.diff(close, prepend=np.nan)
    gain, loss = wilder(np.where(np.isnan(change), np.nan, np.maximum(change, 0)), n), wilder(np.where(np.isnan(change), np.nan, np.maximum(-change, 0)), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(gain), np.nan, np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss)))


RECURSIVE = ("ema_9", "ema_21", "ema_50", "rsi_14", "macd", "macd_signal", "macd_histogram", "atr_14", "atr_pct", "plus_di", "minus_di", "adx")


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("open_time", ignore_index=True)
    close, high, low = (pdf[c].to_numpy(float) for c in ("close", "high", "low"))
    before = np.roll(close, 1)
    span = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    span[:1] = (high - low)[:1]
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    rise, fall = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    rise[:1] = fall[:1] = np.nan
    later = span.copy()
    later[:1] = np.nan
    macd = ema(close, 12) - ema(close, 26)
    signal = ema(macd, 9)
    atr = wilder(span, 14)
    with np.errstate(divide="ignore", invalid="ignore"):
        smooth = wilder(later, 14)
        plus, minus = 100 * wilder(rise, 14) / smooth, 100 * wilder(fall, 14) / smooth
        plus[smooth == 0] = minus[smooth == 0] = np.nan
        dx = np.where(plus + minus > 0, 100 * np.abs(plus - minus) / (plus + minus), np.where(np.isnan(plus), np.nan, 0.0))
        values = (ema(close, 9), ema(close, 21), ema(close, 50), rsi(close), np.where(np.isnan(signal), np.nan, macd), signal, macd - signal, atr, np.where(close > 0, atr / close * 100, np.nan), plus, minus, wilder(dx, 14))
    return pdf.assign(**{c: pd.Series(v).where(~np.isnan(v), None).astype(object) for c, v in zip(RECURSIVE, values, strict=True)})


def recursive(bars: DataFrame, key=KEY) -> DataFrame:
    """bars with the recursive indicators: EMA, RSI, MACD, ATR, ADX."""
    schema = StructType([*bars.schema.fields, *(StructField(c, DoubleType()) for c in RECURSIVE)])
    return bars.groupBy(*key).applyInPandas(_fold, schema)


def features(bars: DataFrame, timeframe: str, key=KEY) -> DataFrame:
    """All indicators of the final bars, from the bar on at which every average is warm."""
    out = recursive(windowed(bars.where("is_final"), timeframe, key), key)
    change = F.when(F.col("open") > 0, (F.col("close") - F.col("open")) / F.col("open") * 100).otherwise(0.0)
    span = F.when(F.col("low") > 0, (F.col("high") - F.col("low")) / F.col("low") * 100).otherwise(0.0)
    return out.withColumn("change_pct", change).withColumn("range_pct", span).where(F.col("bars_seen") >= WARMUP)
