"""Ticks and bars: roll-ups, the canonical view, deterministic synthetic series.

A bar has the columns of BAR; a series is one (asset, source, timeframe).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.grid import floor_to, plus

BAR = (
    "asset string, source string, timeframe string, open_time timestamp_ntz, open double, high double, low double, close double, "
    "volume double, quote_volume double, trades long, is_final boolean"
)


def rollup_ticks(ticks: DataFrame, timeframe: str, asset: str = "asset", ts: str = "ts", price: str = "price", order: tuple[str, ...] = ("ts", "tick_id"), source: Column | None = None) -> DataFrame:
    """One bar for each asset and grid slot that has ticks; ties in time go by the order columns. One shuffle, combined before it."""
    at = F.struct(*order)
    bars = ticks.groupBy(F.col(asset).alias("asset"), floor_to(F.col(ts), timeframe).alias("open_time")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.sum(price).alias("quote_volume"),
        F.count("*").alias("trades"),
    )
    return bars.select("asset", (source if source is not None else F.lit("ticks")).alias("source"), F.lit(timeframe).alias("timeframe"), "open_time", "open", "high", "low", "close", "volume", "quote_volume", "trades", F.lit(True).alias("is_final"))


def rollup_bars(bars: DataFrame, timeframe: str) -> DataFrame:
    """Final bars of a faster timeframe as bars of a slower one."""
    slot = floor_to(F.col("open_time"), timeframe).alias("slot")
    out = bars.where("is_final").groupBy("asset", "source", slot).agg(
        F.min_by("open", "open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("quote_volume").alias("quote_volume"),
        F.sum("trades").alias("trades"),
    )
    return out.select("asset", "source", F.lit(timeframe).alias("timeframe"), F.col("slot").alias("open_time"), "open", "high", "low", "close", "volume", "quote_volume", "trades", F.lit(True).alias("is_final"))


def event_bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    """Bars of the events table: an asset is an event type, a price an event's value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ticks = e.select(F.col("event_type").alias("asset"), "ts", F.col("value").alias("price"), F.col("event_id").alias("tick_id"))
    return rollup_ticks(ticks, timeframe, source=F.lit("events"))


def knowable(bars: DataFrame, timeframe: str, as_of: str) -> DataFrame:
    """The final bars whose end isn't after as_of."""
    return bars.where(F.col("is_final") & (plus(F.col("open_time"), timeframe) <= F.lit(as_of).cast("timestamp_ntz")))
