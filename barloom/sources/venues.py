"""Venue payloads as bars: rows of raw JSON bodies (asset, timeframe, body, fetched_at) read by built-in functions.

Fetching is left to the caller; a body that isn't valid gives no rows, one that carries errors raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.grid import TIMEFRAMES, seconds


def _bars(rows: DataFrame, source: str, ms: Column, fields: dict[str, Column]) -> DataFrame:
    span = F.create_map(*(F.lit(x) for t in TIMEFRAMES for x in (t, seconds(t))))[F.col("timeframe")]
    at = F.timestamp_millis(ms)
    known = F.unix_millis(at) + span * 1000 <= F.unix_millis(F.col("fetched_at"))
    none = F.lit(None)
    return rows.select(
        F.upper("asset").alias("asset"), F.lit(source).alias("source"), "timeframe", at.cast("timestamp_ntz").alias("open_time"),
        *(fields[c].cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")),
        fields.get("quote_volume", none).cast("double").alias("quote_volume"), fields.get("trades", none).cast("long").alias("trades"), known.alias("is_final"),
    )


def _rows(bodies: DataFrame, body: Column = F.col("body")) -> DataFrame:  # noqa: B008
    return bodies.withColumn("r", F.explode(F.from_json(body, "array<array<string>>")))


def klines(bodies: DataFrame) -> DataFrame:
    """[open time ms, open, high, low, close, volume, close time, quote volume, trades, ...], oldest first."""
    r = F.col("r")
    return _bars(_rows(bodies), "binance", r[0].cast("long"), {"open": r[1], "high": r[2], "low": r[3], "close": r[4], "volume": r[5], "quote_volume": r[7], "trades": r[8]})


def candles(bodies: DataFrame) -> DataFrame:
    """[time s, low, high, open, close, volume], newest first."""
    r = F.col("r")
    return _bars(_rows(bodies), "coinbase", r[0].cast("long") * 1000, {"low": r[1], "high": r[2], "open": r[3], "close": r[4], "volume": r[5]})


def ohlc(bodies: DataFrame) -> DataFrame:
    """{error: [...], result: {pair: [[time s, open, high, low, close, vwap, volume, trades]]}}; errors within the body raise."""
    errors = F.from_json(F.get_json_object("body", "$.error"), "array<string>")
    checked = F.when(F.size(errors) > 0, F.raise_error(F.concat(F.lit("venue: "), F.array_join(errors, "; ")))).otherwise(F.get_json_object("body", "$.result"))
    pairs = bodies.withColumn("_p", F.explode(F.map_values(F.map_filter(F.from_json(checked, "map<string,string>"), lambda k, v: k != "last"))))
    r = F.col("r")
    return _bars(_rows(pairs, F.col("_p")), "kraken", r[0].cast("long") * 1000, {"open": r[1], "high": r[2], "low": r[3], "close": r[4], "volume": r[6], "quote_volume": r[5].cast("double") * r[6].cast("double"), "trades": r[7]})
