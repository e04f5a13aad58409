"""The time grid: timeframes, floor, ceil, grid points. Weeks start on Monday."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Timeframes in seconds, fastest first; the position is the rank.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "12h": 43200, "1d": 86400, "1w": 604800}
#: The first Monday after the epoch, to which weeks are anchored.
MONDAY = 4 * 86400


def seconds(timeframe: str) -> int:
    try:
        return TIMEFRAMES[timeframe]
    except KeyError:
        raise ValueError(f"unknown timeframe: {timeframe}") from None


def rank(timeframe: str) -> int:
    return list(TIMEFRAMES).index(timeframe)


def bars_per_year(timeframe: str) -> float:
    return 365 * 86400 / seconds(timeframe)


def floor_to(ts: Column, timeframe: str) -> Column:
    """The grid point at or before ts, of the type of ts; expects a time without zone, or UTC sessions."""
    size = seconds(timeframe)
    anchor = MONDAY if timeframe == "1w" else 0
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    since = F.timestamp_diff("SECOND", epoch, ts.cast("timestamp_ntz")) - anchor
    return F.timestamp_add("SECOND", (F.floor(since / size) * size + anchor).cast("int"), epoch)


def ceil_to(ts: Column, timeframe: str) -> Column:
    low = floor_to(ts, timeframe)
    return F.when(low == ts, low).otherwise(plus(low, timeframe, 1))


def plus(ts: Column, timeframe: str, bars: int = 1) -> Column:
    return ts + F.expr(f"INTERVAL {seconds(timeframe) * bars} SECONDS")


def close_time(ts: Column, timeframe: str) -> Column:
    """When a bar that opens at ts is known: its exclusive end."""
    return plus(ts, timeframe, 1)


def grid(df: DataFrame, start: str, end: str, timeframe: str, name: str = "open_time") -> DataFrame:
    """df with a row for each grid point in [start, end): start is floored, end is not."""
    step = F.expr(f"INTERVAL {seconds(timeframe)} SECONDS")
    last = F.col(end) - F.expr("INTERVAL 1 MICROSECOND")
    points = F.sequence(floor_to(F.col(start), timeframe), last, step)
    return df.where(F.col(start) < F.col(end)).withColumn(name, F.explode(points))


def expected_count(start: Column, end: Column, timeframe: str) -> Column:
    """Whole bars between the floor of start and end."""
    return F.greatest(F.lit(0), F.floor(F.timestamp_diff("SECOND", floor_to(start, timeframe), end) / seconds(timeframe)))
