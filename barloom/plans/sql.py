"""SQL fragments that the queries' DuckDB texts share."""

SECONDS = {"5m": "5 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}


def bars(timeframe: str = "1h", name: str = "bars") -> str:
    """The bars of events as a common table."""
    return f"""{name} AS (SELECT event_type AS asset, time_bucket(INTERVAL '{SECONDS[timeframe]}', ts) AS open_time,
      arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
      count(*)::DOUBLE AS volume, sum(value) AS quote_volume, count(*) AS trades
      FROM events GROUP BY 1, 2)"""


def r(x: str, alias: str) -> str:
    return f"round({x}, 6) AS {alias}"
