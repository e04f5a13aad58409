"""Queries on validation, trust and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.grid import plus
from barloom.functions.numbers import rounded
from barloom.operators import quality as q
from barloom.operators import store
from barloom.plans.registry import query
from barloom.plans.sql import bars as sql_bars
from barloom.sources.bars import event_bars, rollup_ticks


def _broken(spark, sf):
    """Event bars with faults at fixed places: swapped shapes, slots off the grid, copies, tripled closes; arrival is the row's time of arrival."""
    b = event_bars(spark, sf)
    h = F.floor(F.unix_timestamp(F.col("open_time").cast("timestamp")) / 3600)
    swap = h % 97 == 5
    b = b.withColumn("high", F.when(swap, F.col("low") - 1).otherwise(F.col("high"))).withColumn("close", F.when(h % 211 == 7, F.col("high") * 3).otherwise(F.col("close")))
    b = b.withColumn("high", F.when(h % 211 == 7, F.greatest("high", "close")).otherwise(F.col("high")))
    b = b.withColumn("open_time", F.when(h % 89 == 3, F.col("open_time") + F.expr("INTERVAL 7 SECONDS")).otherwise(F.col("open_time"))).withColumn("arrival", h * 10)
    again = b.where(h % 53 == 1).withColumn("arrival", F.col("arrival") + 25).withColumn("volume", F.col("volume") + 1)
    return b.unionByName(again)


_BROKEN = f"""{sql_bars()}, h AS (SELECT *, epoch(open_time)::BIGINT // 3600 AS h FROM bars),
  s AS (SELECT asset, h, open_time, open, CASE WHEN h % 97 = 5 THEN low - 1 ELSE high END AS high, low, close, volume FROM h),
  c AS (SELECT asset, h, open_time, open, high, low, CASE WHEN h % 211 = 7 THEN high * 3 ELSE close END AS close, volume FROM s),
  d AS (SELECT asset, h, CASE WHEN h % 89 = 3 THEN open_time + INTERVAL 7 SECONDS ELSE open_time END AS open_time, open, CASE WHEN h % 211 = 7 THEN greatest(high, close) ELSE high END AS high, low, close, volume, h * 10 AS arrival FROM c),
  broken AS (SELECT * FROM d UNION ALL SELECT * REPLACE (arrival + 25 AS arrival, volume + 1 AS volume) FROM d WHERE h % 53 = 1),
  f AS (SELECT *, CASE WHEN least(open, high, low, close) <= 0 THEN 'not positive' WHEN high < low THEN 'high below low' WHEN high < greatest(open, close) THEN 'high below body' WHEN low > least(open, close) THEN 'low above body' END AS fault,
    time_bucket(INTERVAL '1 hour', open_time) <> open_time AS off FROM broken),
  good AS (SELECT * FROM f WHERE fault IS NULL AND NOT off),
  kept AS (SELECT asset, open_time, arg_max(high, arrival) AS high, arg_max(low, arrival) AS low, arg_max(close, arrival) AS close, arg_max(volume, arrival) AS volume, count(*) AS copies FROM good GROUP BY 1, 2)"""


@query(
    "validate_events",
    f"""WITH {_BROKEN}, ch AS (SELECT *, (close - lag(close) OVER w) / lag(close) OVER w * 100 AS change, lead(open_time) OVER w AS nxt FROM kept WINDOW w AS (PARTITION BY asset ORDER BY open_time)),
    m AS (SELECT asset, median(change) AS centre, count(change) AS samples FROM ch GROUP BY asset), sc AS (SELECT ch.asset, centre, samples, median(abs(change - centre)) * 1.4826 AS scale FROM ch JOIN m USING (asset) GROUP BY 1, 2, 3),
    fl AS (SELECT asset, open_time, row_number() OVER (PARTITION BY asset ORDER BY open_time) AS n, volume <= 0 OR high = low AS flat FROM kept), fr AS (SELECT asset, open_time, n - row_number() OVER (PARTITION BY asset ORDER BY open_time) AS g FROM fl WHERE flat)
    SELECT 'shape_invalid' AS event_type, 'error' AS severity, asset, open_time AS window_start, 1::BIGINT AS n FROM f WHERE fault IS NOT NULL
    UNION ALL SELECT 'misaligned', 'error', asset, open_time, 1 FROM f WHERE fault IS NULL AND off
    UNION ALL SELECT 'out_of_order', 'warning', asset, open_time, 1 FROM (SELECT *, max(open_time) OVER (PARTITION BY asset ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM good) WHERE open_time < seen
    UNION ALL SELECT 'duplicate', 'warning', asset, open_time, copies - 1 FROM kept WHERE copies > 1
    UNION ALL SELECT CASE WHEN abs(change) > 35 THEN 'impossible_move' ELSE 'outlier' END, CASE WHEN abs(change) > 35 THEN 'error' ELSE 'warning' END, asset, open_time, 1 FROM ch JOIN sc USING (asset) WHERE abs(change) > 35 OR (samples >= 30 AND scale > 0 AND abs(change - centre) / scale > 25)
    UNION ALL SELECT 'flatline', 'warning', asset, min(open_time), count(*) FROM fr GROUP BY asset, g HAVING count(*) >= 8
    UNION ALL SELECT 'missing', CASE WHEN ratio >= {q.GAP_ERROR} THEN 'error' WHEN ratio >= {q.GAP_WARNING} THEN 'warning' ELSE 'info' END, asset, open_time + INTERVAL '1 hour', date_diff('hour', open_time, nxt) - 1 FROM ch JOIN (SELECT asset, 1 - count(*) / (date_diff('hour', min(open_time), max(open_time)) + 1) AS ratio FROM kept GROUP BY asset) USING (asset) WHERE date_diff('hour', open_time, nxt) > 1""",
)
def validate_events(spark, sf):
    return q.validated(_broken(spark, sf), "1h", "arrival")[1].drop("source", "timeframe")


@query(
    "accepted_bars",
    f"WITH {_BROKEN} SELECT asset, open_time, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM kept",
)
def accepted_bars(spark, sf):
    return rounded(q.validated(_broken(spark, sf), "1h", "arrival")[0].select("asset", "open_time", "high", "low", "close", "volume"))


@query(
    "trust_scores",
    f"""WITH {sql_bars()}, g AS (SELECT asset, open_time, lead(open_time) OVER (PARTITION BY asset ORDER BY open_time) AS nxt FROM bars),
    e AS (SELECT asset, date_diff('second', nxt, TIMESTAMP '2024-01-31 00:00:00') AS age, CASE WHEN date_diff('hour', open_time, nxt) >= 4 THEN 0.5 ELSE 0.15 END AS w FROM g WHERE date_diff('hour', open_time, nxt) > 1),
    m AS (SELECT asset, sum(w * pow(2.0, -greatest(age, 0) / (720 * 900.0))) AS mass, count(*) AS events_in_window FROM e WHERE greatest(age, 0) <= 720 * 3600 GROUP BY asset),
    c AS (SELECT asset, count(*) AS n, date_diff('second', max(open_time), TIMESTAMP '2024-01-31 00:00:00') / 10800.0 AS behind FROM bars GROUP BY asset),
    p AS (SELECT asset, coalesce(events_in_window, 0) AS events_in_window, CASE WHEN coalesce(mass, 0) > 0 THEN least(0.95, 1 - exp(-1000 * mass / greatest(50, n) / 8)) ELSE 0 END AS pen, CASE WHEN behind <= 1 THEN 0 ELSE least(0.7, 0.3 * log2(behind + 1)) END AS st FROM c LEFT JOIN m USING (asset))
    SELECT asset, round(greatest(0.1, least(1, 1 - pen - st)), 4) AS score, events_in_window, round(pen, 6) AS penalty, round(st, 6) AS staleness FROM p""",
)
def trust_scores(spark, sf):
    b = event_bars(spark, sf)
    gaps = q.gap_runs(b, "1h").select(*q.KEY, F.col("stop").alias("detected_at"), F.when(F.col("missing") >= 3, "error").otherwise("warning").alias("severity"))
    cover = b.groupBy(*q.KEY).agg(F.count("*").alias("assessed"), F.max("open_time").alias("last_at"))
    return rounded(q.trust(gaps, cover, "1h", "2024-01-31 00:00:00", window_hours=720).drop("source", "timeframe", "degraded", "unusable"))


def _half(k: int, name: str) -> str:
    return f"{name} AS (SELECT event_type AS asset, time_bucket(INTERVAL '1 day', ts) AS open_time, arg_max(value, (ts, event_id)) AS close FROM events WHERE user_id % 2 = {k} GROUP BY 1, 2)"


@query(
    "source_audit",
    f"""WITH {_half(0, 'a')}, {_half(1, 'b')} SELECT a.asset, a.open_time, round(abs(a.close - b.close) / a.close * 100, 6) AS deviation_pct, CASE WHEN abs(a.close - b.close) / a.close * 100 > 80 THEN 'error' ELSE 'warning' END AS severity
    FROM a JOIN b ON a.asset = b.asset AND a.open_time = b.open_time WHERE abs(a.close - b.close) / a.close * 100 > 20""",
)
def source_audit(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    half = lambda k: rollup_ticks(e.where(F.col("user_id") % 2 == k).select(F.col("event_type").alias("asset"), "ts", F.col("value").alias("price"), F.col("event_id").alias("tick_id")), "1d")
    return rounded(q.audit(half(0), half(1), 20.0).select("asset", "open_time", "deviation_pct", "severity"))


@query(
    "upsert_bars",
    f"""WITH {sql_bars()}, old AS (SELECT asset, open_time, close, epoch(open_time)::BIGINT // 3600 % 3 <> 0 AS fin FROM bars WHERE epoch(open_time)::BIGINT // 3600 % 5 <> 0),
    new AS (SELECT asset, open_time, close + 1 AS close, epoch(open_time)::BIGINT // 3600 % 2 = 0 AS fin FROM bars WHERE epoch(open_time)::BIGINT // 3600 % 7 <> 0)
    SELECT coalesce(o.asset, n.asset) AS asset, coalesce(o.open_time, n.open_time) AS open_time,
      round(CASE WHEN o.asset IS NULL OR (n.asset IS NOT NULL AND (NOT o.fin OR n.fin)) THEN n.close ELSE o.close END, 6) AS close,
      CASE WHEN o.asset IS NULL OR (n.asset IS NOT NULL AND (NOT o.fin OR n.fin)) THEN n.fin ELSE o.fin END AS is_final,
      (CASE WHEN o.asset IS NOT NULL AND n.asset IS NOT NULL AND (NOT o.fin OR n.fin) THEN 1 ELSE 0 END)::BIGINT AS revision FROM old o FULL JOIN new n ON o.asset = n.asset AND o.open_time = n.open_time""",
)
def upsert_bars(spark, sf):
    h = F.floor(F.unix_timestamp(F.col("open_time").cast("timestamp")) / 3600)
    b = event_bars(spark, sf).withColumn("ingested_at", F.col("open_time"))
    old = b.where(h % 5 != 0).withColumn("is_final", h % 3 != 0).withColumn("revision", F.lit(0).cast("long"))
    new = b.where(h % 7 != 0).withColumn("is_final", h % 2 == 0).withColumn("close", F.col("close") + 1)
    return rounded(store.upsert_bars(old, new).select("asset", "open_time", "close", "is_final", "revision"))


@query(
    "stale_series",
    f"WITH {sql_bars()} SELECT asset, max(open_time) + INTERVAL '1 hour' AS newest_close, date_diff('second', max(open_time) + INTERVAL '1 hour', TIMESTAMP '2024-01-31 06:00:00') AS age_s, CASE WHEN date_diff('second', max(open_time) + INTERVAL '1 hour', TIMESTAMP '2024-01-31 06:00:00') > 32400 THEN 'error' WHEN date_diff('second', max(open_time) + INTERVAL '1 hour', TIMESTAMP '2024-01-31 06:00:00') > 10800 THEN 'warning' END AS severity FROM bars GROUP BY asset",
)
def stale_series(spark, sf):
    return q.staleness(event_bars(spark, sf), "1h", "2024-01-31 06:00:00").drop("source", "timeframe")


@query(
    "forward_outcomes",
    f"""WITH {sql_bars()} SELECT asset, open_time, open_time + INTERVAL '1 hour' AS known_at, round((lead(close, 12) OVER w - close) / close * 100, 6) AS move_pct, round(max(high) OVER f, 6) AS best, round(min(low) OVER f, 6) AS worst FROM bars
    WINDOW w AS (PARTITION BY asset ORDER BY open_time), f AS (PARTITION BY asset ORDER BY open_time ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)""",
)
def forward_outcomes(spark, sf):
    from barloom.operators.patterns import outcomes

    out = outcomes(event_bars(spark, sf), 12)
    return rounded(out.select("asset", "open_time", plus(F.col("open_time"), "1h").alias("known_at"), "move_pct", "best", "worst"))
