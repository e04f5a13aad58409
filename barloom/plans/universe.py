"""Queries on sources, listings and event studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.numbers import rounded, sql_tail
from barloom.operators import universe as u
from barloom.plans.registry import query, registered_sql
from barloom.plans.sql import bars as sql_bars
from barloom.sources.bars import event_bars


@query(
    "source_failover",
    """WITH s AS (SELECT s_nationkey AS k, count(*) AS n, min(s_suppkey) AS first FROM supplier GROUP BY 1), a AS (SELECT n_regionkey AS region, n_nationkey AS nation, n FROM nation JOIN s ON k = n_nationkey)
    SELECT region, arg_min(nation, nation) AS nation, arg_min(n, nation) AS suppliers FROM a GROUP BY region""",
)
def source_failover(spark, sf):
    """The first nation, in order of its key, of each region that has suppliers: dimension tables as providers."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select(F.col("n_regionkey").alias("asset"), F.lit("all").alias("timeframe"), F.col("s_nationkey").alias("source"))
    p = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("source"), F.col("n_nationkey").alias("priority"))
    return u.failover(rows, p).groupBy(F.col("asset").alias("region")).agg(F.min("source").alias("nation"), F.count("*").alias("suppliers"))


@query(
    "survivorship",
    """WITH l AS (SELECT o_custkey, min(o_orderdate) AS a, CASE WHEN max(o_orderdate) < TIMESTAMP '2001-01-01' THEN max(o_orderdate) END AS b FROM orders GROUP BY 1),
    m AS (SELECT unnest([TIMESTAMP '1996-01-01', TIMESTAMP '1998-01-01', TIMESTAMP '2000-01-01']) AS moment)
    SELECT moment, count(*) AS as_of, count(b) AS missing, round(count(b) / count(*), 4) AS bias FROM l JOIN m ON a <= moment AND (b IS NULL OR moment < b) GROUP BY moment""",
)
def survivorship(spark, sf):
    """Customers as listings: from the first order to the last, if that is past."""
    o = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("asset")).agg(F.min("o_orderdate").alias("listed_at"), F.max("o_orderdate").alias("last"))
    gone = F.when(F.col("last") < F.lit("2001-01-01").cast("timestamp_ntz"), F.col("last"))
    moments = spark.range(3).select(F.timestamp_add("DAY", F.element_at(F.array(F.lit(0), F.lit(731), F.lit(1461)), F.col("id").cast("int") + 1), F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")).alias("moment"))
    return u.survivorship(o.select("asset", "listed_at", gone.alias("delisted_at")), moments)


def _tail(s: str, n: str, bs: str, bn: str) -> str:
    pool = f"(({s} + {bs}) / ({n} + {bn}))"
    z = f"(abs({s} / {n} - {bs} / {bn}) / sqrt({pool} * (1 - {pool}) * (1 / {n} + 1 / {bn})))"
    return f"CASE WHEN {n} > 0 AND {bn} > 0 AND {pool} > 0 AND {pool} < 1 THEN least(1.0, 2 * {sql_tail(z)}) ELSE 1.0 END"


def _horizon(h: int) -> str:
    return f"""b{h} AS (SELECT asset, open_time, bar, CASE WHEN bar >= 48 AND before > 0 AND after > 0 AND close_n IS NOT NULL THEN after / before END AS ratio, (close_n - close) / close * 100 AS ret FROM (SELECT *, stddev_pop(l) OVER (PARTITION BY asset ORDER BY bar ROWS BETWEEN 47 PRECEDING AND 1 PRECEDING) AS before, stddev_pop(l) OVER (PARTITION BY asset ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS after, lead(close, {h}) OVER (PARTITION BY asset ORDER BY bar) AS close_n FROM lg)),
  m{h} AS (SELECT asset, count(*) AS bn, count(*) FILTER (ratio >= 1.5) AS bs FROM b{h} WHERE ret IS NOT NULL AND bar >= 48 AND (bar - 48) % {h} = 0 AND ratio IS NOT NULL GROUP BY 1), w{h} AS (SELECT asset, count(*) AS dn, count(*) FILTER (ret > 0) AS du FROM b{h} WHERE ret IS NOT NULL AND bar % {h} = 0 GROUP BY 1),
  l{h} AS (SELECT ev.asset, ev.category, ev.pub, arg_min(ratio, open_time) AS ratio, arg_min(ret, open_time) AS ret FROM (SELECT ev.*, b.ratio IS NULL AS none, b.ratio, b.ret, b.open_time, row_number() OVER (PARTITION BY ev.asset, ev.category, ev.pub ORDER BY b.open_time) AS k FROM ev JOIN b{h} b ON b.asset = ev.asset AND b.open_time >= slot AND b.open_time <= slot + INTERVAL '7 hours') ev WHERE k = 1 AND NOT none GROUP BY 1, 2, 3),
  o{h} AS (SELECT *, row_number() OVER (PARTITION BY asset, category ORDER BY pub) AS k FROM l{h}),
  r{h} AS (SELECT asset, category, k, pub AS last, true AS kept FROM o{h} WHERE k = 1 UNION ALL SELECT o.asset, o.category, o.k, CASE WHEN o.pub - r.last >= INTERVAL '{h} hours' THEN o.pub ELSE r.last END, o.pub - r.last >= INTERVAL '{h} hours' FROM r{h} r JOIN o{h} o ON o.asset = r.asset AND o.category = r.category AND o.k = r.k + 1),
  k{h} AS (SELECT o.asset, o.category, {h} AS horizon, count(*) AS events, median(ratio) AS median_ratio, avg(ratio) AS mean_ratio, median(ret) AS median_return_pct, count(*) FILTER (ratio >= 1.5) AS s, count(*) FILTER ((ret > 0) = (o.category = 'etf')) AS ds FROM o{h} o JOIN r{h} r USING (asset, category, k) WHERE kept GROUP BY 1, 2 HAVING count(*) >= 5),
  j{h} AS (SELECT k.*, bn, bs, dn, CASE WHEN category = 'etf' THEN du ELSE dn - du END AS db FROM k{h} k JOIN m{h} USING (asset) JOIN w{h} USING (asset))"""


@query(
    "event_impact",
    f"""WITH RECURSIVE {sql_bars()}, lg AS (SELECT asset, open_time, close, ln(close / lag(close) OVER w) AS l, row_number() OVER w - 1 AS bar FROM bars WINDOW w AS (PARTITION BY asset ORDER BY open_time)),
    ev AS (SELECT DISTINCT event_type AS asset, CASE WHEN value > 120 THEN 'etf' WHEN event_id % 2 = 0 THEN 'enforcement' ELSE 'macro' END AS category, ts AS pub, time_bucket(INTERVAL '1 hour', ts) + CASE WHEN time_bucket(INTERVAL '1 hour', ts) < ts THEN INTERVAL '1 hour' ELSE INTERVAL '0 hours' END AS slot FROM events WHERE value > 80 AND event_id % 7 <> 0 AND user_id % 5 <> 0),
    {_horizon(6)}, {_horizon(24)}, al AS (SELECT * FROM j6 UNION ALL SELECT * FROM j24),
    te AS (SELECT asset, category, horizon, events, median_ratio, mean_ratio, median_return_pct, 'elevated' AS test, s AS hits, bs AS bh, bn AS bt FROM al UNION ALL SELECT asset, category, horizon, events, median_ratio, mean_ratio, median_return_pct, 'directional', ds, db, dn FROM al WHERE category <> 'macro'),
    tp AS (SELECT *, hits / events AS rate, bh / bt AS baseline, {_tail('hits', 'events', 'bh', 'bt')} AS p_value FROM te), tr AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY p_value) AS i, count(*) OVER (PARTITION BY asset) AS c FROM tp)
    SELECT asset, category, horizon::INT AS horizon, test, events, round(median_ratio, 6) AS median_ratio, round(mean_ratio, 6) AS mean_ratio, round(median_return_pct, 6) AS median_return_pct, round(rate, 6) AS rate, round(baseline, 6) AS baseline, round(p_value, 6) AS p_value, coalesce(p_value <= max(CASE WHEN p_value <= i * 0.05 / c THEN p_value END) OVER (PARTITION BY asset), false) AS significant FROM tr""",
)
def event_impact(spark, sf):
    return rounded(_impact(spark, sf).drop("verdict"))


def _impact(spark, sf):
    """Large single events as news about their type's bars; every seventh is recycled, every fifth user's about something else."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("value > 80")
    kind = F.when(F.col("value") > 120, "etf").when(F.col("event_id") % 2 == 0, "enforcement").otherwise("macro")
    news = e.select(F.col("event_type").alias("asset"), kind.alias("category"), F.col("ts").alias("at"), F.when(F.col("user_id") % 5 == 0, 0.2).otherwise(0.8).alias("relevance"), (F.col("event_id") % 7 == 0).alias("is_recycled"))
    return u.impact(event_bars(spark, sf), news)


@query(
    "impact_verdicts",
    f"""WITH t AS ({registered_sql("event_impact")}), w AS (SELECT *, rate AS p, events AS n FROM t),
    i AS (SELECT *, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS mid, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) AS half FROM w),
    v AS (SELECT *, events >= 25 AND significant AND (mid - half > baseline OR mid + half < baseline) AS sure FROM i)
    SELECT asset, category, horizon, any_value(events) AS events, CASE WHEN any_value(events) < 25 THEN 'insufficient evidence (' || any_value(events) || ' events, need 25)' WHEN bool_or(sure AND rate > baseline AND test = 'directional') THEN 'moves price directionally'
      WHEN bool_or(sure AND rate > baseline AND test = 'elevated') THEN 'precedes elevated volatility, direction unpredictable' WHEN bool_or(sure AND rate < baseline AND test = 'elevated') THEN 'followed by calmer-than-usual conditions' ELSE 'no measurable impact' END AS verdict FROM v GROUP BY 1, 2, 3""",
)
def impact_verdicts(spark, sf):
    return u.impact_verdicts(_impact(spark, sf))


@query(
    "impact_estimates",
    f"""WITH p(category, vol, dir, hours) AS (VALUES {', '.join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE)" for k, v in u.IMPACT_PRIORS.items())}), e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'etf' WHEN 'view' THEN 'macro' WHEN 'error' THEN 'security_incident' ELSE 'unheard of' END AS category, (event_id % 8) / 8 AS importance, (event_id % 4) / 4 AS confidence FROM events)
    SELECT event_id, round(1 + (coalesce(vol, 1) - 1) * (0.6 + 0.8 * importance), 3) AS volatility_multiple, round(coalesce(dir, 0) * importance, 3) AS direction_bias, coalesce(hours, 6) AS expected_hours, round(least(0.35, 0.15 + 0.2 * confidence), 3) AS sureness FROM e LEFT JOIN p USING (category)""",
)
def impact_estimates(spark, sf):
    kind = F.when(F.col("event_type") == "click", "etf").when(F.col("event_type") == "view", "macro").when(F.col("event_type") == "error", "security_incident").otherwise("unheard of")
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("event_type").alias("asset"), kind.alias("category"), (F.col("event_id") % 8 / 8).alias("importance"), (F.col("event_id") % 4 / 4).alias("confidence"))
    return u.impact_estimates(e).select("event_id", "volatility_multiple", "direction_bias", "expected_hours", "sureness")
