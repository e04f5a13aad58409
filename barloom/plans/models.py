"""Queries on forecasts, their evaluation and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.numbers import rounded
from barloom.operators import evaluation as e
from barloom.operators import models as m
from barloom.plans.registry import query
from barloom.plans.sql import bars as sql_bars
from barloom.sources.bars import event_bars

H = 6
_CTX = f"""WITH {sql_bars()}, b AS (SELECT *, row_number() OVER w - 1 AS bar, (close - lag(close) OVER w) / lag(close) OVER w * 100 AS ret, (lead(close, {H}) OVER w - close) / close * 100 AS realised FROM bars WINDOW w AS (PARTITION BY asset ORDER BY open_time)),
  c AS (SELECT *, greatest(0.05, median(abs(ret)) OVER (PARTITION BY asset ORDER BY bar ROWS 98 PRECEDING) * 0.6 * sqrt({H})) AS thr, sum(ret) OVER (PARTITION BY asset ORDER BY bar ROWS {H - 1} PRECEDING) AS mv FROM b),
  pt AS (SELECT *, CASE WHEN realised > thr THEN 'up' WHEN realised < -thr THEN 'down' ELSE 'flat' END AS truth FROM c WHERE bar >= 200 AND (bar - 200) % {H} = 0 AND realised IS NOT NULL)"""
_CLIMATE = f"""k AS (SELECT pt.asset, pt.bar, count(*) FILTER (h.realised > pt.thr) AS u, count(*) FILTER (h.realised < -pt.thr) AS d, count(*) AS n FROM pt JOIN c h ON h.asset = pt.asset AND h.bar % {H} = 0 AND h.bar + {H} <= pt.bar AND h.realised IS NOT NULL GROUP BY 1, 2),
  cl AS (SELECT pt.*, CASE WHEN n >= 30 THEN (u + 1) / (n + 3) ELSE 1 / 3.0 END AS pu, CASE WHEN n >= 30 THEN (n - u - d + 1) / (n + 3) ELSE 1 / 3.0 END AS pf, CASE WHEN n >= 30 THEN (d + 1) / (n + 3) ELSE 1 / 3.0 END AS pd FROM pt LEFT JOIN k USING (asset, bar)),
  pe AS (SELECT *, greatest(-1, least(1, greatest(-1, least(1, mv / (thr * 2))) * 0.6)) AS ed FROM pt)"""


@query("climatology", f"{_CTX}, {_CLIMATE} SELECT asset, open_time AS as_of, round(pu, 6) AS up, round(pf, 6) AS flat, round(pd, 6) AS down, round(thr, 6) AS threshold, truth FROM cl")
def climatology(spark, sf):
    b = event_bars(spark, sf)
    df = m.climatology(b, m.points(b, H), H).where("realised IS NOT NULL")
    return rounded(df.select("asset", F.col("open_time").alias("as_of"), "p.up", "p.flat", "p.down", "threshold", m.outcome(F.col("realised"), F.col("threshold")).alias("truth")))


@query(
    "persistence_scores",
    f"{_CTX}, {_CLIMATE}, x AS (SELECT *, 0.66 * (0.5 + ed / 2) AS pu FROM pe) SELECT asset, open_time AS as_of, round(pu, 6) AS up, round(0.66 - pu, 6) AS down, round(power(pu - (truth = 'up')::INT, 2) + power(0.34 - (truth = 'flat')::INT, 2) + power(0.66 - pu - (truth = 'down')::INT, 2), 6) AS brier, round(-ln(CASE truth WHEN 'up' THEN pu WHEN 'flat' THEN 0.34 ELSE greatest(0.66 - pu, 1e-12) END), 6) AS log_loss FROM x",
)
def persistence_scores(spark, sf):
    b = event_bars(spark, sf)
    df = m.persistence(m.contexts(b, H), H).where((F.col("bar") >= 200) & ((F.col("bar") - 200) % H == 0) & F.col("realised").isNotNull())
    df = e.scored(df.withColumn("truth", m.outcome(F.col("realised"), F.col("threshold"))))
    return rounded(df.select("asset", F.col("open_time").alias("as_of"), "p.up", "p.down", "brier", "log_loss"))


@query(
    "class_balance",
    f"{_CTX} SELECT asset, count(*) AS points, round(count(*) FILTER (truth = 'up') / count(*), 4) AS up, round(count(*) FILTER (truth = 'flat') / count(*), 4) AS flat, round(count(*) FILTER (truth = 'down') / count(*), 4) AS down, round(median(thr), 4) AS median_threshold FROM pt GROUP BY asset",
)
def class_balance(spark, sf):
    df = m.points(event_bars(spark, sf), H).where("realised IS NOT NULL").withColumn("truth", m.outcome(F.col("realised"), F.col("threshold")))
    share = lambda k: F.round(F.count(F.when(F.col("truth") == k, 1)) / F.count("*"), 4).alias(k)
    return df.groupBy("asset").agg(F.count("*").alias("points"), share("up"), share("flat"), share("down"), F.round(F.percentile("threshold", F.lit(0.5)), 4).alias("median_threshold"))


_BRIER = "power(pu - (truth = 'up')::INT, 2) + power(pf - (truth = 'flat')::INT, 2) + power(pd - (truth = 'down')::INT, 2)"


@query(
    "skill_against_climatology",
    f"""{_CTX}, {_CLIMATE}, s AS (SELECT asset, bar, {_BRIER} AS base FROM cl), q AS (SELECT asset, bar, truth, 0.66 * (0.5 + ed / 2) AS pu, 0.34 AS pf, 0.66 - 0.66 * (0.5 + ed / 2) AS pd FROM pe UNION ALL SELECT asset, bar, truth, -1, 0, 0 FROM pe),
    z AS (SELECT q.asset, q.bar, CASE WHEN pu = -1 THEN 'baseline_uniform' ELSE 'baseline_persistence' END AS model, CASE WHEN pu = -1 THEN 2 / 3.0 ELSE {_BRIER} END AS brier, base FROM q JOIN s USING (asset, bar))
    SELECT model, count(*) AS n, round(avg(brier), 6) AS brier, round(avg(base), 6) AS base_brier, round(1 - avg(brier) / avg(base), 6) AS skill FROM z GROUP BY model""",
)
def skill(spark, sf):
    b = event_bars(spark, sf)
    f = e.scored(m.walk_forward(b, H)).where(F.col("model").startswith("baseline"))
    return rounded(e.against_baseline(f, slices=()).select("model", "n", "brier", "base_brier", "skill"))


@query("walk_forward_skill")
def walk_forward_skill(spark, sf):
    return rounded(e.against_baseline(e.scored(m.walk_forward(event_bars(spark, sf), H))))


@query("calibration_curves")
def calibration_curves(spark, sf):
    f = m.walk_forward(event_bars(spark, sf), H).withColumn("slice", F.explode(F.array(F.lit("all"), F.col("regime")))).where("confidence > 0")
    return e.isotonic(f)




@query(
    "reliability_diagram",
    f"{_CTX}, {_CLIMATE}, l AS (SELECT 'up' AS outcome, pu AS stated, (truth = 'up')::INT AS hit FROM cl UNION ALL SELECT 'flat', pf, (truth = 'flat')::INT FROM cl UNION ALL SELECT 'down', pd, (truth = 'down')::INT FROM cl) SELECT outcome, least(9, floor(stated * 10))::INT AS bin, count(*) AS n, round(avg(stated), 6) AS mean_stated, sum(hit)::BIGINT AS hits, round(sum(hit) / count(*), 6) AS observed FROM l GROUP BY 1, 2",
)
def reliability_diagram(spark, sf):
    b = event_bars(spark, sf)
    f = m.climatology(b, m.points(b, H), H).where("realised IS NOT NULL").withColumn("truth", m.outcome(F.col("realised"), F.col("threshold"))).withColumn("model", F.lit("baseline_climatology"))
    return rounded(e.reliability(f).select("outcome", "bin", "n", "mean_stated", "hits", "observed"))


@query(
    "expected_volatility",
    f"""WITH {sql_bars()}, x AS (SELECT asset, open_time, abs((close - lag(close) OVER w) / lag(close) OVER w * 100) AS r FROM bars WINDOW w AS (PARTITION BY asset ORDER BY open_time)),
    m AS (SELECT asset, open_time, count(r) OVER f AS n, median(r) OVER f AS c FROM x WINDOW f AS (PARTITION BY asset ORDER BY open_time ROWS 99 PRECEDING)) SELECT asset, open_time, round(CASE WHEN n >= 5 THEN c ELSE 0 END * sqrt({H}), 6) AS expected_volatility FROM m""",
)
def expected_volatility(spark, sf):
    return rounded(m.expected_volatility(event_bars(spark, sf), H).select("asset", "open_time", "expected_volatility"))


@query(
    "correlation_matrix",
    f"WITH {sql_bars('1d')}, x AS (SELECT asset, open_time, (close - lag(close) OVER w) / lag(close) OVER w * 100 AS ret FROM bars WINDOW w AS (PARTITION BY asset ORDER BY open_time)) SELECT p.asset AS a, q.asset AS b, count(*) AS n, round(CASE WHEN count(*) < 20 THEN 0 ELSE corr(p.ret, q.ret) END, 6) AS correlation FROM x p JOIN x q ON p.open_time = q.open_time AND p.asset < q.asset WHERE p.ret IS NOT NULL AND q.ret IS NOT NULL GROUP BY 1, 2",
)
def correlation_matrix(spark, sf):
    return rounded(e.correlation(m.contexts(event_bars(spark, sf, "1d"), 1), least=20))


@query(
    "prediction_ledger",
    f"""{_CTX}, {_CLIMATE}, x AS (SELECT *, 'baseline_climatology|' || upper(asset) || '|1h|{H}|' || strftime(open_time, '%Y-%m-%dT%H:%M:%S+00:00') AS what FROM cl) SELECT asset, open_time AS as_of, substr(sha256(what), 1, 40) AS prediction_id FROM x""",
)
def prediction_ledger(spark, sf):
    b = event_bars(spark, sf)
    f = m.climatology(b, m.points(b, H), H).where("realised IS NOT NULL").withColumnRenamed("open_time", "as_of").withColumn("model", F.lit("baseline_climatology"))
    return e.hashed(f, H).select("asset", "as_of", "prediction_id")


@query(
    "resolved_outcomes",
    f"""{_CTX}, {_CLIMATE}, a AS (SELECT *, row_number() OVER () AS k, 'baseline_climatology|' || upper(asset) || '|1h|{H}|' || strftime(open_time, '%Y-%m-%dT%H:%M:%S+00:00') AS what FROM (SELECT c.asset, c.open_time, c.close, c.thr, c.bar FROM c WHERE bar >= 200 AND (bar - 200) % {H} = 0)),
    k2 AS (SELECT a.asset, a.bar, count(*) FILTER (h.realised > a.thr) AS u, count(*) FILTER (h.realised < -a.thr) AS d, count(*) AS n FROM a JOIN c h ON h.asset = a.asset AND h.bar % {H} = 0 AND h.bar + {H} <= a.bar AND h.realised IS NOT NULL GROUP BY 1, 2),
    x AS (SELECT a.asset, a.open_time, a.close, a.thr, a.what, e.close AS exit_price, (e.close - a.close) / a.close * 100 AS move, CASE WHEN n >= 30 THEN (u + 1) / (n + 3) ELSE 1 / 3.0 END AS pu, CASE WHEN n >= 30 THEN (n - u - d + 1) / (n + 3) ELSE 1 / 3.0 END AS pf, CASE WHEN n >= 30 THEN (d + 1) / (n + 3) ELSE 1 / 3.0 END AS pd
      FROM a JOIN bars e ON e.asset = a.asset AND e.open_time = a.open_time + INTERVAL '{H} hours' LEFT JOIN k2 ON k2.asset = a.asset AND k2.bar = a.bar WHERE a.open_time + INTERVAL '{H + 2} hours' <= TIMESTAMP '2024-02-01'),
    y AS (SELECT *, CASE WHEN move > thr THEN 'up' WHEN move < -thr THEN 'down' ELSE 'flat' END AS truth FROM x)
    SELECT asset, open_time AS as_of, substr(sha256(what), 1, 40) AS prediction_id, round(exit_price, 6) AS exit_price, round(move, 6) AS move_pct, truth, round(power(pu - (truth = 'up')::INT, 2) + power(pf - (truth = 'flat')::INT, 2) + power(pd - (truth = 'down')::INT, 2), 6) AS brier,
      round(-ln(CASE truth WHEN 'up' THEN pu WHEN 'flat' THEN pf ELSE pd END), 6) AS log_loss, CASE WHEN pu >= pf AND pu >= pd THEN 'up' WHEN pf >= pd THEN 'flat' ELSE 'down' END = truth AS correct FROM y""",
)
def resolved_outcomes(spark, sf):
    """Ledger rows recorded, verified and resolved against later bars."""
    b = event_bars(spark, sf)
    f = m.climatology(b, m.points(b, H), H).withColumnRenamed("open_time", "as_of").withColumn("model", F.lit("baseline_climatology")).withColumn("reference_price", F.col("close"))
    return rounded(e.resolve(e.hashed(f, H), b, "1h", "2024-02-01 00:00:00").select("asset", "as_of", "prediction_id", "exit_price", "move_pct", "truth", "brier", "log_loss", "correct"))
