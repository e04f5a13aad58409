"""Queries on stored forecasts: learning, calibration, the ensemble and its gate.

Lines of orders stand in for a ledger of forecasts: a week of a kind of line is a point
of time of an asset, the order number picks the model, quantity and tax its statement
and confidence.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.numbers import rounded, sql_tail
from barloom.operators import ensemble as s
from barloom.operators import evaluation as e
from barloom.operators import models as m
from barloom.plans.registry import query
from barloom.sources.tables import stored

MODELS = ("baseline_climatology", "baseline_persistence", "technical", "timeseries", "similarity", "regime", "sentiment", "crossasset")
#: How much of the truth each model's statement has, in tenths.
KNOWS = (0, 0, 9, 5, 0, 7, 2, 3)
REGIMES, BUCKETS = ("range", "uptrend", "downtrend"), ("low", "normal", "high")


def forecasts(spark, sf):
    """model, asset, source, timeframe, as_of, regime, p, confidence, threshold, realised, close, data_quality, truth."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    first = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    one = lines.groupBy(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("as_of"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 8).cast("int").alias("m"))
    one = one.agg(F.min_by("l_quantity", first).alias("q"), F.min_by("l_tax", first).alias("t"))
    day = F.datediff(F.col("as_of"), F.lit("1970-01-01"))
    week = F.floor(day / 7)
    of = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    df = one.withColumn("k", (day * 7919 + F.ascii("asset") * 31 + F.ascii(F.substring("asset", 2, 1)) * 17) % 100).withColumn("realised", (F.col("k") - 50) / 20.0)
    edge = F.floor(F.least(F.lit(0.6), F.greatest(F.lit(-0.6), of(KNOWS, F.col("m")) / 10.0 * F.col("realised") * 0.32 + (F.col("q") - 25.5) / 100.0)) * 100) / 100
    base = F.col("m") == 0
    p = F.struct(*(F.when(base, b).otherwise(x).alias(n) for n, b, x in (("up", 0.3, 0.35 + edge / 2), ("flat", 0.41, F.lit(0.3)), ("down", 0.29, 0.35 - edge / 2))))
    return df.select(
        of(MODELS, F.col("m")).alias("model"), "asset", F.lit("stored").alias("source"), F.lit("1w").alias("timeframe"), "as_of", F.lit(1).alias("horizon"), of(REGIMES, week % 3).alias("regime"), of(BUCKETS, F.floor(week / 4) % 3).alias("volatility_bucket"),
        p.alias("p"), F.when(base, 0.3).otherwise(F.round(F.col("t") * 8, 2)).alias("confidence"), F.lit(1.0).alias("threshold"), "realised", (F.col("k") + 100).cast("double").alias("close"),
        F.when(F.col("k") % 10 == 0, 0.8).otherwise(0.95).alias("data_quality"), m.outcome(F.col("realised"), F.lit(1.0)).alias("truth"),
    )


def _pick(names, at: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][({at} + 1)::INT]"


_FC = f"""ln AS (SELECT l_returnflag || l_linestatus AS asset, date_trunc('week', l_shipdate)::TIMESTAMP AS as_of, ((l_orderkey * 7 + l_linenumber) % 8)::INT AS m, l_quantity AS q, l_tax AS t, (l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax) AS o FROM lineitem),
  one AS (SELECT asset, as_of, m, arg_min(q, o) AS q, arg_min(t, o) AS t FROM ln GROUP BY ALL), dd AS (SELECT *, date_diff('day', DATE '1970-01-01', as_of::DATE) AS d FROM one),
  kk AS (SELECT *, d // 7 AS wk, (d * 7919 + ascii(asset) * 31 + ascii(substr(asset, 2, 1)) * 17) % 100 AS k FROM dd), rr AS (SELECT *, (k - 50) / 20.0::DOUBLE AS realised FROM kk),
  ee AS (SELECT *, floor(least(0.6, greatest(-0.6, {_pick(KNOWS, 'm')} / 10.0::DOUBLE * realised * 0.32::DOUBLE + (q - 25.5::DOUBLE) / 100.0::DOUBLE)) * 100) / 100 AS edge FROM rr),
  fc AS (SELECT {_pick(MODELS, 'm')} AS model, asset, as_of, {_pick(REGIMES, 'wk % 3')} AS regime, {_pick(BUCKETS, '(wk // 4) % 3')} AS vol, CASE WHEN m = 0 THEN 0.3::DOUBLE ELSE 0.35::DOUBLE + edge / 2 END AS pu, CASE WHEN m = 0 THEN 0.41::DOUBLE ELSE 0.3::DOUBLE END AS pf, CASE WHEN m = 0 THEN 0.29::DOUBLE ELSE 0.35::DOUBLE - edge / 2 END AS pd,
    CASE WHEN m = 0 THEN 0.3::DOUBLE ELSE round(t * 8, 2) END AS confidence, realised, (k + 100)::DOUBLE AS close, CASE WHEN k % 10 = 0 THEN 0.8::DOUBLE ELSE 0.95::DOUBLE END AS quality, CASE WHEN realised > 1 THEN 'up' WHEN realised < -1 THEN 'down' ELSE 'flat' END AS truth FROM ee),
  sc AS (SELECT *, power(pu - (truth = 'up')::INT, 2) + power(pf - (truth = 'flat')::INT, 2) + power(pd - (truth = 'down')::INT, 2) AS brier, CASE truth WHEN 'up' THEN pu WHEN 'flat' THEN pf ELSE pd END AS pt, CASE WHEN pu >= pf AND pu >= pd THEN 'up' WHEN pf >= pd THEN 'flat' ELSE 'down' END = truth AS correct FROM fc)"""


def scored(spark, sf):
    f = e.scored(forecasts(spark, sf))
    return f.withColumn("probability_of_truth", m.probability(F.col("p"), F.col("truth")))


_SLICES = f"""{_FC}, sl AS (SELECT *, unnest([{{'d': 'overall', 'v': 'all'}}, {{'d': 'asset', 'v': asset}}, {{'d': 'timeframe', 'v': '1w'}}, {{'d': 'horizon', 'v': '1 bars'}}, {{'d': 'regime', 'v': regime}}, {{'d': 'volatility', 'v': vol}}]) AS x FROM sc),
  sg AS (SELECT model, x.d AS dimension, x.v AS value, count(*) AS n, round(avg(brier), 5) AS brier, round(avg(-ln(greatest(pt, 1e-12))), 5) AS log_loss, round(avg(correct::INT), 4) AS accuracy, round(count(*) FILTER (truth = 'up') / count(*), 4) AS up, round(count(*) FILTER (truth = 'flat') / count(*), 4) AS flat, round(count(*) FILTER (truth = 'down') / count(*), 4) AS down, round(avg(pt), 4) AS mean_probability_of_truth, count(*) >= 30 AS has_evidence FROM sl GROUP BY 1, 2, 3)"""


@query("outcome_slices", f"WITH {_SLICES} SELECT * FROM sg")
def outcome_slices(spark, sf):
    return e.outcome_slices(scored(spark, sf))


@query("best_slices", f"WITH {_SLICES} SELECT dimension, model, value, brier, n FROM sg WHERE has_evidence QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY brier, model, value) = 1")
def best_slices(spark, sf):
    return e.best_slices(e.outcome_slices(scored(spark, sf)))


def _p(n: str, mean: str, var: str) -> str:
    z = f"({mean} / sqrt({var} / {n}))"
    return f"CASE WHEN {n} < 5 THEN 1.0 WHEN {var} <= 0 THEN CASE WHEN {mean} <= 0 THEN 1.0 ELSE 0.0 END WHEN {z} >= 0 THEN {sql_tail(z)} ELSE 1 - {sql_tail('-' + z)} END"


def _step_up(table: str, p: str) -> str:
    return f"SELECT *, coalesce({p} <= (SELECT max({p}) FROM (SELECT {p}, row_number() OVER (ORDER BY {p}) AS i, count(*) OVER () AS c FROM {table}) WHERE {p} <= i * 0.05 / c), false) AS significant FROM {table}"


_WEIGHTS = f"""{_FC}, pr AS (SELECT a.*, b.brier AS base FROM sc a JOIN sc b ON b.model = 'baseline_climatology' AND a.asset = b.asset AND a.as_of = b.as_of WHERE a.model <> 'baseline_climatology'),
  px AS (SELECT *, unnest(['all', regime]) AS slice FROM pr), py AS (SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY model, asset, slice ORDER BY as_of DESC) <= 400),
  w0 AS (SELECT model, asset, slice, count(*) AS n, avg(brier) AS brier, avg(base) AS base_brier, avg(base - brier) AS mm, var_samp(base - brier) AS vv FROM py GROUP BY 1, 2, 3),
  w1 AS (SELECT *, round(1 - brier / base_brier, 6) AS skill, round({_p('n', 'mm', 'vv')}, 6) AS p_value FROM w0), w2 AS ({_step_up('w1', 'p_value')}),
  w3 AS (SELECT *, CASE WHEN n >= 40 AND skill > 0.01 AND significant THEN round(skill * n / (n + 100), 6) ELSE 0 END AS w FROM w2),
  w4 AS (SELECT *, CASE WHEN w > 0 AND count(*) FILTER (w > 0) OVER s >= 2 THEN round(w * 0.7 + avg(w) FILTER (w > 0) OVER s * 0.3, 6) ELSE w END AS weight FROM w3 WINDOW s AS (PARTITION BY asset, slice))"""


@query(
    "learned_weights",
    f"WITH {_WEIGHTS} SELECT model, asset, slice, n, skill, p_value, significant, weight::DOUBLE AS weight, CASE WHEN weight > 0 THEN NULL WHEN n < 40 THEN 'too few samples' WHEN skill <= 0.01 THEN 'no skill' WHEN NOT significant THEN 'not significant' ELSE 'shrunk to zero' END AS gated_by FROM w4",
)
def learned_weights(spark, sf):
    return rounded(e.learned_weights(scored(spark, sf)).select("model", "asset", "slice", "n", "skill", "p_value", "significant", "weight", "gated_by"))


@query(
    "weight_changes",
    f"""WITH {_WEIGHTS} SELECT model, asset, slice, weight::DOUBLE AS weight, round(weight - coalesce(o.old, 0), 6) AS delta FROM w4 LEFT JOIN (SELECT model, asset, slice, 0.01::DOUBLE AS old FROM w4 WHERE slice = 'all') o USING (model, asset, slice) WHERE abs(weight - coalesce(o.old, 0)) > 1e-9""",
)
def weight_changes(spark, sf):
    """New weights against those of a round before, which gave every model 0.01 over all."""
    f = scored(spark, sf)
    old = f.where("model <> 'baseline_climatology'").select("model", "asset", "timeframe", F.lit("all").alias("slice"), F.lit(0.01).alias("weight")).distinct()
    return rounded(e.learned_weights(f, previous=old).where("abs(delta) > 1e-9").select("model", "asset", "slice", "weight", "delta"))


_REPORT = f"""{_FC}, pr AS (SELECT a.*, b.brier AS base FROM sc a JOIN sc b ON b.model = 'baseline_climatology' AND a.asset = b.asset AND a.as_of = b.as_of WHERE a.model <> 'baseline_climatology'),
  r0 AS (SELECT model, slice, count(*) AS n, avg(brier) AS brier, avg(base) AS base_brier, avg(base - brier) AS mm, var_samp(base - brier) AS vv FROM (SELECT *, unnest(['all', regime]) AS slice FROM pr) GROUP BY 1, 2 HAVING count(*) >= 5),
  r1 AS (SELECT *, 1 - brier / base_brier AS skill, {_p('n', 'mm', 'vv')} AS p_value FROM r0), r2 AS ({_step_up('r1', 'p_value')}), rep AS (SELECT *, n >= 30 AND skill > 0.01 AND significant AS beats FROM r2)"""
_CURVES = """, ct AS (SELECT *, unnest(['all', regime]) AS slice FROM fc WHERE confidence > 0), cp AS (SELECT *, row_number() OVER (PARTITION BY model, slice ORDER BY as_of, asset) - 1 AS pos, count(*) OVER (PARTITION BY model, slice) AS n FROM ct),
  cz AS (SELECT model, slice, n, greatest(1, floor(n * 0.6::DOUBLE)) AS cut FROM (SELECT DISTINCT model, slice, n FROM cp)), ok AS (SELECT *, n - cut AS hold, n >= 120 AND n - cut >= 20 AS good FROM cz),
  cl AS (SELECT cp.model, cp.slice, pos < cut AS fits, as_of, asset, truth, unnest([{'o': 'up', 'p': pu}, {'o': 'flat', 'p': pf}, {'o': 'down', 'p': pd}]) AS x FROM cp JOIN ok USING (model, slice) WHERE good),
  pts AS (SELECT model, slice, x.o AS o, round(x.p, 4) AS px, avg((truth = x.o)::INT) AS y, count(*)::DOUBLE AS w FROM cl WHERE fits GROUP BY 1, 2, 3, 4), pn AS (SELECT *, count(*) OVER (PARTITION BY model, slice, o) AS c FROM pts),
  cu AS (SELECT *, row_number() OVER g AS r, sum(w * y) OVER g AS sy, sum(w) OVER g AS sw FROM pn WHERE c >= 2 WINDOW g AS (PARTITION BY model, slice, o ORDER BY px)),
  av AS (SELECT j.model, j.slice, j.o, j.r AS j, k.r AS i, (k.sy - j.sy + j.w * j.y) / (k.sw - j.sw + j.w) AS a FROM cu j JOIN cu k ON j.model = k.model AND j.slice = k.slice AND j.o = k.o AND k.r >= j.r),
  mn AS (SELECT model, slice, o, i, min(a) OVER (PARTITION BY model, slice, o, j ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS a FROM av), ft AS (SELECT model, slice, o, i AS r, max(a) AS y FROM mn GROUP BY 1, 2, 3, 4),
  cv AS (SELECT cu.model, cu.slice, cu.o, cu.px, ft.y FROM cu JOIN ft USING (model, slice, o, r)),
  xs AS (SELECT DISTINCT model, slice, x.o AS o, x.p AS p FROM cl), lo AS (SELECT xs.model, xs.slice, xs.o, xs.p, arg_max(cv.px, cv.px) AS x0, arg_max(cv.y, cv.px) AS y0 FROM xs JOIN cv ON xs.model = cv.model AND xs.slice = cv.slice AND xs.o = cv.o AND cv.px <= xs.p GROUP BY 1, 2, 3, 4),
  hi AS (SELECT xs.model, xs.slice, xs.o, xs.p, arg_min(cv.px, cv.px) AS x1, arg_min(cv.y, cv.px) AS y1 FROM xs JOIN cv ON xs.model = cv.model AND xs.slice = cv.slice AND xs.o = cv.o AND cv.px > xs.p GROUP BY 1, 2, 3, 4),
  mp AS (SELECT model, slice, o, p, CASE WHEN y0 IS NULL AND y1 IS NULL THEN p WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (p - x0) / (x1 - x0) END AS q FROM xs LEFT JOIN lo USING (model, slice, o, p) LEFT JOIN hi USING (model, slice, o, p)),
  hq AS (SELECT cl.model, cl.slice, cl.as_of, cl.asset, x.o AS o, x.p AS p, (truth = x.o)::INT AS hit, q, sum(q) OVER (PARTITION BY cl.model, cl.slice, as_of, asset) AS tot FROM cl JOIN mp ON mp.model = cl.model AND mp.slice = cl.slice AND mp.o = x.o AND mp.p = x.p WHERE NOT fits),
  bn AS (SELECT model, slice, o, b, k, count(*) AS c, abs(avg(v) - avg(hit)) AS gap FROM (SELECT *, z.b AS b, z.v AS v, least(9, floor(z.v * 10)) AS k FROM (SELECT *, unnest([{'b': 0, 'v': p}, {'b': 1, 'v': CASE WHEN tot > 0 THEN q / tot ELSE p END}]) AS z FROM hq)) GROUP BY 1, 2, 3, 4, 5),
  ec AS (SELECT model, slice, o, b, round(sum(c * gap) / sum(c), 5) AS ece FROM bn GROUP BY 1, 2, 3, 4), em AS (SELECT model, slice, round(sum(ece) FILTER (b = 0) / 3, 5) AS ece_before, round(sum(ece) FILTER (b = 1) / 3, 5) AS ece_after FROM ec GROUP BY 1, 2),
  th AS (SELECT cp.model, cp.slice, max(as_of) AS fitted_through FROM cp JOIN ok USING (model, slice) WHERE pos < cut AND good GROUP BY 1, 2),
  recs AS (SELECT ok.model, ok.slice, ok.n AS samples, CASE WHEN good THEN hold ELSE 0 END::BIGINT AS holdout, ece_before, ece_after, round(ece_before - ece_after, 5) AS improvement, coalesce(round(ece_before - ece_after, 5) >= 0.005, false) AS improved, fitted_through FROM ok LEFT JOIN em USING (model, slice) LEFT JOIN th USING (model, slice))"""


@query("calibration_records", f"WITH {_FC}{_CURVES} SELECT model, slice, samples, holdout, round(ece_before, 4) AS ece_before, round(ece_after, 4) AS ece_after, improved, fitted_through FROM recs")
def calibration_records(spark, sf):
    out = s.calibration_records(forecasts(spark, sf))
    return rounded(out.select("model", "slice", F.col("samples").cast("long").alias("samples"), F.col("holdout").cast("long").alias("holdout"), "ece_before", "ece_after", "improved", "fitted_through"), 4)


_MAPPED = """, cx AS (SELECT fc.*, coalesce(a.improved, b.improved) AS kept, CASE WHEN a.model IS NOT NULL THEN regime ELSE 'all' END AS use, coalesce(a.fitted_through, b.fitted_through) AS ft, CASE WHEN a.model IS NOT NULL THEN a.improvement ELSE b.improvement END AS better, a.model IS NOT NULL OR b.model IS NOT NULL AS known, coalesce(a.improved, false) AS own FROM fc LEFT JOIN recs a ON a.model = fc.model AND a.slice = fc.regime LEFT JOIN recs b ON b.model = fc.model AND b.slice = 'all'),
  cy AS (SELECT *, coalesce(kept, false) AND as_of <= ft AS early, coalesce(kept, false) AND as_of > ft AS uses FROM cx),
  cw AS (SELECT cy.*, u.q AS qu, f.q AS qf, d.q AS qd FROM cy LEFT JOIN mp u ON uses AND u.model = cy.model AND u.slice = use AND u.o = 'up' AND u.p = pu LEFT JOIN mp f ON uses AND f.model = cy.model AND f.slice = use AND f.o = 'flat' AND f.p = pf LEFT JOIN mp d ON uses AND d.model = cy.model AND d.slice = use AND d.o = 'down' AND d.p = pd),
  ca AS (SELECT * EXCLUDE (pu, pf, pd), CASE WHEN qu + qf + qd > 0 THEN qu / (qu + qf + qd) ELSE pu END AS pu, CASE WHEN qu + qf + qd > 0 THEN qf / (qu + qf + qd) ELSE pf END AS pf, CASE WHEN qu + qf + qd > 0 THEN qd / (qu + qf + qd) ELSE pd END AS pd, known AND NOT early AS record, uses AND own AS in_regime FROM cw)"""


@query("calibrated_forecasts", f"WITH {_FC}{_CURVES}{_MAPPED} SELECT model, asset, as_of, round(pu, 5) AS up, round(pf, 5) AS flat, round(pd, 5) AS down, record, in_regime FROM ca WHERE confidence > 0")
def calibrated_forecasts(spark, sf):
    f = stored(forecasts(spark, sf))
    out = s.calibrated(f, s.calibration_records(f)).where("confidence > 0")
    return rounded(out.select("model", "asset", "as_of", "p.up", "p.flat", "p.down", "record", "in_regime"), 5)


#: What the eight models read, as declared.
_FREE = """inp(model, reads) AS (VALUES ('baseline_climatology', ['price']), ('baseline_persistence', ['price']), ('technical', ['features']), ('timeseries', ['price']), ('similarity', ['features', 'price']), ('regime', ['state']), ('sentiment', ['news']), ('crossasset', ['peers'])),
  free AS (SELECT a.model, round(1 / (1 + sum(len(list_intersect(a.reads, b.reads)) / len(list_distinct(a.reads || b.reads)))), 4) AS i FROM inp a JOIN inp b ON a.model <> b.model GROUP BY 1)"""
_PANEL = f"""{_REPORT}{_CURVES}{_MAPPED}, {_FREE},
  sk AS (SELECT ca.*, i, coalesce(a.w, b.w, 0) AS skill, coalesce(a.n, b.n, 0) AS ns, pu - pd AS edge FROM ca JOIN free USING (model) LEFT JOIN (SELECT model, slice, n, CASE WHEN beats THEN round(skill, 5) END AS w FROM rep) a ON a.model = ca.model AND a.slice = regime LEFT JOIN (SELECT model, slice, n, CASE WHEN beats THEN round(skill, 5) END AS w FROM rep) b ON b.model = ca.model AND b.slice = 'all'),
  sv AS (SELECT *, CASE WHEN confidence > 0 AND skill > 0 THEN round(skill * i, 6) END AS share, CASE WHEN confidence <= 0 OR abs(edge) < 0.04 THEN NULL WHEN edge > 0 THEN 'up' ELSE 'down' END AS vote FROM sk),
  pg AS (SELECT asset, as_of, regime, count(*) AS members, count(vote) AS votes, coalesce(sum(i) FILTER (vote = 'up'), 0) AS uw, coalesce(sum(i) FILTER (vote = 'down'), 0) AS dw, count(*) FILTER (vote = 'up') AS uv, count(*) FILTER (vote = 'down') AS dv, coalesce(sum(share), 0) AS weight, count(share) AS contributors, max(skill) AS best, max(ns) AS ns,
    bool_or(record) AS rec, bool_or(in_regime) AS inr, coalesce(max(better) FILTER (uses), 0) AS better, count(*) FILTER (share IS NOT NULL AND own) AS rs, count(*) FILTER (vote IS NOT NULL AND own) AS rv, sum(pu * share) AS su, sum(pf * share) AS sf, sum(pd * share) AS sd, max(close) AS close, min(quality) AS quality FROM sv GROUP BY 1, 2, 3),
  ph AS (SELECT pg.*, CASE WHEN uw > 0 AND uw > dw + 1e-9 THEN 'up' WHEN dw > 0 AND dw > uw + 1e-9 THEN 'down' END AS majority, coalesce(g.rn, 0) AS rn FROM pg LEFT JOIN (SELECT slice AS regime, max(n) AS rn FROM rep GROUP BY 1) g USING (regime)),
  pi AS (SELECT *, CASE WHEN majority IS NOT NULL THEN round(greatest(uw, dw), 4) ELSE 0 END AS eff, CASE majority WHEN 'up' THEN uv WHEN 'down' THEN dv ELSE 0 END AS agreeing FROM ph), pj AS (SELECT *, CASE WHEN uw + dw > 0 THEN round(eff / round(uw + dw, 4), 4) ELSE 0 END AS consensus, votes - agreeing AS dissent FROM pi),
  pk AS (SELECT *, dissent > 0 AND consensus < 0.7 AS split, CASE WHEN weight <= 0 OR best <= 0 THEN 0 ELSE greatest(0, least(1, 0.4 + least(0.6, best / 0.05 * 0.6))) END AS f1, CASE WHEN NOT rec THEN 0 WHEN NOT inr THEN 0.45 ELSE greatest(0, least(1, 0.7 + least(0.3, greatest(0, better) / 0.02 * 0.3))) END AS f2,
    CASE WHEN eff <= 0 THEN 0 ELSE greatest(0, least(1, consensus * least(1, eff / greatest(1, members * 0.5)))) END AS f3, quality AS f4, least(1, ns / 400) AS f5, least(1, rn / 100) AS f6 FROM pj),
  pl AS (SELECT *, round(least(0.85, f1 * f2 * f3 * f5 * f6) * f4, 4) AS value, CASE least(f1, f2, f3, f4, f5, f6) WHEN f1 THEN 'skill' WHEN f2 THEN 'calibration' WHEN f3 THEN 'agreement' WHEN f4 THEN 'data_quality' WHEN f5 THEN 'sample' ELSE 'regime_familiarity' END AS limited_by FROM pk),
  pm AS (SELECT *, weight > 0 AND NOT split AND value >= 0.35 AS open, CASE WHEN weight <= 0 THEN 'no member has demonstrated skill' WHEN split THEN 'models disagree' WHEN value < 0.35 THEN 'confidence below the floor, limited by ' || limited_by END AS reason FROM pl),
  po AS (SELECT *, CASE WHEN open THEN su / weight ELSE 1 / 3.0 END AS pu, CASE WHEN open THEN sf / weight ELSE 1 / 3.0 END AS pf, CASE WHEN open THEN sd / weight ELSE 1 / 3.0 END AS pd FROM pm), pp AS (SELECT *, open AND abs(pu - pd) >= 0.08 AS published FROM po)"""


def independence(spark):
    """How much each model counts by what it shares with the others; one row a model."""
    return s.independence_table(spark.createDataFrame([(n, x) for n in MODELS for x in m.INPUTS[n]], "model string, input string"))


def _panel(spark, sf):
    f = stored(forecasts(spark, sf))  # weights, records and the panel itself read it
    weights = s.skill_weights(e.against_baseline(e.scored(f)))
    return s.panel(f, weights, s.calibration_records(f), independence(spark))


@query(
    "panel_members",
    f"""WITH {_PANEL}, a AS (SELECT asset, as_of, list(sv.model || ':' || printf('%.6f', share) ORDER BY share DESC, sv.model) FILTER (share IS NOT NULL) AS ev, list(sv.model ORDER BY sv.model) FILTER (vote IS NULL) AS ab FROM sv GROUP BY 1, 2),
    d AS (SELECT pp.asset, pp.as_of, list(sv.model ORDER BY sv.model) FILTER (vote IS NOT NULL AND (majority IS NULL OR vote <> majority)) AS di FROM pp JOIN sv ON sv.asset = pp.asset AND sv.as_of = pp.as_of GROUP BY 1, 2)
    SELECT pp.asset, pp.as_of, CASE WHEN open THEN coalesce(array_to_string(ev[1:5], ','), '') END AS evidence, coalesce(array_to_string(di[1:4], ','), '') AS dissenters, coalesce(array_to_string(ab[1:6], ','), '') AS abstainers FROM pp JOIN a USING (asset, as_of) JOIN d USING (asset, as_of)""",
)
def panel_members(spark, sf):
    """Which models carry a point, which speak against it and which are silent."""
    out = _panel(spark, sf)
    evidence = F.array_join(F.transform("evidence", lambda x: F.format_string("%s:%.6f", x["model"], x["weight"])), ",")
    return out.select("asset", "as_of", evidence.alias("evidence"), F.array_join("dissenters", ",").alias("dissenters"), F.array_join("abstainers", ",").alias("abstainers"))


@query(
    "ensemble_panel",
    f"""WITH {_PANEL} SELECT asset, as_of, members, votes, majority, round(consensus, 4) AS consensus, split, round(weight, 6) AS weight, floor(value * 100 + 0.25) / 100 AS value, limited_by, round(pu, 4) AS up, round(pf, 4) AS flat, round(pd, 4) AS down, published, reason,
      CASE WHEN open THEN CASE WHEN pu >= pf AND pu >= pd THEN printf('price crossing %.2f', close * (1 - 1.0 / 100)) WHEN pf >= pd THEN 'a close beyond 1.00% against flat' ELSE printf('price crossing %.2f', close * (1 + 1.0 / 100)) END END AS invalid_if FROM pp""",
)
def ensemble_panel(spark, sf):
    out = _panel(spark, sf)
    cols = ("asset", "as_of", "members", "votes", "majority", "consensus", "split", "weight", (F.floor(F.col("value") * 100 + 0.25) / 100).alias("value"), "limited_by", *(F.round(f"p.{k}", 4).alias(k) for k in ("up", "flat", "down")), "published", F.get("suppressed_because", 0).alias("reason"), F.get("invalidation", 0).alias("invalid_if"))
    return rounded(out.select(*cols))


_CHECKS = {
    "panel size": "members >= 8", "families agreeing": "agreeing >= 6", "independent agreement": "eff >= 6", "no material dissent": "NOT split AND consensus >= 0.75", "calibrated in this regime": "CASE WHEN contributors > 0 THEN rs ELSE rv END >= 6",
    "demonstrated skill": "contributors > 0", "confidence": "value >= 0.65", "data quality": "quality >= 0.85", "ensemble published": "published",
}


@query("gate_conditions", f"WITH {_PANEL} SELECT asset, as_of, x.name AS name, x.passed AS passed FROM (SELECT asset, as_of, unnest([{', '.join(f'{{{{{chr(39)}name{chr(39)}: {chr(39)}{n}{chr(39)}, {chr(39)}passed{chr(39)}: {c}}}}}' for n, c in _CHECKS.items())}]) AS x FROM pp)".replace("{{", "{").replace("}}", "}"))
def gate_conditions(spark, sf):
    return s.gate(_panel(spark, sf)).select("asset", "as_of", F.inline("checks"))


@query("responses", f"WITH {_PANEL} SELECT asset, as_of, CASE WHEN published THEN 'call' ELSE 'insufficient evidence' END AS form, CASE WHEN published THEN CASE WHEN pu >= pf AND pu >= pd THEN 'up' WHEN pf >= pd THEN 'flat' ELSE 'down' END END AS direction, CASE WHEN NOT published THEN coalesce(reason, 'below threshold') END AS reason FROM pp")
def responses(spark, sf):
    return s.response(_panel(spark, sf)).select("asset", "as_of", "form", "call.direction", "reason")


@query(
    "learning_verdict",
    f"WITH {_WEIGHTS}, k AS (SELECT count(*) FILTER (weight > 0) AS w FROM w4), o AS (SELECT count(*) AS n FROM sc) SELECT n AS outcomes, w AS weights, CASE WHEN n < 60 THEN 'no evidence' WHEN w > 0 THEN 'learned' ELSE 'learned nothing' END AS verdict FROM k, o",
)
def learning_verdict(spark, sf):
    f = scored(spark, sf)
    w = e.learned_weights(f).agg(F.count(F.when(F.col("weight") > 0, 1)).alias("weights"))
    out = f.agg(F.count("*").alias("outcomes")).join(F.broadcast(w))  # one row each
    return out.withColumn("verdict", e.verdict(F.col("outcomes"), F.col("weights")))
