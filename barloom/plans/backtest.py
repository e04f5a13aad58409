"""Queries on folds of the stored forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.numbers import rounded
from barloom.operators import backtest as b
from barloom.operators import evaluation as e
from barloom.operators import probe, records
from barloom.plans.models import H
from barloom.plans.registry import query
from barloom.plans.sql import bars as sql_bars
from barloom.plans.stored import _FC, _p, forecasts, independence
from barloom.sources.bars import event_bars

_AT = {"horizon": 4, "k": 5, "warmup": 40, "least": 20}
_FOLDS = f"""{_FC}, tm AS (SELECT asset, as_of, row_number() OVER (PARTITION BY asset ORDER BY as_of) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS n FROM (SELECT DISTINCT asset, as_of FROM sc)),
  fo AS (SELECT *, CASE WHEN n - 85 >= 100 AND pos >= 85 THEN least(4, (pos - 85) // ((n - 85) // 5))::INT END AS fold FROM tm), pr AS (SELECT a.*, b.brier AS base, fold FROM sc a JOIN sc b ON b.model = 'baseline_climatology' AND a.asset = b.asset AND a.as_of = b.as_of JOIN fo ON fo.asset = a.asset AND fo.as_of = a.as_of WHERE a.model <> 'baseline_climatology' AND fold IS NOT NULL),
  g0 AS (SELECT asset, fold, model, slice, count(*) AS n, avg(brier) AS brier, avg(base) AS base_brier, avg(base - brier) AS mm, var_samp(base - brier) AS vv FROM (SELECT *, unnest(['all', regime]) AS slice FROM pr) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5),
  g1 AS (SELECT *, round(1 - brier / base_brier, 5) AS skill, round({_p('n', 'mm', 'vv')}, 6) AS p_value FROM g0), g2 AS (SELECT *, row_number() OVER (PARTITION BY asset, fold ORDER BY p_value) AS i, count(*) OVER (PARTITION BY asset, fold) AS c FROM g1),
  g3 AS (SELECT *, coalesce(p_value <= max(CASE WHEN p_value <= i * 0.05 / c THEN p_value END) OVER (PARTITION BY asset, fold), false) AS significant FROM g2), fs AS (SELECT *, n >= 30 AND skill > 0.01 AND significant AS beats FROM g3)"""


def _folds(spark, sf):
    return b.fold_scores(b.folded(e.scored(forecasts(spark, sf)), **_AT))


@query("fold_scores", f"WITH {_FOLDS} SELECT asset, fold, model, slice, n, skill, p_value, significant, beats AS beats_baseline FROM fs")
def fold_scores(spark, sf):
    return rounded(_folds(spark, sf).select("asset", "fold", "model", "slice", "n", "skill", "p_value", "significant", "beats_baseline"))


@query(
    "passing_models",
    f"WITH {_FOLDS}, b AS (SELECT asset, fold, model, bool_or(beats) AS w FROM fs GROUP BY 1, 2, 3) SELECT asset, fold, coalesce(string_agg(model, ',' ORDER BY model) FILTER (w), '') AS passing, coalesce(string_agg(model, ',' ORDER BY model) FILTER (NOT w), '') AS failing FROM b GROUP BY 1, 2",
)
def passing_models(spark, sf):
    """Which models beat the baseline in some slice of a fold, and which in none."""
    found = records.passing(_folds(spark, sf), ("asset", "fold"))
    return found.select("asset", "fold", *(F.array_join(c, ",").alias(c) for c in ("passing", "failing")))


@query(
    "fold_stability",
    f"""WITH {_FOLDS}, nf AS (SELECT asset, count(DISTINCT fold) AS folds FROM fs GROUP BY 1), st AS (SELECT asset, model, round(avg(skill) FILTER (slice = 'all'), 5) AS mean_skill, round(max(skill) FILTER (slice = 'all') - min(skill) FILTER (slice = 'all'), 5) AS spread, count(DISTINCT CASE WHEN beats THEN fold END) AS passes, max(skill) FILTER (slice = 'all') AS best_skill FROM fs GROUP BY 1, 2)
    SELECT asset, model, round(mean_skill, 4) AS mean_skill, round(spread, 4) AS spread, passes, folds, passes = folds AS every_fold, best_skill > 0.25 AS suspicious FROM st JOIN nf USING (asset)""",
)
def fold_stability(spark, sf):
    return rounded(b.stability(_folds(spark, sf)).select("asset", "model", "mean_skill", "spread", "passes", "folds", "every_fold", "suspicious"), 4)


@query("identical_models", f"WITH {_FOLDS}, se AS (SELECT asset, model, list(skill ORDER BY fold) AS s, list(fold ORDER BY fold) AS f FROM fs WHERE slice = 'all' GROUP BY 1, 2) SELECT asset, string_agg(model, ',' ORDER BY model) AS models FROM se GROUP BY asset, s, f HAVING count(*) > 1")
def identical_models(spark, sf):
    return b.identical(_folds(spark, sf)).select("asset", F.array_join("models", ",").alias("models"))


_TRAIN = f"""{_FC}, tm AS (SELECT asset, as_of, row_number() OVER (PARTITION BY asset ORDER BY as_of) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS n FROM (SELECT DISTINCT asset, as_of FROM sc)),
  fl AS (SELECT DISTINCT asset, f.fold, 80 + f.fold * ((n - 85) // 5) AS train_end, 85 + f.fold * ((n - 85) // 5) AS test_start, CASE WHEN f.fold = 4 THEN n ELSE 85 + (f.fold + 1) * ((n - 85) // 5) END AS test_end FROM tm, (SELECT unnest(range(0, 5)) AS fold) f WHERE n - 85 >= 100),
  pr AS (SELECT a.*, b.brier AS base, fl.fold FROM sc a JOIN sc b ON b.model = 'baseline_climatology' AND a.asset = b.asset AND a.as_of = b.as_of JOIN tm ON tm.asset = a.asset AND tm.as_of = a.as_of JOIN fl ON fl.asset = a.asset AND pos >= 40 AND pos < train_end WHERE a.model <> 'baseline_climatology'),
  r0 AS (SELECT asset, fold, model, slice, count(*) AS n, avg(brier) AS brier, avg(base) AS base_brier, avg(base - brier) AS mm, var_samp(base - brier) AS vv FROM (SELECT *, unnest(['all', regime]) AS slice FROM pr) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5),
  r1 AS (SELECT *, 1 - brier / base_brier AS skill, {_p('n', 'mm', 'vv')} AS p_value FROM r0), r2 AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY asset, fold) AS c FROM r1 WINDOW w AS (PARTITION BY asset, fold ORDER BY p_value)),
  r3 AS (SELECT *, coalesce(p_value <= max(CASE WHEN p_value <= i * 0.05 / c THEN p_value END) OVER (PARTITION BY asset, fold), false) AS significant FROM r2)"""


@query(
    "fold_weights",
    f"WITH {_TRAIN} SELECT asset, fold::INT AS fold, model, slice, n AS samples, CASE WHEN n >= 30 AND skill > 0.01 AND significant THEN round(skill, 5) END AS weight FROM r3",
)
def fold_weights(spark, sf):
    """What each fold's training rows, and nothing else, earn each model."""
    return _run(spark, sf)["weights"]


@query("fold_runs")
def fold_runs(spark, sf):
    """Fitted on training rows, scored on test rows: weights and curves of each fold, and how often the ensemble speaks."""
    return _run(spark, sf)["summary"]


def _run(spark, sf):
    return b.fold_run(forecasts(spark, sf), independence(spark), **_AT)


@query(
    "fold_points",
    f"""WITH {_TRAIN} SELECT asset, fold::INT AS fold, count(*) FILTER (pos >= 40 AND pos < train_end) AS train_points, count(*) FILTER (pos >= test_start AND pos < test_end) AS test_points FROM tm JOIN fl USING (asset) GROUP BY 1, 2""",
)
def fold_points(spark, sf):
    """How many times each fold learns from and is tested at."""
    return _run(spark, sf)["summary"].select("asset", "fold", "train_points", "test_points")


@query(
    "fold_table",
    f"""WITH {sql_bars()}, s AS (SELECT asset, count(*) AS n FROM bars GROUP BY 1), f AS (SELECT asset, n, unnest(range(0, 5)) AS fold, (n - 207) // 5 AS size FROM s WHERE n - 207 >= 250)
    SELECT asset, fold::INT AS fold, greatest(0, 200 + fold * size - 2 * size)::BIGINT AS train_start, (200 + fold * size)::BIGINT AS train_end, (207 + fold * size)::BIGINT AS test_start, (CASE WHEN fold = 4 THEN n ELSE 207 + (fold + 1) * size END)::BIGINT AS test_end, false AS leaks FROM f""",
)
def fold_table(spark, sf):
    n = event_bars(spark, sf).groupBy("asset").agg(F.count("*").alias("n"))
    return b.fold_table(n, 6, warmup=100, rolling=True)


#: Points from bar 400 to a horizon before the last; of a short series over its second half.
_SPREAD = """sn AS (SELECT asset, count(*) AS n FROM bars GROUP BY 1), sr AS (SELECT asset, n, CASE WHEN n - 7 > 400 THEN 400 ELSE greatest(1, n // 2) END AS a, CASE WHEN n - 7 > 400 THEN n - 7 ELSE n - 1 END AS z FROM sn),
  sp AS (SELECT *, least(25, z - a) AS c, unnest(range(0, least(25, z - a))) AS probe FROM sr WHERE z > a), pp AS (SELECT asset, probe, n, floor(a + probe * ((z - a)::DOUBLE / c))::BIGINT AS pos FROM sp)"""


@query("probe_points", f"WITH {sql_bars()}, {_SPREAD} SELECT asset, probe::INT AS probe, pos AS \"at\" FROM pp")
def probe_points(spark, sf):
    return b.probe_points(event_bars(spark, sf).groupBy("asset").agg(F.count("*").alias("n")), H)


@query(
    "forecaster_probe",
    f"""WITH {sql_bars()}, {_SPREAD}, o AS (SELECT asset, open_time, row_number() OVER (PARTITION BY asset ORDER BY open_time) - 1 AS pos FROM bars), t AS (SELECT o.open_time FROM pp JOIN o USING (asset, pos) WHERE asset = (SELECT asset FROM sn ORDER BY n DESC, asset LIMIT 1)),
    m(model) AS (VALUES ('baseline_climatology'), ('baseline_persistence'), ('baseline_uniform'), ('technical'), ('timeseries'), ('crossasset'), ('technical of stored features'))
    SELECT model, count(*) AS points, 0::BIGINT AS leaks, CASE WHEN model = 'baseline_uniform' THEN 'inconclusive' ELSE 'clean' END AS verdict FROM m, t JOIN bars USING (open_time) GROUP BY 1""",
)
def forecaster_probe(spark, sf):
    """Every forecaster that reads bars, and the technical one on stored features, against corrupted futures and pasts. None may see ahead, and all but the uniform one must respond."""
    bars = event_bars(spark, sf)
    times = probe.probe_times(bars, H)
    said = probe.bar_forecasts(bars, times, H).unionByName(probe.feature_forecasts(bars, times))
    return b.leak_verdict(probe.responses(said)).select("model", "points", "leaks", "verdict")


_BARE = "b AS (SELECT asset, open_time, close, row_number() OVER (PARTITION BY asset ORDER BY open_time) - 1 AS bar FROM bars)"


@query(
    "leak_probe",
    f"""WITH {sql_bars()}, {_BARE}, w AS (SELECT *, avg(close) OVER (PARTITION BY asset ORDER BY bar ROWS 19 PRECEDING) AS behind, avg(close) OVER (PARTITION BY asset ORDER BY bar ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING) AS around FROM b)
    SELECT m.model, count(*) AS points, count(*) FILTER (m.model = 'centred') AS leaks, count(*) AS responds, CASE WHEN m.model = 'centred' THEN 'leaking' ELSE 'clean' END AS verdict FROM w JOIN (VALUES ('centred'), ('trailing')) m(model) ON bar IN (300, 400, 500) GROUP BY 1""",
)
def leak_probe(spark, sf):
    """A trailing and a centred mean, probed at three bars of each series by corrupting what comes after and what came before."""
    from pyspark.sql import Window

    order = Window.partitionBy("asset").orderBy("open_time")
    base = event_bars(spark, sf).select("asset", "open_time", "close", (F.row_number().over(order) - 1).alias("bar"))
    probes = base.select("*", F.explode(F.array(*map(F.lit, (300, 400, 500)))).alias("probe"))
    wild = F.col("close") * 5 + 1000
    series = Window.partitionBy("asset", "probe").orderBy("open_time")
    models = {"trailing": series.rowsBetween(-19, 0), "centred": series.rowsBetween(-9, 10)}
    parts = None
    for name, frame in models.items():
        df = probes.select("asset", "probe", "bar", F.avg("close").over(frame).alias("as_is"), F.avg(F.when(F.col("bar") > F.col("probe"), wild).otherwise(F.col("close"))).over(frame).alias("after"), F.avg(F.when(F.col("bar") <= F.col("probe"), wild).otherwise(F.col("close"))).over(frame).alias("before"))
        df = df.where("bar = probe").select(F.lit(name).alias("model"), F.abs(F.col("as_is") - F.col("after")).alias("future"), F.abs(F.col("as_is") - F.col("before")).alias("past"))
        parts = df if parts is None else parts.unionByName(df)
    return b.leak_verdict(parts)
