"""Walk-forward folds: purged and embargoed tests, per-fold skill, and what it takes to believe it.

A fold is a number that a row's position in its series gives; nothing is looped over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.evaluation import BASELINE, paired_p
from barloom.operators.patterns import benjamini_hochberg
from barloom.sources.tables import stored

#: Fixed value: a skill over climatology that no sound model has.
IMPLAUSIBLE = 0.25


def fold_table(series: DataFrame, horizon: int, k: int = 5, warmup: int = 400, least: int = 50, rolling: bool = False, key: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Of series (key, n) the k folds as half-open position ranges: trained before, purged by the horizon and embargoed by a quarter of it, tested after; leaks says whether that holds."""
    gap = horizon + horizon // 4
    usable = F.col("n") - 2 * warmup - gap
    rows = series.where(usable >= k * least).withColumn("_size", F.floor(usable / k).cast("int")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = 2 * warmup + gap + F.col("fold") * F.col("_size")
    end = F.when(F.col("fold") == k - 1, F.col("n")).otherwise(start + F.col("_size"))
    stop = start - gap
    first = F.greatest(F.lit(0), stop - 2 * F.col("_size")) if rolling else F.lit(0)
    out = rows.select(*key, "fold", *(x.cast("long").alias(n) for n, x in (("train_start", first), ("train_end", stop), ("test_start", start), ("test_end", end))))
    return out.withColumn("leaks", (F.col("train_end") > F.col("test_start")) | (F.col("test_start") - F.col("train_end") < horizon))


def fold_of(at: Column, n: Column, horizon: int, k: int = 5, warmup: int = 400, least: int = 50) -> Column:
    """The fold that tests position `at` of a series of n, null where none does."""
    gap = horizon + horizon // 4
    usable = n - 2 * warmup - gap
    size = F.floor(usable / k)
    begun = at - (2 * warmup + gap)
    return F.when((usable >= k * least) & (begun >= 0), F.least(F.lit(k - 1), F.floor(begun / size)).cast("int"))


def folded(scores: DataFrame, horizon: int, k: int = 5, warmup: int = 400, least: int = 50, key: tuple[str, ...] = ("asset",)) -> DataFrame:
    """scores (key, as_of) with fold; positions are those of the series' different times."""
    times = scores.select(*key, "as_of").distinct()
    w = Window.partitionBy(*key)
    times = times.withColumn("_at", F.row_number().over(w.orderBy("as_of")) - 1).withColumn("_n", F.count("*").over(w))
    fold = fold_of(F.col("_at"), F.col("_n"), horizon, k, warmup, least)
    return scores.join(times.select(*key, "as_of", fold.alias("fold")), [*key, "as_of"]).where("fold IS NOT NULL")


def fold_scores(scores: DataFrame, key: tuple[str, ...] = ("asset",), baseline: str = BASELINE, rate: float = 0.05) -> DataFrame:
    """Of each key, fold, model and slice (all, regime): n, skill, p, significance among the fold's tests, beats_baseline. scores has fold."""
    base = scores.where(F.col("model") == baseline).select(*key, "as_of", F.col("brier").alias("base_brier"))
    pairs = scores.where(F.col("model") != baseline).join(base, [*key, "as_of"]).withColumn("slice", F.explode(F.array(F.lit("all"), F.col("regime")))).withColumn("_d", F.col("base_brier") - F.col("brier"))
    g = pairs.groupBy(*key, "fold", "model", "slice").agg(F.count("*").alias("n"), F.avg("brier").alias("brier"), F.avg("base_brier").alias("base_brier"), F.avg("_d").alias("_m"), F.var_samp("_d").alias("_v")).where("n >= 5")
    g = g.withColumn("skill", F.round(F.when(F.col("base_brier") > 0, 1 - F.col("brier") / F.col("base_brier")).otherwise(0.0), 5)).withColumn("p_value", F.round(paired_p(F.col("n"), F.col("_m"), F.col("_v")), 6))
    g = benjamini_hochberg(g, "p_value", rate, (*key, "fold")).drop("_m", "_v")
    return g.withColumn("beats_baseline", (F.col("n") >= 30) & (F.col("skill") > 0.01) & F.col("significant"))


def fold_run(forecasts: DataFrame, independence: DataFrame, horizon: int, k: int = 5, warmup: int = 400, least: int = 50, rolling: bool = False, excluded: DataFrame | None = None) -> dict[str, DataFrame]:
    """Each fold of each asset by itself: weights and curves fitted on its training rows only, models and ensemble scored on its test rows.

    forecasts: POINT, model, regime, p, confidence, threshold, close, data_quality, truth. excluded has the models that leak.
    Gives weights (asset, fold, model, slice), records (the same), scores of the test rows, the ensemble's points, and a summary
    (asset, fold). A training row belongs to as many folds as train on it, so all folds are one plan.
    """
    from barloom.operators import ensemble
    from barloom.operators.evaluation import SCOPE, against_baseline, scored

    rows = scored(forecasts if excluded is None else forecasts.join(excluded.select("model"), "model", "left_anti"))
    by, w = ("asset", "fold"), Window.partitionBy("asset")
    times = rows.select("asset", "as_of").distinct().withColumn("_at", F.row_number().over(w.orderBy("as_of")) - 1)
    folds = fold_table(times.groupBy("asset").agg(F.count("*").alias("n")), horizon, k, warmup, least, rolling)
    placed = stored(rows.join(times, ["asset", "as_of"]).join(folds, "asset"))  # read by every fit and score below
    train = placed.where((F.col("_at") >= F.greatest(F.col("train_start"), F.lit(warmup))) & (F.col("_at") < F.col("train_end"))).select(*rows.columns, "fold")
    test = placed.where((F.col("_at") >= F.col("test_start")) & (F.col("_at") < F.col("test_end"))).select(*rows.columns, "fold")
    on = (*SCOPE, "as_of", "fold")
    weights = stored(ensemble.skill_weights(against_baseline(train, on=on, key=by), by))
    records = stored(ensemble.calibration_records(train, by=by))
    points = stored(ensemble.panel(test, weights, records, independence, by=by))
    count = lambda df, name: df.groupBy(*by).agg(F.countDistinct("as_of").alias(name))
    earned = weights.where("weight > 0").groupBy(*by).agg(F.countDistinct("model").alias("skilled"))
    fits = records.groupBy(*by).agg(F.count(F.when(F.col("holdout") > 0, 1)).alias("fitted"), F.count(F.when(F.col("improved"), 1)).alias("usable"))
    said = points.groupBy(*by).agg(F.count(F.when(F.col("published"), 1)).alias("published"), F.count(F.when(F.col("factors.calibration") == 0, 1)).alias("_not"))
    out = folds.select(*by)
    for part in (count(train, "train_points"), count(test, "test_points"), earned, fits, said):
        out = out.join(part, list(by), "left")
    names = ("train_points", "test_points", "skilled", "fitted", "usable", "published")
    out = out.select(*by, *(F.coalesce(n, F.lit(0)).alias(n) for n in names), F.when(F.coalesce("usable", F.lit(0)) > 0, F.coalesce("_not", F.lit(0))).otherwise(0).alias("not_applicable"))
    return {"weights": weights, "records": records, "scores": against_baseline(test, on=on, key=by), "points": points, "summary": out}


def stability(folds: DataFrame, key: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Of each model over a key's folds: mean and spread of the pooled skill, in how many folds it passes in some slice, whether in every one, and whether its best skill is implausible."""
    n = folds.groupBy(*key).agg(F.countDistinct("fold").alias("folds"))
    pooled = F.when(F.col("slice") == "all", F.col("skill"))
    g = folds.groupBy(*key, "model").agg(F.round(F.avg(pooled), 5).alias("mean_skill"), F.round(F.max(pooled) - F.min(pooled), 5).alias("spread"), F.countDistinct(F.when(F.col("beats_baseline"), F.col("fold"))).alias("passes"), F.max(pooled).alias("best_skill"))
    return g.join(n, list(key)).withColumn("every_fold", F.col("passes") == F.col("folds")).withColumn("suspicious", F.col("best_skill") > IMPLAUSIBLE)


def identical(folds: DataFrame, key: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Groups of models whose pooled skill is the same in every fold: not so many independent results."""
    series = folds.where("slice = 'all'").groupBy(*key, "model").agg(F.array_sort(F.collect_list(F.struct("fold", "skill"))).alias("_s"))
    return series.groupBy(*key, "_s").agg(F.array_sort(F.collect_list("model")).alias("models")).where(F.size("models") > 1).drop("_s")


def probe_points(series: DataFrame, horizon: int, most: int = 25, warmup: int = 400, key: tuple[str, ...] = ("asset",)) -> DataFrame:
    """At most `most` positions (key, probe, at) of series (key, n) at which look-ahead is probed: spread evenly from the warm-up to a horizon before the last bar.

    A series that is too short for that is probed over its second half.
    """
    whole = F.col("n") - horizon - 1 > warmup
    df = series.withColumn("_from", F.when(whole, warmup).otherwise(F.greatest(F.lit(1), F.floor(F.col("n") / 2)))).withColumn("_to", F.when(whole, F.col("n") - horizon - 1).otherwise(F.col("n") - 1))
    df = df.where("_to > _from").withColumn("_c", F.least(F.lit(most), F.col("_to") - F.col("_from")))
    df = df.select(*key, "_from", ((F.col("_to") - F.col("_from")) / F.col("_c")).alias("_step"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c").cast("long") - 1)).alias("probe"))
    return df.select(*key, F.col("probe").cast("int").alias("probe"), F.floor(F.col("_from") + F.col("probe") * F.col("_step")).alias("at"))


def prediction_distance(a: Column, b: Column, confidence_a: Column, confidence_b: Column) -> Column:
    """How far two forecasts are apart: the sum over probabilities and confidence."""
    return sum((F.abs(a[k] - b[k]) for k in ("up", "flat", "down")), F.abs(confidence_a - confidence_b))


def leak_verdict(responses: DataFrame, key: tuple[str, ...] = ("model",), tolerance: float = 1e-9) -> DataFrame:
    """Of responses (key, future, past: distance of a forecast when the bars after or before its point are corrupted): leaking if a future moved one, inconclusive if no past did, else clean."""
    g = responses.groupBy(*key).agg(F.count("*").alias("points"), F.count(F.when(F.col("future") > tolerance, 1)).alias("leaks"), F.count(F.when(F.col("past") > tolerance, 1)).alias("responds"))
    return g.withColumn("verdict", F.when(F.col("leaks") > 0, "leaking").when(F.col("responds") == 0, "inconclusive").otherwise("clean"))
