"""Historical analogues: the earlier bars whose features are closest to a given one.

The bars asked about are gathered in blocks of a series; a block and the series' bars
up to its end are one Arrow group, in which each question sees its own past only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numbers import two_proportion_p, wilson

#: The features that are compared.
FEATURES = ("rsi_14", "bb_percent_b", "bb_bandwidth", "adx", "plus_di", "minus_di", "atr_pct", "roc_10", "stoch_k", "realised_vol_20", "vwap_distance_pct")
KEY = ("asset", "source", "timeframe")
CEILING, TOP, FRACTION = 1.5, 200, 0.85
LEAST_PAST, LEAST_VALUES = 20, 30
#: Bars of a series whose questions are one group.
BLOCK = 2_000


def _searched(names: tuple[str, ...], horizon: int, ceiling: float | None, top: int, key: tuple[str, ...]):
    columns = [*key, "asked", "bar", "rank", "distance", "move_pct"]

    def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(((x - y) ** 2).mean(axis=-1))

    def run(asked: pd.DataFrame, series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("bar", ignore_index=True)
        bar, close = series["bar"].to_numpy(np.int64), series["close"].to_numpy(np.float64)
        x = series[list(names)].to_numpy(np.float64)
        later = np.append(close[horizon:], np.full(min(horizon, len(close)), np.nan))
        out = []
        for q in sorted(asked["bar"]):
            at, end = np.searchsorted(bar, [q, q - horizon])
            if end < LEAST_PAST or at == len(bar) or bar[at] != q:
                continue
            past = x[:end]
            enough = np.flatnonzero((~np.isnan(past)).sum(axis=0) >= LEAST_VALUES)
            centre = np.array([np.nanmedian(past[:, i]) for i in enough])
            spread = np.array([np.nanmedian(np.abs(past[:, i] - c)) * 1.4826 for i, c in zip(enough, centre, strict=True)])
            used = spread > 0
            enough, centre, spread = enough[used], centre[used], spread[used]
            asked_v = (x[at, enough] - centre) / spread
            if not len(enough) or np.isnan(asked_v).any():
                continue
            v = (past[:, enough] - centre) / spread
            whole = np.flatnonzero(~np.isnan(v).any(axis=1))
            v, most = v[whole], ceiling
            if most is None:
                some = v[:: max(1, len(v) // 200)]
                some = some[: len(some) // 2 * 2]
                most = CEILING if len(v) < 50 else min(CEILING, FRACTION * float(distance(some[::2], some[1::2]).mean()))
            d = distance(v, asked_v)
            near = np.flatnonzero(d <= most)
            near = near[np.argsort(d[near], kind="stable")][:top]
            near = near[close[whole[near]] > 0]
            own = whole[near]
            got = pd.DataFrame({"asked": q, "bar": bar[own], "rank": np.arange(1, len(own) + 1), "distance": d[near], "move_pct": (later[own] - close[own]) / close[own] * 100})
            for k in key:
                got[k] = asked[k].iloc[0]
            out.append(got[columns])
        return pd.concat(out) if out else pd.DataFrame(columns=columns)

    return run


def analogues(features: DataFrame, questions: DataFrame, horizon: int, names: tuple[str, ...] = FEATURES, ceiling: float | None = None, top: int = TOP, key=KEY) -> DataFrame:
    """Of each question (key, bar): the closest earlier bars whose outcomes are known before it, with distance and move_pct.

    features has key, bar, close and the named columns. Centre and scale are median and MAD of the question's past; a feature with fewer
    than LEAST_VALUES values there or without spread is left out, a bar that misses one of the others too. Distance is the root mean square
    over the features. The ceiling, unless one is given, is FRACTION of the mean distance of pairs a stride apart in that past, at most CEILING.
    """
    block = F.floor(F.col("bar") / BLOCK).alias("block")
    asked = questions.select(*key, F.col("bar").cast("long").alias("bar"), block).distinct()
    last = asked.groupBy(*key, "block").agg(F.max("bar").alias("last"))
    series = features.select(*key, F.col("bar").cast("long").alias("bar"), F.col("close").cast("double").alias("close"), *(F.col(n).cast("double").alias(n) for n in names))
    series = series.join(last, list(key)).where(F.col("bar") <= F.col("last")).drop("last")
    series = series.toDF(*series.columns)  # new columns, as both sides of the groups may come from features
    schema = ", ".join(f"`{k}` {features.schema[k].dataType.simpleString()}" for k in key) + ", asked long, bar long, rank int, distance double, move_pct double"
    by = [*key, "block"]
    return asked.groupBy(*by).cogroup(series.groupBy(*by)).applyInPandas(_searched(tuple(names), horizon, ceiling, top, tuple(key)), schema)


def verdicts(found: DataFrame, bars: DataFrame, horizon: int, least: int = 20, key=KEY) -> DataFrame:
    """Of each question: analogues, their up-rate with interval, the rate of the non-overlapping windows that ended before the analogues' limit, p, informative."""
    from barloom.operators.patterns import outcomes

    up = F.col("move_pct") > 0
    so_far = Window.partitionBy(*key).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    base = outcomes(bars, horizon, key).where(F.col("bar") % horizon == 0)
    base = base.select(*key, F.col("bar").cast("long").alias("_at"), F.count("move_pct").over(so_far).alias("base_n"), F.count(F.when(up, 1)).over(so_far).alias("base_up"))
    g = found.groupBy(*key, "asked").agg(F.count("*").alias("n"), F.count(F.when(up, 1)).alias("up"), F.avg("move_pct").alias("mean_move_pct"), F.avg("distance").alias("mean_distance"))
    g = g.withColumn("_at", (F.floor((F.col("asked") - 2 * horizon - 1) / horizon) * horizon).cast("long")).join(base, [*key, "_at"], "left").fillna(0, ["base_n", "base_up"])
    g = g.withColumn("_i", wilson(F.col("up"), F.col("n"))).withColumn("p_value", F.when(F.col("base_n") > 0, two_proportion_p(F.col("up"), F.col("n"), F.col("base_up"), F.nullif(F.col("base_n"), F.lit(0)))).otherwise(1.0))
    rate, own = F.col("up") / F.col("n"), F.when(F.col("base_n") > 0, F.col("base_up") / F.col("base_n"))
    apart = (F.col("_i.low") > own) | (F.col("_i.high") < own)
    return g.select(*key, "asked", "n", rate.alias("up_rate"), F.col("_i.low").alias("low"), F.col("_i.high").alias("high"), own.alias("base_rate"), "p_value", "mean_move_pct", "mean_distance", ((F.col("n") >= least) & (F.col("p_value") < 0.05) & F.coalesce(apart, F.lit(False))).alias("informative"))
