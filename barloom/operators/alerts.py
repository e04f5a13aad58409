"""Alerts: rules over frames, and admission within a rate budget.

A rule is an expression over a series' own past and gives alert rows. The budget is a
fold over one recipient's alerts in time order, which its own limits keep short; the
same step runs in batch and as a stream's state.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.numbers import mad_scale
from barloom.operators.records import directional_faults

KEY = ("asset", "source", "timeframe")
#: Severities, their default by kind, and the budget's limits.
LEVELS = {"info": 10, "notice": 20, "warning": 30, "critical": 40}
SEVERITY = {
    "volume_anomaly": 20, "volatility_expansion": 20, "volatility_compression": 10, "regime_change": 30, "correlation_breakdown": 20, "liquidation_event": 30,
    "data_quality": 30, "model_disagreement": 10, "major_news": 30, "prediction_invalidated": 30, "strong_prediction": 30, "super_prediction": 40, "suppression_digest": 10,
}
LIMITS = {"per_hour": 6, "per_day": 30, "cooldown_h": 4, "repeat_h": 12, "reserve_hour": 2, "reserve_day": 8, "digest_h": 6}
ALERT = "asset string, timeframe string, at timestamp_ntz, kind string, level int, title string, value double"
ALERT_COLUMNS = ("asset", "timeframe", "at", "kind", "level", "title", "value")


def _alert(df: DataFrame, when: Column, kind: Column | str, title: Column, value: Column, timeframe: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    k = F.lit(kind) if isinstance(kind, str) else kind
    levels = F.create_map(*(F.lit(x) for p in SEVERITY.items() for x in p))
    return df.where(when).select("asset", (F.lit(None).cast("string") if timeframe is None else timeframe).alias("timeframe"), F.col("at").cast("timestamp_ntz").alias("at"), k.alias("kind"), levels[k].alias("level"), title.alias("title"), value.cast("double").alias("value"), *(c for c in carry if c in df.columns))


def volume_rule(bars: DataFrame, threshold: float = 3.5, key=KEY) -> DataFrame:
    """A volume far above the median of up to 200 earlier ones, of at least 30 that are positive."""
    w = Window.partitionBy(*key).orderBy("open_time").rowsBetween(-200, -1)
    df = bars.where("volume > 0").withColumn("_v", F.collect_list("volume").over(w)).withColumn("_c", F.percentile("volume", F.lit(0.5)).over(w)).withColumnRenamed("open_time", "at")
    df = df.withColumn("_s", mad_scale(F.col("_v"), F.col("_c")))
    z = F.when((F.size("_v") >= 30) & (F.col("_s") > 0), (F.col("volume") - F.col("_c")) / F.col("_s"))
    return _alert(df.withColumn("z", z), F.col("z") >= threshold, "volume_anomaly", F.concat(F.lit("unusual volume in "), "asset"), F.col("z"), F.col("timeframe"))


def volatility_rule(bars: DataFrame, wide: float = 1.8, tight: float = 0.55, key=KEY) -> DataFrame:
    """The median true range of 14 bars against that of 100."""
    order = Window.partitionBy(*key).orderBy("open_time")
    last = F.lag("close").over(order)
    df = bars.withColumn("_t", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)))
    mid = lambda n: F.percentile("_t", F.lit(0.5)).over(order.rowsBetween(1 - n, 0))
    df = df.withColumn("_n", F.count("_t").over(order.rowsBetween(-99, 0))).withColumn("ratio", F.when(mid(100) > 0, mid(14) / mid(100))).withColumnRenamed("open_time", "at")
    kind = F.when(F.col("ratio") >= wide, "volatility_expansion").when(F.col("ratio") <= tight, "volatility_compression")
    return _alert(df.withColumn("_k", kind), (F.col("_n") >= 100) & F.col("_k").isNotNull(), F.col("_k"), F.concat(F.replace("_k", F.lit("_"), F.lit(" ")), F.lit(" in "), "asset"), F.col("ratio"), F.col("timeframe"))


def regime_rule(states: DataFrame, key=KEY) -> DataFrame:
    """states (key, at, regime): a label that differs from the one before."""
    before = F.lag("regime").over(Window.partitionBy(*key).orderBy("at"))
    df = states.withColumn("_b", before)
    return _alert(df, (F.col("_b") != F.col("regime")) & (F.col("regime") != "unknown") & (F.col("_b") != "unknown"), "regime_change", F.concat("asset", F.lit(": "), "_b", F.lit(" to "), "regime"), F.lit(None), F.col("timeframe"))


def correlation_rule(pairs: DataFrame, base: float = 0.5, drop: float = 0.35) -> DataFrame:
    """pairs (asset, peer, at, now, baseline): a high correlation that has gone."""
    title = F.format_string("correlation with %s fell %.2f to %.2f", F.col("peer"), F.col("baseline"), F.col("now"))
    return _alert(pairs, (F.col("baseline") >= base) & (F.col("baseline") - F.col("now") >= drop), "correlation_breakdown", title, F.col("baseline") - F.col("now"))


def rolling_pairs(returns: DataFrame, short: int = 24, long: int = 168) -> DataFrame:
    """pairs (asset, peer, at, now, baseline) of returns (asset, open_time, ret): each pair's correlation over its last `short` and `long` common times."""
    a = returns.where("ret IS NOT NULL").select("asset", F.col("open_time").alias("at"), F.col("ret").alias("x"))
    both = a.join(a.select(F.col("asset").alias("peer"), "at", F.col("x").alias("y")), "at").where("asset <> peer")
    order = Window.partitionBy("asset", "peer").orderBy("at")
    over = lambda n: F.corr("x", "y").over(order.rowsBetween(1 - n, 0))
    return both.select("asset", "peer", "at", over(short).alias("now"), over(long).alias("baseline"), F.row_number().over(order).alias("n")).where(F.col("n") >= long).drop("n")


def liquidation_rule(interest: DataFrame, drop_pct: float = 4.0, move_pct: float = 2.0) -> DataFrame:
    """interest (asset, at, open_interest, close), positive ones: open interest well below the peak of 24 points while the price moved over 6."""
    w = Window.partitionBy("asset").orderBy("at")
    df = interest.where("open_interest > 0 AND close > 0").withColumn("_n", F.row_number().over(w))
    peak, old = F.max("open_interest").over(w.rowsBetween(-23, 0)), F.first("close").over(w.rowsBetween(-5, 0))
    df = df.withColumn("_d", (peak - F.col("open_interest")) / peak * 100).withColumn("_m", F.abs(F.col("close") - old) / old * 100)
    return _alert(df, (F.col("_n") >= 6) & (F.col("_d") >= drop_pct) & (F.col("_m") >= move_pct), "liquidation_event", F.format_string("open interest fell %.1f%% during a %.1f%% move", F.col("_d"), F.col("_m")), F.col("_d"))


def quality_rule(scores: DataFrame, least: float = 0.7) -> DataFrame:
    return _alert(scores, F.col("score") < least, "data_quality", F.format_string("data quality degraded to %.2f", F.col("score")), F.col("score"))


def disagreement_rule(panel: DataFrame, voters: int = 4) -> DataFrame:
    return _alert(panel, F.col("split") & (F.col("votes") >= voters), "model_disagreement", F.format_string("models disagree (%.0f%% consensus)", F.col("consensus") * 100), F.col("consensus"))


def news_rule(events: DataFrame, least: float = 0.75) -> DataFrame:
    return _alert(events, F.col("importance") >= least, "major_news", F.substring("title", 1, 180), F.col("importance"))


def prediction_rules(panel: DataFrame) -> DataFrame:
    """panel (asset, at, published, passed, confidence, invalidation): strong predictions for what is published, and super-predictions where the gate passed too."""
    carry = ("confidence", "invalidation")
    strong = _alert(panel, F.col("published"), "strong_prediction", F.concat(F.lit("prediction for "), "asset"), F.lit(None), carry=carry)
    return strong.unionByName(_alert(panel, F.col("published") & F.coalesce("passed", F.lit(False)), "super_prediction", F.concat(F.lit("super prediction for "), "asset"), F.lit(None), carry=carry))


def invalidation_rule(open_calls: DataFrame) -> DataFrame:
    """open_calls (asset, at, close, direction, level): the price reached the level that a call named."""
    crossed = F.when(F.col("direction") == "up", F.col("close") <= F.col("level")).when(F.col("direction") == "down", F.col("close") >= F.col("level"))
    return _alert(open_calls, crossed & (F.col("close") > 0) & (F.col("level") > 0), "prediction_invalidated", F.concat(F.lit("a published "), "direction", F.lit(" call has been invalidated")), F.col("level"))


def dedup_key() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", "kind", "asset", F.coalesce("timeframe", F.lit("")), "title"), 256), 1, 16)


class Budget:
    """Admits alerts in time order: repeats, cooldown, hourly and daily limits with a reserve for critical ones."""

    def __init__(self, limits: dict | None = None, state: dict | None = None):
        self.limits = LIMITS | (limits or {})
        s = state or {}
        self.sent: list = list(s.get("sent", []))
        self.scopes: dict = dict(s.get("scopes", {}))
        self.keys: dict = dict(s.get("keys", {}))
        self.held: Counter = Counter(s.get("held", {}))
        self.kinds: Counter = Counter(s.get("kinds", {}))
        self.last_digest = s.get("last_digest")

    def state(self) -> dict:
        return {"sent": self.sent, "scopes": self.scopes, "keys": self.keys, "held": dict(self.held), "kinds": dict(self.kinds), "last_digest": self.last_digest}

    def admit(self, at: float, kind: str, asset: str, level: int, key: str) -> str:
        """Why the alert is held, or an empty text if it is sent. at: seconds."""
        m, hour = self.limits, 3600
        scope = f"{kind}|{asset}"
        self.sent = [x for x in self.sent if x[0] >= at - 24 * hour]
        for d, reach in ((self.scopes, m["cooldown_h"]), (self.keys, m["repeat_h"])):
            for k in [k for k, t in d.items() if at - t >= reach * hour]:
                del d[k]
        why = ""
        if key in self.keys:
            why = "duplicate"
        elif scope in self.scopes:
            why = "cooldown"
        else:
            for name, span, most, reserve in (("hourly", hour, m["per_hour"], m["reserve_hour"]), ("daily", 24 * hour, m["per_day"], m["reserve_day"])):
                inside = [x for x in self.sent if x[0] >= at - span]
                spare = level >= LEVELS["critical"] and sum(x[1] >= LEVELS["critical"] for x in inside) < reserve
                if len(inside) >= most and not spare:
                    why = name
                    break
        if why:
            self.held[why] += 1
            self.kinds[kind] += 1
        else:
            self.sent.append((at, level))
            self.scopes[scope] = self.keys[key] = at
        return why

    def digest(self, at: float) -> tuple[int, str] | None:
        """How many alerts were held since the last digest, and of what: at most one each digest_h hours. Sent whatever the budget, and counted by it."""
        if not self.held or (self.last_digest is not None and at - self.last_digest < self.limits["digest_h"] * 3600):
            return None
        most = lambda c, n: sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n]
        text = ", ".join(f"{n} {why}" for why, n in most(self.held, None)) + "; most held: " + ", ".join(f"{kind} x{n}" for kind, n in most(self.kinds, 5))
        total = sum(self.held.values())
        self.held, self.kinds, self.last_digest = Counter(), Counter(), at
        self.sent.append((at, LEVELS["info"]))
        return total, text

    def moment(self, at: float, alerts: list[tuple[str, str, int, str]]) -> tuple[list[str], tuple[int, str] | None]:
        """Why each of a moment's alerts (kind, asset, level, key), most severe first, is held, and the digest that is then due."""
        return [self.admit(at, *x) for x in alerts], self.digest(at)


def capacity(alerts: DataFrame, limits: dict | None = None) -> DataFrame:
    """Sent alerts (recipient, at, held) with what is left after each of them, of the last hour's and day's budgets."""
    m = LIMITS | (limits or {})
    sent = alerts.where("held = ''").withColumn("_s", F.unix_seconds(F.col("at").cast("timestamp")))
    over = lambda span: F.count("*").over(Window.partitionBy("recipient").orderBy("_s").rangeBetween(-span, 0))
    left = lambda most, span: F.greatest(F.lit(0), most - over(span))
    return sent.withColumn("hour_left", left(m["per_hour"], 3600)).withColumn("day_left", left(m["per_day"], 86400)).drop("_s")


def folded(rows: pd.DataFrame, budget: Budget, columns: list[str], recipient: str = "recipient") -> pd.DataFrame:
    """One recipient's alerts, moment by moment, through the budget: the columns and held, digests among them."""
    rows = rows.sort_values(["at", "level", "_key"], ascending=[True, False, True], ignore_index=True)
    seconds = (rows["at"] - pd.Timestamp("1970-01-01")).dt.total_seconds()
    held, said = [], []
    for at, group in rows.groupby(seconds, sort=True):
        why, digest = budget.moment(float(at), [(k, a, int(v), d) for k, a, v, d in zip(group.kind, group.asset, group.level, group._key, strict=True)])
        held += why
        if digest:
            own = {recipient: group[recipient].iloc[0], "at": group["at"].iloc[0], "asset": "SYSTEM", "kind": "suppression_digest", "level": SEVERITY["suppression_digest"], "title": f"{digest[0]} alerts suppressed: {digest[1]}", "value": float(digest[0]), "held": ""}
            said.append([own.get(c) for c in (*columns, "held")])
    rows["held"] = held
    out = rows[[*columns, "held"]]
    return pd.concat([out, pd.DataFrame(said, columns=out.columns).astype(out.dtypes.to_dict())], ignore_index=True) if said else out


def admit(alerts: DataFrame, recipient: str = "recipient", limits: dict | None = None) -> DataFrame:
    """alerts with held: why each isn't sent, empty if it is; and the digests that tell a recipient of what was held.

    A recipient's alerts of one moment go by severity, then a digest if one is due. One group a recipient.
    """
    cols = alerts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alerts.schema) + ", held string"
    return alerts.withColumn("_key", dedup_key()).groupBy(recipient).applyInPandas(lambda pdf: folded(pdf, Budget(limits), cols, recipient), schema)


def raised(rules: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The alerts of all rules in one plan, with the rule's name, and (rule, error) of each that can't be planned over its inputs: one broken rule doesn't silence the others."""
    out, rejected = None, []
    for name, rule in rules.items():
        try:
            part = rule()
            said = {c: F.col(c) if c in part.columns else F.lit(None) for c in ("confidence", "invalidation")}
            part = part.select(*ALERT_COLUMNS, said["confidence"].cast("double").alias("confidence"), said["invalidation"].cast("array<string>").alias("invalidation"), F.lit(name).alias("rule"))
        except AnalysisException as e:
            rejected.append((name, e.getCondition() or "failed"))
            continue
        out = part if out is None else out.unionByName(part)
    return out, rejected


def run(rules: dict[str, Callable[[], DataFrame]], recipient: Column, spark: SparkSession, limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """One run of the engine: the rules' alerts, admitted within each recipient's budget with digests, and what was rejected (rule, asset, at, error).

    Alerts without an asset, a moment, a title or a known kind are rejected themselves, and directional ones without confidence or invalidation.
    """
    alerts, broken = raised(rules)
    whole = spark.createDataFrame([(r, None, None, e) for r, e in broken], "rule string, asset string, at timestamp_ntz, error string")
    if alerts is None:
        return spark.createDataFrame([], f"recipient string, {ALERT}, rule string, held string"), whole
    fault = F.when(F.col("asset").isNull(), "no asset").when(F.col("at").isNull(), "no moment").when(F.coalesce(F.trim("title"), F.lit("")) == "", "no title").when(F.col("level").isNull(), "unknown kind").otherwise(F.col("fault"))
    alerts = directional_faults(alerts)
    sound = alerts.where(fault.isNull()).select(recipient.alias("recipient"), *ALERT_COLUMNS, "rule")
    faulty = alerts.select("rule", "asset", "at", fault.alias("error")).where("error IS NOT NULL")
    return admit(sound, limits=limits), whole.unionByName(faulty)
