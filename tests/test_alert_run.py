"""The whole run of the alert engine against plain Python, alert by alert."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barloom.operators import alerts

T0 = datetime(2025, 3, 1)
NAMES = ("volume_anomaly", "regime_change", "major_news", "liquidation_event", "data_quality", "model_disagreement", "correlation_breakdown")


def plain(rows):
    """Why each alert (at, level, asset, kind, title) is held, and the digests, by the limits as they are stated."""
    sent, scope, said, held, kinds, last, out, digests = [], {}, {}, Counter(), Counter(), None, {}, []
    hours = lambda n: timedelta(hours=n)
    order = sorted(rows, key=lambda r: (r[0], -r[1], alerts_key(r)))
    for at in sorted({r[0] for r in order}):
        for r in (x for x in order if x[0] == at):
            _, level, asset, kind, title = r
            why = ""
            if (kind, asset, title) in said and at - said[kind, asset, title] < hours(12):
                why = "duplicate"
            elif (kind, asset) in scope and at - scope[kind, asset] < hours(4):
                why = "cooldown"
            for name, span, most, reserve in (("hourly", 1, 6, 2), ("daily", 24, 30, 8)):
                inside = [lv for t, lv in sent if t >= at - hours(span)]
                if not why and len(inside) >= most and not (level >= 40 and sum(lv >= 40 for lv in inside) < reserve):
                    why = name
            if why:
                held[why] += 1
                kinds[kind] += 1
            else:
                sent.append((at, level))
                scope[kind, asset] = said[kind, asset, title] = at
            out[r] = why
        if held and (last is None or at - last >= hours(6)):
            most = lambda c: sorted(c.items(), key=lambda x: (-x[1], x[0]))
            digests.append((at, f"{sum(held.values())} alerts suppressed: " + ", ".join(f"{n} {w}" for w, n in most(held)) + "; most held: " + ", ".join(f"{k} x{n}" for k, n in most(kinds)[:5])))
            held, kinds, last = Counter(), Counter(), at
            sent.append((at, 10))
    return out, digests


def alerts_key(r):
    import hashlib

    return hashlib.sha256("|".join((r[3], r[2], "", r[4])).encode()).hexdigest()[:16]


def frame(spark, rows):
    return spark.createDataFrame([(asset, None, at, kind, level, title, 1.0) for at, level, asset, kind, title in rows], alerts.ALERT)


def test_a_month_of_alerts(spark):
    rng = random.Random(5)
    rows = {(T0 + timedelta(minutes=10 * rng.randrange(3000)), 40 if k == "liquidation_event" else alerts.SEVERITY[k], f"A{rng.randrange(4)}", k, f"t{rng.randrange(5)}") for k in (rng.choice(NAMES) for _ in range(1500))}
    split = sorted(rows)
    rules = {f"rule {i}": lambda i=i: frame(spark, split[i::13]) for i in range(13)}
    sent, rejected = alerts.run(rules, F.lit("me"), spark)
    want, digests = plain(rows)
    got = sent.collect()
    assert rejected.count() == 0 and len(digests) > 50
    assert {(r["at"], r.level, r.asset, r.kind, r.title): r.held for r in got if r.kind != "suppression_digest"} == want
    assert sorted((r["at"], r.title) for r in got if r.kind == "suppression_digest") == digests
    assert all(b[0] - a[0] >= timedelta(hours=6) for a, b in zip(digests, digests[1:], strict=False))


def test_a_broken_rule_silences_no_other(spark):
    good = [(T0, 30, "A", "regime_change", "t"), (None, 30, "A", "regime_change", "no time"), (T0, 30, None, "regime_change", "no asset"), (T0, 30, "A", "major_news", " ")]
    calls = spark.createDataFrame([("A", T0, True, 0.6, ["price crossing 1"]), ("B", T0, True, None, ["x"]), ("C", T0, True, 0.6, [" "]), ("D", T0, False, None, None)], "asset string, at timestamp_ntz, published boolean, confidence double, invalidation array<string>").withColumn("passed", F.lit(None).cast("boolean"))
    rules = {"good": lambda: frame(spark, good), "broken": lambda: frame(spark, good).where("nothing > 1"), "lacking": lambda: spark.range(3), "calls": lambda: alerts.prediction_rules(calls)}
    sent, rejected = alerts.run(rules, F.col("asset"), spark)
    assert sorted((r.recipient, r.kind, r.held) for r in sent.collect()) == [("A", "regime_change", ""), ("A", "strong_prediction", "")]
    assert sorted((r.rule, r.error) for r in rejected.collect()) == [("broken", "UNRESOLVED_COLUMN.WITH_SUGGESTION"), ("calls", "no confidence"), ("calls", "no invalidation"), ("good", "no asset"), ("good", "no moment"), ("good", "no title"), ("lacking", "UNRESOLVED_COLUMN.WITH_SUGGESTION")]
    none, rejected = alerts.run({"broken": rules["broken"]}, F.col("asset"), spark)
    assert none.count() == 0 and rejected.count() == 1
