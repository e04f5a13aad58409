"""Stories that are told again, looked up in blocks."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barloom.operators import news

SCHEMA = "item_id long, source string, title string, published_at timestamp_ntz"


def titles(n, words, length, days, common=()):
    rng = random.Random(11)
    return [(i, "s", " ".join([*common, *rng.sample([f"w{k}" for k in range(words)], length)]), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(days * 1440))) for i in range(n)]


def events(spark, rows):
    return news.story_events(news.stories(spark.createDataFrame(rows, SCHEMA)))


def test_small_blocks_find_what_brute_force_finds(spark, monkeypatch):
    ev = events(spark, titles(400, 40, 5, 9)).persist()
    monkeypatch.setattr(news, "ASKING_A_BLOCK", 30)
    monkeypatch.setattr(news, "KNOWN_A_BLOCK", 20)
    rows = news.recycled(ev).collect()
    used = {}
    for e in rows:
        used.setdefault(e.cycle, []).extend(e.words)
    for e in rows:
        w = {k: max(news.FLOOR, math.log((e.cycle_titles + 1) / (used[e.cycle].count(k) + 1))) for k in set(used[e.cycle])}
        mass = lambda words: math.fsum(w.get(k, max(w.values())) for k in words)  # noqa: E731, B023
        a = set(e.words)
        older = [p.earliest for p in rows if p.cluster_id != e.cluster_id and e.earliest - p.earliest > timedelta(hours=36) and mass(a & set(p.words)) / mass(a | set(p.words)) >= news.SAME_STORY]
        assert e.recycled_from == (min(older) if older else None)
    assert 20 < sum(e.recycled_from is not None for e in rows) < len(rows)
    ev.unpersist()


def written_rows(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_pairs_of_stories_are_not_shuffled(spark):
    """1,500 titles of three words that all have and eight rarer ones: half a million pairs share one of these."""
    ev = events(spark, titles(1500, 300, 8, 15, ("alpha", "beta", "gamma"))).persist()
    n = ev.count()
    before = written_rows(spark)
    assert news.recycled(ev).agg(F.count("recycled_from")).first()[0] >= 0
    rows = sum(x for k, x in written_rows(spark).items() if k not in before)
    assert n > 1000 and rows < 20 * n
    ev.unpersist()
