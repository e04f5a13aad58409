"""Nearest neighbours against all products."""

import math
from collections import defaultdict

import numpy as np
import pytest

from barloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, v int, key int, h int"


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def plain(rows, most=20, every=20):
    """For each query the best of all candidates, as a list of (score, id)."""
    rows = list({(i, tuple(np.float32(v).astype(float) + 0.0)): None for i, v, *_ in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)})
    count = defaultdict(int)
    for _, v in rows:
        count[len(v)] += 1
    long = max(count, key=lambda n: (count[n], n), default=0)
    rows = [r for r in rows if len(r[1]) == long]
    return {q: sorted(((-dot(v, w), x) for x, w in rows if x != i))[:most] for q in rows if (i := q[0]) % every == 0 for v in [q[1]]}


def found(df, **more):
    by = defaultdict(list)
    for r in neighbours.neighbours(df, **more).collect():
        by[r.query_id].append((r["rank"], -r.score, r.vec_id))
    return {i: sorted(x) for i, x in by.items()}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.RandomState(2)
    return rng.standard_normal((1500, 12)) * rng.lognormal(0, 0.6, (1500, 1))


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3) for i, v in rows], SCHEMA).repartition(4)


def recall(got, want):
    hits = [len({x for *_, x in got[q[0]]} & {x for _, x in best}) / len(best) for q, best in want.items()]
    return sum(hits) / len(hits)


def test_many_lists_find_what_all_products_find(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 32)
    rows = list(enumerate(vectors))
    got, want = found(frame(spark, rows)), plain([(i, list(v)) for i, v in rows])
    assert got.keys() == {q[0] for q in want} and all([r for r, *_ in x] == list(range(1, 21)) for x in got.values())
    assert recall(got, want) >= 0.9
    scores = {(i, x): s for (i, _), best in want.items() for s, x in best}
    assert all(scores.get((i, x), s) == s for i, best in got.items() for _, s, x in best)


def test_blocks_don_t_change_the_result(spark, vectors, monkeypatch):
    df = frame(spark, list(enumerate(vectors)))
    whole = found(df)
    monkeypatch.setattr(neighbours, "VECTORS_A_BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERIES_A_BLOCK", 7)
    assert found(df) == whole


def test_queries_with_too_few_candidates_read_all_lists(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 8)
    monkeypatch.setattr(neighbours, "PROBES", 1)
    monkeypatch.setattr(neighbours, "REPLICAS", 1)
    rows = list(enumerate(vectors[:300]))
    got, want = found(frame(spark, rows)), plain([(i, list(v)) for i, v in rows])
    assert {i: [(s, x) for _, s, x in best] for i, best in got.items()} == {q[0]: best for q, best in want.items()}


def test_odd_rows_ties_and_a_hot_vector(spark, vectors):
    rows = [(i, v) for i, v in enumerate(vectors[:60])]
    rows += [(1000 + i, vectors[0]) for i in range(400)]  # a vector that most rows share
    rows += [(40, vectors[40]), (40, vectors[40]), (60, vectors[7]), (60, vectors[8])]  # repeated rows, an id with two vectors
    bad = [None, [], [0.0] * 12, [-0.0] * 12, [None] + [1.0] * 11, [math.nan] + [1.0] * 11, [math.inf] * 12, [1.0, 2.0]]
    rows += [(2000 + 20 * i, v) for i, v in enumerate(bad)] + [(None, vectors[3])]
    rows += [(2500, [-0.0] + [1.0] * 11), (2520, [0.0] + [1.0] * 11)]
    want, got = plain([(i, v if v is None else list(v)) for i, v in rows]), found(frame(spark, rows))
    assert got.keys() == {q[0] for q in want}
    for i in got:
        both = sorted((r, s, x) for q, best in want.items() if q[0] == i for r, (s, x) in enumerate(best, 1))
        assert got[i] == both, i
    copies = [x for *_, x in got[1000] if x == 0 or 1000 <= x < 1400]
    assert len(copies) > 10 and copies == [0, *range(1001, 1000 + len(copies))]


def test_few_rows_none_and_other_parameters(spark, vectors):
    few = frame(spark, list(enumerate(vectors[:5])))
    assert [x for *_, x in found(few)[0]] == [x for _, x in plain([(i, list(v)) for i, v in enumerate(vectors[:5])]).popitem()[1]]
    assert found(few, most=2, every=1).keys() == set(range(5)) and all(len(x) == 2 for x in found(few, most=2, every=1).values())
    assert neighbours.neighbours(few.limit(0)).collect() == [] and neighbours.neighbours(few.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    assert found(frame(spark, [(0, [1.0, 2.0])])) == {}


def test_query_recalls_nine_of_ten(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in neighbours.op13_nearest_neighbours(spark, sf).collect():
        got[r.query_id].append((r["rank"], -r.score, r.vec_id))
    assert recall(got, plain(rows)) >= 0.9
