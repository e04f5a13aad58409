"""Periodic runs against the definition, pair by pair of words."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import periodic


def plain(words):
    """Every stretch of matches of every lag; of equal stretches the smallest lag."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def plain_row(doc_id, text):
    words = plain_planted(doc_id, text)
    found = plain(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 12), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=12))
def test_equals_the_definition(head, period, times, tail):
    words = head + [x % 3 for x in range(period)] * times + tail
    assert periodic.runs(periodic.numbered(words)) == plain(words)


@pytest.mark.parametrize("words", ["a", "aaaaaa", "ab" * 3, "ab" * 4, "aab" * 5 + "aab" * 4, "a" * 50 + "b" + "a" * 50, "abcabd" * 6, "aabaab" * 7 + "c" * 6, ("ab" * 5 + "c") * 6])
def test_nested_touching_and_multiple_periods(words):
    assert periodic.runs(periodic.numbered(list(words))) == plain(words)


def test_long_texts_of_any_kind_take_little_time():
    rng = np.random.RandomState(1)
    same = np.zeros(1_000_000, np.int64)
    fibonacci, last = [0, 1], [0]
    while len(fibonacci) < 500_000:
        fibonacci, last = fibonacci + last, fibonacci
    crowded = np.where(rng.rand(1_000_000) < 0.5, 0, rng.randint(1, 50_000, 1_000_000))
    began = time.time()
    assert periodic.runs(same) == [(0, 1_000_000, 1)]
    assert periodic.runs(np.array(fibonacci)) == []  # no word of it repeats four times
    periodic.runs(crowded)
    assert periodic.runs(np.tile(rng.permutation(200_000), 5)) == [(0, 1_000_000, 200_000)]
    assert time.time() - began < 60


def test_operator_and_planted_texts(spark):
    rng = random.Random(4)
    made = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 120))) for _ in range(150)]
    texts = [None, "", " \t ", "one", "né né né né né né", "x " * 4000, "A a A a A a A a", " b b b b\x0bb b\x0cb b\rb b b b ", *made]
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(None, "z z z z z z"), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by = {r.doc_id: r for r in periodic.planted(docs).collect()}
    assert all((by[i].text or "").encode().split() == plain_planted(i, t) for i, t in rows)
    got = {r.doc_id: r for r in periodic.periodic_runs(docs, "doc_id").collect()}
    assert len(got) == len({i for i, _ in rows})
    for i, t in rows:
        words = (t or "").encode().split()
        assert [tuple(x) for x in got[i].runs] == plain(words) and got[i].n_words == len(words)


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b", 5, 6)], "doc_id long, body string, row int, text int")
    (one,) = periodic.periodic_runs(docs, "row", "text", "doc_id", text="body").collect()
    assert (one.row, one.text, one.doc_id, one.collapsed, [tuple(r) for r in one.runs]) == (5, 6, 1, "a b", [(0, 6, 1)])
    assert periodic.periodic_runs(docs.limit(0), "doc_id", text="body").collect() == []


def test_query_equals_the_definition(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in periodic.op12_periodic_runs(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    some = {i: t for i, t in texts.items() if len((t or "").split()) < 1500}
    assert len(some) > 100 and all(got[i] == plain_row(i, t) for i, t in some.items())
    assert any(r[0] for r in got.values())
