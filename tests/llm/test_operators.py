"""The training-data operators: brute-force comparisons and the defined odd cases."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import decontaminate, langid, licenses, media, mixing, neardup, quality, tokencounts, toxicity, urls

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, score double, node long, predicted string, row int"


def words(text):
    return BLANK.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus(n=120, seed=1):
    """Invented texts with copies, near copies, a shared passage, nulls, empties, one very long text and clashing columns."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 7))) for _ in range(400)]
    passage = rng.choices(vocabulary, k=40)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            texts.append(rng.choices(vocabulary, k=rng.randint(1, 90)))
        elif kind == 1:
            texts.append(list(rng.choice(texts)))
        elif kind in (2, 3):
            t = list(rng.choice(texts))
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(t)
        else:
            texts.append(passage + rng.choices(vocabulary, k=rng.randint(2, 40)))
    rows = [(i, " ".join(t), "en" if i % 2 else None, f"s{i % 5}", 0.5, 1, "x", 2) for i, t in enumerate(texts)]
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", "en", None, 1.0, 1, "", 1), (n + 2, " \t\n ", "fr", "s1", 1.0, 1, "", 1)]
    rows += [(None, "one two three four five six", "en", "s1", 1.0, 1, "", 1), (None, None, None, None, None, None, None, None)]
    rows += [(n + 3, " ".join(rng.choices(vocabulary, k=60_000)), "de", "s2", 1.0, 1, "", 1), (n + 4, "x" * 300_000, "de", "s2", 1.0, 1, "", 1)]
    rows += [rows[0], rows[0]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(100)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def expected_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, (_, s) in enumerate(sets):
        meets = Counter(m for x in s for m in holders[x] if m < k)
        for m, both in meets.items():
            if 100 * both >= 75 * (len(s) + len(sets[m][1]) - both):
                parent[root(k)] = root(m)
    low = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            low[root(k)].append(i)
    return sorted((i if i is not None else -1, len(s), (min(low[root(k)]) if low[root(k)] else -1) if s else (i if i is not None else -1)) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("crowd", [64, 3])
def test_near_duplicates_are_those_of_brute_force(spark, docs, monkeypatch, crowd):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got) == expected_components(corpus())
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_contained_items_are_those_of_brute_force(spark, docs, monkeypatch):
    rows = corpus()
    items = [(0, " ".join(words(rows[4][1])[3:30])), (1, " ".join(words(rows[0][1])[:9])), (2, "no such words here at all"), (3, ""), (4, None), (5, "one two"), (6, " ".join(words(rows[-4][1])[100:400]))]
    want = Counter()
    for i, t, *_ in rows:
        for j, u in items:
            s = shingles(u)
            both = len(s & shingles(t))
            if s and 100 * both >= 75 * len(s):
                want[(i, j, len(s), both)] += 1
    table = spark.createDataFrame(items + items[:1], "item_id long, text string")
    assert want and Counter(tuple(r)[:4] for r in decontaminate.contained(docs, table).collect()) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 20)
    assert Counter(tuple(r)[:4] for r in decontaminate.contained(docs, table).collect()) == want


def test_quality_separates_held_out_junk(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(400):
        w = ["".join(rng.choices("abcdefg", k=4)) for _ in range(50)]
        bad = i % 3 == 0
        rows.append((i, " ".join(x + "!!" if bad else x for x in w)))
        marks.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs, labels, "doc_id").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and sum(got[i].predicted == int(i % 3 != 0) for i in held) >= 0.97 * len(held)


def test_toxic_passages_of_held_out_texts(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(900):
        w = ["".join(rng.choices("abcdefghi", k=3)) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            w[30:33] = rng.choices(["vilest", "scummy", "rotten"], k=3)
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model, "doc_id").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == int(i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert all(any(p.first_word <= 32 and p.last_word >= 30 for p in got[i].passages) for i in held if got[i].predicted and i % 5 == 0)


def test_segments_are_the_maximal_ones():
    import numpy as np

    def brute(s):
        """Split recursively at the best segment."""
        best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = best[2], best[3]
        return brute(s[:i]) + [(round(best[0], 6), i, j)] + [(v, a + j, b + j) for v, a, b in brute(s[j:])]

    rng = random.Random(2)
    for _ in range(60):
        s = [rng.choice([-3.1, -1.3, 0.7, 2.2, 1.9]) for _ in range(14)]
        a = np.array(s)
        total = np.concatenate([[0], a.cumsum()])
        win = np.flatnonzero(a > 0)
        got = [(round(v, 6), int(win[x]), int(win[y]) + 1) for x, y, v in toxicity.segments(win, a[win], total[win])]
        assert got == brute(s)


def test_language_of_held_out_texts_and_of_mixed_ones(spark):
    rng = random.Random(6)
    stems = {"aa": "bcdfg", "zz": "vwxyz"}

    def text(lang, n=40):
        return ["".join(rng.choices(stems[lang] + "aeiou", k=5)) for _ in range(n)]

    rows = [(i, " ".join(text(lang)), lang) for i in range(300) for lang in [("aa", "zz")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    odd = [(1000, " ".join(text("aa", 30) + text("zz", 20)), None), (1001, None, "aa"), (1002, "12 34 !!", "aa"), (1003, "", None), (None, "— … «»", None)]
    got = {r.doc_id: r for r in langid.identify(docs.unionByName(spark.createDataFrame(odd, docs.schema)), model, "doc_id").collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == ("aa", "zz")[i % 2] for i in held) >= 0.98 * len(held)
    assert got[1000].lang_pred == "aa" and [s.lang for s in got[1000].spans] == ["aa", "zz"] and abs(got[1000].spans[1].first_word - 30) <= 2
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1001, 1002, 1003, None))


def test_forward_backward_sums_all_paths():
    import itertools

    import numpy as np

    rng = np.random.RandomState(0)
    score, move = rng.randn(1, 4, 3), langid.Moves(*rng.randn(3, 3))
    step = [[move.stay[a] if a == b else move.leave[a] + move.enter[b] for b in range(3)] for a in range(3)]
    p, stay, leave, enter = langid._marginals(score, np.ones((1, 4), bool), move)
    want, steps, z = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=4):
        v = np.exp(sum(score[0, t, y] for t, y in enumerate(path)) + sum(step[a][b] for a, b in zip(path, path[1:], strict=False)))
        z += v
        for t, y in enumerate(path):
            want[t, y] += v
        for a, b in zip(path, path[1:], strict=False):
            steps[a, b] += v
    steps /= z
    between = steps - np.diag(np.diag(steps))
    assert np.allclose(p[0], want / z)
    assert np.allclose(stay, np.diag(steps)) and np.allclose(leave, between.sum(1)) and np.allclose(enter, between.sum(0))


def test_a_long_text_is_one_chain(spark, monkeypatch):
    """Pieces that hand on what they know give what one pass over the whole text gives."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choices("abcde" if i % 2 else "cdefg", k=3)) for _ in range(30)), "xy"[i % 2]) for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model.move.stay[:] = 4  # so that a word matters far away
    texts = pa.array([" ".join("".join(rng.choices("cde", k=3)) for _ in range(n)) for n in (500, 64, 65, 0, 1, 129)])
    pieces = list(langid.labelled(texts, model))
    monkeypatch.setattr(langid, "CELLS", 64 * 2 * 3)
    split = list(langid.labelled(texts, model))
    monkeypatch.setattr(langid, "CHAIN", 512)
    whole = list(langid.labelled(texts, model))
    for got in (pieces, split):
        assert len(got) == len(whole) and all((a[2] == b[2]).all() and np.allclose(a[3], b[3], atol=1e-9) for a, b in zip(got, whole, strict=True))


def test_rare_and_many_languages_are_learned(spark):
    """600 languages, one of them with a thousandth of the rows."""
    rng = random.Random(9)
    spell = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)] for _ in range(600)]
    rows = [(i, " ".join(rng.choices(spell[j], k=12)), f"l{j}") for i in range(9000) for j in [i % 599 if i % 1000 else 599]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample = langid.stratified(docs, 3000).groupBy("lang").count().collect()
    assert len(sample) == 600 and sum(r["count"] for r in sample) <= 3000 and {r.lang: r["count"] for r in sample}["l599"] >= 4
    got = langid.identify(docs, langid.train(docs), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in held) >= 0.97 * len(held)


def test_license_places(spark, docs):
    rows = [(900, "X. Licensed under the Apache License, Version 2.0. Apache-License!"), (901, "MIT License mit license CC BY-NC 4.0"), (902, "gnu general  PUBLIC\nlicense — released under the MIT license"), (903, "the license of mit"), (904, "apachelicense")]
    got = {r.doc_id: r for r in licenses.scan(docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")), licenses.BASE, licenses.NOTICES, "doc_id").collect()}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text in rows + [(r[0], r[1]) for r in corpus() if r[0] is not None]:
        w = pattern.findall((text or "").translate(LOWER))
        want = sorted((k, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p)
        assert got[i].n_words == len(w) and sorted((p.first_word, p.label) for p in got[i].places if p.is_base) == want
    assert {p.label for p in got[900].places} == {"apache", "apache-2.0"} and {p.label for p in got[902].places} == {"gpl", "mit", "mit-release"} and not got[903].places


def test_url_verdicts(spark):
    cases = {
        "http://example.com/en/7": ("example.com/en/7", "allow"),
        "http://a.B.EXAMPLE.com/en/711?x#y": ("example.com/en/7", "allow"),
        "https://other.com/en/8": ("com/en/", "block"),
        "https://othercom/en/8": (None, "allow"),
        "https://example.net/de/8": ("example.net/de/8", "block"),
        "https://x.net/de/?q": ("net/de/", "allow"),
        "https://x.net/DE/": (None, "allow"),
        "https://x.org?/es/": (None, "allow"),
        "ftp://spam-farm.example.org/x": (None, "block"),
        "no scheme com/en/": (None, "allow"),
        "http://": (None, "allow"),
        "": (None, "allow"),
        None: (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)] + [(0, "http://example.com/en/7", "", "")], "page_id long, url string, host string, rule string")
    got = urls.judge(pages.drop("host", "rule").withColumn("verdict", F.lit(1)), urls.HOST_RULES + urls.PATTERNS, "page_id").collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r.rule, r.verdict) == list(cases.values())[r.page_id]


def test_mix_is_near_its_targets_and_repeats(spark, docs):
    got = sorted(mixing.mixed(docs).collect(), key=str)
    assert sorted(mixing.mixed(docs.repartition(7)).collect(), key=str) == got and len(got) == docs.count()
    sums, target, size = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        sums[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    names = sorted(size, key=lambda x: (x is None, x))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] < level * weight[s]}
        if not full:
            break
        want |= {s: 2 * size[s] for s in full}
        left -= sum(want[s] for s in full)
        open_ -= full
    want |= {s: level * weight[s] for s in open_}
    assert all(abs(want[s] - target[s]) < 1e-6 for s in names)
    assert all(abs(sums[s] - target[s]) <= 2 * max(r.size for r in got if r.source == s) for s in names)


def test_flight_keeps_both_totals():
    import numpy as np

    rng = np.random.RandomState(3)
    size = rng.randint(1, 500, 400).tolist()
    p = mixing._flight([0.37] * 400, size, rng, False)
    left = [x for x in p if 0 < x < 1]
    assert len(left) <= 2 and abs(sum(p) - 0.37 * 400) < 1e-6 and abs(sum(a * b for a, b in zip(p, size, strict=True)) - 0.37 * sum(size)) < 1e-4


def test_token_totals_follow_the_changes(spark, tmp_path):
    changes = spark.createDataFrame
    schema = "source string, lang string, tokenizer string, kind string, n_tokens long, old_tokens long"
    ledger = tokencounts.Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    one = changes([("a", "en", "t1", "insert", 5, None), ("a", "en", "t1", "insert", 7, None), (None, None, "t1", "insert", 1, None), ("b", "en", "t1", "insert", 2, None)], schema)
    two = changes([("a", "en", "t1", "delete", 5, None), ("a", "en", "t1", "revise", 9, 7), ("b", "en", "t1", "delete", 2, None)], schema)
    assert ledger.commit("1", one) and ledger.commit("2", two) and not ledger.commit("1", one) and ledger.commit("3", one.limit(0))
    (tmp_path / "ledger" / "batch=4").mkdir()
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == [("a", "en", "t1", 1, 9), (None, None, "t1", 1, 1)]
    with pytest.raises(Exception, match="unknown change"):
        ledger.commit("5", changes([("a", "en", "t1", "upsert", 1, None)], schema))


def test_token_counts_are_the_tokenizers(spark, docs):
    import base64

    import tiktoken

    with open(tokencounts.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("t", pat_str=tokencounts.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    got = tokencounts.with_tokens(docs.where("length(text) < 2000 OR text IS NULL"), "text").collect()
    assert all(r.n_tokens == len(encode(r.text or "")) for r in got)


def test_media_round_trip_and_sniffing(spark, docs):
    rows = media.sniff(media.store(docs, "doc_id", "text"), "media", "declared", "doc_id", "text", "n_bytes", "media").collect()
    assert len(rows) == docs.count()
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r.n_bytes == len(raw) and r.media[r.sample_start : r.sample_start + r.sample_bytes] == payload and r.media_bytes == len(r.media)
    inner = media.wav(b"q" * 64)
    gz = zlib.compressobj(9, zlib.DEFLATED, 31)
    packed = gz.compress(b"abc" * 99) + gz.flush()
    blob = media.pgm(b"y" * 128) + b"BM junk" + inner + b"RIFF" + packed
    assert media.sniffed(blob)[0] == "pgm" and [(t, n) for t, _, n in media.sniffed(blob)[4]] == [("wav", len(inner)), ("gzip", len(packed))]
    assert media.sniffed(b"")[0] is None and media.sniffed(inner[:-1])[0] is None
    odd = spark.createDataFrame([(1, None, "png", 1), (2, inner, "png", 2), (3, bytearray(b"text"), None, 3)], "doc_id long, media binary, declared string, media_bytes int")
    got = {r.doc_id: r for r in media.sniff(odd.drop("media_bytes"), "media", "declared", "doc_id").collect()}
    assert (got[2].media_type, got[2].corrected) == ("wav", True) and got[1].media_type == "png" and got[3].media_type is None


def test_odd_rows_and_empty_tables(spark, docs, labels, tmp_path, monkeypatch):
    """Every query over a folder of odd tables, and over empty ones."""
    from barloom.llm.queries import QUERIES

    pages = spark.createDataFrame([(1, None, None, 1), (None, "http://a.com/en/", "", 2), (None, "http://a.com/en/", "", 2)], "page_id long, url string, html string, verdict int")
    items = spark.createDataFrame([(1, "one two three four five six", 0), (None, None, 1)], "item_id long, text string, doc_id int")
    vectors = spark.createDataFrame([(20, [1.0, 2.0], 0), (20, None, 1), (None, [1.0, 1.0], 2), (3, [0.0, 0.0], 3), (4, [float("nan"), 1.0], 4), (5, [2.0, 1.0], 5)], "vec_id long, embedding array<float>, rank int")
    for name, rows in (("odd", None), ("empty", 0)):
        for t, df in (("documents", docs), ("labels", labels), ("pages", pages), ("benchmark", items), ("embeddings", vectors)):
            (df if rows is None else df.limit(0)).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        for q, f in QUERIES.items():
            n = f(spark, f"{tmp_path}/{name}").count()
            if name == "empty":
                assert n == 0, q
            elif q not in ("op2_token_counts", "op7_benchmark_decontamination"):
                assert n == (3 if "url" in q else 1 if "neighbours" in q else docs.count()), q


def test_equal_texts_equal_media(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "doc_id long, text string")
    a, b, c = sorted(media.store(docs, "doc_id").collect())
    assert a.media == b.media and a.declared == b.declared and hashlib.sha256(a.media).digest() != hashlib.sha256(c.media).digest()


def test_documents_without_id_are_recounted_too(spark, tmp_path):
    rows = [(None, "same line here\nsame line here\nother", "en", "s"), (2, "x y z", "en", "s"), (3, "a b\na b\nc", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = spark.createDataFrame([("same line here\nother",), ("x y z",), ("a b\nc",)], "text string")
    want = sum(r.n_tokens for r in tokencounts.with_tokens(texts, "text").collect())
    assert [(r.documents, r.tokens) for r in tokencounts.op2_token_counts(spark, str(tmp_path)).collect()] == [(3, want)]
