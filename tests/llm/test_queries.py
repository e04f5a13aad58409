"""The registered queries over the whole smallest tables against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import langid, licenses, tokencounts, toxicity
from barloom.llm.queries import QUERIES
from tests.llm import plain
from tests.llm.test_operators import LOWER, expected_components, words


@pytest.fixture(scope="module")
def rows(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def test_op2(spark, sf, rows):
    import tiktoken

    with open(tokencounts.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("t", pat_str=tokencounts.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    seen, want = set(), defaultdict(lambda: [0, 0])
    for r in sorted(rows, key=lambda r: r.doc_id):
        if r.text not in seen:
            seen.add(r.text)
            own = want[r.source, r.lang]
            own[0] += 1
            own[1] += len(encode("\n".join(dict.fromkeys(r.text.split("\n")))))
    got = QUERIES["op2_token_counts"](spark, sf).collect()
    assert {(r.source, r.lang): [r.documents, r.tokens] for r in got} == dict(want)


def test_op3(spark, sf, rows):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: r for r in QUERIES["op3_license_scan"](spark, sf).collect()}
    for r in rows:
        w = pattern.findall(r.text.translate(LOWER))
        at = sorted((k, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert g.base_labels == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(g.labels.split(",")) and 0 <= g.score <= 1


def test_op6(spark, sf, rows):
    got = QUERIES["op6_near_duplicates"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected_components([(r.doc_id, r.text) for r in rows])


def test_op9(spark, sf, rows):
    got = {r.doc_id: r for r in QUERIES["op9_mixing"](spark, sf).collect()}
    size = Counter()
    for r in rows:
        size[r.source] += len(words(r.text))
    assert all(got[r.doc_id].size == len(words(r.text)) and got[r.doc_id].source_size == size[r.source] and got[r.doc_id].taken <= 2 * got[r.doc_id].size for r in rows)
    assert abs(sum({r.source: got[r.doc_id].target for r in rows}.values()) - 1.5 * sum(size.values())) < 1e-3
    taken, longest, target = Counter(), Counter(), {}
    for r in rows:
        g = got[r.doc_id]
        taken[r.source] += g.taken
        longest[r.source], target[r.source] = max(longest[r.source], g.size), g.target
        assert g.size == 0 or g.taken % g.size == 0
    assert all(abs(taken[x] - target[x]) <= 2 * longest[x] for x in size)


def test_op10(spark, sf, rows):
    got = {r.doc_id: r for r in QUERIES["op10_media_columns"](spark, sf).collect()}
    for r in rows:
        raw = r.text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


@pytest.mark.parametrize("name", ["op1_quality_classifier", "op5_language_id", "op8_toxicity"])
def test_scores_have_one_row_a_document(spark, sf, rows, name):
    got = QUERIES[name](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


@pytest.fixture(scope="module")
def marks(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").collect()


def test_op1_is_a_plain_loop(spark, sf, rows, marks):
    order = dict(spark.read.parquet(f"{sf}/documents.parquet").select("text", F.xxhash64("text")).collect())
    want = plain.quality_scores(rows, marks, order)
    got = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, sf).collect()}
    assert len({round(x, 3) for x in want}) > 20
    for r, w in zip(rows, want, strict=True):
        assert abs(got[r.doc_id].score - w) < 1e-4 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_op5_sums_all_paths(spark, sf, rows, tmp_path):
    """Short texts among the documents, in one and in two languages, against all label paths under the trained weights."""
    rng = random.Random(3)
    short = []
    for i in range(40):
        a, b = (rng.choice(rows).text.split() for _ in range(2))
        short.append((100_000 + i, " ".join(rng.choices(a, k=rng.randint(1, 3)) + rng.choices(b, k=rng.randint(0, 2)))))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(*s, None) for s in short], docs.schema))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.train(docs.withColumn("text", F.lower("text")))
    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, str(tmp_path)).collect()}
    for i, text in short:
        if len(plain.runs(text.lower(), plain._text.LETTER_WORDS)) <= 6:
            lang, score = plain.language(text, model)
            assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-6
    held = [r for r in rows if plain.held_out(r.doc_id) and r.lang is not None]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_op8_is_the_plain_formula(spark, sf, rows, marks):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    known = plain.toxic_rows(rows, marks)
    raw = plain.log_odds(rows, known)
    shift = raw - model.scores
    assert abs(shift - shift[0]).max() < 1e-4 and shift[0] > -1e-6  # one constant, as the mean clean word must lose
    clean = [[float(max(model.scores[a], model.scores[b])) for a, b in plain.columns(t)] for t, y in known if y == 0]
    every = [x for s in clean for x in s]
    assert sum(every) < 0 and abs(sum(math.exp(model.rate * x) for x in every) / len(every) - 1) < 0.05
    top = [(len(s), max(plain.best_segments(s), default=0.0)) for s in clean if s]
    assert math.isclose(model.k, len(top) / sum(m * math.exp(-model.rate * v) for m, v in top), rel_tol=1e-3)
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    for r in rows:
        assert abs(got[r.doc_id].score - plain.toxic_score(r.text, model)) < 1e-4 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
