"""Toxic passages by maximum-scoring segment search.

Words hash into half of BUCKETS columns, their first STEM bytes into the other
half. The score of either is the log-odds of meeting it in toxic against clean
labelled texts, smoothed by an informative Dirichlet prior (its share of all
documents) and drawn towards zero by a few standard errors; a word takes the
larger of its two, so that compounds of a known stem count, less a small constant
by which an average word scores below zero. One
left-to-right pass over a text's scores finds all maximal-scoring segments
(Ruzzo and Tompa); neighbouring losses are summed first, so the pass takes one
step for each winning word. Under the extreme-value law a clean text of m words
has a segment of score S or more with probability 1 - exp(-K m exp(-lambda S)):
lambda solves the Karlin-Altschul equation on clean words, K is fitted to the
best segments of clean labelled texts. A text's evidence is the sum of
lambda S - ln(K m) over its significant segments; a logistic curve fitted on the
labelled sample turns it into a probability.

Labels come from a bounded sample (MAX_TRAIN_ROWS) outside the held-out fold, from
which near copies (texts that share two minimum hashes of their word triples) are
dropped; the prior counts every document.

Defined cases: null, empty and word-free texts have no segment and get the score
of texts without evidence; repeated rows get equal scores; rows with null label or
null doc_id are not learned from; without labels of both kinds every score is 0;
other columns are ignored, kept ones named like a result give way to it; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from barloom.llm._run import held_out, kept, labelled, small_batches, table, written
from barloom.llm._text import LETTER_WORDS, Words, distinct, shingles, slices

BUCKETS = 1 << 18
#: At most about so many labelled rows, and bytes of their texts, are learned from.
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 20_000, 128 << 20
TOXIC = 0.3
#: Weight of the prior, in words.
PRIOR = 2_000.0
#: Standard errors by which a score moves towards zero.
SHRINK = 2.0
#: Bytes of a stem.
STEM = 5
#: What every word costs.
COST = 0.25
#: A segment is significant if clean texts of that length have a better one this rarely.
P_VALUE = 0.01


#: Bins in which the scores of clean words are counted.
GRID = np.linspace(-12, 24, 1801)


@dataclass(frozen=True)
class Model:
    scores: np.ndarray
    rate: float  # lambda
    k: float
    slope: float
    offset: float


def _buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """The columns of each word and of its stem."""
    w = Words(raw, offsets, LETTER_WORDS)
    half = np.uint64(BUCKETS // 2)
    return (w.hashes() % half).astype(np.int64), (w.hashes(STEM) % half + half).astype(np.int64), w


def _corpus_counts(batches):
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, raw, offsets in slices(b.column("text")):
            word, stem, _ = _buckets(raw, offsets)
            total += np.bincount(word, minlength=BUCKETS) + np.bincount(stem, minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def _sketched(batches):
    for b in batches:
        marks = []
        for _, raw, offsets in slices(b.column("text")):
            v, _, n = shingles(raw, offsets, 3)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            low = np.zeros((len(n), 2), np.uint64)
            if len(v):
                some = n > 0
                for i, a in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    low[some, i] = np.minimum.reduceat(v * np.uint64(a), first[some])
            marks.append(low)
        marks = np.concatenate(marks).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("y"), pa.array(marks[:, 0]), pa.array(marks[:, 1])], ["doc_id", "text", "y", "m1", "m2"])


def segments(start: np.ndarray, gain: np.ndarray, before: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of one text: (first win, last win, score).

    gain[i] is what the i-th winning run adds, before[i] the total up to its left end.
    A candidate is [first, last, total before, total after, nearest earlier candidate that
    starts lower]; a new one joins backwards while that one ends no higher. Those that the
    search passes start no lower than the new one, so none looks at them again: they go
    with a join, or lie behind the new one's own link. So all searches take as many steps
    as there are winning runs.
    """
    out: list[list] = []
    for i, (lo, add) in enumerate(zip(before.tolist(), gain.tolist(), strict=True)):
        new, j = [i, i, lo, lo + add, -1], len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= new[3]:
                new[4] = j
                out.append(new)
                break
            new = [out[j][0], i, out[j][2], new[3], -1]
            j, cut = out[j][4], j
            del out[cut:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in out]


def found(column: pa.Array, scores: np.ndarray):
    """For each text: its number of words and its maximal segments as (first word, last word, score)."""
    for _, raw, offsets in slices(column):
        word, stem, w = _buckets(raw, offsets)
        s = np.maximum(scores[word], scores[stem])
        total = np.concatenate([[0.0], np.cumsum(s)])
        win = np.flatnonzero(s > 0)
        of = w.text[win]
        cut = np.searchsorted(of, np.arange(len(offsets)))
        for t in range(len(offsets) - 1):
            own = win[cut[t] : cut[t + 1]]
            base = w.first[t]
            if len(own):
                # rel. to the text's own start, so that a text's sums don't depend on its neighbours
                before = total[own] - total[base]
                got = [(int(own[a] - base), int(own[b] - base), v) for a, b, v in segments(own, s[own], before)]
            else:
                got = []
            yield int(w.count[t]), got


def _evidence(m: int, got: list, rate: float, k: float) -> tuple[float, int]:
    line = np.log(-np.log1p(-P_VALUE))
    x = [rate * v - np.log(k * max(m, 1)) for _, _, v in got]
    x = [v for v in x if v > -line]
    return float(sum(x)), len(x)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | None:
    spark = docs.sparkSession
    small_batches(spark)
    counts = docs.select("text").mapInArrow(_corpus_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    corpus = np.zeros(BUCKETS)
    corpus[counts.bucket.to_numpy()] = counts.n.to_numpy()
    rows = labelled(docs, labels, label, MAX_TRAIN_ROWS, MAX_TRAIN_BYTES).mapInArrow(_sketched, "doc_id long, text string, y int, m1 long, m2 long")
    # Read by several jobs below, so written once: of each group of near copies the row with the smallest id.
    rows = written(rows.groupBy("m1", "m2").agg(F.min_by(F.struct("text", "y"), F.struct("doc_id", "text", "y")).alias("row")).select("row.*"))

    def presence(batches):
        seen = np.zeros((2, BUCKETS), np.int64)
        n = np.zeros(2, np.int64)
        for b in batches:
            y = b.column("y").to_numpy()
            for i, raw, offsets in slices(b.column("text")):
                *both, w = _buckets(raw, offsets)
                for bucket in both:
                    v, t = distinct(bucket, w.text)
                    for c in (0, 1):
                        seen[c] += np.bincount(v[y[i + t] == c], minlength=BUCKETS)
                for c in (0, 1):
                    n[c] += (y[i : i + len(w.count)] == c).sum()
        some = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[0][some], n[0])), pa.array(np.append(seen[1][some], n[1]))], ["bucket", "clean", "toxic"])

    both = rows.select("text", "y").mapInArrow(presence, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    size = both[both.bucket == -1]
    if not len(size) or not size.clean.iloc[0] or not size.toxic.iloc[0]:
        return None
    body = both[both.bucket >= 0]
    y = np.zeros((2, BUCKETS))
    y[0, body.bucket.to_numpy()], y[1, body.bucket.to_numpy()] = body.clean.to_numpy(), body.toxic.to_numpy()
    prior = PRIOR * (corpus + 0.01) / (corpus + 0.01).sum()
    odds = [np.log((y[c] + prior) / (y[c].sum() + PRIOR - y[c] - prior)) for c in (0, 1)]
    delta = odds[1] - odds[0]
    error = np.sqrt(1 / (y[0] + prior) + 1 / (y[1] + prior))
    scores = np.sign(delta) * np.maximum(0, np.abs(delta) - SHRINK * error) - COST

    # lambda: the positive root of mean exp(lambda * score) = 1 over the words of clean rows, whose mean score is below zero.
    first = spark.sparkContext.broadcast(scores)

    def spread(batches):
        total = np.zeros(len(GRID) - 1, np.int64)
        for b in batches:
            for _, raw, offsets in slices(b.column("text")):
                word, stem, _ = _buckets(raw, offsets)
                total += np.histogram(np.clip(np.maximum(first.value[word], first.value[stem]), GRID[0], GRID[-1]), GRID)[0]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bin", "n"])

    bins = rows.where("y = 0").select("text").mapInArrow(spread, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    value, share = GRID[bins.bin.to_numpy()] + (GRID[1] - GRID[0]) / 2, bins.n.to_numpy() / max(1, bins.n.sum())
    less = max(0.0, float(share @ value) + 0.05)
    scores, value = scores - less, value - less
    low, high = 1e-3, 1.0
    while share @ np.exp(high * value) < 1 and high < 16:
        low, high = high, 2 * high
    for _ in range(50):
        rate = (low + high) / 2
        low, high = (rate, high) if share @ np.exp(rate * value) < 1 else (low, rate)
    shared = spark.sparkContext.broadcast(scores.astype(np.float32))

    def best(batches):
        for b in batches:
            got = list(found(b.column("text"), shared.value.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in got], pa.int64()), pa.array([max((v for *_, v in g), default=0.0) for _, g in got], pa.float64())], ["m", "top"])

    clean = rows.where("y = 0").select("text").mapInArrow(best, "m long, top double").where("m > 0").toPandas()
    m = clean.m.to_numpy(float)
    # K: the maximum-likelihood value of the extreme-value law for a known lambda.
    k = max(1e-9, len(m) / max(1e-9, float((m * np.exp(-rate * clean.top.to_numpy())).sum())))

    def weighed(batches):
        for b in batches:
            x = [_evidence(n, got, rate, k)[0] for n, got in found(b.column("text"), shared.value.astype(np.float64))]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(x, pa.float64())], ["y", "x"])

    fit = rows.select("text", "y").mapInArrow(weighed, "y int, x double").toPandas()  # two numbers a row of the bounded sample
    slope, offset = _logistic(np.log1p(fit.x.to_numpy()), fit.y.to_numpy(float))
    return Model(scores.astype(np.float32), float(rate), float(k), slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak pull to zero that keeps a separable fit finite."""
    a = np.array([0.0, 0.0])
    z = np.column_stack([x, np.ones(len(x))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        pull = np.array([0.05, 0.05])
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * a)
        a = a + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(a[0])), float(a[1])


def toxicity(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The kept columns of docs, score, passages (first and last word, segment score, evidence) and predicted."""
    spark, keep = docs.sparkSession, kept(keep, "score", "n_words", "passages", "predicted")
    small_batches(spark)
    passage = "array<struct<first_word:long,last_word:long,gain:double,evidence:double>>"
    fields = StructType([docs.schema[c] for c in keep] + [StructField("score", DoubleType()), StructField("n_words", LongType())])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", passages {passage}"
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("gain", pa.float64()), ("evidence", pa.float64())]))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        mod = shared.value
        scores = mod.scores.astype(np.float64) if mod else np.full(BUCKETS, -1.0)
        for b in batches:
            score, words, spans = [], [], []
            for m, got in found(b.column("text"), scores):
                own = []
                if mod:
                    line = -np.log(-np.log1p(-P_VALUE))
                    own = [{"first_word": a, "last_word": z, "gain": v, "evidence": e} for a, z, v in got if (e := float(mod.rate * v - np.log(mod.k * max(m, 1)))) > line]
                    x = np.log1p(sum(p["evidence"] for p in own))
                    score.append(1 / (1 + np.exp(-np.clip(mod.slope * x + mod.offset, -30, 30))))
                else:
                    score.append(0.0)
                words.append(m)
                spans.append(own)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score, pa.float64()), pa.array(words, pa.int64()), pa.array(spans, kind)], [*keep, "score", "n_words", "passages"])

    out = docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
