"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Features of a text are its words and runs of signs, its pairs of neighbours, and
whether a neighbour repeats the word before it, each hashed into BUCKETS columns
and weighted by its share of the text, so that length doesn't matter. Training
shards a bounded sample of labelled rows; each shard makes FTRL-proximal updates
(adaptive rates, L1 and L2) and the shards' weights are averaged. A score is a
sparse dot product with the broadcast weights, whose size is fixed by BUCKETS.

Defined cases: a null or empty text has only the bias, as the corpus' share of
good rows; repeated rows get equal scores and are learned from once; rows without a label, a null label or
a null doc_id are never learned from; without any usable label every score is
0.5; other columns are ignored, a kept one named score (or, in quality, predicted) gives
way to the result; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._run import held_out, kept, labelled, small_batches, table
from barloom.llm._text import WORDS_AND_SIGNS, Words, mix, slices

BUCKETS = 1 << 18
#: At most about so many labelled rows, and bytes of their texts, are learned from.
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 20_000, 128 << 20
ROWS_A_SHARD = 2_500
EPOCHS = 3
GOOD = 0.7
#: Shares are small numbers; this brings them to the order of 1.
SCALE = 30.0


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every feature occurrence of a slice, and the occurrences by text. Bucket 0 is the bias."""
    w = Words(raw, offsets, WORDS_AND_SIGNS)
    h, t = w.hashes(), w.text
    same_text = t[1:] == t[:-1]
    pair = mix(h[:-1] * np.uint64(3) + h[1:])[same_text]
    again = (h[:-1] == h[1:])[same_text]
    top = np.uint64(BUCKETS - 3)
    bucket = np.concatenate([h % top, pair % top, np.where(again, BUCKETS - 4, BUCKETS - 5).astype(np.uint64)]).astype(np.int64) + 3
    text = np.concatenate([t, t[1:][same_text], t[1:][same_text]])
    return bucket, text, np.bincount(text, minlength=len(offsets) - 1)


def _trained(rule: Ftrl):
    def run(batches):
        rows = []
        for b in batches:
            y = b.column("y").to_numpy()
            for i, raw, offsets in slices(b.column("text")):
                bucket, text, n = features(raw, offsets)
                order = np.argsort(text, kind="stable")
                for k, own in enumerate(np.split(bucket[order], np.cumsum(n)[:-1])):
                    idx, count = np.unique(own, return_counts=True)
                    rows.append((np.concatenate([[0], idx]), np.concatenate([[1.0], SCALE * count / max(1, n[k])]), float(y[i + k])))
        if not rows:
            return
        z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
        rng = np.random.RandomState(3)

        def weight(i):
            w = -(z[i] - np.sign(z[i]) * rule.l1) / ((rule.beta + np.sqrt(n[i])) / rule.alpha + rule.l2)
            return np.where(np.abs(z[i]) <= rule.l1, 0.0, w)

        for _ in range(EPOCHS):
            for k in rng.permutation(len(rows)):
                idx, x, y = rows[k]
                w = weight(idx)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
                z[idx] += g - (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / rule.alpha * w
                n[idx] += g * g
        used = np.flatnonzero(n)
        w = weight(used)
        used, w = used[w != 0], w[w != 0] * len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(w, len(rows)))], ["bucket", "w"])  # -1: the shard's rows

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rule: Ftrl = Ftrl()) -> np.ndarray:  # noqa: B008
    """Weights by bucket, learned from labelled rows outside the held-out fold."""
    sample = labelled(docs, labels, label, MAX_TRAIN_ROWS, MAX_TRAIN_BYTES)
    n = sample.count()
    out = np.zeros(BUCKETS)
    if not n:
        return out
    shards = max(1, min(8, n // ROWS_A_SHARD))
    rows = sample.select("text", F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(shards)).alias("shard"))
    fits = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", F.xxhash64("text")).select("text", "y").mapInArrow(_trained(rule), "bucket long, w double")
    total = fits.groupBy("bucket").agg(F.sum("w").alias("w")).toPandas()
    size = float(total.loc[total.bucket == -1, "w"].sum())
    body = total[total.bucket >= 0]
    out[body.bucket.to_numpy()] = body.w.to_numpy() / max(1.0, size)
    return out


def score(docs: DataFrame, weights: np.ndarray, *keep: str) -> DataFrame:
    """The kept columns of docs and score: the probability of label 1."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark, keep = docs.sparkSession, kept(keep, "score")
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        w = shared.value
        for b in batches:
            parts = [np.zeros(0)]
            for _, raw, offsets in slices(b.column("text")):
                bucket, text, n = features(raw, offsets)
                parts.append(float(w[0]) + SCALE * np.bincount(text, weights=w[bucket], minlength=len(n)) / np.maximum(1, n))
            x = np.clip(np.concatenate(parts), -30, 30)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(1 / (1 + np.exp(-x)))], [*keep, "score"])

    schema = StructType([docs.schema[c] for c in keep] + [StructField("score", DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, score and predicted (1 from GOOD on) of each row of docs, whose text it reads."""
    small_batches(docs.sparkSession)
    return score(docs, train(docs, labels), *keep).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
