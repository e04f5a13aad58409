"""Mixing sources to target weights by the cube method.

Sources share a budget by weight, capped at REPEAT times their own size, the excess
being shared again until none is above. A source's documents are then all wanted
target / size times: each is taken the whole number of times, and once more with the
fraction as inclusion probability. The cube method turns these probabilities into
yes or no: it moves three undecided documents at a time along the null space of the
two balancing constraints (number of documents, number of words) until one of them
is decided, so both totals stay exactly where they were. Blocks of a source fly
independently and keep at most two undecided documents each; these meet in larger
levels, until two a source remain. Landing decides those two, and exchanges one pair of
the last level's documents whose lengths differ by what the total is then off.

Rows are first counted by id, source, size and digest of the text; what such a count
stands for can't be told apart. Counts are cut into bundles of at most BUNDLE rows with
running numbers, and bundles are dealt to blocks by hash, so that neither a hot source
nor a hot id, null or repeated, fills one block: each has about BLOCK rows. Random
choices are seeded by the rows of a block: reruns agree, however the input is dealt.

Sources are ranked by range partitions and the counts of the partitions before.

Defined cases: null and empty texts have size 0 and are taken 0 words; null sources
are one source, ordered last; equal rows are separate units; a source without words
has target 0; null and repeated ids are as any others; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._run import small_batches, table, written
from barloom.llm._text import BLANK_WORDS, Words, mix, slices

WEIGHTS = (3, 1, 2)
#: The mix's words for each 100 of the corpus.
BUDGET = 150
REPEAT = 2
BLOCK = 1024
#: Rows that are dealt together.
BUNDLE = 64
_UNIT = "doc_id long, source string, size long, digest long, first long, many int, source_size long, target double, whole long, p double, blocks long"


def _sized(batches):
    for b in batches:
        n = [Words(raw, offsets, BLANK_WORDS).count for _, raw, offsets in slices(b.column("text"))]
        own = ["doc_id", "source", "digest"]
        yield pa.RecordBatch.from_arrays([*map(b.column, own), pa.array(np.concatenate([np.zeros(0, np.int64), *n]).astype(np.int64))], [*own, "size"])


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank: 1 for the first source by code point, null last."""
    order = F.col("source").asc_nulls_last()
    rows = written(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before, total = {}, 0
    for r in sorted(rows.groupBy("part").count().collect()):  # one row a partition
        before[r.part], total = total, total + r["count"]
    if not before:
        return rows.select(*sources.columns, F.lit(1).alias("rank"))
    base = F.create_map(*(F.lit(int(x)) for pair in before.items() for x in pair))
    return rows.select(*sources.columns, (F.row_number().over(Window.partitionBy("part").orderBy(order)) + F.element_at(base, F.col("part"))).alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: int = BUDGET, repeat: int = REPEAT) -> DataFrame:
    """source, n, source_size and target of each source of sources (source, n, source_size)."""
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    known = written(ranked(sources).withColumn("weight", weight))
    level, capped = 0.0, -1
    while True:
        above = F.col("source_size") * repeat < F.lit(level) * F.col("weight")
        s = known.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, F.col("source_size") * repeat).otherwise(0)).alias("full"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights"),
            F.count(F.when(above, 1)).alias("capped"),
        ).head()
        if s.all is None or not s.weights or s.capped == capped:
            break
        level, capped = (s.all * budget / 100 - s.full) / s.weights, s.capped
    return known.select("source", "n", "source_size", F.least(F.col("source_size") * float(repeat), F.lit(level) * F.col("weight")).alias("target"))


def _flight(p: list[float], size: list[int], rng: np.random.RandomState, land: bool) -> list[float]:
    """The inclusion probabilities moved to 0 or 1, but for at most two; for none if the flight shall land."""
    p = list(p)

    def move(units, u):
        up = min(((1 - p[i]) / d if d > 0 else -p[i] / d) for i, d in zip(units, u, strict=True) if d)
        down = min((p[i] / d if d > 0 else (p[i] - 1) / d) for i, d in zip(units, u, strict=True) if d)
        go = up if rng.random_sample() * (up + down) < down else -down
        for i, d in zip(units, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + go * d))
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = round(p[i])
        return [i for i in units if 0 < p[i] < 1]

    open_: list[int] = []
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        open_.append(i)
        while len(open_) == 3:
            a, b, c = (size[k] for k in open_)
            u = (b - c, c - a, a - b)
            if not any(u):
                u = (1, -1, 0)
            big = max(map(abs, u))
            open_ = move(open_, [x / big for x in u])
    if land:
        while len(open_) == 2:  # keeps the number of documents, gives up that of words
            open_ = move(open_, [1, -1])
        for i in open_:
            p[i] = float(rng.random_sample() < p[i])
    return p


def _exchanged(p: np.ndarray, size: np.ndarray, goal: float) -> np.ndarray:
    """One taken and one left document change places if that brings the words nearer to the goal."""
    off = goal - float(p @ size)
    taken, left = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
    if len(taken) and len(left):
        left = left[np.argsort(size[left], kind="stable")]
        near = np.searchsorted(size[left], size[taken] + off)
        pairs = [(abs(off - (size[left[k]] - size[i])), i, left[k]) for i, n in zip(taken, near, strict=True) for k in (n - 1, n) if 0 <= k < len(left)]
        gap, i, j = min(pairs)
        if gap < abs(off):
            p[i], p[j] = 0.0, 1.0
    return p


def _flown(last: bool, level: int):
    def run(group: pa.Table) -> pa.Table:
        many = group.column("many").to_numpy()
        nth = np.concatenate([np.zeros(0, np.int64), *(np.arange(k) for k in many)]).astype(np.int64)
        group = group.take(pa.array(np.repeat(np.arange(len(many)), many)))
        nth += group.column("first").to_numpy()
        ids, digest = group.column("doc_id").fill_null(0).to_numpy(), group.column("digest").to_numpy()
        size, p = group.column("size").to_numpy(), group.column("p").to_numpy()
        turn = mix(ids.astype(np.uint64) + mix(digest.astype(np.uint64) + nth.astype(np.uint64)))
        order = np.lexsort((nth, digest, size, ids, turn))
        group, p, size, nth = group.take(pa.array(order)), p[order], size[order], nth[order]
        rng = np.random.RandomState(zlib.crc32(turn[order].tobytes(), level))
        new = np.array(_flight(p.tolist(), size.tolist(), rng, last), np.float64)
        if last:
            moved = (p > 0) & (p < 1)
            new[moved] = _exchanged(new[moved], size[moved].astype(float), float(p[moved] @ size[moved]))
        for name, value in (("p", pa.array(new, pa.float64())), ("first", pa.array(nth)), ("many", pa.array(np.ones(len(p), np.int32)))):
            group = group.set_column(group.schema.get_field_index(name), name, value)
        return group.drop_columns(["block"])

    return run


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row of docs (doc_id, source, text)."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("digest"), "text")
    counted = own.mapInArrow(_sized, "doc_id long, source string, digest long, size long").groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n"))
    counted = written(counted)
    wanted = written(targets(counted.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("source_size"))))
    most = wanted.agg(F.max("n").alias("n")).head().n or 0
    bundles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BUNDLE).cast("long")), lambda i: F.struct(i.alias("first"), F.least(F.lit(BUNDLE), F.col("n") - i).cast("int").alias("many")))
    units = counted.select("doc_id", "source", "size", "digest", F.inline(bundles))
    # A table of sources is joined by hash where it is small; a hot source is then never dealt to one task.
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = units.alias("u").join(wanted.alias("w"), F.col("u.source").eqNullSafe(F.col("w.source")))
    rows = rows.select("u.*", "w.source_size", "w.target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"), F.ceil(F.col("w.n") / BLOCK).alias("blocks"))
    out, level, blocks = None, 0, -(-most // BLOCK)
    while True:
        last = blocks <= 1
        block = F.pmod(F.xxhash64("doc_id", "size", "digest", "first", F.lit(level)), F.greatest(F.col("blocks"), F.lit(1)))
        flown = written(rows.withColumn("block", block).groupBy("source", "block").applyInArrow(_flown(last, level), _UNIT))
        done = flown if last else flown.where("p = 0 OR p = 1")
        out = done if out is None else out.unionByName(done)
        if last:
            break
        rows = flown.where("p > 0 AND p < 1").withColumn("blocks", F.ceil(2 * F.col("blocks") / BLOCK))
        blocks, level = -(-2 * blocks // BLOCK), level + 1
    copies = F.col("whole") + F.col("p").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("source")
