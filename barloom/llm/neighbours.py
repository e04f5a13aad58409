"""Approximate nearest neighbours by balanced posting lists.

Largest inner products become smallest distances: a vector x gets the coordinate
sqrt(M^2 - |x|^2), M being the largest norm, and a query gets length M and 0 there. Lists
are fitted to a bounded sample: a tree of equal halves, then rounds of means that charge
a list for being long. Every vector is posted to its nearest list and, if it lies at a
border, to further ones about as near. A graph of the lists' centroids, each linked to
its nearest and a few distant ones, is held in memory and searched best first for
vectors and queries alike; a query reads the lists whose distance is within a ratio
of the nearest one's.

Equal vectors are one posting with their smallest ids, so copies don't crowd a list.
Lists and the queries that meet at one are cut into blocks by their counted sizes, and
each pair of blocks is one task's product; a query's best are ranked after that, at most
`most` + 1 a block. Queries whose lists hold too few candidates read all lists.

Bounds: SAMPLE_ROWS rows and SAMPLE_VALUES numbers are fitted on the driver, and
centroids, an eighth of them at most, are broadcast. Every vector is posted and searched.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows without an id, nor lengths other than the commonest (of
equally common ones the longest); repeated equal rows count once; a query's candidates are the rows with other
ids, and an id with several vectors is as many queries; equal scores rank by id; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._run import small_batches, table, written

MOST = 20
EVERY = 20
#: The sample that lists are fitted on.
SAMPLE_ROWS, SAMPLE_VALUES = 32_768, 4_000_000
#: Vectors a list, and sampled vectors a list at least.
LIST_SIZE, FITTED = 256, 8
ROUNDS = 8
#: A vector is posted to further lists within this ratio of the nearest distance.
BORDER, REPLICAS = 1.10, 4
#: A query reads the lists within this ratio of the nearest distance.
REACH, PROBES = 1.20, 64
#: Links of a centroid to its nearest and to distant ones; nodes that a search keeps at least.
NEAR_LINKS, FAR_LINKS, BEAM = 24, 8, 32
VECTORS_A_BLOCK, QUERIES_A_BLOCK = 4096, 1024


@dataclass(frozen=True)
class Lists:
    """Centroids with the added coordinate, their links and where a search begins."""

    norm: float
    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0, norm**2 - (x * x).sum(1)))])


def aimed(q: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([q * (norm / np.sqrt((q * q).sum(1)))[:, None], np.zeros(len(q))])


def _halved(x: np.ndarray, n: int) -> np.ndarray:
    """Means of n parts of equal size, by halving along the direction of most spread."""
    means, todo, rng = [], [(np.arange(len(x)), n)], np.random.RandomState(5)
    while todo:
        own, k = todo.pop()
        part = x[own]
        if k == 1:
            means.append(part.mean(0))
            continue
        centred, way = part - part.mean(0), rng.standard_normal(x.shape[1])
        for _ in range(6):
            way = centred.T @ (centred @ way)
            way /= max(1e-300, np.sqrt(way @ way))
        cut = len(own) * (k // 2) // k
        order = np.argpartition(centred @ way, cut)
        todo += [(own[order[cut:]], k - k // 2), (own[order[:cut]], k // 2)]
    return np.array(means)


def fitted(sample: np.ndarray, norm: float, n: int) -> Lists:
    """n lists, or fewer if the sample has fewer than FITTED vectors for each."""
    x = lifted(sample, norm)
    n = max(1, min(n, len(x) // FITTED))
    c, charge = _halved(x, n), np.zeros(n)
    square = (x * x).sum(1)
    for _ in range(ROUNDS):
        total, count, spread = np.zeros_like(c), np.zeros(n), 0.0
        for i in range(0, len(x), 2048):
            d = square[i : i + 2048, None] + (c * c).sum(1) - 2 * x[i : i + 2048] @ c.T
            at = (d + charge).argmin(1)
            np.add.at(total, at, x[i : i + 2048])
            count += np.bincount(at, minlength=n)
            spread += float(d[np.arange(len(at)), at].sum())
        c = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], c)
        charge = charge / 2 + 0.1 * spread / len(x) * (count * n / len(x) - 1)
    return _linked(norm, c)


def _linked(norm: float, c: np.ndarray) -> Lists:
    n, rng = len(c), np.random.RandomState(9)
    near = np.empty((n, min(NEAR_LINKS, n - 1)), np.int64)
    for i in range(0, n, 1024):
        d = (c * c).sum(1) - 2 * c[i : i + 1024] @ c.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near[i : i + 1024] = np.argsort(d, 1, kind="stable")[:, : near.shape[1]]
    far = rng.randint(0, n, (n, FAR_LINKS))
    entries = rng.permutation(n)[: min(n, int(4 * np.sqrt(n)))]
    return Lists(norm, c, np.concatenate([near, far], 1), np.sort(entries))


def searched(lists: Lists, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, distance) of the `most` nearest centroids of each row found by the graph; -1 and inf where there are fewer."""
    c, n, rows = lists.centroids, len(lists.centroids), np.arange(len(x))[:, None]
    square, width = (c * c).sum(1), max(most + most // 2, BEAM)
    away = lambda nodes: square[nodes] - 2 * np.einsum("bd,bkd->bk", x, c[nodes])  # noqa: E731  less |x|^2, the same for all
    seen = np.zeros((len(x), n), bool)
    node = np.broadcast_to(lists.entries, (len(x), len(lists.entries)))
    seen[rows, node] = True
    d, done = away(node), np.zeros(node.shape, bool)
    while True:
        if node.shape[1] > width:
            best = np.argpartition(d, width - 1, 1)[:, :width]
            node, d, done = node[rows, best], d[rows, best], done[rows, best]
        open_ = np.where(done, np.inf, d)
        pick = np.argpartition(open_, min(4, open_.shape[1]) - 1, 1)[:, :4]
        live = np.isfinite(open_[rows, pick])
        if not live.any():
            break
        done[rows, pick] = True
        new = lists.links[np.maximum(node[rows, pick], 0)].reshape(len(x), -1)
        fresh = np.repeat(live, lists.links.shape[1], 1) & ~seen[rows, new]
        new = np.where(fresh, new, n)
        order = np.argsort(new, 1, kind="stable")
        ranked = np.take_along_axis(new, order, 1)
        twice = np.zeros_like(fresh)  # a node that two links name is taken once
        np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        fresh &= ~twice
        seen[np.broadcast_to(rows, new.shape)[fresh], new[fresh]] = True
        width_new = int(fresh.sum(1).max(initial=0))
        if width_new:
            front = np.argsort(~fresh, 1, kind="stable")[:, :width_new]
            real, new = fresh[rows, front], np.minimum(new[rows, front], n - 1)
            node = np.concatenate([node, np.where(real, new, -1)], 1)
            d = np.concatenate([d, np.where(real, away(new), np.inf)], 1)
            done = np.concatenate([done, ~real], 1)
    order = np.argsort(d, 1, kind="stable")[:, :most]
    d = d[rows, order]
    return np.where(np.isfinite(d), node[rows, order], -1), np.sqrt(np.maximum(0, d + (x * x).sum(1)[:, None]))


def _posted(lists: Lists, rows: DataFrame, ratio: float, most: int, as_query: bool) -> DataFrame:
    """key and the lists that each of rows (key, v) is posted to, or reads as a query."""
    shared = rows.sparkSession.sparkContext.broadcast(lists)

    def run(batches):
        own = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                x = matrix(part.column("v"))
                node, d = searched(own, aimed(x, own.norm) if as_query else lifted(x, own.norm), most)
                taken = (node >= 0) & (d <= ratio * d[:, :1] + 1e-12)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.split(node[taken], np.cumsum(taken.sum(1))[:-1]), pa.list_(pa.int64()))], ["key", "lists"])

    return rows.select("key", "v").mapInArrow(run, "key long, lists array<long>")


def _best(most: int):
    """The products of one block of queries with one of vectors: each query's best ids."""
    kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        key, best = [], []
        if queries.num_rows and vectors.num_rows:
            q, v, ids = matrix(queries.column("v")), matrix(vectors.column("v")), vectors.column("ids").to_pylist()
            first = np.array([x[0] for x in ids])
            about = q @ v.T
            slack = 1e-9 * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max())
            k = min(most, len(v))
            line = np.partition(about, len(v) - k, 1)[:, len(v) - k] - slack
            for i, name in enumerate(queries.column("key").to_pylist()):
                near = np.flatnonzero(about[i] >= line[i])
                score = np.zeros(len(near))
                for t in range(q.shape[1]):  # term by term, so that a score doesn't depend on the block
                    score += q[i, t] * v[near, t]
                order = np.lexsort((first[near], -score))[:most]
                pairs = sorted(((-score[o], x) for o in order for x in ids[near[o]]))[:most]
                key.append(name)
                best.append([{"score": -s, "vec_id": x} for s, x in pairs])
        return pa.table([pa.array(key, pa.int64()), pa.array(best, kind)], ["key", "best"])

    return run


def _answered(queries: DataFrame, points: DataFrame, asked: DataFrame, posted: DataFrame, most: int) -> DataFrame:
    """key and best: the `most` best (score, vec_id) of each query over the lists that it reads."""
    spark = queries.sparkSession
    one = lambda df: df.select("key", F.explode("lists").alias("list"))
    asked, posted = one(asked), one(posted)
    # One row a list, of which there are SAMPLE_ROWS / FITTED at most: how many blocks it is cut into on either side.
    size = posted.groupBy("list").count().select("list", F.ceil(F.col("count") / VECTORS_A_BLOCK).alias("vb"))
    size = size.join(asked.groupBy("list").count().select("list", F.ceil(F.col("count") / QUERIES_A_BLOCK).alias("qb")), "list")
    blocks = F.broadcast(spark.createDataFrame(size.toPandas(), "list long, vb long, qb long"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n))
    q = asked.join(blocks, "list").select("key", "list", own("qb", 3).alias("q"), each("vb").alias("b"))
    v = posted.join(blocks, "list").select("key", "list", own("vb", 4).alias("b"), each("qb").alias("q"))
    left = q.join(queries, "key").select("list", "q", "b", "key", "v").groupBy("list", "q", "b")
    right = v.join(points, "key").select("list", "q", "b", "v", "ids").groupBy("list", "q", "b")
    found = left.cogroup(right).applyInArrow(_best(most), "key long, best array<struct<score:double,vec_id:long>>")
    rows = found.select("key", F.inline("best")).distinct()
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    return top.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))), lambda r: F.struct(r["score"], r["vec_id"])).alias("best"))


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and v, in double precision, of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


def neighbours(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = MOST, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score: the `most` largest inner products found for each row whose id `every` divides."""
    spark = df.sparkSession
    small_batches(spark)
    rows = usable(df, vec_id, vector)
    square = F.reduce("v", F.lit(0.0), lambda a, x: a + x * x)
    lengths = rows.groupBy(F.size("v").alias("long")).agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("norm"))
    common = lengths.orderBy(F.desc("n"), F.desc("long")).limit(1).collect()
    long, norm = (common[0].long, common[0].norm) if common else (0, 0.0)
    if common and not np.isfinite(norm):
        raise ValueError("the vectors are too long for double precision")
    rows = rows.where(F.size("v") == long).select("vec_id", "v", F.xxhash64("v").alias("h"))
    # Of equal vectors the most + 1 smallest ids are enough for any query; the ranks are cut before and after the shuffle.
    alone = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("r") <= most + 1)
    points = alone.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = written(points.withColumn("key", F.monotonically_increasing_id()))
    wanted = rows.where(F.col("vec_id") % every == 0).distinct()
    queries = written(wanted.select("h", "v").distinct().withColumn("key", F.monotonically_increasing_id()))
    n, total = points.agg(F.count("*"), F.sum(F.size("ids"))).first()
    fit = min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, long))
    share = int(min(1.0, fit / max(1, n)) * (1 << 30))
    sample = points.where(F.pmod(F.col("h"), F.lit(1 << 30)) < share).orderBy("h").limit(2 * fit).select("v").toArrow() if n else None
    if sample is None or not sample.num_rows:
        sample = points.limit(1).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = fitted(matrix(sample.column("v")), norm, -(-n // LIST_SIZE))
    posted = written(_posted(lists, points, BORDER, REPLICAS, False))
    asked = written(_posted(lists, queries, REACH, PROBES, True))
    best = written(_answered(queries, points, asked, posted, most + 1))
    short = queries.join(best.where(F.size("best") >= min(most + 1, total)), "key", "left_anti")
    if not short.isEmpty():
        everywhere = short.select("key", F.sequence(F.lit(0).cast("long"), F.lit(len(lists.centroids) - 1).cast("long")).alias("lists"))
        best = best.join(short, "key", "left_anti").unionByName(_answered(short, points, everywhere, posted, most + 1))
    result = queries.join(best, "key").select("h", "v", "best")
    own = F.slice(F.filter("best", lambda r: r["vec_id"] != F.col("query_id")), 1, most)
    found = wanted.select(F.col("vec_id").alias("query_id"), "h", "v").join(result, ["h", "v"]).select("query_id", F.posexplode(own).alias("at", "hit"))
    return found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def op13_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
