"""Benchmark items inside documents by size-partitioned containment MinHash.

A short item inside a long document has a tiny Jaccard similarity, so documents
are not sketched: each item keeps the SKETCH smallest hashes of its shingles, and
a document's share of those hashes estimates the item's containment in it, however
long the document. Items are partitioned by size. Up to SKETCH shingles the sketch
is the item, and the estimate exact; above, at least MATCHES of SKETCH hashes must
be present (a containment of 0.75 fails that less than twice in a million). A
partition is skipped for documents too short to contain its smallest item.
Every candidate is verified by the exact containment of the whole shingle sets.

Items of up to BROADCAST_SHINGLES shingles in sum, counted first, are broadcast as one
index, and documents are read once without a shuffle. Beyond, the sketches are a table:
each document's hashes that a bitmap of fixed size (FILTER_BITS) can't rule out are
joined with it, candidates are counted by document and item, and those that reach the
threshold are joined with both whole texts. Both ways give the same rows.

Defined cases: null, empty and word-free texts contain nothing and are contained in
nothing; an item of one to four words is one shingle and matches only a document of
just these words; repeated documents repeat their hits, repeated items do not; null
ids are reported as null; items are told apart by id and shingle set; other columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._run import small_batches, table, written
from barloom.llm._text import mix, shingles, slices

WORDS = 5
SKETCH = 32
MATCHES = 12
#: Least share of an item's shingles that a contaminated document holds, in hundredths.
CONTAINED = 75
#: Shingles of items that are broadcast, 8 bytes each.
BROADCAST_SHINGLES = 2_000_000
#: Bits of the filter that decides which hashes of documents are shuffled beyond that.
FILTER_BITS = 1 << 27


def _item_sets(batches):
    for b in batches:
        sets = []
        for _, raw, offsets in slices(b.column("text")):
            v, _, n = shingles(raw, offsets, WORDS)
            sets += np.split(v.view(np.int64), np.cumsum(n)[:-1])
        size = np.array([len(x) for x in sets], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(size), lists], ["item_id", "n", "shingles"])


class _Index:
    """A block of items: postings of sketch hashes by size partition, and each item's whole set."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.sets = [np.sort(s.view(np.uint64)) for _, s in items]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.need = np.where(self.size > SKETCH, MATCHES, -(-CONTAINED * self.size // 100))
        self.parts = []
        kind = np.floor(np.log2(np.maximum(1, self.size))).astype(int)
        for p in np.unique(kind):
            own = np.flatnonzero(kind == p)
            heads = [self.sets[i][:SKETCH] for i in own]
            value, item = np.concatenate(heads), np.repeat(own, [len(x) for x in heads])
            order = np.argsort(value, kind="stable")
            self.parts.append((int(-(-CONTAINED * self.size[own].min() // 100)), value[order], item[order]))

    def hits(self, v: np.ndarray, t: np.ndarray, n: np.ndarray):
        """(text, item, shingles in common) of contained items; v has each text's sorted set."""
        first = np.concatenate([[0], np.cumsum(n)])
        for least, value, item in self.parts:
            long = n[t] >= least
            own, text = (v, t) if long.all() else (v[long], t[long])
            low, high = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
            many = high - low
            some = many > 0
            many = many[some]
            at = np.repeat(low[some], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            pair, count = np.unique(np.stack([np.repeat(text[some], many), item[at]]), axis=1, return_counts=True)
            for a, i in pair[:, count >= self.need[pair[1]]].T if len(count) else ():
                both = len(np.intersect1d(v[first[a] : first[a + 1]], self.sets[i], assume_unique=True))
                if 100 * both >= CONTAINED * self.size[i]:
                    yield int(a), int(i), both


def _bitmap(batches):
    for b in batches:
        bits = np.unique(mix(b.column("value").to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
        byte, first = np.unique(bits >> 3, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(byte), pa.array(np.bitwise_or.reduceat(1 << (bits & 7), first))], ["byte", "bits"])


def _verified(batches):
    for b in batches:
        both = []
        lists = b.column("shingles")
        for i, raw, offsets in slices(b.column("text")):
            v, _, n = shingles(raw, offsets, WORDS)
            both += [len(np.intersect1d(x, lists[i + k].values.to_numpy().view(np.uint64), assume_unique=True)) for k, x in enumerate(np.split(v, np.cumsum(n)[:-1]))]
        own = [b.column(c) for c in ("doc_id", "item_id", "n_item")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(both, pa.int64())], ["doc_id", "item_id", "n_item", "n_common"])


def _joined(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_common of docs (doc_id, text) and sets (item_id, n, shingles) of any number."""
    spark = docs.sparkSession
    sets = written(sets.withColumn("item", F.monotonically_increasing_id()))
    order = F.array_sort("shingles", lambda x, y: F.when(x.bitwiseXOR(F.lit(-(1 << 63))) < y.bitwiseXOR(F.lit(-(1 << 63))), -1).when(x == y, 0).otherwise(1))  # as unsigned
    heads = written(sets.select("item", "n", F.explode(F.slice(order, 1, SKETCH)).alias("value")))
    parts = heads.select("value").mapInArrow(_bitmap, "byte long, bits long").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toPandas()
    filter_ = np.zeros(FILTER_BITS // 8, np.uint8)
    filter_[parts.byte.to_numpy()] = parts.bits.to_numpy()
    shared = spark.sparkContext.broadcast(filter_)
    docs = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))

    def hashes(batches):
        for b in batches:
            row, many, value = b.column("row").to_numpy(), [], []
            at = []
            for i, raw, offsets in slices(b.column("text")):
                v, t, n = shingles(raw, offsets, WORDS)
                bit = mix(v) % np.uint64(FILTER_BITS)
                maybe = (shared.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                at.append(i + t[maybe])
                many.append(n[t[maybe]])
                value.append(v[maybe])
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(row[np.concatenate([*at, *none])]), pa.array(np.concatenate([*many, *none]).astype(np.int64)), pa.array(np.concatenate([*value, np.zeros(0, np.uint64)]).view(np.int64))], ["row", "many", "value"])

    met = docs.select("row", "text").mapInArrow(hashes, "row long, many long, value long").join(heads, "value").where(f"100 * many >= {CONTAINED} * n")
    need = F.when(F.col("n") > SKETCH, MATCHES).otherwise(F.ceil(F.col("n") * CONTAINED / 100))
    pairs = met.groupBy("row", "item", "n").count().where(F.col("count") >= need)
    both = pairs.select("row", "item").join(docs, "row").join(sets.select("item", "item_id", F.col("n").alias("n_item"), "shingles"), "item")
    found = both.select("doc_id", "item_id", "n_item", "text", "shingles").mapInArrow(_verified, "doc_id long, item_id long, n_item long, n_common long")
    return found.where(f"100 * n_common >= {CONTAINED} * n_item")


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_common, containment of every item of items (item_id, text) inside a row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().mapInArrow(_item_sets, "item_id long, n long, shingles array<long>").where("n > 0").distinct()
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head().n
    if total > BROADCAST_SHINGLES:
        return _joined(docs, sets).withColumn("containment", F.col("n_common") / F.col("n_item"))
    index = spark.sparkContext.broadcast(_Index([(r.item_id, np.array(r.shingles, np.int64)) for r in sets.collect()]))

    def run(batches):
        ix = index.value
        for b in batches:
            ids, rows = b.column("doc_id"), []
            for i, raw, offsets in slices(b.column("text")):
                rows += [(i + a, ix.ids[j], int(ix.size[j]), both) for a, j, both in ix.hits(*shingles(raw, offsets, WORDS))]
            at, item, size, both = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(size, pa.int64()), pa.array(both, pa.int64())], ["doc_id", "item_id", "n_item", "n_common"])

    out = docs.mapInArrow(run, "doc_id long, item_id long, n_item long, n_common long")
    return out.withColumn("containment", F.col("n_common") / F.col("n_item"))


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contaminated documents with the items they hold; clean documents have no row."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
items AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM ds JOIN items USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_common, n_common / n_item AS containment FROM c JOIN n USING (item_id) WHERE 100 * n_common >= 75 * n_item
"""
