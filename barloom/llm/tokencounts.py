"""Token counts as rollups that are maintained by deltas.

A change inserts a document's count, deletes it, or revises it from an old to a new
one. A batch of changes becomes signed sums of documents and tokens by source,
language and tokenizer version, which are additive: the totals are the sums over all
committed batches, and no batch reads an earlier one. A batch is written under a name of
its own and committed by renaming its folder to the batch's id, which fails if another
writer was first. Committing an id again does nothing; a batch that failed half-way was
never renamed and isn't counted.

Counting splits texts with the tokenizer's pattern and looks up each different
piece's number of tokens once a task, as most pieces are frequent words.

Defined cases: null and empty texts have 0 tokens; null source or lang is a group of
its own; changes are counted one by one, repeated ones too; groups whose totals are 0
documents and 0 tokens stay out of the totals; other columns are ignored, a kept column
named n_tokens gives way to the count; an empty batch commits, an empty ledger has no
totals. In the registered query one row of each text stays, that of the smallest id,
null ids last; null texts are no copies of each other, empty texts are.
"""

from __future__ import annotations

import base64
import re
import uuid
from functools import lru_cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barloom.llm._run import kept, scratch, small_batches, table, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer splits a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP = ("source", "lang", "tokenizer")
#: Pieces whose counts a task remembers, and the characters of the longest.
MEMORY, LONGEST = 300_000, 64


@lru_cache(2)
def _encoder(path: str):
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    class Known(dict):
        def __missing__(self, piece):
            n = len(encode(piece))
            if len(piece) <= LONGEST:
                if len(self) >= MEMORY:
                    self.clear()
                self[piece] = n
            return n

    return regex.compile(PATTERN).findall, Known()


def with_tokens(docs: DataFrame, *keep: str, path: str = TOKENIZER) -> DataFrame:
    """The kept columns of docs (text) and n_tokens under the vocabulary file at path, which each executor has."""
    small_batches(docs.sparkSession)
    keep = kept(keep, "n_tokens")
    schema = StructType([docs.schema[c] for c in keep] + [StructField("n_tokens", LongType())])

    def run(batches):
        split, known = _encoder(path)
        for b in batches:
            n = [sum(map(known.__getitem__, split(t))) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def delta(changes: DataFrame) -> DataFrame:
    """Signed sums by group of changes (source, lang, tokenizer, kind, n_tokens, old_tokens); kind is insert, delete or revise."""
    kind = F.col("kind")
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0)
    tokens = F.when(kind == "insert", F.col("n_tokens")).when(kind == "delete", -F.col("n_tokens")).when(kind == "revise", F.col("n_tokens") - F.col("old_tokens"))
    checked = F.when(docs.isNull(), F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(kind, F.lit("null"))))).otherwise(docs)
    return changes.groupBy(*GROUP).agg(F.sum(checked).cast("long").alias("documents"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"))


class Ledger:
    """A folder with one sub-folder for each batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place, jvm

    def committed(self, batch: str) -> bool:
        fs, place, _ = self._files(f"{self.path}/batch={batch}/_SUCCESS")
        return fs.exists(place)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the batch unless it is there already; says whether it did. Of several writers of one id one does."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"no batch id: {batch}")
        if self.committed(batch):
            return False
        draft = f"{self.path}/draft-{uuid.uuid4().hex}"
        delta(changes).write.parquet(draft)
        fs, source, jvm = self._files(draft)
        _, goal, _ = self._files(f"{self.path}/batch={batch}")
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.valueOf("OVERWRITE")  # an empty folder at most
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(source, goal, how)
        except Py4JJavaError:
            fs.delete(source, True)
            if not self.committed(batch):
                raise
            return False
        return True

    def totals(self) -> DataFrame:
        """documents and tokens by source, lang and tokenizer over the committed batches."""
        fs, place, _ = self._files(self.path)
        found = [str(s.getPath()) for s in fs.listStatus(place) if "batch=" in str(s.getPath().getName())] if fs.exists(place) else []
        done = [p for p in found if self.committed(p.rpartition("batch=")[2])]
        schema = "source string, lang string, tokenizer string, documents long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*sorted(done)) if done else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Loads all documents, removes exact copies, recounts documents with repeated lines without these; batches are delivered twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.monotonically_increasing_id().alias("row"))
    lines = F.split("text", "\n")
    once = F.array_distinct(lines)
    # Each document, and once more without repeated lines if it has any; rows get their numbers where both are written.
    forms = F.array(F.struct(F.lit(False).alias("again"), "text"), F.when(F.size(once) < F.size(lines), F.struct(F.lit(True).alias("again"), F.array_join(once, "\n").alias("text"))))
    keep = ("row", "doc_id", "source", "lang")
    docs = docs.select(*keep, F.md5(F.col("text").cast("binary")).alias("mark"), F.inline(F.filter(forms, F.isnotnull)))
    counts = written(with_tokens(docs, *keep, "mark", "again"))
    version = F.lit("byte_bpe_50k-1").alias("tokenizer")
    none = F.lit(None).cast("long").alias("old_tokens")
    full = counts.where("NOT again")
    first = full.where("mark IS NOT NULL").groupBy("mark").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"), F.min("n_tokens").alias("old_tokens"))
    first = written(first.select("mark", F.col("first.row").alias("first"), "old_tokens"))  # a table, so that a join with a hot mark can be split
    copies = full.join(first, "mark").where("row <> first")
    revised = counts.where("again").join(first, "mark").where("row = first")
    batches = {
        "load": full.select("source", "lang", version, F.lit("insert").alias("kind"), "n_tokens", none),
        "copies": copies.select("source", "lang", version, F.lit("delete").alias("kind"), "n_tokens", none),
        "lines": revised.select("source", "lang", version, F.lit("revise").alias("kind"), "n_tokens", "old_tokens"),
    }
    ledger = Ledger(spark, scratch(spark))
    for _ in range(2):
        for name, changes in batches.items():
            ledger.commit(name, changes)
    return ledger.totals()
