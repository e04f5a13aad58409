"""Session helpers of the training-data operators: shared scratch, folds, samples."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor shares.

    Without that setting a session in local mode uses a temporary folder, which goes with
    the process; a cluster's is refused, as its executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-barloom-", dir=os.environ.get("TMPDIR", "/tmp")))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = _OWN[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor re-reads it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.parquet(path)


def cleared(spark: SparkSession) -> int:
    """Deletes the tables that this process has written to the shared folder, and counts them; for when their results are stored."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(_MADE)
    while _MADE:
        place = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        place.getFileSystem(conf).delete(place, True)
    return n


def kept(names: tuple[str, ...], *own: str) -> list[str]:
    """The names once each, without those that an operator gives to columns of its own, whatever their case."""
    taken = {x.lower() for x in own}
    return [c for c in dict.fromkeys(names) if c.lower() not in taken]


def packed(df: DataFrame, keep: list[str], **own: Column) -> DataFrame:
    """The kept columns as one struct, named row, beside an operator's own, so that no names can clash."""
    row = F.struct(*(df[c] for c in keep)) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    return df.select(row.alias("row"), *(c.alias(name) for name, c in own.items()))


def unpacked(df: DataFrame, keep: list[str], *own: str) -> DataFrame:
    """The kept columns under their names, then the operator's own."""
    return df.select(*(F.col("row")[c].alias(c) for c in keep), *own)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, not only by rows, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no model learns from: crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, key: tuple[str, ...], most: int, text: str | None = None, most_bytes: int = 0) -> DataFrame:
    """About `most` rows, of about `most_bytes` of text if one is named, picked by the hash of their key; all rows if there are no more. Same rows on every run."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(text) if text else F.lit(0))).first()
    share = min(1.0, most / max(1, n), most_bytes / size if text and size else 1.0)
    return df if share == 1.0 else df.where(F.pmod(F.xxhash64(*key, F.lit(71)), F.lit(1 << 30)) < int(share * (1 << 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int) -> DataFrame:
    """doc_id, text and y of documents with a label 0 or 1 outside the held-out fold: different rows, at most about `most` of them and `most_bytes` of text.

    Labels are cut first, so that they can be broadcast; the rows that they meet are cut again, as an id may be repeated.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    known = F.broadcast(bounded_sample(known, ("doc_id",), most))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id").distinct()
    return bounded_sample(written(rows), ("doc_id", "text"), most, "text", most_bytes)
