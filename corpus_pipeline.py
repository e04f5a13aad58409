"""A training corpus in five stages, each calling one operator of barloom.llm.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps with the
columns of documents; the last one returns the mix. Models are learned from the
documents that reach the stage. Decisions are about rows, not ids: a stage whose
operator names the documents it means numbers the rows of its input first, so null
and repeated ids lose nothing and shield nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm._run import table, written
from barloom.llm.decontaminate import contained
from barloom.llm.mixing import mixed
from barloom.llm.neardup import near_duplicates
from barloom.llm.quality import GOOD, score, train
from barloom.llm.toxicity import toxicity
from barloom.llm.toxicity import train as train_toxicity


def _packed(docs: DataFrame) -> DataFrame:
    """Whole rows as one column beside text, so that no column can clash with an operator's own."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number of its own for each row, and the name of that column."""
    name = "number"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id())), name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier doesn't predict to be good."""
    return score(_packed(docs), train(docs, table(spark, sf_dir, "labels")), "row").where(F.col("score") >= GOOD).select("row.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted to be toxic."""
    return toxicity(_packed(docs), train_toxicity(docs, table(spark, sf_dir, "labels")), "row").where("predicted = 0").select("row.*")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, one without an id if none has one."""
    rows, number = _numbered(docs)
    kept = near_duplicates(rows, number).where("kept").select(F.col("number").alias(number))
    return rows.join(kept, number, "left_semi").select(*docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    rows, number = _numbered(docs)
    found = contained(rows.select(F.col(number).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = written(found.select(F.col("doc_id").alias(number)).distinct())
    return rows.join(hit, number, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies and words."""
    return mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", no_near_copies),
    ("decontamination", no_benchmark),
    ("mixing", mix),
]

#: The stages learn models and search iteratively, which SQL doesn't express; tests/llm holds a brute-force version against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
