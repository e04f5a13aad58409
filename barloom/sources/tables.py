"""Results that several branches of a plan read, written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df as a table under spark.checkpoint.dir: computed once, and read again if an executor is lost.

    A session in local mode without that setting writes to a temporary folder, which goes with the process.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-barloom-", dir=os.environ.get("TMPDIR", "/tmp")))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = _OWN[0]
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
