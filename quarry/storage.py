"""Tables in the folder that all executors and the driver share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a local one of our own if all tasks run on this
    machine; else an error, since other machines could not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or os.path.join(tempfile.gettempdir(), "quarry-shared")


_written: list[str] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_so_far() -> int:
    """How many tables this process has stored and not deleted."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, but_last: int = 0) -> None:
    """Delete the tables that this process stored, once no DataFrame that reads them is needed any more: those after the
    first ``since``, without the ``but_last`` last ones."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    end = len(_written) - but_last
    for name in _written[since:end]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)
    _written[since:end] = []
