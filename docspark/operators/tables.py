"""Written intermediate tables: they cut a plan's lineage, survive lost executors, and serve several readers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines of a cluster share.

    Where that is unset, a temporary folder of this process, if driver and executors are one machine; else an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="docspark-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path beneath the shared folder that nothing else uses; ``forget`` deletes it."""
    _written.append(f"{shared_dir(spark)}/docspark/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def mark() -> int:
    """A moment that ``forget`` can go back to."""
    return len(_written)


def forget(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables written since a ``mark``; for when the results that read them are stored."""
    while len(_written) > since:
        delete(spark, _written.pop())
