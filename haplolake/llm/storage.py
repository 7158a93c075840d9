"""Tables that cut lineage: written to the folder that the cluster shares, and read again."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a local master; else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        spark.sparkContext.setCheckpointDir(_own[0])
    return _own[0]


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path and the path itself, as Hadoop's API names them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def until_exit(spark: SparkSession, path: str) -> None:
    """Have what is at the path removed when the driver ends: nothing can read it after that."""
    files, p = _folder(spark, path)
    files.deleteOnExit(p)


#: Has Spark remove a query's shuffle files as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder; lost executors don't undo them.

    Nothing reads the shuffle files behind the table again, so they go when it is complete. The table
    itself goes when the driver ends, or with drop() before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that written() made, once all that was derived from them is written too."""
    for t in tables:
        path = _paths.pop(t, None)
        if path:
            files, p = _folder(t.sparkSession, path)
            files.delete(p, True)
