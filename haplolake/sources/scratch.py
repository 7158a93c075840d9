"""Folder for intermediate files that all executors can reach, and tables stored in it."""

from __future__ import annotations

import math
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files to a partition of spread().
PART_BYTES = 8 << 20
_own: list[str] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path and the path itself, as Hadoop's API names them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A path in a new folder under spark.checkpoint.dir; the folder goes when the driver ends, or with removed() before.

    Where spark.checkpoint.dir is unset, a temporary folder takes its place on a local master; else that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        base = _own[0]
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, p = _files(spark, folder)
    files.mkdirs(p)
    files.deleteOnExit(p)
    return f"{folder}/rows"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once and read from Parquet by all that is built on them (SRC15); a table that is stored already is returned as it is."""
    if df in _paths:
        return df
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def spread(df: DataFrame, *keys: str, size: int = PART_BYTES) -> DataFrame:
    """Rows by key in as many partitions as the files below hold ``size`` bytes, at least one a core; smaller tables are left to Spark.

    Else the number of partitions is the session's, whatever the input, and small ones are merged by compressed bytes, so that what
    a task holds in a join or an aggregation grows with the input. A join with such a side is dealt in the same way on the other.
    """
    # Files are named as URIs, in which a blank is %20.
    found = (_files(df.sparkSession, df.sparkSession._jvm.java.net.URI(f)) for f in df.inputFiles())
    parts = math.ceil(sum(files.getFileStatus(p).getLen() for files, p in found) / size)
    return df if parts <= 1 else df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *keys)


def removed(*tables: DataFrame) -> None:
    """Remove what stored() wrote for these tables, once all that is built on them is written too."""
    for t in tables:
        path = _paths.pop(t, None)
        if path:
            files, p = _files(t.sparkSession, path)
            files.delete(p.getParent(), True)
