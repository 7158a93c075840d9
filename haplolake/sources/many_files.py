"""Folders of very many small files, such as one for each sample.

What such a folder costs is not its bytes. Spark lists folders in one task each (up to 10,000), and on a local or mounted
disk Hadoop writes a checksum file beside every file and, without its native library, starts a process for each
change of a file's mode. Here folders are listed by a few tasks a core, and files are written without either.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Options of a writer, for paths of file:// alone: files without checksum files beside them, made with the mode that the system gives.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Listing tasks for each core.
PER_CORE = 4


@contextmanager
def listed_by_few(spark: SparkSession) -> Iterator[None]:
    """Within it, reading a folder lists its subfolders in PER_CORE tasks a core."""
    before = spark.conf.get(_LISTERS)
    spark.conf.set(_LISTERS, str(min(int(before), PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_LISTERS, before)
