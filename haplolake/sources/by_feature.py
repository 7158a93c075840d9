"""Matrices stored by feature: bucketed tables whose rows of one feature are in one bucket, sorted.

Statistics by feature (means, variances, weights) and joins of them with the matrix read such a table bucket by
bucket, without an exchange. The table belongs to the session's catalog and its files to the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from haplolake.sources.scratch import new_path


def store_by_feature(matrix: DataFrame, feature: str = "feature_id", buckets: int | None = None, table: str | None = None, path: str | None = None) -> DataFrame:
    """The same rows, bucketed and sorted by feature. Without a path the files go when the driver ends.

    buckets: the number of shuffle partitions, unless given; tables that are joined by feature should have the same. Rows are
    exchanged once before writing, so each bucket is one file.
    """
    spark = matrix.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = table or f"by_feature_{uuid.uuid4().hex}"
    writer = matrix.repartition(buckets, feature).write.format("parquet").bucketBy(buckets, feature).sortBy(feature)
    writer.option("path", path or new_path(spark, "by-feature")).saveAsTable(table)
    return spark.table(table)


def open_by_feature(spark: SparkSession, table: str) -> DataFrame:
    """A table that store_by_feature wrote under a name."""
    return spark.table(table)
