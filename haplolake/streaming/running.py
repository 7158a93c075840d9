"""Per-sample tables as they arrive: the same aggregates, kept up to date.

The batch operators read whole folders. Where samples trickle in, a file stream over the same folder
keeps the sums that the quality profile needs; files are picked up once, and the checkpoint folder of the
query holds which. Sums by sample and feature need no event time: rows of a sample come in one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplolake.operators.qc import qc_profile


def stream_gene_counts(spark: SparkSession, folder: str, pattern: str = "*", schema: str = "sample_id string, feature_id string, count long", files_per_trigger: int = 100) -> DataFrame:
    """Rows of tab-separated count files, as files appear in the folder."""
    reader = spark.readStream.schema(schema).option("sep", "\t").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(folder)


def running_counts(stream: DataFrame, sample: str = "sample_id", feature: str = "feature_id", count: str = "count") -> DataFrame:
    """Sums by sample and feature, for an output mode of update or complete."""
    return stream.groupBy(sample, feature).agg(F.sum(count).alias(count))


def running_profile(counts: DataFrame, **names: object) -> DataFrame:
    """Quality profile of the sums so far (a table written from running_counts)."""
    return qc_profile(counts, **names)
