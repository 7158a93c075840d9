"""Malformed rows of text sources: kept apart with their reason, counted by file, and held to a budget.

A row is malformed if a field doesn't fit its type, if it has too many or too few fields, or if a required
field is empty. Good rows and malformed ones come from one reading of the files; nothing becomes null in silence.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haplolake.sources.many_files import listed_by_few

_RAW = "_malformed"


@dataclass(frozen=True)
class Checked:
    """Rows of checked files: all of them with ``reason`` (null for good ones) and the raw line of malformed ones."""

    rows: DataFrame

    @property
    def good(self) -> DataFrame:
        return self.rows.filter("reason IS NULL").drop("reason", _RAW)

    @property
    def quarantined(self) -> DataFrame:
        """path, file, reason, record."""
        return self.rows.filter("reason IS NOT NULL").select("path", "file", "reason", F.col(_RAW).alias("record"))

    @property
    def errors(self) -> DataFrame:
        """path, file, rows, malformed of every file that has rows."""
        return self.rows.groupBy("path", "file").agg(F.count(F.lit(1)).alias("rows"), F.count("reason").alias("malformed"))

    def over_budget(self, share: float, least: int = 0) -> DataFrame:
        """The files of which more than that share and more than ``least`` rows are malformed."""
        return self.errors.filter((F.col("malformed") > share * F.col("rows")) & (F.col("malformed") > least))

    def within_budget(self, share: float, least: int = 0) -> Checked:
        """Only files within the budget; the others go as a whole, good rows too."""
        return Checked(self.rows.join(self.over_budget(share, least).select("path"), "path", "left_anti"))

    def enforced(self, share: float, least: int = 0) -> DataFrame:
        """The good rows; using them is an error if a file is over the budget."""
        worst = self.over_budget(share, least).agg(F.min("file").alias("_file"))
        alarm = F.when(F.col("_file").isNotNull(), F.raise_error(F.concat(F.lit("too many malformed rows in "), "_file")).cast("boolean")).otherwise(F.lit(True))
        return self.good.crossJoin(F.broadcast(worst)).filter(alarm).drop("_file")  # one row


def read_checked(spark: SparkSession, roots: Sequence[str], pattern: str, schema: str, required: Sequence[str] = (), valid: Column | None = None, **options: object) -> Checked:
    """Rows of all files that fit the pattern, each with path, file, reason and the raw record of malformed ones (SRC5-SRC11).

    required: columns that must be given. valid: a further condition on good rows.
    """
    made = {"pathGlobFilter": pattern, "recursiveFileLookup": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW, **options}
    with listed_by_few(spark):
        rows = spark.read.schema(f"{schema}, {_RAW} string").options(**made).csv(list(roots))
    names = [c for c in rows.columns if c != _RAW]
    reason = F.when(F.col(_RAW).isNotNull(), "unreadable")
    for c in required:
        reason = reason.when(F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`").cast("string")) == ""), f"no {c}")
    reason = reason if valid is None else reason.when(~F.coalesce(valid, F.lit(False)), "out of range")
    # A raw record is there for unreadable rows only; the others' is written again from their fields.
    record = F.coalesce(F.col(_RAW), F.concat_ws(str(made.get("sep", ",")), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names)))
    return Checked(rows.select(*(F.col(f"`{c}`") for c in names), F.when(reason.isNotNull(), record).alias(_RAW), reason.alias("reason"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file")))
