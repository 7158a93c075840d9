"""Consolidation of sample annotation lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplolake.functions.columns import blank_to_null
from haplolake.operators.relational import append, common_columns, full_join_on_common, keep_ranked, pick_non_null


def numbered(lists: Sequence[DataFrame], row: str | None = None, common_only: bool = False) -> DataFrame:
    """The lists stacked, with list_no and row_no; missing columns are null, or only common ones kept (ST1-3).

    ``row`` names a column that orders a list's rows; without it, the order of reading is taken, which is
    stable for files that Spark reads in one piece each.
    """
    keep = common_columns(*lists) if common_only else None
    parts = []
    for i, f in enumerate(lists):
        place = F.col(row).cast("long") if row else F.monotonically_increasing_id()
        own = f if keep is None else f.select(*keep)
        parts.append((own if row is None or row in own.columns else f).withColumns({"list_no": F.lit(i), "row_no": place}).select(*own.columns, "list_no", "row_no"))
    return append(*parts, fill=True)


def consolidate(lists: Sequence[DataFrame], key: str, keep: str = "last", row: str | None = None) -> DataFrame:
    """One row per key: every column's last (or first) non-null value over the stacked lists (DOM40, AG16, ST2)."""
    return pick_non_null(numbered(lists, row), [key], ["list_no", "row_no"], keep)


def consolidate_with_corrections(lists: Sequence[DataFrame], corrections: DataFrame, key: str, row: str | None = None) -> DataFrame:
    """Last non-null values over the lists; where the correction list has a value, that one (DOM40)."""
    merged = consolidate(lists, key, "last", row)
    return consolidate([corrections.drop(*([row] if row else [])), merged.drop(*([row] if row else []))], key, "first")


def consolidate_strict(lists: Sequence[DataFrame], key: str, row: str | None = None) -> DataFrame:
    """Columns that all lists share; of rows with one key the last (DOM41, WN6)."""
    stacked = numbered(lists, row, common_only=True)
    return keep_ranked(stacked, [key], [F.desc("list_no"), F.desc("row_no")]).drop("list_no", "row_no")


def finalise_annotation(a: DataFrame, b: DataFrame, qc: DataFrame, key: str, order: DataFrame, position: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Both annotations merged on all common columns, profile added, blanks nulled, in the original row order (DOM42).

    A trailing ``_`` of keys is trimmed first. Rows that ``order`` lacks come last, by key.
    """
    trim = lambda f: f.withColumn(key, F.regexp_replace(key, "_$", ""))
    merged = full_join_on_common(trim(a), trim(b))
    merged = full_join_on_common(merged, qc, [key])
    merged = merged.select(*(blank_to_null(c).alias(c) if t == "string" else F.col(c) for c, t in merged.dtypes))
    out = merged.select(*(columns or merged.columns))
    return out.join(order.select(key, position), key, "left").orderBy(F.col(position).asc_nulls_last(), key).drop(position)
