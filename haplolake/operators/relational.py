"""Relational pieces that the domain operators share: key joins, membership, aggregates, windows, reshaping.

Every function takes and returns DataFrames and names its columns by parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplolake.functions.columns import col, safe_div


# ---- joins


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join with a lookup table; Spark sends it to all tasks if its size allows (JN4, JN12, JN15-27, JN30)."""
    return df.join(table, list(on), how)


def full_join_on_common(a: DataFrame, b: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Full outer join on all common columns (or ``on``); null keys match null keys (JN13, JN14)."""
    keys = list(on or [c for c in a.columns if c in b.columns])
    right = b.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns), F.lit(True).alias("_in_b"))
    left = a.withColumn("_in_a", F.lit(True))
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(right[f"_r_{k}"])
        condition = same if condition is None else condition & same
    merged = left.join(right, condition, "full")
    # A key is the left row's where there is one, even if null.
    return merged.select(
        *(F.when(F.col("_in_a"), F.col(k)).otherwise(F.col(f"_r_{k}")).alias(k) for k in keys),
        *(c for c in a.columns if c not in keys),
        *(c for c in b.columns if c not in keys),
    )


def members_of(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys`` (JN2, JN9, ST4)."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def not_members_of(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``keys``, on one or several columns (JN10, JN11, ST5)."""
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Attach a one-row table, such as a factor, to every row (AG11)."""
    return df.crossJoin(F.broadcast(scalar))


# ---- aggregates


def mean_where(value: Column | str, condition: Column | str) -> Column:
    """Mean over rows that meet a condition, nulls skipped (AG4)."""
    return F.avg(F.when(col(condition), col(value)))


def variance_where(value: Column | str, condition: Column | str) -> Column:
    """Sample variance over rows that meet a condition; null for a single row (AG6)."""
    return F.var_samp(F.when(col(condition), col(value)))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """sum(w v) / sum(w) over rows in which both are given; null if that is empty or weighs 0 (AG7)."""
    both = col(value).isNotNull() & col(weight).isNotNull()
    return safe_div(F.sum(col(weight) * col(value)), F.sum(F.when(both, col(weight))))


def pick_non_null(df: DataFrame, key: Sequence[str], order: Sequence[str], which: str = "last") -> DataFrame:
    """Per key, the last (or first) non-null value of every other column, in the given order (AG16)."""
    place = F.struct(*order)
    pick = F.max_by if which == "last" else F.min_by
    values = [c for c in df.columns if c not in {*key, *order}]
    return df.groupBy(*key).agg(*(pick(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in values))


def frequency(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """Counts by category, most frequent first, ties by category (AG17, AG18)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *by)


# ---- windows


def with_group_total(df: DataFrame, value: str, by: Sequence[str], name: str = "total") -> DataFrame:
    """WN3."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by)))


def with_group_zscore(df: DataFrame, value: str, by: Sequence[str], prefix: str = "") -> DataFrame:
    """Group mean, sample deviation and absolute z-score of every row (WN4); null keys are a group.

    Statistics are pre-aggregated and joined back, so a group's rows need not meet in one task.
    """
    mean, sd = f"{prefix}mean", f"{prefix}sd"
    stats = df.groupBy(*by).agg(F.avg(value).alias(mean), F.stddev_samp(value).alias(sd))
    keys = [f"_k{i}" for i in range(len(by))]
    stats = stats.withColumnsRenamed(dict(zip(by, keys, strict=True)))
    out = df.join(stats, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]).drop(*keys)
    return out.withColumn(f"{prefix}z", F.abs(safe_div(F.col(value) - F.col(mean), sd)))


def keep_ranked(df: DataFrame, key: Sequence[str], order: Sequence[Column], rank: int = 1) -> DataFrame:
    """The rank-th row per key in an order: first, second or (descending) last duplicate (WN6, WN7)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_rank") == rank).drop("_rank")


def groups_with_one_value(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows of groups that hold exactly one distinct value; a null is a value of its own (AG20, WN9)."""
    one = single_values(df, by, value).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & df[c].eqNullSafe(one[f"_k{i}"])
    return df.join(one, same, "left_semi")


def single_values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value of the groups that hold exactly one distinct value; a null is a value of its own. Counted without keeping the values."""
    sums = df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(value).alias("_given"), F.count(F.lit(1)).alias("_all"))
    return sums.filter("_given = 0 OR (_given = _all AND _low = _high)").select(*by, F.col("_low").alias(value))


def fill_from_group(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """All rows of a group get its first non-null value; groups without one are dropped (JN20)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(value, F.first(value, ignorenulls=True).over(w)).filter(F.col(value).isNotNull())


# ---- sets, order, reshaping


def append(*frames: DataFrame, fill: bool = False) -> DataFrame:
    """Stack tables; with ``fill``, columns that one lacks are null (ST1, ST2)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=fill)
    return out


def common_columns(*frames: DataFrame) -> list[str]:
    """Column names that all tables have, in the first one's order (ST3)."""
    return [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]


def with_all_regions(df: DataFrame, regions: DataFrame, samples: DataFrame, region: str, sample: str) -> DataFrame:
    """A row for every region and sample; those without data are null (ST7)."""
    return regions.select(region).distinct().crossJoin(samples.select(sample).distinct()).join(df, [region, sample], "left")


def ordered_like(df: DataFrame, order: DataFrame, key: str, position: str) -> DataFrame:
    """Sort by position in another list; rows that it lacks come last, by key (SO3)."""
    return df.join(order.select(key, position), key, "left").orderBy(F.col(position).asc_nulls_last(), key)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long (RS3)."""
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in values], name, value)


def widen(df: DataFrame, ids: Sequence[str], column: str, values: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Long to wide with an explicit list of columns, named <value>_<measure>; two rows for one cell are an error (RS1, RS2)."""
    unique = {m: F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one row for a cell"))).otherwise(F.first(m)) for m in measures}
    wide = df.groupBy(*ids).pivot(column, list(values)).agg(*(e.alias(m) for m, e in unique.items()))
    if len(measures) > 1:
        return wide
    return wide.withColumnsRenamed({v: f"{v}_{measures[0]}" for v in values})


def stack_labelled(df: DataFrame, ids: Sequence[str], parts: Mapping[str, str], label: str, value: str) -> DataFrame:
    """One row per (row, part): parts maps a label to the column that holds its value (RS4, RS6)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias(label), F.col(c).alias(value)) for k, c in parts.items()))).alias("_p")
    return df.select(*ids, pairs).select(*ids, f"_p.{label}", f"_p.{value}")
