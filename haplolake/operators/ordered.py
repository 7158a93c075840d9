"""Exact order statistics, ranks and prefix sums of groups of any size.

A group's rows are dealt to cells along their order: the first order column rounded to 16 significant
bits, which keeps the order. A cell with too many rows is dealt again, by the exact value and by the next
order column rounded in the same way, so that neither one large group nor one frequent value makes a large
task. Totals of cells are summed along the order (a few bytes a cell), and each row gets the total before
its cell added to what its cell alone gives. Which cell a row is in depends on the rows' values alone, so
plans stay lazy and any part can be computed again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Rows above which a cell is dealt again.
CELL_ROWS = 1_000_000
_DIGITS = ("_d0", "_d1", "_d2")


def _same(a: DataFrame, b: DataFrame, names: Mapping[str, str]) -> Column:
    """Null-safe equality of a's columns and b's renamed ones."""
    out = F.lit(True)
    for x, y in names.items():
        out = out & a[x].eqNullSafe(b[y])
    return out


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which null keys match null keys; the keys come once."""
    other = {k: f"_r_{k}" for k in keys}
    renamed = right.withColumnsRenamed(other)
    return left.join(renamed, _same(left, renamed, other), how).drop(*other.values())


def _text(c: Column) -> Column:
    """Text in its order, with null before the empty one."""
    return F.coalesce(F.concat(F.lit("1"), c), F.lit("0"))


def coarse(df: DataFrame, column: str, bits: int = 16) -> Column:
    """A value that never falls as the column rises and has few distinct values: numbers rounded to some bits, prefixes of text. Null comes first."""
    if not isinstance(df.schema[column].dataType, NumericType):
        return _text(F.substring(F.col(column).cast("string"), 1, 6))
    x = F.col(column).cast("double")
    y = x * float(2 ** (53 - bits) + 1)
    return F.coalesce(F.when(F.abs(x) < 1e290, y - (y - x)).otherwise(x), F.lit(-math.inf))


def _in_cells(df: DataFrame, by: Sequence[str], order: Sequence[str], cell_rows: int) -> DataFrame:
    """Rows with their cell."""
    placed = df.withColumn("_d0", coarse(df, order[0]))
    full = placed.groupBy(*by, "_d0").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cell_rows).select(*by, "_d0", F.lit(True).alias("_full"))
    again = join_null_safe(placed, full, [*by, "_d0"], "left")
    exact = F.coalesce(F.col(order[0]).cast("double"), F.lit(-math.inf)) if isinstance(df.schema[order[0]].dataType, NumericType) else _text(F.col(order[0]).cast("string"))
    finer = [exact, coarse(df, order[1]) if len(order) > 1 else F.lit(0.0)]
    return again.withColumns({d: F.when(F.col("_full"), f) for d, f in zip(_DIGITS[1:], finer, strict=True)}).drop("_full")


def _added(before: str, own: Column) -> Column:
    """Sum in which a null counts as nothing; null if both are."""
    return F.when(F.col(before).isNull(), own).when(own.isNull(), F.col(before)).otherwise(F.col(before) + own)


def running_sum(df: DataFrame, columns: Mapping[str, str], order: Sequence[str], by: Sequence[str] = (), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Running sums of columns in a given order, per group (WN1). Nulls count as nothing, and come first in the order.

    The order should tell all rows of a group apart; where it doesn't, any order of the rest may be taken. Groups of at most
    cell_rows rows are one cell each and are sorted as they are, after one exchange.
    """
    if not by:
        return _summed_in_cells(df, columns, order, by, cell_rows)
    # At most one row for each cell_rows of the table.
    large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cell_rows).select(*by)
    own = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    listed = F.broadcast(large.withColumnsRenamed({k: f"_r_{k}" for k in by}))
    same = _same(df, listed, {k: f"_r_{k}" for k in by})
    small = df.join(listed, same, "left_anti").select(*df.columns, *(F.sum(c).over(own).alias(name) for name, c in columns.items()))
    return small.unionByName(_summed_in_cells(df.join(listed, same, "left_semi"), columns, order, by, cell_rows))


def _summed_in_cells(df: DataFrame, columns: Mapping[str, str], order: Sequence[str], by: Sequence[str], cell_rows: int) -> DataFrame:
    """Running sums in groups of any size, by cells."""
    placed = _in_cells(df, by, order, cell_rows)
    totals = placed.groupBy(*by, *_DIGITS).agg(*(F.sum(c).alias(f"_t_{name}") for name, c in columns.items()))
    earlier = Window.partitionBy(*by).orderBy(*_DIGITS).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, *_DIGITS, *(F.sum(f"_t_{name}").over(earlier).alias(f"_b_{name}") for name in columns))
    own = Window.partitionBy(*by, *_DIGITS).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_null_safe(placed, before, [*by, *_DIGITS])
    return out.select(*df.columns, *(_added(f"_b_{name}", F.sum(c).over(own)).alias(name) for name, c in columns.items()))


def ranked(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "rank", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Place of every row in its group's order, from 1; rows whose first order column is null come first."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), {name: "_one"}, order, by, cell_rows).drop("_one")


def rank_chunks(df: DataFrame, order: Sequence[str], size: int, by: Sequence[str] = (), name: str = "chunk", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Number groups of ``size`` consecutive rows in rank order, from 1; the last may be short (WN2)."""
    return ranked(df, order, by, "_rank", cell_rows).withColumn(name, (F.floor((F.col("_rank") - 1) / size) + 1).cast("long")).drop("_rank")


def quantiles(df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per name, nulls skipped; a group of nulls gives null (AG9, AG10, RP8).

    Counts of cells of 20 significant bits tell which cells hold the wanted places; only their values are counted,
    equal ones once, and walked in order. Without ``by`` there is one row, also for an empty table.
    """
    numbers = df.select(*by, F.col(value).cast("double").alias("_v"))
    placed = numbers.withColumn("_d0", coarse(numbers, "_v", 20))
    cell = [*by, "_d0"]
    counts = placed.groupBy(*cell).agg(F.count("_v").alias("_n"))
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_d0").rowsBetween(Window.unboundedPreceding, -1)
    cum = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(order), F.lit(0)), "_all": F.sum("_n").over(group)})
    place = {k: (F.col("_all") - 1) * F.lit(float(q)) for k, q in shares.items()}
    held = lambda e, at, n: (e >= at) & (e < at + n)
    wanted = F.col("_all") == 0
    for p in place.values():
        wanted = wanted | held(F.floor(p), F.col("_before"), F.col("_n")) | held(F.ceil(p), F.col("_before"), F.col("_n"))
    values = join_null_safe(placed, cum.filter(wanted).drop("_n"), cell).groupBy(*cell, "_before", "_all", "_v").agg(F.count("_v").alias("_k"))
    inside = Window.partitionBy(*cell).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_k").over(inside), F.lit(0)))
    picked = values.groupBy(*by).agg(
        F.max("_all").alias("_all"),
        *(F.max(F.when(held(f(p), F.col("_at"), F.col("_k")), F.col("_v"))).alias(f"_{side}_{i}") for i, p in enumerate(place.values()) for side, f in (("low", F.floor), ("high", F.ceil))),
    )
    parts = [F.col(f"_low_{i}") + (F.col(f"_high_{i}") - F.col(f"_low_{i}")) * (p - F.floor(p)) for i, p in enumerate(place.values())]
    return picked.select(*by, *(c.alias(k) for k, c in zip(shares, parts, strict=True)))


def five_numbers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles and whiskers (extremes within 1.5 interquartile ranges) per group (AG21)."""
    q = quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.when(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach), F.col(value))
    return join_null_safe(df.select(*by, value), q, by).groupBy(*by, "q1", "median", "q3").agg(F.min(inside).alias("low"), F.max(inside).alias("high"))
