"""Mergeable moments: per feature and group, a stored summary from which means, variances and weights follow.

A summary row holds counts (given values, nulls, zeros), the mean and the sum of squared deviations.
Summaries of further samples are merged by the pairwise update, which stays exact to rounding however large the
mean is; the matrix of the earlier samples isn't read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.functions.columns import safe_div

MOMENTS = ("n", "nulls", "zeros", "mean", "m2")


def summarise(rows: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """by, n, nulls, zeros, mean, m2 (sum of squared deviations from the mean); mean is null if all values are."""
    v = F.col(value).cast("double")
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(v == 0).alias("zeros"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")
    )


def _joined(a: Column, b: Column) -> Column:
    n = a["n"] + b["n"]
    shift = F.coalesce(b["mean"] - a["mean"], F.lit(0.0))
    mean = F.coalesce(a["mean"] + shift * b["n"] / n, a["mean"], b["mean"])
    m2 = F.coalesce(a["m2"], F.lit(0.0)) + F.coalesce(b["m2"], F.lit(0.0)) + shift * shift * a["n"] * b["n"] / F.greatest(n, F.lit(1))
    return F.struct(n.alias("n"), (a["nulls"] + b["nulls"]).alias("nulls"), (a["zeros"] + b["zeros"]).alias("zeros"), mean.alias("mean"), m2.alias("m2"))


def merge(*summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    """One summary of all: rows of one key are folded in the summaries' order, as many as there are summaries."""
    parts = [s.select(*by, F.struct(F.lit(i).alias("i"), *(F.col(m) for m in MOMENTS)).alias("_s")) for i, s in enumerate(summaries)]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    listed = stacked.groupBy(*by).agg(F.sort_array(F.collect_list("_s")).alias("_l"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("nulls"), F.lit(0).cast("long").alias("zeros"), F.lit(None).cast("double").alias("mean"), F.lit(0.0).alias("m2"))
    plain = F.transform("_l", lambda s: F.struct(*(s[m].alias(m) for m in MOMENTS)))
    return listed.select(*by, F.aggregate(plain, zero, lambda a, b: F.when(b["n"] == 0, F.struct(a["n"].alias("n"), (a["nulls"] + b["nulls"]).alias("nulls"), (a["zeros"] + b["zeros"]).alias("zeros"), a["mean"].alias("mean"), a["m2"].alias("m2"))).otherwise(_joined(a, b))).alias("_m")).select(*by, *(F.col(f"_m.{m}") for m in MOMENTS))


def with_absent_as_zero(summary: DataFrame, total: Column | int) -> DataFrame:
    """The same as if every absent and null value up to ``total`` samples were a row of 0: what a zero-filled matrix gives."""
    n = F.lit(total) if isinstance(total, int) else total
    missing = n - F.col("n")
    mean = F.coalesce(F.col("mean"), F.lit(0.0))
    return summary.select(
        *(c for c in summary.columns if c not in MOMENTS), n.cast("long").alias("n"), F.lit(0).cast("long").alias("nulls"), (F.col("zeros") + missing).cast("long").alias("zeros"),
        safe_div(mean * F.col("n"), n).alias("mean"), (F.coalesce("m2", F.lit(0.0)) + F.coalesce(safe_div(mean * mean * F.col("n") * missing, n), F.lit(0.0))).alias("m2"),
    )


def variance() -> Column:
    """Sample variance from the columns of a summary; null for fewer than two values."""
    return F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1))


def ratio_weight() -> Column:
    """Inverse variance of the values' ratios to their mean, 0 if there is none: mean squared over variance."""
    return F.coalesce(safe_div(F.col("mean") * F.col("mean"), variance()), F.lit(0.0))
