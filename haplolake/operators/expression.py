"""Expression matrices in long form: zero filling, filters, ratios to controls, adjustment of samples.

A matrix has one row per feature and sample; an absent row is a missing value. Operators that count
absent rows as 0 say so and divide by the number of samples instead of filling the matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplolake.functions.columns import log2_positive, safe_div, weight_or_zero
from haplolake.operators.grid import on_grid
from haplolake.operators.ordered import quantiles
from haplolake.operators.relational import members_of, variance_where, weighted_mean, with_scalar


def densify(matrix: DataFrame, features: DataFrame, samples: DataFrame, feature: str = "feature_id", sample: str = "sample_id", value: str = "value") -> DataFrame:
    """A row for every feature and sample, 0 where there was none or a null (PRJ5)."""
    zero = lambda df: df.withColumn(value, F.coalesce(value, F.lit(0.0)))
    return on_grid(features.select(feature).distinct(), samples, matrix.select(feature, sample, value), [feature], sample, each=zero)


def control_mean_with_zeros(matrix: DataFrame, samples: DataFrame, feature: str = "feature_id", sample: str = "sample_id", value: str = "value", control: str = "is_control") -> DataFrame:
    """feature, control_mean over all controls, absent and null rows counting as 0 (AG5); features with rows of others only have 0."""
    n = samples.filter(F.col(control)).agg(F.count_distinct(sample).alias("_n"))
    sums = matrix.join(samples, sample).groupBy(feature).agg(F.coalesce(F.sum(F.when(F.col(control), F.col(value))), F.lit(0.0)).alias("_sum"))
    return with_scalar(sums, n).select(feature, safe_div("_sum", "_n").alias("control_mean"))


def strong_features(matrix: DataFrame, samples: DataFrame, least: float = 25, feature: str = "feature_id", **names: str) -> DataFrame:
    """feature: those whose control mean, zeros counted, is at least ``least`` (DOM9); a cell's value may be spread over several rows."""
    return control_mean_with_zeros(matrix, samples, feature, **names).filter(F.col("control_mean") >= least).select(feature)


def min_expression(matrix: DataFrame, samples: DataFrame, least: float = 25, feature: str = "feature_id", **names: str) -> DataFrame:
    """Rows of features whose control mean, zeros counted, is at least ``least`` (DOM9)."""
    return members_of(matrix, strong_features(matrix, samples, least, feature, **names), [feature])


def ratio_to_controls(matrix: DataFrame, samples: DataFrame, feature: str = "feature_id", sample: str = "sample_id", value: str = "value", control: str = "is_control") -> DataFrame:
    """value divided by the feature's control mean; null where that is 0 or missing (DOM10)."""
    means = members_of(matrix, samples.filter(F.col(control)), [sample]).groupBy(feature).agg(F.avg(value).alias("_mean"))
    rest = [c for c in matrix.columns if c != value]
    return matrix.join(means, feature, "left").select(*rest, safe_div(value, "_mean").alias(value))


def inverse_variance(matrix: DataFrame, samples: DataFrame, feature: str = "feature_id", sample: str = "sample_id", value: str = "value", control: str = "is_control") -> DataFrame:
    """feature, variance and weight (1 / variance over controls, 0 if that is infinite or missing)."""
    var = matrix.join(samples, sample).groupBy(feature).agg(variance_where(value, control).alias("variance"))
    return var.withColumn("weight", weight_or_zero(safe_div(F.lit(1.0), "variance")))


def adjust_by_invvar(matrix: DataFrame, samples: DataFrame, cap: float | None = None, features: DataFrame | None = None, exclude: Sequence[str] = (), feature: str = "feature_id", sample: str = "sample_id", value: str = "value", control: str = "is_control", region: str = "chr") -> DataFrame:
    """Divide each sample by its weighted mean over all features (DOM11); with ``cap``, weights are cut at
    that quantile of the finite weights outside the excluded regions (DOM12)."""
    weights = inverse_variance(matrix, samples, feature, sample, value, control)
    if cap is not None:
        # A variance of 0 has weight 0 here and takes part in the quantile only if it is a finite weight.
        inner = weights.filter(F.col("variance").isNull() | (F.col("variance") > 0))
        if features is not None and exclude:
            inner = inner.join(features.filter(~F.col(region).isin(*exclude)).select(feature), feature, "left_semi")
        weights = with_scalar(weights, quantiles(inner, "weight", {"_cap": cap})).withColumn("weight", F.least("weight", "_cap"))
    weighted = matrix.join(weights.select(feature, "weight"), feature)
    factors = weighted.groupBy(sample).agg(weighted_mean(value, "weight").alias("_factor"))
    rest = [c for c in matrix.columns if c != value]
    return matrix.join(factors, sample, "left").select(*rest, safe_div(value, "_factor").alias(value))


def global_factors(matrix: DataFrame, samples: DataFrame, sample: str = "sample_id", value: str = "value", control: str = "is_control") -> DataFrame:
    """sample, factor: 2 to the sample's mean log2 value less the mean of the controls' means; values of 0 are skipped (DOM23, AG12)."""
    means = matrix.groupBy(sample).agg(F.avg(log2_positive(value)).alias("_mean"))
    center = members_of(means, samples.filter(F.col(control)), [sample]).agg(F.avg("_mean").alias("_center"))
    return with_scalar(means, center).select(sample, F.pow(F.lit(2.0), F.col("_mean") - F.col("_center")).alias("factor"))
