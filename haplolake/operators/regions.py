"""Aggregation of matrices to bins, chromosomes and arms by capped inverse-variance weights.

Features are placed once, whatever the number of samples: placements of several levels (bin, chromosome,
arm) are one table (level, place, region, feature). A feature's control variance is the same wherever it is
placed, so it is taken once from the matrix; what differs by level is the cap, the quantile of the weights
of the rows placed there. The matrix, with several values side by side, then meets placements and weights in one
join and is aggregated by (level, place, sample) in one pass. All of it is lazy; the cap is a node of the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.functions.columns import merge_labels, safe_div
from haplolake.operators.grid import on_grid
from haplolake.operators.intervals import interval_join, label_overlaps, make_bins
from haplolake.operators.ordered import join_null_safe, quantiles
from haplolake.operators.relational import members_of, variance_where, weighted_mean, with_scalar
from haplolake.sources.scratch import spread

CAP = 0.95


def _raw(variance: Column) -> Column:
    """1 / variance, 0 without a variance, null (infinite) at 0."""
    return F.when(variance.isNull(), F.lit(0.0)).otherwise(safe_div(F.lit(1.0), variance))


def _capped(weight: str, cap: str) -> Column:
    # least() skips nulls, so an infinite weight becomes the cap; without any finite weight, all infinite ones are equal.
    return F.coalesce(F.least(F.col(weight), F.col(cap)), F.lit(1.0))


def invvar_weights(rows: DataFrame, samples: DataFrame, key: Sequence[str], q: float = CAP, exclude: Sequence[str] = ("chrX",), region: str = "chr", sample: str = "sample_id", value: str = "value", control: str = "is_control") -> DataFrame:
    """key, region, weight: 1 / control variance, 0 if there is none, all cut at the q-quantile of the
    finite weights outside the excluded regions (DOM13). A variance of 0 gets the cap."""
    keys = list(dict.fromkeys([*key, region]))
    raw = rows.join(samples, sample).groupBy(*keys).agg(variance_where(value, control).alias("_v")).select(*keys, _raw(F.col("_v")).alias("_w"))
    cap = quantiles(raw.filter(~F.col(region).isin(*exclude)), "_w", {"_cap": q})
    return with_scalar(raw, cap).select(*keys, _capped("_w", "_cap").alias("weight"))


# ---- placements: level, place, region, feature


def place_by_region(features: DataFrame, region: str = "chr", feature: str = "feature_id", level: str = "chr") -> DataFrame:
    """Every feature in its own region."""
    return features.select(F.lit(level).alias("level"), F.col(region).cast("string").alias("place"), region, feature)


def place_by_bin(features: DataFrame, bins: DataFrame, region: str = "chr", feature: str = "feature_id", level: str = "bin") -> DataFrame:
    """Every feature in every bin that it touches (JN7, DOM15); place is the bin's number."""
    hits = interval_join(bins.select("bin", region, "start", "end"), features.select(region, feature, "start", "end"), [region])
    return hits.select(F.lit(level).alias("level"), F.col("bin").cast("string").alias("place"), region, F.col(f"r_{feature}").alias(feature))


def place_by_arm(features: DataFrame, arms: DataFrame, split: Sequence[str] = ("chr10a", "chr10b"), whole: str = "chr10", region: str = "chr", feature: str = "feature_id", level: str = "arm") -> DataFrame:
    """Every feature in every arm that it touches, split regions joined again first; features in no arm are left out (JN8, DOM17)."""
    joined = features.withColumn(region, merge_labels(region, split, whole))
    hits = label_overlaps(joined.select(feature, region, "start", "end"), arms.select(region, "start", "end", "arm"), [region]).filter("r_arm IS NOT NULL")
    return hits.select(F.lit(level).alias("level"), F.col("r_arm").alias("place"), region, feature)


# ---- aggregation


def aggregate_levels(matrix: DataFrame, placed: DataFrame, samples: DataFrame, values: Sequence[str] = ("value",), simple: Mapping[str, Sequence[str]] | None = None, q: float = CAP, exclude: Sequence[str] = ("chrX",), region: str = "chr", feature: str = "feature_id", sample: str = "sample_id", control: str = "is_control", strict: Sequence[str] = (), fine: bool = False) -> DataFrame:
    """level, place, sample and the weighted mean of each value, over all placements at once (DOM15-17).

    simple: for a value, places that take its plain mean (AG8). Each level has caps of its own, over its placed
    features outside the excluded regions. Places whose features lack all values of a sample have null there.

    strict: levels whose places stay only if every value occurs in some sample (ST4). fine: whether some level has places of few
    features, whose means are about as many as the matrix's rows; then a row is sent once with all its places, by sample.
    """
    simple = simple or {}
    names, given = [f"_v{i}" for i in range(len(values))], [f"_given{i}" for i in range(len(values))]
    # Rows of samples that aren't listed count in means, if their feature has others, but in no variance.
    listed = matrix.join(samples.select(sample, control, F.lit(True).alias("_listed")), sample, "left")
    occurs = [F.max(F.col(v).isNotNull()).alias(g) for v, g in zip(values, given, strict=True)]
    variances = listed.groupBy(feature).agg(F.max("_listed").alias("_any"), *occurs, *(variance_where(v, control).alias(n) for v, n in zip(values, names, strict=True))).filter("_any")
    raw = placed.join(variances, feature).select("level", "place", region, feature, *given, *(_raw(F.col(n)).alias(n) for n in names))
    counted = raw.filter(~F.col(region).isin(*exclude))
    # The caps of all values in one pass, each value and level a group.
    stacked = counted.select("level", F.posexplode(F.array(*names)).alias("_i", "_w"))
    caps = quantiles(stacked, "_w", {"_cap": q}, ["level", "_i"]).groupBy("level").agg(*(F.max(F.when(F.col("_i") == i, F.col("_cap"))).alias(f"_cap{i}") for i in range(len(values))))
    weights = join_null_safe(raw, caps, ["level"], "left").select("level", "place", feature, *given, *(_capped(n, f"_cap{i}").alias(f"_w{i}") for i, n in enumerate(names)))
    if strict:
        # Weights are not negative: a mean is given where a value is that has a weight, a plain one where a value is.
        has = [F.col(g) & ((F.col(f"_w{i}") > 0) | F.col("place").isin(*simple.get(v, ()))) for i, (v, g) in enumerate(zip(values, given, strict=True))]
        lacking = weights.filter(F.col("level").isin(*strict)).groupBy("level", "place").agg(*(F.max(h).alias(g) for h, g in zip(has, given, strict=True))).filter(~reduce(and_, map(F.col, given)))
        weights = join_null_safe(weights, lacking.select("level", "place", F.lit(True).alias("_lacks")), ["level", "place"], "left").filter("_lacks IS NULL").drop("_lacks")
    weights = weights.drop(*given)
    own = matrix.select(feature, sample, *values)
    # A matrix row makes a group or more here, which are held in a task's memory.
    if fine:
        spots = weights.groupBy(feature).agg(F.collect_list(F.struct(*(c for c in weights.columns if c != feature))).alias("_spots"))
        rows = spread(own.join(spots, feature), sample).select(sample, *values, F.inline("_spots"))
    else:
        rows = spread(own, feature).join(weights, feature)
    means = rows.groupBy("level", "place", sample).agg(*(m for i, v in enumerate(values) for m in (weighted_mean(v, f"_w{i}").alias(v), F.avg(v).alias(f"_plain{i}"))))
    chosen = (F.when(F.col("place").isin(*simple[v]), F.col(f"_plain{i}")).otherwise(F.col(v)).alias(v) if simple.get(v) else F.col(v) for i, v in enumerate(values))
    return means.select("level", "place", sample, *chosen)


def haplotype_levels(matrix: DataFrame, placed: DataFrame, samples: DataFrame, simple: Mapping[str, Sequence[str]] | None = None, tpm: str = "tpm", af: str = "af", sample: str = "sample_id", strict: Sequence[str] = ("arm",), **names: object) -> DataFrame:
    """level, place, sample, tpm, af, hap_a, hap_b of all levels from one aggregation (DOM18 over DOM15-17).

    In the strict levels, places stay only if both values occur in some sample (ST4).
    """
    out = aggregate_levels(matrix, placed, samples, (tpm, af), simple, sample=sample, strict=strict, **names)
    return out.withColumns({"hap_a": 2 * F.col(tpm) * F.col(af), "hap_b": 2 * F.col(tpm) * (1 - F.col(af))})


def on_all_bins(values: DataFrame, bins: DataFrame, samples: DataFrame, region: str = "chr", sample: str = "sample_id", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The bin level with its bins' spans, a row for every bin and sample, nulls in empty ones (DOM15); for the sink. each: as of on_grid."""
    own = values.filter("level = 'bin'").withColumn("bin", F.col("place").cast("long")).drop("level", "place")
    return on_grid(bins, samples, own, ["bin"], sample, each=each)


def agg_by_chr(matrix: DataFrame, features: DataFrame, samples: DataFrame, simple_for: Sequence[str] = (), q: float = CAP, exclude: Sequence[str] = ("chrX",), region: str = "chr", feature: str = "feature_id", sample: str = "sample_id", value: str = "value", control: str = "is_control") -> DataFrame:
    """region, sample, value: weighted mean of a region's features; plain mean in the ``simple_for`` regions (DOM16, AG8)."""
    out = aggregate_levels(matrix, place_by_region(features, region, feature), samples, (value,), {value: simple_for}, q, exclude, region, feature, sample, control)
    return out.select(F.col("place").alias(region), sample, value)


def agg_by_bin(matrix: DataFrame, features: DataFrame, samples: DataFrame, size: int = 10_000_000, q: float = CAP, exclude: Sequence[str] = ("chrX",), region: str = "chr", feature: str = "feature_id", sample: str = "sample_id", value: str = "value", control: str = "is_control") -> DataFrame:
    """bin, region, start, end, mid, sample, value: weighted mean of the features that touch a bin (DOM15).

    A feature on an edge counts in both bins, also for the weights' cap. Empty bins stay, with nulls, for every sample.
    """
    bins = make_bins(features, size, region)
    out = aggregate_levels(matrix, place_by_bin(features, bins, region, feature), samples, (value,), None, q, exclude, region, feature, sample, control)
    return on_all_bins(out, bins, samples, region, sample)


def agg_by_arm(matrix: DataFrame, features: DataFrame, arms: DataFrame, samples: DataFrame, simple_for: Sequence[str] = (), split: Sequence[str] = ("chr10a", "chr10b"), whole: str = "chr10", q: float = CAP, exclude: Sequence[str] = ("chrX",), region: str = "chr", feature: str = "feature_id", sample: str = "sample_id", value: str = "value", control: str = "is_control") -> DataFrame:
    """arm, sample, value, split regions joined again first; features in no arm are left out, those in two count in each (DOM17)."""
    out = aggregate_levels(matrix, place_by_arm(features, arms, split, whole, region, feature), samples, (value,), {value: simple_for}, q, exclude, region, feature, sample, control)
    return out.select(F.col("place").alias("arm"), sample, value)


def in_both(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables, restricted to the keys that occur in both; nulls go (DOM17, ST4)."""
    return members_of(a.filter(F.col(key).isNotNull()), b, [key]), members_of(b.filter(F.col(key).isNotNull()), a, [key])


def haplotype_expression(tpm: DataFrame, af: DataFrame, keys: Sequence[str], tpm_value: str = "value", af_value: str = "value") -> DataFrame:
    """keys, tpm, af, hap_a = 2 tpm af, hap_b = 2 tpm (1 - af), joined on the keys (DOM18, JN30)."""
    left = tpm.select(*keys, F.col(tpm_value).alias("tpm"))
    right = af.select(*keys, F.col(af_value).alias("af"))
    return left.join(right, list(keys)).withColumns({"hap_a": F.col("tpm") * 2 * F.col("af"), "hap_b": F.col("tpm") * 2 * (1 - F.col("af"))})
