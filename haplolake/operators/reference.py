"""Reference distributions and z-tests against them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.functions.columns import normal_two_sided, safe_div
from haplolake.operators.relational import members_of, not_members_of, stack_labelled

Values = DataFrame  # sample, region and value columns, one row per pair


def reference_total(values: DataFrame, labelled: DataFrame, controls: DataFrame, skip: Sequence[str] = ("chrX", "chr10b"), sample: str = "sample_id", region: str = "chr", value: str = "tpm") -> DataFrame:
    """id, cn, chr, vals: labelled samples at their copy number, controls at 2 in all but the skipped regions (DOM19).

    labelled: sample, region, cn. Labelled pairs without a value stay, with null.
    """
    v = values.select(sample, region, F.col(value).cast("double").alias("vals"))
    known = labelled.select(sample, region, F.col("cn").cast("int").alias("cn")).join(v, [sample, region], "left")
    everywhere = controls.select(sample).distinct().crossJoin(values.select(region).distinct().filter(~F.col(region).isin(*skip)))  # a few regions
    normal = everywhere.join(v, [sample, region], "left").withColumn("cn", F.lit(2))
    return known.select(sample, "cn", region, "vals").unionByName(normal.select(sample, "cn", region, "vals"))


def reference_haplotype(values: DataFrame, controls: DataFrame, drop: DataFrame | None = None, skip: Sequence[str] = ("chrX", "chr10b"), sample: str = "sample_id", region: str = "chr", a: str = "hap_a", b: str = "hap_b", tpm: str = "tpm") -> DataFrame:
    """id, cn, chr, hap, vals: control haplotypes at CN 1, twice their total at CN 2 as ``A&B``; listed (sample, region) pairs go (DOM20)."""
    own = members_of(values, controls, [sample])
    single = stack_labelled(own, [sample, region], {"A": a, "B": b}, "hap", "vals").withColumn("cn", F.lit(1))
    double = own.filter(~F.col(region).isin(*skip)).select(sample, region, F.lit("A&B").alias("hap"), (2 * F.col(tpm)).alias("vals"), F.lit(2).alias("cn"))
    both = single.unionByName(double)
    both = both if drop is None else not_members_of(both, drop, [sample, region])
    return both.select(sample, "cn", region, "hap", "vals")


def reference_arm(values: DataFrame, controls: DataFrame, sample: str = "sample_id", arm: str = "arm", a: str = "hap_a", b: str = "hap_b") -> DataFrame:
    """id, cn, arm, vals: mean of both haplotypes of every control and arm, CN 1 (DOM21, AG14)."""
    own = members_of(values, controls, [sample])
    return own.select(sample, F.lit(1).alias("cn"), arm, ((F.col(a) + F.col(b)) / 2).alias("vals"))


def reference_aneuploid(values: DataFrame, labelled: DataFrame, controls: DataFrame, skip: Sequence[str] = ("chrX", "chr10b"), sample: str = "sample_id", region: str = "chr", a: str = "hap_a", b: str = "hap_b") -> tuple[DataFrame, DataFrame]:
    """Wide (id, cn, chr, aneuploid, normal) and long (id, cn, chr, hap, vals) (DOM22).

    CN 1: (min, max) of the haplotypes; controls, CN 2: (A, B) in all but the skipped regions, whose number isn't
    two; CN 3: (max, min). cn is given less 1, the aneuploid haplotype's own number.
    """
    v = values.select(sample, region, F.col(a).alias("_a"), F.col(b).alias("_b"))
    known = labelled.select(sample, region, F.col("cn").cast("int").alias("cn")).join(v, [sample, region], "left")
    normal = members_of(v.filter(~F.col(region).isin(*skip)), controls, [sample]).withColumn("cn", F.lit(2))
    low, high = (F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), f("_a", "_b")) for f in (F.least, F.greatest))
    first = F.when(F.col("cn") == 1, low).when(F.col("cn") == 3, high).otherwise(F.col("_a"))
    second = F.when(F.col("cn") == 1, high).when(F.col("cn") == 3, low).otherwise(F.col("_b"))
    wide = known.unionByName(normal).select(sample, (F.col("cn") - 1).alias("cn"), region, first.alias("aneuploid"), second.alias("normal"))
    return wide, stack_labelled(wide, [sample, "cn", region], {"aneuploid": "aneuploid", "normal": "normal"}, "hap", "vals")


def _mean_and_sd(value: str, names: tuple[str, str], where: Column | None = None, na: str = "propagate") -> list[Column]:
    """Mean and sample deviation over the rows that meet a condition; both null if one of them holds a null, unless na is "skip"."""
    taken = F.lit(True) if where is None else where
    chosen = F.when(taken, F.col(value))
    clean = F.lit(True) if na == "skip" else F.count(chosen) == F.count_if(taken)
    return [F.when(clean, f(chosen)).alias(n) for f, n in zip((F.avg, F.stddev_samp), names, strict=True)]


def _z(value: str, names: tuple[str, str]) -> Column:
    return safe_div(F.col(value) - F.col(names[0]), names[1])


def _tested(values: DataFrame, reference: DataFrame, by: Sequence[str], groups: Mapping[str, Column], tests: Mapping[str, tuple[str, str]], ref_value: str) -> DataFrame:
    """Adds a p for every test (value column, group): all groups' statistics come from one aggregation and one join."""
    names = {g: (f"_mean_{g}", f"_sd_{g}") for g in groups}
    stats = reference.groupBy(*by).agg(*(c for g, where in groups.items() for c in _mean_and_sd(ref_value, names[g], where)))
    joined = values.join(stats, list(by), "left") if by else values.crossJoin(F.broadcast(stats))  # one row
    out = joined.withColumns({f"_z_{p}": _z(value, names[g]) for p, (value, g) in tests.items()})
    return out.select(*values.columns, *(normal_two_sided(f"_z_{p}").alias(p) for p in tests))


def ztest(values: DataFrame, reference: DataFrame, by: Sequence[str] = (), value: str = "value", ref_value: str = "vals", na: str = "propagate", name: str = "p") -> DataFrame:
    """Adds z and the two-sided p of every value against its reference group (DOM24-27).

    by=[]: one group for all (DOM25). A null in a group makes all of it null; na="skip" leaves nulls out.
    Groups of fewer than two values, or without spread, give null.
    """
    if na not in ("propagate", "skip"):
        raise ValueError("na is 'propagate' or 'skip'")
    names = ("_mean", "_sd")
    stats = reference.groupBy(*by).agg(*_mean_and_sd(ref_value, names, na=na))
    joined = values.join(stats, list(by), "left") if by else values.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumn(f"{name}_z", _z(value, names)).withColumn(name, normal_two_sided(f"{name}_z")).drop(*names)


def unspecific_p(values: DataFrame, reference: DataFrame, value: str = "tpm", numbers: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """p1, p2, p3: values against all reference totals of one copy number (DOM25)."""
    groups = {f"cn{n}": F.col("cn") == n for n in numbers}
    return _tested(values, reference, [], groups, {f"p{n}": (value, f"cn{n}") for n in numbers}, "vals")


def region_p(values: DataFrame, reference: DataFrame, skip: Sequence[str] = ("chrX", "chr10b"), region: str = "chr", a: str = "hap_a", b: str = "hap_b") -> DataFrame:
    """p1_a, p1_b, p2_a, p2_b: haplotypes against their own CN 1 values and against the joint CN 2 values of their region (DOM26).

    No CN 2 test in the skipped regions.
    """
    one = F.col("cn") == 1
    groups = {"a": (F.col("hap") == "A") & one, "b": (F.col("hap") == "B") & one, "both": (F.col("hap") == "A&B") & (F.col("cn") == 2) & ~F.col(region).isin(*skip)}
    tests = {"p1_a": (a, "a"), "p2_a": (a, "both"), "p1_b": (b, "b"), "p2_b": (b, "both")}
    return _tested(values, reference, [region], groups, tests, "vals")


def arm_p(values: DataFrame, controls: DataFrame, sample: str = "sample_id", arm: str = "arm", a: str = "hap_a", b: str = "hap_b") -> DataFrame:
    """p_a, p_b: haplotypes against the controls' values of the same arm and haplotype (DOM27)."""
    own = stack_labelled(members_of(values, controls, [sample]), [arm], {"a": a, "b": b}, "hap", "vals")
    groups = {h: F.col("hap") == h for h in "ab"}
    return _tested(values, own, [arm], groups, {"p_a": (a, "a"), "p_b": (b, "b")}, "vals")
