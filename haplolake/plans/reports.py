"""Report tables: the data under the plots, for all cells and families in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplolake.functions.columns import chr_number, half_hypotenuse, log2_positive, normal_two_sided, order_rank, rescale, safe_div
from haplolake.operators.expression import control_mean_with_zeros
from haplolake.operators.grid import on_grid
from haplolake.operators.ordered import quantiles, rank_chunks, running_sum
from haplolake.operators.reference import ztest
from haplolake.operators.relational import fill_from_group, frequency, members_of, stack_labelled, with_group_total, with_group_zscore, with_scalar


def _x_factor(values: DataFrame, controls: DataFrame, x: str, sample: str, region: str, b: str) -> DataFrame:
    return members_of(values, controls, [sample]).filter(F.col(region) == x).agg(F.avg(b).alias("_x"))


def haplotype_bars(values: DataFrame, controls: DataFrame, roles: DataFrame, sample: str = "sample_id", region: str = "chr", a: str = "hap_a", b: str = "hap_b", x: str = "chrX", half: str = "chr10b") -> DataFrame:
    """sample, role, chr, number, hap, value, total: total before the rescale of X and the split chromosome (RP1, WN3, JN21)."""
    long = stack_labelled(values, [sample, region], {"A": a, "B": b}, "hap", "value")
    long = with_group_total(long, "value", [sample, region])
    scaled = with_scalar(long, _x_factor(values, controls, x, sample, region, b))
    value = rescale("value", region, {half: 1.5, x: F.try_divide(F.lit(1.0), F.col("_x"))})
    return scaled.join(roles, sample).select(sample, "role", region, chr_number(region).alias("number"), "hap", value.alias("value"), "total")


def bin_track(bins: DataFrame, centromeres: DataFrame, region: str = "chr", sample: str = "sample_id", ratio: str = "tpm", a: str = "hap_a", b: str = "hap_b") -> DataFrame:
    """sample, chr, mid, track (total, A, B), value (twice the ratio for the total), centromere (RP2, RS6)."""
    doubled = bins.withColumn("_total", 2 * F.col(ratio))
    long = stack_labelled(doubled, [sample, region, "mid"], {"total": "_total", "A": a, "B": b}, "track", "value")
    return long.join(F.broadcast(centromeres), region, "left")  # a row for each region of the genome


def ratio_by_expression(matrix: DataFrame, samples: DataFrame, size: int = 10, feature: str = "feature_id", sample: str = "sample_id", value: str = "value", digits: tuple[int, int] | None = None) -> DataFrame:
    """sample, chunk, control, ratio, log2_ratio: genes with a control mean, in chunks of its order; absent cells count as 0 (RP3, WN2, AG19).

    digits: of control, and of both ratios; given here, a number is rounded once and not in every empty cell.
    """
    means = control_mean_with_zeros(matrix, samples, feature, sample, value).filter("control_mean > 0")
    # Genes of all chromosomes are ranked in one order. Means that differ by rounding alone are one.
    keyed = means.withColumn("_mean", F.round("control_mean", 9))
    chunks = rank_chunks(keyed, ["_mean", feature], size).drop("_mean")
    sizes = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("_n"), F.avg("control_mean").alias("control"))
    sums = matrix.join(chunks, feature).groupBy(sample, "chunk").agg(F.sum(safe_div(value, "control_mean")).alias("_s"))
    near, far = (lambda c: F.round(c, digits[0]), lambda c: F.round(c, digits[1])) if digits else (F.col, lambda c: c)
    ratio = F.when(F.col("_s").isNotNull(), F.col("_s") / F.col("_n"))
    finished = lambda df: df.select(sample, "chunk", "control", F.coalesce(far(ratio), F.lit(0.0)).alias("ratio"), far(log2_positive(ratio)).alias("log2_ratio"))
    return on_grid(sizes.withColumn("control", near("control")), samples, sums, ["chunk"], sample, each=finished)


def cumulative_expression(matrix: DataFrame, samples: DataFrame, features: DataFrame, feature: str = "feature_id", sample: str = "sample_id", value: str = "value", region: str = "chr") -> DataFrame:
    """sample, chr, feature, cum_sample, cum_control, half: running sums by control expression within a chromosome (RP4, WN1)."""
    means = control_mean_with_zeros(matrix, samples, feature, sample, value).filter("control_mean > 0")
    rows = matrix.join(means, feature).join(features.select(feature, region), feature)
    out = running_sum(rows, {"cum_sample": value, "cum_control": "control_mean"}, ["control_mean", feature], [sample, region])
    return out.select(sample, region, feature, "cum_sample", "cum_control", half_hypotenuse("cum_sample", "cum_control").alias("half"))


def control_distribution(values: DataFrame, controls: DataFrame, families: DataFrame, sample: str = "sample_id", region: str = "chr", a: str = "hap_a", b: str = "hap_b", x: str = "chrX", half: str = "chr10b") -> DataFrame:
    """sample, chr, hap, value, kind: control values and family points, rescaled; kind is control, related or unrelated (RP5).

    families: sample, related (boolean); its other columns, as the family, are carried with the points and null for controls.
    """
    scaled = with_scalar(values, _x_factor(values, controls, x, sample, region, b))
    long = stack_labelled(scaled, [sample, region, "_x"], {"A": a, "B": b}, "hap", "value")
    long = long.withColumn("value", rescale("value", region, {half: 1.5, x: F.try_divide(F.lit(1.0), F.col("_x"))})).drop("_x")
    points = long.join(families, sample).withColumn("kind", F.when(F.col("related"), "related").otherwise("unrelated")).drop("related")
    return members_of(long, controls, [sample]).withColumn("kind", F.lit("control")).unionByName(points, allowMissingColumns=True)


def cells_of_interest(reviewed: DataFrame, cells: DataFrame, values: DataFrame, family_info: DataFrame, haplotypes: DataFrame, base_cn: DataFrame, hap_key: Sequence[str] = ("family", "chr", "generation", "interpretation")) -> DataFrame:
    """Reviewed events with their family's cell, its values, annotation, micronucleus haplotype and base copy number (RP6, JN19, JN20, JN22-25).

    reviewed: family, chr, ...; cells: family, chr, cell; values: cell, chr, hap, value; haplotypes: hap_key and mn_hap.
    """
    events = fill_from_group(reviewed.join(cells, ["family", "chr"], "left"), ["family"], "cell", ["chr"])
    wide = events.join(values, ["cell", "chr"]).join(family_info, ["cell", "chr", "family"], "left")
    chosen = wide.join(haplotypes, list(hap_key)).filter(F.col("hap") == F.col("mn_hap"))
    return chosen.join(base_cn, "pattern", "left")


def cohort_of_interest(interest: DataFrame, values: DataFrame, reference: DataFrame, alpha: float = 0.05 / 48) -> DataFrame:
    """All regions of the cells of interest, z-scored within that cohort; interpretation is null where a region is not the reviewed one (RP6 into RP7).

    interest: cell, chr, hap, interpretation, as cells_of_interest gives; values: cell, chr, hap, value.
    """
    cohort = members_of(values, interest, ["cell"])
    marks = interest.select("cell", "chr", "hap", "interpretation")
    return cohort_zscores(cohort, reference, alpha=alpha).join(marks, ["cell", "chr", "hap"], "left")


def cohort_zscores(values: DataFrame, reference: DataFrame, by: Sequence[str] = ("chr", "hap"), value: str = "value", ref_value: str = "vals", alpha: float = 0.05 / 48) -> DataFrame:
    """Absolute z within the cohort, p, flag p < alpha, and the reference's .05, .5, .95 bounds (RP7, WN4, JN26, SC7)."""
    bounds = confidence_bands(reference, by, ref_value)
    scored = with_group_zscore(values, value, by)
    return scored.withColumn("p", normal_two_sided("z")).withColumn("flag", F.col("p") < alpha).join(bounds, list(by))


def confidence_bands(reference: DataFrame, by: Sequence[str], value: str = "vals") -> DataFrame:
    """lower, middle, upper per group (RP8, AG10, WN5)."""
    return quantiles(reference, value, {"lower": 0.05, "middle": 0.5, "upper": 0.95}, by)


def generation_subset(rows: DataFrame, generation: str, base_cn: Sequence[int] = (), rupture: str | None = None) -> DataFrame:
    """Rows of a generation, optionally of some base copy numbers and one rupture class (RP9)."""
    out = rows.filter(F.col("generation") == generation)
    out = out.filter(F.col("base_cn").isin(*base_cn)) if base_cn else out
    return out if rupture is None else out.filter(F.col("rupture") == rupture)


def interpretation_counts(reviewed: DataFrame) -> DataFrame:
    """table, level, interpretation, n: by chromosome, by rupture class, and over all (RP10, AG18)."""
    parts = [frequency(reviewed.withColumns({"table": F.lit(t), "level": level.cast("string")}), ["table", "level", "interpretation"]) for t, level in (("chr", F.col("chr")), ("rupture", F.col("rupture")), ("all", F.lit("all")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cells_with_p(values: DataFrame, reference: DataFrame, by: Sequence[str] = ("chr", "hap"), alpha: float = 0.05 / 48) -> DataFrame:
    """All cells x chr x hap: value, p of its region and flag (RP11, JN27)."""
    return ztest(values, reference, by).drop("p_z").withColumn("flag", F.col("p") < alpha)


def family_list(annotation: DataFrame, cohort: Sequence[str] = ("Gen1", "Gen2"), group: str = "key_pairs", family: str = "family", exclusion: str = "exclusion") -> DataFrame:
    """Families of the cohort by size, the later generation first (RP12, PRJ15, AG17)."""
    kept = annotation.filter(F.col(group).isin(*cohort) & (F.col(exclusion) == ""))
    counted = kept.groupBy(group, family).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(order_rank(group, [*reversed(cohort)]), F.desc("n"), family)


def labelled_distribution(reference: DataFrame, labels: Mapping[int, str] | None = None) -> DataFrame:
    """Reference with a state name per copy number; the controls' alleles are normal (RP13)."""
    names = labels or {0: "loss", 1: "control", 2: "gain"}
    case = None
    for cn, name in names.items():
        case = F.when(F.col("cn") == cn, name) if case is None else case.when(F.col("cn") == cn, name)
    return reference.withColumn("label", F.when((F.col("cn") == 1) | (F.col("hap") == "normal"), "normal").otherwise(case))
