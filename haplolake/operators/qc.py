"""Quality profile of samples and the choice of controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplolake.functions.columns import rounded_even, safe_div
from haplolake.operators.relational import members_of

COUNTERS = ("N_unmapped", "N_multimapping", "N_noFeature", "N_ambiguous")
THRESHOLDS = (1, 5, 10)


def qc_profile(counts: DataFrame, annotated: DataFrame | None = None, sample: str = "sample_id", feature: str = "feature_id", count: str = "count", counters: Sequence[str] = COUNTERS, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """One row per sample: each counter and geneCounts as half-even percentages, th<t> genes with t reads or more, totalReads (DOM1).

    Rows whose feature is a counter are kept apart, all others are genes. Samples that ``annotated``
    lacks are left out. A sample without reads has null percentages.
    """
    rows = counts if annotated is None else members_of(counts, annotated, [sample])
    gene = ~F.col(feature).isin(*counters)
    sums = rows.groupBy(sample).agg(
        *(F.coalesce(F.sum(F.when(F.col(feature) == c, F.col(count))), F.lit(0)).cast("double").alias(f"_{c}") for c in counters),
        F.coalesce(F.sum(F.when(gene, F.col(count))), F.lit(0)).cast("double").alias("_geneCounts"),
        *(F.count_if(gene & (F.col(count) >= t)).alias(f"th{t}") for t in thresholds),
    )
    parts = [*counters, "geneCounts"]
    # 100 is multiplied first: that product is exact, so a percentage that ends in a half is one, and is rounded to even.
    total = sum((F.col(f"_{p}") for p in parts[1:]), F.col(f"_{parts[0]}"))
    return sums.select(sample, *(rounded_even(safe_div(100 * F.col(f"_{p}"), total)).alias(p) for p in parts), *(f"th{t}" for t in thresholds), total.alias("totalReads"))


def select_controls(annotation: DataFrame, qc: DataFrame, sample: str = "sample_id", group: str = "key_pairs", groups: Sequence[str] = ("c1", "c2", "c3"), measure: str = "th5", above: float = 6000) -> DataFrame:
    """Samples of the control groups whose measure exceeds the limit (DOM2)."""
    good = qc.filter(F.col(measure) > above).select(sample)
    return members_of(annotation.filter(F.col(group).isin(*groups)), good, [sample]).select(sample).distinct()
