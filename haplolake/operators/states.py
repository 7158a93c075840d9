"""Copy-number scaling and transcription states of haplotypes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.functions.columns import rescale
from haplolake.operators.ordered import quantiles
from haplolake.operators.relational import with_scalar

#: Expected values other than 1, by haplotype and region. Fixed values.
CENTERS = {("a", "chrX"): 0.23, ("b", "chr10b"): 2.0}


def rescale_cn(values: DataFrame, x: str = "chrX", half: str = "chr10b", region: str = "chr", tpm: str = "tpm", a: str = "hap_a", b: str = "hap_b") -> DataFrame:
    """Haplotypes: ``half`` times 1.5, X divided by the mean of all its B values; totals: ``half`` times 3,
    X times the sum of the rescaled haplotypes' means there, the rest times 2 (DOM28)."""
    factor = values.filter(F.col(region) == x).agg(F.avg(b).alias("_x"))
    one = with_scalar(values, factor)
    scaled = {c: rescale(c, region, {half: 1.5, x: F.try_divide(F.lit(1.0), F.col("_x"))}) for c in (a, b)}
    one = one.withColumns(scaled)
    total = one.filter(F.col(region) == x).agg((F.avg(a) + F.avg(b)).alias("_t"))
    out = with_scalar(one, total)
    times = F.when(F.col(region) == half, F.lit(3.0)).when(F.col(region) == x, F.col("_t")).otherwise(F.lit(2.0))
    return out.withColumn(tpm, F.col(tpm) * times).drop("_x", "_t")


def full_loss_threshold(reference: DataFrame, share: float = 0.95, cn: str = "cn", value: str = "aneuploid") -> DataFrame:
    """One row, threshold: the 95 % quantile of the lost haplotype's values (DOM29)."""
    return quantiles(reference.filter(F.col(cn) == 0), value, {"threshold": share})


def _center(hap: str, region: Column, centers: Mapping[tuple[str, str], float]) -> Column:
    out: Column = F.lit(1.0)
    for (h, r), v in centers.items():
        if h == hap:
            out = F.when(region == r, F.lit(v)).otherwise(out)
    return out


def call_states(values: DataFrame, threshold: DataFrame, alpha: float | None = None, n_regions: int = 24, centers: Mapping[tuple[str, str], float] = CENTERS, region: str = "chr") -> DataFrame:
    """Adds cn1_a, cn1_b (gain, loss, normal), cn2_a, cn2_b (full gain, intermediate, missing) and state_a, state_b (DOM30-32).

    values holds hap_a, hap_b, p1_a, p1_b, p2_a, p2_b; alpha defaults to .05 / (2 * regions). Rows whose
    p1 is null for either haplotype, or whose significant value equals its center, are dropped.
    """
    alpha = 0.05 / (2 * n_regions) if alpha is None else alpha
    out = with_scalar(values, threshold)
    for h in ("a", "b"):
        v, p, c = F.col(f"hap_{h}"), F.col(f"p1_{h}"), _center(h, F.col(region), centers)
        out = out.withColumn(f"cn1_{h}", F.when(p >= alpha, "normal").when((p < alpha) & (v > c), "gain").when((p < alpha) & (v < c), "loss"))
    out = out.filter("cn1_a IS NOT NULL AND cn1_b IS NOT NULL")
    both = F.col("p2_a").isNotNull() & F.col("p2_b").isNotNull()
    for h in ("a", "b"):
        p = F.col(f"p2_{h}")
        out = out.withColumn(f"cn2_{h}", F.when(~both, "missing").when(p >= alpha, "full gain").otherwise("intermediate"))
    for h in ("a", "b"):
        one, two, v, t = F.col(f"cn1_{h}"), F.col(f"cn2_{h}"), F.col(f"hap_{h}"), F.col("threshold")
        state = (
            F.when((one == "loss") & (v < t), "0").when((one == "loss") & (v > t), "1-")
            .when((one == "gain") & (two == "full gain"), "2").when((one == "gain") & two.isin("intermediate", "missing"), "1+")
            .when(one == "normal", "1").otherwise(".")
        )
        out = out.withColumn(f"state_{h}", state)
    return out.drop("threshold")
