"""Allelic counts: phasing, lanes, roll-up to genes, allele fractions, mono-allelic genes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplolake.functions.columns import safe_div
from haplolake.operators.intervals import interval_join
from haplolake.operators.relational import members_of, not_members_of
from haplolake.sources.scratch import stored


def usable_phase(phase: DataFrame, min_maf: float = 0.348, min_samples: int = 10, haplotype: str = "Haplotype", maf: str = "MAF", samples: str = "sample_count") -> DataFrame:
    """Phased sites that are common enough and seen in enough samples (PRJ10)."""
    return phase.filter((F.col(maf) > min_maf) & (F.col(samples) > min_samples) & (F.col(haplotype) != 0))


def assign_haplotype(counts: DataFrame, phase: DataFrame, site: Sequence[str] = ("chr", "pos"), sample: str = "sample_id", ref: str = "ref", alt: str = "alt", haplotype: str = "Haplotype") -> DataFrame:
    """sample, site, a, b: at phase 1 the reference allele is A, at -1 it is B; unphased sites go (DOM3, JN1, RS4 in wide form)."""
    phased = counts.join(phase.select(*site, haplotype).filter(F.col(haplotype).isin(1, -1)), list(reversed(site)))
    plus = F.col(haplotype) == 1
    rest = [c for c in counts.columns if c not in {*site, sample, ref, alt}]
    return phased.select(sample, *site, *rest, F.when(plus, F.col(ref)).otherwise(F.col(alt)).cast("double").alias("a"), F.when(plus, F.col(alt)).otherwise(F.col(ref)).cast("double").alias("b"))


def assign_own_phase(counts: DataFrame, min_maf: float = 0.348, min_samples: int = 10, site: Sequence[str] = ("chr", "pos"), sample: str = "sample_id", ref: str = "ref", alt: str = "alt", haplotype: str = "haplotype", maf: str = "maf") -> DataFrame:
    """assign_haplotype with the usable phase that the rows themselves tell: a site's greatest haplotype and frequency, and its number of rows.

    A site's rows meet once and bring their phase along, where a phase table would be summed from a second exchange of all rows and joined.
    """
    rows = counts
    for c in site:
        rows = rows.filter(F.col(c).isNotNull())
    # Positions tell most rows apart, so they are compared first.
    own = Window.partitionBy(*reversed(site))
    phased = rows.withColumns({"_h": F.max(haplotype).over(own), "_maf": F.max(maf).over(own), "_n": F.count(F.lit(1)).over(own)})
    usable = usable_phase(phased, min_maf, min_samples, "_h", "_maf", "_n").filter(F.col("_h").isin(1, -1))
    plus = F.col("_h") == 1
    rest = [c for c in counts.columns if c not in {*site, sample, ref, alt, haplotype, maf}]
    return usable.select(sample, *site, *rest, F.when(plus, F.col(ref)).otherwise(F.col(alt)).cast("double").alias("a"), F.when(plus, F.col(alt)).otherwise(F.col(ref)).cast("double").alias("b"))


def allele_rows(assigned: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Two rows a site, one per allele, with label and count (RS4)."""
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("allele"), F.col(c).alias("counts")) for n, c in (("A", "a"), ("B", "b"))))).alias("_x")
    return assigned.select(*ids, both).select(*ids, "_x.*")


def merge_lanes(df: DataFrame, key: Sequence[str], values: Sequence[str], sample: str = "sample_id", lane: str = "lane", n_lanes: DataFrame | None = None) -> DataFrame:
    """Mean over a sample's lanes, a missing lane counting as 0; samples with one lane are unchanged (DOM4).

    n_lanes (sample, lanes) says how many lanes a sample has; else they are counted in df.
    """
    df = stored(df, "lanes") if n_lanes is None else df
    lanes = n_lanes if n_lanes is not None else lane_counts(df, sample, lane)
    sums = df.groupBy(*key, sample).agg(*(F.sum(v).alias(v) for v in values))
    return sums.join(lanes.select(sample, "lanes"), sample).select(*key, sample, *(safe_div(v, "lanes").alias(v) for v in values))


def lane_counts(df: DataFrame, sample: str = "sample_id", lane: str = "lane") -> DataFrame:
    """sample, lanes: how many lanes a sample has."""
    return df.groupBy(sample).agg(F.count_distinct(lane).alias("lanes"))


def lane_shares(df: DataFrame, lanes: DataFrame, values: Sequence[str], sample: str = "sample_id") -> DataFrame:
    """Each row's values over its sample's number of lanes: what rows of a key and sample add up to is merge_lanes of them (DOM4)."""
    rest = [c for c in df.columns if c not in values]
    return df.join(lanes.select(sample, "lanes"), sample).select(*rest, *(safe_div(v, "lanes").alias(v) for v in values))


def rollup_to_gene(sites: DataFrame, exons: DataFrame, chrom: str = "chr", pos: str = "pos", sample: str = "sample_id", gene: str = "gene_id", values: Sequence[str] = ("a", "b"), multiplicity: str = "row") -> DataFrame:
    """gene, sample and summed counts of the sites inside a gene's exons (DOM5, JN6, AG1).

    multiplicity="row" counts a site once for every exon row that holds it, "site" once per gene.
    """
    if multiplicity not in ("row", "site"):
        raise ValueError("multiplicity is 'row' or 'site'")
    # Sites repeat over samples: find their genes once, then join the counts.
    sites = stored(sites, "sites")
    places = sites.select(chrom, pos).distinct().withColumn("_end", F.col(pos))
    hits = interval_join(places, exons.select(chrom, "start", "end", gene), [chrom], (pos, "_end")).select(chrom, pos, F.col(f"r_{gene}").alias(gene))
    # Positions first: keys are compared in this order, and a region has many.
    joined = sites.join(hits if multiplicity == "row" else hits.distinct(), [pos, chrom])
    return joined.groupBy(gene, sample).agg(*(F.sum(v).alias(v) for v in values))


def allele_fraction(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds af = a / (a + b), null at 0 / 0, and tc = a + b (DOM6)."""
    total = F.col(a) + F.col(b)
    return df.withColumns({"af": safe_div(a, total), "tc": total})


def _mean_fraction(value: str, condition: str) -> Column:
    """Mean of fractions (0 to 1) over rows that meet a condition, nulls skipped, the same in whatever order rows come (AG4).

    Doubles are added in the order of arrival otherwise, and a mean on a band's edge may come out on either side. Here
    the first 30 binary digits, the next 30 and the next 30 are added as integers, which is exact.
    """
    rest, sums = F.when(F.col(condition), F.col(value)), []
    for _ in range(3):
        whole = F.floor(rest * float(2**30))
        rest = rest * float(2**30) - whole
        sums.append(F.sum(whole))
    total = sums[0] * 2.0**-30 + (sums[1] * 2.0**-60 + sums[2] * 2.0**-90)
    return safe_div(total, F.count(F.when(F.col(condition), F.col(value))))


def monoallelic_genes(alleles: DataFrame, samples: DataFrame, features: DataFrame, bands: Mapping[str, tuple[float, float]], default: tuple[float, float] = (0.3, 0.7), exempt: Sequence[str] = ("chrX",), gene: str = "feature_id", sample: str = "sample_id", region: str = "chr", control: str = "is_control", band_of: Column | None = None) -> DataFrame:
    """Genes whose mean control allele fraction lies outside their region's band; a null mean is outside (DOM7).

    bands: by region, or by ``band_of`` if that column is given. Exempt regions are not listed, nor are genes without rows.
    """
    means = alleles.join(samples, sample).groupBy(gene).agg(_mean_fraction("af", control).alias("control_af"))
    placed = means.join(features.select(gene, region, *([band_of.alias("_band")] if band_of is not None else [])), gene)
    key = F.col("_band") if band_of is not None else F.col(region)
    low, high = F.lit(default[0]), F.lit(default[1])
    for name, (lo, hi) in bands.items():
        low, high = F.when(key == name, lo).otherwise(low), F.when(key == name, hi).otherwise(high)
    inside = F.coalesce(F.col("control_af").between(low, high), F.lit(False))
    return placed.filter(~F.col(region).isin(*exempt) & ~inside).select(gene, region, "control_af")


def drop_genes(df: DataFrame, genes: DataFrame, gene: str = "feature_id", samples: DataFrame | None = None, sample: str = "sample_id") -> DataFrame:
    """Take listed genes out; keep only samples of a table, if given (DOM8)."""
    left = not_members_of(df, genes, [gene])
    return left if samples is None else members_of(left, samples, [sample])
