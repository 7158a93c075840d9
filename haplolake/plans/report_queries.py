"""Report tables on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplolake.operators import intervals, regions
from haplolake.operators.reference import reference_aneuploid, reference_haplotype
from haplolake.operators.relational import stack_labelled
from haplolake.plans import reports
from haplolake.plans.domain_queries import _ANEU, _CHAIN, _HAP, _LEVEL_SQL, _PROFILE, _SIZE, Analysis, _affected, _halved, _role_levels
from haplolake.plans.registry import query, rounded
from haplolake.plans.roles import HALF, SKIP, Roles, X, tail_sql, with_roles
from haplolake.sources.scratch import stored

_R = "round({}, 6)".format
_XF = f"SELECT AVG(hb) AS x FROM rv JOIN smp USING (s) WHERE c AND g = '{X}'"
_LONG = "SELECT s, g, 'A' AS hap, ha AS v FROM rv UNION ALL SELECT s, g, 'B', hb FROM rv"
_SCALE = f"CASE g WHEN '{HALF}' THEN v * 1.5 WHEN '{X}' THEN v / x ELSE v END"


@query("rp01_haplotype_bars", with_roles(f"SELECT s AS sample_id, role, g AS chr, TRY_CAST(g AS DOUBLE) AS number, hap, {_R(_SCALE)} AS value, {_R('total')} AS total FROM (SELECT *, SUM(v) OVER (PARTITION BY s, g) AS total FROM q) JOIN fam USING (s), xf", "rv", "smp", "fam", q=_LONG, xf=_XF))
def rp01(r: Roles) -> DataFrame:
    roles = r.family.select("sample_id", F.col("relationship").alias("role"))
    return rounded(reports.haplotype_bars(r.values, r.controls, roles, x=X, half=HALF), "value", "total")


@query("rp02_bin_track", with_roles(
    f"SELECT smp.s AS sample_id, bins.g AS chr, (bins.a + bins.b) / 2 AS mid, track, {_R('CASE track WHEN ' + chr(39) + 'total' + chr(39) + ' THEN 2 * tpm WHEN ' + chr(39) + 'A' + chr(39) + ' THEN ha ELSE hb END')} AS value, CAST(len // 2 AS BIGINT) AS centromere"
    " FROM bins CROSS JOIN smp LEFT JOIN lh ON level = 'bin' AND place = CAST(bin AS VARCHAR) AND lh.s = smp.s JOIN ln ON ln.g = bins.g CROSS JOIN (VALUES ('total'), ('A'), ('B')) t(track)",
    "m", "smp", "ln", "arms", "al", **_LEVEL_SQL))
def rp02(r: Roles) -> DataFrame:
    """Tracks of all bins, empty ones too."""
    bins = intervals.make_bins(r.features, _SIZE)
    centromeres = r.features.groupBy("chr").agg(F.floor(F.max("end") / 2).alias("centromere"))
    return regions.on_all_bins(_role_levels(r), bins, r.samples, each=lambda df: rounded(reports.bin_track(df, centromeres), "value"))


_CM = "SELECT f, COALESCE(SUM(v) FILTER (WHERE c), 0) / (SELECT COUNT(*) FROM smp WHERE c) AS mu FROM m JOIN smp USING (s) GROUP BY f"


@query("rp03_ratio_by_expression", with_roles(
    f"SELECT smp.s AS sample_id, ks.chunk, round(control, 9) AS control, {_R('COALESCE(x, 0) / n')} AS ratio, {_R('log2(NULLIF(COALESCE(x, 0) / n, 0))')} AS log2_ratio FROM ks CROSS JOIN smp LEFT JOIN t ON t.s = smp.s AND t.chunk = ks.chunk",
    "m", "smp", cm=_CM, k="SELECT f, mu, (row_number() OVER (ORDER BY round(mu, 9), f) - 1) // 10 + 1 AS chunk FROM cm WHERE mu > 0",
    ks="SELECT chunk, COUNT(*) AS n, AVG(mu) AS control FROM k GROUP BY chunk", t="SELECT s, chunk, SUM(v / mu) AS x FROM m JOIN k USING (f) GROUP BY ALL"))
def rp03(r: Roles) -> DataFrame:
    return reports.ratio_by_expression(r.matrix, r.samples, digits=(9, 6))


@query("rp04_cumulative", with_roles(
    "SELECT s AS sample_id, g AS chr, f AS feature_id, round(cs, 8) AS cum_sample, round(cc, 8) AS cum_control, round(sqrt(cs * cs + cc * cc) / 2, 6) AS half FROM (SELECT s, g, f, SUM(v) OVER w AS cs, SUM(mu) OVER w AS cc FROM m JOIN cm USING (f) JOIN ft USING (f) WHERE mu > 0 WINDOW w AS (PARTITION BY s, g ORDER BY mu, f ROWS UNBOUNDED PRECEDING))",
    "m", "smp", "ft", cm=_CM))
def rp04(r: Roles) -> DataFrame:
    return rounded(rounded(reports.cumulative_expression(r.matrix, r.samples, r.features), "half"), "cum_sample", "cum_control", digits=8)


@query("rp05_control_distribution", with_roles(
    f"SELECT s AS sample_id, g AS chr, hap, {_R(_SCALE)} AS value, 'control' AS kind, CAST(NULL AS BIGINT) AS family FROM q JOIN smp USING (s), xf WHERE c UNION ALL SELECT s, g, hap, {_R(_SCALE)}, CASE WHEN role IN ('A', 'B') THEN 'related' ELSE 'unrelated' END, family FROM q JOIN fam USING (s), xf", "rv", "smp", "fam", q=_LONG, xf=_XF))
def rp05(r: Roles) -> DataFrame:
    families = r.family.select("sample_id", "family", F.col("relationship").isin("A", "B").alias("related"))
    return rounded(reports.control_distribution(r.values, r.controls, families, x=X, half=HALF).select("sample_id", "chr", "hap", "value", "kind", "family"), "value")


_BOUNDS = "SELECT g, hap, QUANTILE_CONT(v, 0.05) AS lower, QUANTILE_CONT(v, 0.5) AS middle, QUANTILE_CONT(v, 0.95) AS upper FROM h GROUP BY ALL"


def _pairs(r: Roles) -> DataFrame:
    return stack_labelled(r.values, ["sample_id", "chr"], {"A": "hap_a", "B": "hap_b"}, "hap", "value")


def _controls(r: Roles) -> DataFrame:
    return reference_haplotype(r.values, r.controls, None, r.skip)


@query("rp07_cohort_zscores", with_roles(
    f"SELECT s AS sample_id, g AS chr, hap, {_R('v')} AS value, {_R('z')} AS z, {_R(tail_sql('z'))} AS p, {tail_sql('z')} < 0.05 AS flag, {_R('lower')} AS lower, {_R('middle')} AS middle, {_R('upper')} AS upper FROM (SELECT *, abs((v - AVG(v) OVER (PARTITION BY g, hap)) / NULLIF(STDDEV_SAMP(v) OVER (PARTITION BY g, hap), 0)) AS z FROM q) JOIN k USING (g, hap)",
    "rv", "smp", q=_LONG, h=_HAP, k=_BOUNDS))
def rp07(r: Roles) -> DataFrame:
    out = reports.cohort_zscores(_pairs(r), _controls(r), alpha=0.05)
    return rounded(out.select("sample_id", "chr", "hap", "value", "z", "p", "flag", "lower", "middle", "upper"), "value", "z", "p", "lower", "middle", "upper")


@query("rp08_confidence_bands", with_roles(f"SELECT g AS chr, hap, {_R('lower')} AS lower, {_R('middle')} AS middle, {_R('upper')} AS upper FROM k", "rv", "smp", h=_HAP, k=_BOUNDS))
def rp08(r: Roles) -> DataFrame:
    return rounded(reports.confidence_bands(_controls(r), ["chr", "hap"]), "lower", "middle", "upper")


@query("rp11_cells_with_p", with_roles(
    f"SELECT s AS sample_id, g AS chr, hap, {_R('v')} AS value, {_R(tail_sql('(v - mu) / NULLIF(sd, 0)'))} AS p, {tail_sql('(v - mu) / NULLIF(sd, 0)')} < 0.05 AS flag FROM q LEFT JOIN (SELECT g, hap, AVG(v) AS mu, STDDEV_SAMP(v) AS sd FROM h GROUP BY ALL HAVING COUNT(v) = COUNT(*)) k USING (g, hap)",
    "rv", "smp", q=_LONG, h=_HAP))
def rp11(r: Roles) -> DataFrame:
    return rounded(reports.cells_with_p(_pairs(r), _controls(r), alpha=0.05).select("sample_id", "chr", "hap", "value", "p", "flag"), "value", "p")


@query("rp12_family_list", with_roles("SELECT generation AS key_pairs, family, COUNT(*) AS n FROM fam WHERE s % 11 <> 0 GROUP BY ALL", "fam"))
def rp12(r: Roles) -> DataFrame:
    annotation = r.family.withColumns({"key_pairs": F.col("generation"), "exclusion": F.when(F.col("sample_id") % 11 == 0, "x").otherwise("")})
    return reports.family_list(annotation)


@query("rp13_labelled_distribution", with_roles(
    f"SELECT s AS sample_id, CAST(cn AS INT) AS cn, g AS chr, hap, {_R('v')} AS vals, CASE WHEN cn = 1 OR hap = 'normal' THEN 'normal' WHEN cn = 0 THEN 'loss' WHEN cn = 2 THEN 'gain' END AS label FROM (SELECT s, cn, g, 'aneuploid' AS hap, an AS v FROM q UNION ALL SELECT s, cn, g, 'normal', no FROM q)", "rv", "lb", "smp", q=_ANEU))
def rp13(r: Roles) -> DataFrame:
    return rounded(reports.labelled_distribution(reference_aneuploid(r.values, r.labelled, r.controls, SKIP)[1]), "vals")


# ---- reports at the end of the whole analysis, from one set of stored tables, at the default significance

_DEFAULT = 0.05 / 48
_INTEREST = {
    "ev": "SELECT family, chr, generation, affected, cn_pattern, MAX(\"A_cell\") OVER (PARTITION BY family) AS cell FROM aff WHERE affected IN ('A', 'B')",
    "coi": "SELECT family, chr, cell, affected AS interpretation, hap, v, TRY_CAST(split_part(cn_pattern, ' ', 1) AS INT) AS base_cn FROM ev JOIN q ON q.s = cell AND q.g = chr AND q.hap = affected",
}


def _interest(a: Roles) -> DataFrame:
    """Affected haplotypes of the families' first cells; profile and region values are stored tables."""
    profile = stored(_affected(a).select("family", "chr", "generation", "affected", "cn_pattern", F.col("A_cell").alias("cell"), "A_state_a", "A_state_b"), "profile")
    reviewed = profile.filter(F.col("affected").isin("A", "B")).select("family", "chr", "generation", F.col("affected").alias("interpretation"), F.col("cn_pattern").alias("pattern"))
    cells = profile.select("family", "chr", "cell")
    haplotypes = reviewed.select("family", "chr", "generation", "interpretation", F.col("interpretation").alias("mn_hap"))
    patterns = reviewed.select("pattern").distinct()
    base = patterns.select("pattern", F.split("pattern", " ")[0].try_cast("int").alias("base_cn"))
    info = profile.filter("cell IS NOT NULL").select("cell", "chr", "family", "A_state_a", "A_state_b")
    values = _pairs(a).withColumnRenamed("sample_id", "cell")
    return reports.cells_of_interest(reviewed, cells, values, info, haplotypes, base)


_EVENTS = "SELECT family, chr, generation, rupt_time AS rupture, affected AS interpretation, TRY_CAST(split_part(cn_pattern, ' ', 1) AS INT) AS base_cn FROM aff WHERE affected <> 'normal'"


def _events(r: Roles) -> DataFrame:
    """The families' events in the place of a manual review of them."""
    base = F.split("cn_pattern", " ")[0].try_cast("int").alias("base_cn")
    return _affected(r).filter("affected <> 'normal'").select("family", "chr", "generation", F.col("rupt_time").alias("rupture"), F.col("affected").alias("interpretation"), base)


@query("rp06_cells_of_interest", with_roles(f"SELECT family, chr, cell, interpretation, hap, {_R('v')} AS value, base_cn FROM coi", "rv", "lb", "smp", "fam", **_PROFILE, q=_LONG, **_INTEREST))
def rp06(r: Roles) -> DataFrame:
    return rounded(_interest(r).select("family", "chr", "cell", "interpretation", "hap", "value", "base_cn"), "value")


@query("rp09_generation_subset", with_roles("SELECT family, chr, rupture FROM ev WHERE generation = 'Gen1' AND rupture = 'ruptured' AND base_cn IN (1, 2)", "rv", "lb", "smp", "fam", **_PROFILE, ev=_EVENTS))
def rp09(r: Roles) -> DataFrame:
    return reports.generation_subset(_events(r), "Gen1", (1, 2), "ruptured").select("family", "chr", "rupture")


@query("rp10_interpretation_counts", with_roles("SELECT 'chr' AS \"table\", chr AS level, interpretation, COUNT(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT 'rupture', rupture, interpretation, COUNT(*) FROM ev GROUP BY ALL UNION ALL SELECT 'all', 'all', interpretation, COUNT(*) FROM ev GROUP BY ALL", "rv", "lb", "smp", "fam", **_PROFILE, ev=_EVENTS))
def rp10(r: Roles) -> DataFrame:
    return reports.interpretation_counts(stored(_events(r), "events"))


@query("analysis_cells", with_roles(
    f"SELECT s AS sample_id, role, q.g AS chr, q.hap, {_R('v')} AS value, {_R('total')} AS total, {_R(tail_sql('(v - mu) / NULLIF(sd, 0)'))} AS p, {tail_sql('(v - mu) / NULLIF(sd, 0)')} < {_DEFAULT} AS flag FROM (SELECT *, SUM(v) OVER (PARTITION BY s, g) AS total FROM q) q JOIN fam USING (s) LEFT JOIN (SELECT g, hap, AVG(v) AS mu, STDDEV_SAMP(v) AS sd FROM h GROUP BY ALL HAVING COUNT(v) = COUNT(*)) k ON k.g = q.g AND k.hap = q.hap",
    "ph", "arms", "fam", **_CHAIN, q=_LONG, **_halved({"h": _HAP})))
def analysis_cells(r: Roles) -> DataFrame:
    """Every cell, region and haplotype: the bars' totals and the p of its region, from counts on."""
    a = Analysis(r.spark, r.folder)
    bars = reports.haplotype_bars(a.values, a.controls, r.family.select("sample_id", F.col("relationship").alias("role")), x=X, half=a.half)
    tested = reports.cells_with_p(_pairs(a), _controls(a))
    out = bars.drop("value").join(tested, ["sample_id", "chr", "hap"])
    return rounded(out.select("sample_id", "role", "chr", "hap", "value", "total", "p", "flag"), "value", "total", "p")


@query("analysis_interest", with_roles(f"SELECT family, chr, cell, interpretation, hap, {_R('v')} AS value, base_cn FROM coi", "ph", "arms", "lb", "fam", **_CHAIN, **_halved(_PROFILE), q=_LONG, **_INTEREST))
def analysis_interest(r: Roles) -> DataFrame:
    """Cells of interest, from counts on: the families' events take the place of the review."""
    out = _interest(Analysis(r.spark, r.folder))
    return rounded(out.select("family", "chr", "cell", "interpretation", "hap", "value", "base_cn"), "value")


@query("analysis_cohort", with_roles(
    f"SELECT s AS cell, z.g AS chr, z.hap, {_R('z.v')} AS value, {_R('z')} AS z, {_R(tail_sql('z'))} AS p, {tail_sql('z')} < {_DEFAULT} AS flag, {_R('lower')} AS lower, {_R('middle')} AS middle, {_R('upper')} AS upper, interpretation FROM (SELECT *, abs((v - AVG(v) OVER (PARTITION BY g, hap)) / NULLIF(STDDEV_SAMP(v) OVER (PARTITION BY g, hap), 0)) AS z FROM q WHERE s IN (SELECT cell FROM coi)) z JOIN kb ON kb.g = z.g AND kb.hap = z.hap LEFT JOIN coi ON coi.cell = z.s AND coi.chr = z.g AND coi.hap = z.hap",
    "ph", "arms", "lb", "fam", **_CHAIN, **_halved(_PROFILE), q=_LONG, **_INTEREST, kb=_BOUNDS))
def analysis_cohort(r: Roles) -> DataFrame:
    """The cells of interest among themselves and against the controls' bounds, from counts on."""
    a = Analysis(r.spark, r.folder)
    out = reports.cohort_of_interest(_interest(a), _pairs(a).withColumnRenamed("sample_id", "cell"), _controls(a))
    return rounded(out.select("cell", "chr", "hap", "value", "z", "p", "flag", "lower", "middle", "upper", "interpretation"), "value", "z", "p", "lower", "middle", "upper")
