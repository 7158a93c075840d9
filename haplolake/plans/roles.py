"""Roles that the given tables play: a supplier is a sample, a part a gene, a brand a chromosome.

Each frame has a SQL twin of the same content, from which the queries' twins are put together.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplolake.sources.scratch import stored

X, HALF = "Brand#25", "Brand#10"
SKIP = (X, HALF)
N_REGIONS = 25


class Roles:
    """Role frames over the tables of one folder."""

    #: Labels of the region that is halved and of those without a test at copy number 2.
    half, skip = HALF, SKIP

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def matrix(self) -> DataFrame:
        """feature_id, sample_id, value."""
        return self.table("lineitem").groupBy(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("sample_id")).agg((F.sum("l_extendedprice") / 1000).alias("value"))

    @property
    def samples(self) -> DataFrame:
        """sample_id, is_control: every fifth is a control."""
        return self.table("supplier").select(F.col("s_suppkey").alias("sample_id"), (F.col("s_suppkey") % 5 == 0).alias("is_control"))

    @property
    def controls(self) -> DataFrame:
        return self.samples.filter("is_control").select("sample_id")

    @property
    def features(self) -> DataFrame:
        """feature_id, chr, start, end, size."""
        start = F.col("p_partkey") * 1000
        return self.table("part").select(F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("chr"), start.alias("start"), (start + F.col("p_size") * 40).alias("end"), F.col("p_size").alias("size"))

    @property
    def sites(self) -> DataFrame:
        """sample_id, lane, chr, pos, ref, alt, haplotype: allele counts with the phase of their row."""
        phase = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
        rows = self.table("lineitem").join(self.features, F.col("l_partkey") == F.col("feature_id"))
        pos = (F.col("l_partkey") * 1000 + F.col("l_quantity").cast("long") * 30).alias("pos")
        return rows.select(F.col("l_suppkey").alias("sample_id"), F.col("l_linestatus").alias("lane"), "feature_id", "chr", pos, F.col("l_quantity").alias("ref"), F.col("l_linenumber").cast("double").alias("alt"), phase.alias("haplotype"), F.col("l_discount").alias("maf"))

    @property
    def phase(self) -> DataFrame:
        """chr, pos, Haplotype, MAF, sample_count: one row per site."""
        return self.sites.groupBy("chr", "pos").agg(F.max("haplotype").alias("Haplotype"), F.max("maf").alias("MAF"), F.count(F.lit(1)).alias("sample_count"))

    @property
    def alleles(self) -> DataFrame:
        """feature_id, sample_id, a, b, af, tc."""
        a = F.sum(F.when(F.col("haplotype") == 1, F.col("ref")).when(F.col("haplotype") == -1, F.col("alt")).otherwise(0.0))
        b = F.sum(F.when(F.col("haplotype") == 1, F.col("alt")).when(F.col("haplotype") == -1, F.col("ref")).otherwise(0.0))
        sums = self.sites.groupBy("feature_id", "sample_id").agg(a.alias("a"), b.alias("b"))
        return sums.withColumns({"af": F.try_divide(F.col("a"), F.col("a") + F.col("b")), "tc": F.col("a") + F.col("b")})

    @cached_property
    def values(self) -> DataFrame:
        """sample_id, chr, tpm, af, hap_a, hap_b: region values near 1, stored once for all that a query builds on them."""
        rows = self.table("lineitem").join(self.features, F.col("l_partkey") == F.col("feature_id"))
        flag = lambda x: F.sum(F.when(F.col("l_returnflag") == x, F.col("l_quantity")).otherwise(0.0))
        sums = rows.groupBy(F.col("l_suppkey").alias("sample_id"), "chr").agg(F.sum("l_extendedprice").alias("t"), flag("A").alias("qa"), flag("R").alias("qr"))
        means = sums.groupBy("chr").agg(F.avg("t").alias("mean_t"))
        out = sums.join(means, "chr").select("sample_id", "chr", (F.col("t") / F.col("mean_t")).alias("tpm"), F.try_divide(F.col("qa"), F.col("qa") + F.col("qr")).alias("af"))
        return stored(out.withColumns({"hap_a": 2 * F.col("tpm") * F.col("af"), "hap_b": 2 * F.col("tpm") * (1 - F.col("af"))}), "region-values")

    @property
    def labelled(self) -> DataFrame:
        """sample_id, chr, cn: samples 1 and 3 of every ten, at one region each."""
        s = self.table("supplier").filter(F.col("s_suppkey") % 10 % 2 == 1).filter(F.col("s_suppkey") % 10 < 4)
        return s.select(F.col("s_suppkey").alias("sample_id"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("chr"), (F.col("s_suppkey") % 10).cast("int").alias("cn"))

    @property
    def family(self) -> DataFrame:
        """sample_id, family, relationship, generation, rupt_time, family_ids, MN_info, event: four suppliers are a family."""
        k = F.col("s_suppkey")
        role = F.element_at(F.array(*map(F.lit, ("A", "B", "c1", "c2"))), (k % 4 + 1).cast("int"))
        family = F.floor(k / 4)
        return self.table("supplier").select(k.alias("sample_id"), family.alias("family"), role.alias("relationship"), F.when(family % 2 == 0, "Gen1").otherwise("Gen2").alias("generation"), F.when(family % 3 == 0, "intact").otherwise("ruptured").alias("rupt_time"), F.concat(F.lit("F"), family.cast("string")).alias("family_ids"), F.when(family % 2 == 0, "A").otherwise("B").alias("MN_info"), F.concat(F.lit("e"), (family % 5).cast("string")).alias("event"))

    @property
    def arms(self) -> DataFrame:
        """chr, start, end, arm: each region cut at the middle of its length; neighbours share the edge."""
        length = self.features.groupBy("chr").agg(F.max("end").alias("len"))
        half = F.floor(F.col("len") / 2)
        p = length.select("chr", F.lit(0).cast("long").alias("start"), half.alias("end"), F.concat("chr", F.lit("p")).alias("arm"))
        return p.unionByName(length.select("chr", half.alias("start"), F.col("len").alias("end"), F.concat("chr", F.lit("q")).alias("arm")))


#: The same frames as common table expressions; short names: f feature, s sample, g region, v value, c control.
SQL = {
    "m": "SELECT l_partkey AS f, l_suppkey AS s, SUM(l_extendedprice) / 1000 AS v FROM lineitem GROUP BY ALL",
    "smp": "SELECT s_suppkey AS s, s_suppkey % 5 = 0 AS c FROM supplier",
    "ft": "SELECT p_partkey AS f, p_brand AS g, p_partkey * 1000 AS a, p_partkey * 1000 + p_size * 40 AS b, p_size AS z FROM part",
    "st": "SELECT l_suppkey AS s, l_linestatus AS lane, f, g, l_partkey * 1000 + CAST(l_quantity AS BIGINT) * 30 AS pos, l_quantity AS r, CAST(l_linenumber AS DOUBLE) AS t,"
    " CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS h, l_discount AS maf FROM lineitem JOIN ft ON f = l_partkey",
    "ph": "SELECT g, pos, MAX(h) AS h, MAX(maf) AS maf, COUNT(*) AS n FROM st GROUP BY ALL",
    "al": "SELECT *, a / NULLIF(a + b, 0) AS af, a + b AS tc FROM (SELECT f, s, SUM(CASE h WHEN 1 THEN r WHEN -1 THEN t ELSE 0 END) AS a, SUM(CASE h WHEN 1 THEN t WHEN -1 THEN r ELSE 0 END) AS b FROM st GROUP BY f, s)",
    "rv0": "SELECT l_suppkey AS s, g, SUM(l_extendedprice) AS t, SUM(CASE l_returnflag WHEN 'A' THEN l_quantity ELSE 0 END) AS qa, SUM(CASE l_returnflag WHEN 'R' THEN l_quantity ELSE 0 END) AS qr FROM lineitem JOIN ft ON f = l_partkey GROUP BY ALL",
    "rv": "SELECT s, g, tpm, af, 2 * tpm * af AS ha, 2 * tpm * (1 - af) AS hb FROM (SELECT s, g, t / AVG(t) OVER (PARTITION BY g) AS tpm, qa / NULLIF(qa + qr, 0) AS af FROM rv0)",
    "lb": "SELECT s_suppkey AS s, 'Brand#' || (s_suppkey % 25 + 1) AS g, CAST(s_suppkey % 10 AS INT) AS cn FROM supplier WHERE s_suppkey % 10 IN (1, 3)",
    "fam": "SELECT s_suppkey AS s, s_suppkey // 4 AS family, ['A', 'B', 'c1', 'c2'][s_suppkey % 4 + 1] AS role, CASE WHEN s_suppkey // 4 % 2 = 0 THEN 'Gen1' ELSE 'Gen2' END AS generation, CASE WHEN s_suppkey // 4 % 3 = 0 THEN 'intact' ELSE 'ruptured' END AS rupt, 'F' || (s_suppkey // 4) AS family_ids, CASE WHEN s_suppkey // 4 % 2 = 0 THEN 'A' ELSE 'B' END AS mn, 'e' || (s_suppkey // 4 % 5) AS event FROM supplier",
    "ln": "SELECT g, MAX(b) AS len FROM ft GROUP BY g",
    "arms": "SELECT g, 0 AS a, len // 2 AS b, g || 'p' AS arm FROM ln UNION ALL SELECT g, len // 2, len, g || 'q' FROM ln",
}
NEEDS = {"st": ["ft"], "ph": ["st"], "al": ["st"], "rv0": ["ft"], "rv": ["rv0"], "ln": ["ft"], "arms": ["ln"]}


def with_roles(body: str, *names: str, **own: str) -> str:
    """WITH clause of the named role tables (and what they need), then own ones, then the body."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in own.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def tail_sql(z: str) -> str:
    """SQL of the two-sided normal tail by other means: the error function's series below 2.8, a continued fraction beyond."""
    x = f"(abs({z}) / sqrt(2.0))"
    series = f"list_reduce(range(60, 0, -1), lambda t, n: 1 + t * 2 * {x} * {x} / (2 * n + 1), 1.0::DOUBLE)"
    fraction = f"list_reduce(range(120, 0, -1), lambda t, n: {x} + n / 2.0 / t, {x})"
    near, far = f"1 - 2 / sqrt(pi()) * {x} * exp(-{x} * {x}) * {series}", f"exp(-{x} * {x}) / sqrt(pi()) / {fraction}"
    return f"CASE WHEN ({z}) IS NULL THEN NULL WHEN {x} < 2 THEN {near} ELSE {far} END"
