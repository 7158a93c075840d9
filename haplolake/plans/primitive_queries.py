"""Primitive operators (sources, projection, joins, aggregates, windows, order, sets, reshaping, scalars) on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.functions import columns as C
from haplolake.operators import intervals, moments, ordered, relational as R
from haplolake.operators.allelic import allele_rows, usable_phase
from haplolake.operators.expression import control_mean_with_zeros, densify, inverse_variance
from haplolake.plans.registry import query, rounded
from haplolake.plans.roles import HALF, N_REGIONS, Roles, X, tail_sql, with_roles
from haplolake.sources import stages, tables as S
from haplolake.sources.many_files import PLAIN_FILES
from haplolake.sources.scratch import new_path, stored

_R = "round({}, 6)".format

# ---- sources and sinks: what Spark writes from the tables is read again by the readers


@query("src01_manifest", "SELECT 'e' || c_nationkey % 3 AS experiment, c_mktsegment AS sample_id FROM customer GROUP BY ALL")
def src01(r: Roles) -> DataFrame:
    paths = {}
    for i in range(3):  # one list per experiment
        paths[f"e{i}"] = path = new_path(r.spark, "manifest")
        r.table("customer").filter(F.col("c_nationkey") % 3 == i).select(F.col("c_mktsegment").alias("samples")).write.csv(path, sep="\t", header=True)
    return S.read_manifest(r.spark, paths)


@query("src02_all_samples", "SELECT sample_id, COUNT(*) AS n FROM (SELECT DISTINCT c_nationkey % 3, c_mktsegment AS sample_id FROM customer) GROUP BY sample_id")
def src02(r: Roles) -> DataFrame:
    return S.all_samples(src01(r)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


def _per_sample(r: Roles, df: DataFrame, header: bool) -> str:
    path = new_path(r.spark, "per-sample")
    df.repartition("sample_id").write.options(**PLAIN_FILES).partitionBy("sample_id").csv(path, sep="\t", header=header)
    return path


def _sample_of_path() -> Column:
    return F.regexp_extract("path", "sample_id=([^/]+)/", 1).alias("sample_id")


@query("src03_per_sample_files", "SELECT CAST(l_suppkey AS VARCHAR) AS sample_id, COUNT(DISTINCT l_partkey) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY ALL")
def src03(r: Roles) -> DataFrame:
    counts = r.table("lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("feature")).agg(F.sum("l_linenumber").alias("count"))
    path = _per_sample(r, counts, header=False)
    rows = S.read_per_sample(r.spark, [path], "part-*", "feature_id string, count long", sep="\t")
    resolved = S.list_files(r.spark, [path], "part-*").select("path", _sample_of_path(), F.lit(1).alias("lane"))
    return S.with_samples(rows, resolved).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


@query("src04_resolve_samples", """
WITH files AS (SELECT page_id AS path, url AS file FROM pages), anno AS (SELECT s_suppkey AS row_no, 's' || s_suppkey AS sample, CAST(s_suppkey * 7 AS VARCHAR) AS q FROM supplier),
hits AS (SELECT path, file, sample, row_no, CASE WHEN contains(lower(file), '_' || q || '_') THEN 1 ELSE 2 END AS tier FROM files JOIN anno ON contains(lower(file), lower(q))),
best AS (SELECT *, row_number() OVER (PARTITION BY sample, row_no ORDER BY file, path) AS lane FROM (SELECT *, MIN(tier) OVER (PARTITION BY sample, row_no) AS best FROM hits) WHERE tier = best),
last AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY row_no DESC, sample) AS n FROM best WHERE lane <= 2)
SELECT CAST(path AS VARCHAR) AS path, file, CASE WHEN lane = 2 THEN sample || '_L2' ELSE sample END AS sample_id, CAST(lane AS INT) AS lane FROM last WHERE n = 1""")
def src04(r: Roles) -> DataFrame:
    files = r.table("pages").select("page_id", F.col("url").alias("file")).withColumnRenamed("page_id", "path")
    anno = r.table("supplier").select(F.col("s_suppkey").alias("row_no"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("sample_id"), (F.col("s_suppkey") * 7).cast("string").alias("fastq"))
    return S.resolve_samples(files, anno).withColumn("path", F.col("path").cast("string"))


@query("src05_allele_counts", with_roles("SELECT CAST(s AS VARCHAR) AS sample_id, g AS chr, pos, CAST(SUM(r) AS BIGINT) AS ref, CAST(SUM(t) AS BIGINT) AS alt FROM st GROUP BY ALL", "st"))
def src05(r: Roles) -> DataFrame:
    rows = r.sites.groupBy("sample_id", F.col("chr").alias("contig"), F.col("pos").alias("position")).agg(F.sum("ref").cast("long").alias("refCount"), F.sum("alt").cast("long").alias("altCount"))
    path = _per_sample(r, rows, header=True)
    read = S.read_allele_counts(r.spark, [path], "part-*", "contig string, position long, refCount long, altCount long")
    return read.select(_sample_of_path(), "chr", "pos", "ref", "alt")


@query("src06_tpm", with_roles(f"SELECT CAST(s AS VARCHAR) AS sample_id, CAST(f AS VARCHAR) AS feature_id, {_R('v')} AS value FROM m", "m"))
def src06(r: Roles) -> DataFrame:
    path = _per_sample(r, r.matrix.select("sample_id", F.col("feature_id").alias("gene_id"), F.col("value").alias("TPM")), header=True)
    read = S.read_tpm(r.spark, [path], "part-*", "gene_id string, TPM double")
    return rounded(read.select(_sample_of_path(), "feature_id", "value"), "value")


@query("src07_gene_counts", "SELECT CAST(l_suppkey AS VARCHAR) AS sample_id, CAST(l_partkey AS VARCHAR) AS feature_id, CAST(SUM(l_linenumber) AS BIGINT) AS count FROM lineitem GROUP BY ALL")
def src07(r: Roles) -> DataFrame:
    counts = r.table("lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("f")).agg(F.sum("l_linenumber").alias("c"), F.lit(0).alias("c2"), F.lit(1).alias("c3"))
    return S.read_gene_counts(r.spark, [_per_sample(r, counts, header=False)], "part-*").select(_sample_of_path(), "feature_id", "count")


@query("src08_gtf", "SELECT p_brand AS chr, p_partkey * 1000 + 1 AS start, p_partkey * 1000 + p_size * 40 AS \"end\", CAST(p_size * 40 AS BIGINT) AS width, '+' AS strand, 'gene' AS type, CAST(p_partkey AS VARCHAR) AS gene_id, p_type AS gene_type FROM part WHERE p_size % 2 = 0")
def src08(r: Roles) -> DataFrame:
    p = r.table("part")
    kind = F.when(F.col("p_size") % 2 == 0, "gene").otherwise("transcript")
    attributes = F.concat(F.lit('gene_id "'), F.col("p_partkey").cast("string"), F.lit('"; gene_type "'), "p_type", F.lit('"; level 2;'))
    line = F.concat_ws("\t", "p_brand", F.lit("src"), kind, (F.col("p_partkey") * 1000 + 1).cast("string"), (F.col("p_partkey") * 1000 + F.col("p_size") * 40).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attributes)
    path = new_path(r.spark, "gtf")
    p.select(line.alias("value")).write.text(path)
    return S.read_gtf(r.spark, path)


@query("src09_phase", with_roles(f"SELECT g AS chr, pos, CAST(h AS INT) AS \"Haplotype\", {_R('maf')} AS \"MAF\", n AS sample_count FROM ph", "ph"))
def src09(r: Roles) -> DataFrame:
    path = new_path(r.spark, "phase")
    names = ["chr", "pos", "Haplotype", "MAF", "sample_count"]
    body = r.phase.select(F.concat_ws("  ", *(F.col(c).cast("string") for c in names)).alias("value"))
    body.unionByName(r.spark.range(1).select(F.lit(" ".join(names)).alias("value"))).write.text(path)
    return rounded(S.read_phase(r.spark, path), "MAF")


@query("src10_annotation", "SELECT c_name, NULLIF(c_mktsegment, 'BUILDING') AS c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer")
def src10(r: Roles) -> DataFrame:
    path = new_path(r.spark, "annotation")
    c = r.table("customer")
    c.select("c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise("none").alias("balance")).write.csv(path, header=True)
    return S.read_annotation(r.spark, path, ["c_name", "c_mktsegment"], ["balance"])


@query("src11_offset_csv", "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS code FROM nation WHERE n_nationkey BETWEEN 5 AND 16 AND n_name <> (SELECT MIN(n_name) FROM nation)")
def src11(r: Roles) -> DataFrame:
    path = new_path(r.spark, "offset")
    n = r.table("nation")
    least = n.agg(F.min("n_name").alias("_m"))
    rows = n.crossJoin(least).select(F.when(F.col("n_name") == F.col("_m"), "").otherwise(F.col("n_name")).alias("a"), F.col("n_regionkey").cast("string").alias("b"), F.lit("x").alias("c"), F.col("n_nationkey").alias("_n"))
    rows.coalesce(1).sortWithinPartitions("_n").select("a", "b", "c").write.csv(path)
    return S.read_offset_csv(r.spark, path, header_row=2, skip=4, take=12, n_columns=2, names=["name", "code"], key="name")


@query("src12_regions", with_roles('SELECT g AS chr, CAST(a AS BIGINT) AS start, b AS "end", arm FROM arms', "arms"))
def src12(r: Roles) -> DataFrame:
    path = f"{new_path(r.spark, 'regions')}.parquet"
    r.arms.write.parquet(path)
    return S.read_regions(r.spark, path, "chr string, start long, end long, arm string")


@query("src13_labelled_samples", "SELECT s_suppkey AS id, s_nationkey AS chr, CAST(1 + 2 * (s_suppkey % 2) AS INT) AS cn FROM supplier WHERE s_suppkey NOT IN (52, 53) AND s_nationkey NOT IN (13, 18, 21, 22)")
def src13(r: Roles) -> DataFrame:
    s = r.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("chr"), (1 + 2 * (F.col("s_suppkey") % 2)).cast("int").alias("cn"))
    return S.labelled_samples(s, (52, 53), (13, 18, 21, 22), "id")


@query("src14_review", "SELECT c_name AS family, CASE WHEN c_nationkey = 0 THEN 23.0::DOUBLE ELSE CAST(c_nationkey AS DOUBLE) END AS chr FROM customer")
def src14(r: Roles) -> DataFrame:
    path = new_path(r.spark, "review")
    r.table("customer").select(F.col("c_name").alias("family"), F.when(F.col("c_nationkey") == 0, "X").otherwise(F.col("c_nationkey").cast("string")).alias("chr")).write.csv(path, header=True)
    return S.read_review(r.spark, path)


@query("src15_checkpoint", with_roles(f"SELECT f AS feature_id, s AS sample_id, {_R('v')} AS value FROM m", "m"))
def src15(r: Roles) -> DataFrame:
    return rounded(S.checkpoint(r.matrix, new_path(r.spark, "stage")), "value")


@query("src16_wide_csv", with_roles(f"SELECT CAST(f AS VARCHAR) AS feature_id, 's' || s AS sample, dense_rank() OVER (ORDER BY 's' || s) AS place, {_R('v')} AS value FROM m", "m"))
def src16(r: Roles) -> DataFrame:
    """The whole matrix as a wide file, a field for each sample, read back with the place of its column."""
    path = new_path(r.spark, "wide")
    S.write_wide_csv(r.matrix.withColumn("sample", F.concat(F.lit("s"), F.col("sample_id").cast("string"))), path, ["feature_id"], "sample", "value", compression="gzip")
    return rounded(S.read_wide_csv(r.spark, path).select("feature_id", F.col("column").alias("sample"), "place", F.col("value").cast("double").alias("value")), "value")


_DAMAGED = "CASE WHEN k % 97 = 0 THEN 'unreadable' WHEN k % 89 = 0 THEN 'no contig' WHEN k % 83 = 0 THEN 'out of range' END"


def _damaged(r: Roles) -> DataFrame:
    """A folder of allele counts in which some rows have a word for a number, no chromosome, or a negative count."""
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    l = r.table("lineitem")
    ref = F.when(k % 97 == 0, "many").when((k % 83 == 0) & (k % 89 != 0), "-1").otherwise(F.col("l_quantity").cast("long").cast("string"))
    contig = F.when((k % 89 == 0) & (k % 97 != 0), F.lit(None)).otherwise(F.lit("chr1"))
    path = new_path(r.spark, "damaged")
    rows = l.select(F.col("l_suppkey").alias("sample_id"), contig.alias("contig"), F.col("l_partkey").alias("position"), ref.alias("refCount"), F.col("l_linenumber").alias("altCount"))
    rows.repartition("sample_id").write.options(**PLAIN_FILES).partitionBy("sample_id").csv(path, sep="\t", header=True)
    return S.check_allele_counts(r.spark, [path], "part-*", "contig string, position long, refCount long, altCount long")


@query("src05_malformed_rows", f"WITH q AS (SELECT l_suppkey AS s, {_DAMAGED} AS reason FROM (SELECT *, l_orderkey * 7 + l_linenumber AS k FROM lineitem)) SELECT CAST(s AS VARCHAR) AS sample_id, COALESCE(reason, 'good') AS reason, COUNT(*) AS n FROM q GROUP BY ALL")
def src05_malformed(r: Roles) -> DataFrame:
    """Rows of every sample by what is wrong with them; good and quarantined ones are one reading."""
    checked = _damaged(r)
    good = checked.good.select("path", F.lit("good").alias("reason"))
    return good.unionByName(checked.quarantined.select("path", "reason")).groupBy(_sample_of_path(), "reason").agg(F.count(F.lit(1)).alias("n"))


@query("src05_error_budget", f"WITH q AS (SELECT l_suppkey AS s, l_quantity AS v, {_DAMAGED} AS reason FROM (SELECT *, l_orderkey * 7 + l_linenumber AS k FROM lineitem)) SELECT CAST(s AS VARCHAR) AS sample_id, COUNT(*) FILTER (WHERE reason IS NULL) AS n, CAST(COALESCE(SUM(CAST(v AS BIGINT)) FILTER (WHERE reason IS NULL), 0) AS BIGINT) AS total FROM q GROUP BY s HAVING COUNT(reason) <= 0.035 * COUNT(*) AND COUNT(*) > COUNT(reason)")
def src05_budget(r: Roles) -> DataFrame:
    """Counts of the files (one a sample) of which at most 3.5 percent of the rows are malformed."""
    return _damaged(r).within_budget(0.035).good.groupBy(_sample_of_path()).agg(F.count(F.lit(1)).alias("n"), F.sum("refCount").alias("total"))


@query("src15_incremental_stage", "SELECT CAST(l_suppkey AS VARCHAR) AS sample_id, COUNT(*) AS n, CAST(SUM(l_partkey) AS BIGINT) AS total FROM lineitem WHERE l_suppkey % 7 <> 0 OR l_linestatus = 'F' GROUP BY ALL")
def src15_incremental(r: Roles) -> DataFrame:
    """A stage over per-sample files, run again after files came, changed and went; the second run reads those alone."""
    path, stage = new_path(r.spark, "arriving"), new_path(r.spark, "stage")
    l = r.table("lineitem").select(F.col("l_suppkey").alias("sample_id"), "l_partkey", "l_linestatus")
    write = lambda rows: rows.repartition("sample_id").sortWithinPartitions("l_partkey").write.options(**PLAIN_FILES).partitionBy("sample_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").csv(path, sep="\t")
    unit = F.regexp_extract("path", "sample_id=([^/]+)/", 1)

    def compute(paths: list[str]) -> DataFrame:
        rows = r.spark.read.schema("l_partkey long, l_linestatus string").csv(paths, sep="\t")
        return rows.select(F.regexp_extract("_metadata.file_path", "sample_id=([^/]+)/", 1).alias("sample_id"), "l_partkey")

    write(l.filter("sample_id % 7 = 0 OR sample_id % 3 = 0"))
    stages.run_stage(r.spark, stage, stages.list_with_sizes(r.spark, [path], "part-*", unit), compute)
    write(l.filter("sample_id % 7 = 0 AND l_linestatus = 'F' OR sample_id % 7 <> 0 AND sample_id % 3 <> 0"))
    out = stages.run_stage(r.spark, stage, stages.list_with_sizes(r.spark, [path], "part-*", unit), compute)
    return out.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("total"))


@query("src18_missing_outputs", "SELECT 'e' || s_nationkey AS experiment, s_name AS sample_id, k AS kind FROM supplier CROSS JOIN (VALUES ('metrics'), ('table')) t(k) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_linenumber = 7 AND (l_returnflag = 'A') = (k = 'table'))")
def src18(r: Roles) -> DataFrame:
    s = r.table("supplier")
    manifest = s.select(F.concat(F.lit("e"), F.col("s_nationkey").cast("string")).alias("experiment"), F.col("s_name").alias("sample_id"))
    made = r.table("lineitem").filter("l_linenumber = 7").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    files = made.select(F.concat("s_name", F.when(F.col("l_returnflag") == "A", ".table").otherwise(".metrics")).alias("file"))
    return S.missing_outputs(manifest, files, {"metrics": F.concat("sample_id", F.lit(".metrics")), "table": F.concat("sample_id", F.lit(".table"))})


# ---- projection, filter, cleaning


@query("prj01_04_columns", "SELECT p_partkey AS feature, CAST(p_size AS DOUBLE) AS size, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS number, 'A' AS allele FROM part")
def prj01(r: Roles) -> DataFrame:
    p = r.table("part").drop("p_name").withColumnsRenamed({"p_partkey": "feature", "p_size": "size"})
    return p.withColumns({"size": F.col("size").try_cast("double"), "number": F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("double"), "allele": F.lit("A")}).select("feature", "size", "number", "allele")


@query("prj05_densify", with_roles(f"SELECT ft.f AS feature_id, smp.s AS sample_id, COALESCE({_R('v')}, 0) AS value FROM ft CROSS JOIN smp LEFT JOIN m ON m.f = ft.f AND m.s = smp.s", "ft", "smp", "m"))
def prj05(r: Roles) -> DataFrame:
    return densify(rounded(r.matrix, "value"), r.features, r.samples)  # zeros need no rounding


@query("prj06_07_missing", "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), '.') AS segment, round(c_acctbal / NULLIF(c_nationkey, 0), 6) AS ratio FROM customer")
def prj06(r: Roles) -> DataFrame:
    blank = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    return rounded(r.table("customer").select("c_custkey", C.null_to_dot(C.blank_to_null(blank)).alias("segment"), C.safe_div("c_acctbal", "c_nationkey").alias("ratio")), "ratio")


@query("prj08_09_weights", with_roles("SELECT f AS feature_id, round(COALESCE(1 / NULLIF(vv, 0), 0), 6) AS weight, round(log2(NULLIF(vv, 0)), 6) AS log_variance FROM (SELECT f, VAR_SAMP(v) FILTER (WHERE c) AS vv FROM m JOIN smp USING (s) GROUP BY f)", "m", "smp"))
def prj08(r: Roles) -> DataFrame:
    w = inverse_variance(r.matrix, r.samples)
    return rounded(w.select("feature_id", "weight", C.log2_positive("variance").alias("log_variance")), "weight", "log_variance")


@query("prj10_phase_filter", with_roles(f"SELECT g AS chr, pos, CAST(h AS INT) AS \"Haplotype\", {_R('maf')} AS \"MAF\", n AS sample_count FROM ph WHERE maf > 0.03 AND n > 1 AND h <> 0", "ph"))
def prj10(r: Roles) -> DataFrame:
    return rounded(usable_phase(r.phase, 0.03, 1), "MAF")


@query("prj11_15_filters", "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN ('Brand#24', 'Brand#23') AND p_brand IN (SELECT p_brand FROM part WHERE p_brand < 'Brand#3') AND p_type <> 'PROMO' AND p_size BETWEEN 5 AND 40 AND p_name NOT LIKE 'red%'")
def prj11(r: Roles) -> DataFrame:
    p = r.table("part")
    kept = p.filter(~F.col("p_brand").isin("Brand#24", "Brand#23") & ~F.col("p_name").rlike("^red") & F.col("p_size").between(5, 40) & (F.col("p_type") != "PROMO"))
    return R.members_of(kept, p.filter("p_brand < 'Brand#3'"), ["p_brand"]).select("p_partkey", "p_brand")


@query("prj16_18_labels", f"SELECT p_partkey, CASE WHEN p_brand <> '{HALF}' THEN p_brand WHEN p_size < 25 THEN '10a' ELSE '10b' END AS split, p_brand AS merged, CASE WHEN p_brand <> '{HALF}' THEN NULL WHEN p_size < 25 THEN 10.1::DOUBLE ELSE 10.2::DOUBLE END AS number, CASE p_type WHEN 'PROMO' THEN 'sale' ELSE p_type END AS kind FROM part")
def prj16(r: Roles) -> DataFrame:
    split = C.split_label("p_brand", "p_size", HALF, 25, "10a", "10b")
    p = r.table("part").withColumn("split", split)
    return p.select("p_partkey", "split", C.merge_labels("split", ("10a", "10b"), HALF).alias("merged"), C.chr_number("split").alias("number"), C.recode("p_type", {"PROMO": "sale"}).alias("kind"))


@query("prj18_chr_labels", "SELECT DISTINCT CASE n WHEN 23 THEN 'chrX' ELSE 'chr' || n END AS label, CAST(n AS DOUBLE) AS number FROM (SELECT p_size % 23 + 1 AS n FROM part)")
def prj18(r: Roles) -> DataFrame:
    label = C.chr_label(F.col("p_size") % 23 + 1)
    return r.table("part").select(label.alias("label"), C.chr_number(label).alias("number")).distinct()


@query("prj19_delete_rows", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (1, 5) AND s_name <> 'Supplier#000000007'")
def prj19(r: Roles) -> DataFrame:
    return r.table("supplier").filter(~F.col("s_suppkey").isin(1, 5) & (F.col("s_name") != "Supplier#000000007")).select("s_suppkey")


@query("prj20_split_alleles", with_roles("SELECT f AS feature_id, s AS sample_id, 'A' AS allele, a AS counts FROM al UNION ALL SELECT f, s, 'B', b FROM al", "al"))
def prj20(r: Roles) -> DataFrame:
    return allele_rows(r.alleles, ["feature_id", "sample_id"])


@query("prj21_rescale", with_roles(f"SELECT s AS sample_id, g AS chr, round(CASE g WHEN '{HALF}' THEN tpm * 1.5 WHEN '{X}' THEN tpm / x ELSE tpm END, 6) AS tpm FROM rv, (SELECT AVG(hb) AS x FROM rv WHERE g = '{X}')", "rv"))
def prj21(r: Roles) -> DataFrame:
    factor = r.values.filter(F.col("chr") == X).agg(F.avg("hap_b").alias("_x"))
    out = R.with_scalar(r.values, factor).select("sample_id", "chr", C.rescale("tpm", "chr", {HALF: 1.5, X: C.safe_div(F.lit(1.0), "_x")}).alias("tpm"))
    return rounded(out, "tpm")


# ---- joins


@query("jn01_02_phase_join", with_roles("SELECT s AS sample_id, COUNT(*) AS n, SUM(r) AS ref FROM st WHERE EXISTS (SELECT 1 FROM ph WHERE ph.g = st.g AND ph.pos = st.pos AND ph.h = 1) GROUP BY s", "ph"))
def jn01(r: Roles) -> DataFrame:
    phased = r.phase.filter(F.col("Haplotype") == 1)
    joined = R.lookup(r.sites, phased.select("chr", "pos", "MAF"), ["chr", "pos"], "inner")
    return R.members_of(joined, phased, ["chr", "pos"]).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ref").alias("ref"))


@query("jn03_04_features", with_roles(f"SELECT g AS chr, round(SUM(v), 6) AS total, COUNT(*) AS n FROM m JOIN ft USING (f) GROUP BY g", "m", "ft"))
def jn03(r: Roles) -> DataFrame:
    joined = R.lookup(r.matrix, r.features, ["feature_id"], "inner")
    return rounded(joined.groupBy("chr").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")), "total")


_OTHER = "SELECT f, g, a + 500 AS a, b + 1400 AS b FROM ft"


def _other(r: Roles) -> DataFrame:
    return r.features.select("feature_id", "chr", (F.col("start") + 500).alias("start"), (F.col("end") + 1400).alias("end"))


@query("jn05_interval_overlap", with_roles("SELECT ft.f AS feature_id, ft.g AS chr, o.f AS r_feature_id FROM ft LEFT JOIN o ON ft.g = o.g AND ft.a <= o.b AND o.a <= ft.b", "ft", o=_OTHER))
def jn05(r: Roles) -> DataFrame:
    return intervals.interval_join(r.features, _other(r), ["chr"], how="left").select("feature_id", "chr", "r_feature_id")


@query("jn06_point_in_interval", with_roles("SELECT st.g AS chr, st.pos, o.f AS r_feature_id, COUNT(*) AS n FROM st LEFT JOIN o ON st.g = o.g AND st.pos BETWEEN o.a AND o.b GROUP BY ALL", "st", o=_OTHER))
def jn06(r: Roles) -> DataFrame:
    points = r.sites.select("chr", "pos", F.col("pos").alias("end_pos"))
    hits = intervals.interval_join(points, _other(r), ["chr"], ("pos", "end_pos"), how="left")
    return hits.groupBy("chr", "pos", "r_feature_id").agg(F.count(F.lit(1)).alias("n"))


@query("jn07_bins_with_features", with_roles(
    "SELECT bin, COUNT(ft.f) AS n FROM (SELECT CAST(before + i + 1 AS BIGINT) AS bin, g, i * 50000 AS a, CASE WHEN i = n - 1 THEN len ELSE (i + 1) * 50000 END AS b FROM (SELECT *, UNNEST(RANGE(CAST(n AS BIGINT))) AS i FROM n1)) k LEFT JOIN ft ON ft.g = k.g AND ft.a <= k.b AND k.a <= ft.b GROUP BY bin",
    "ln", n0="SELECT g, len, GREATEST(1, len // 50000) AS n FROM ln", n1="SELECT g, len, n, COALESCE((SELECT SUM(n) FROM n0 y WHERE y.g < n0.g), 0) AS before FROM n0"))
def jn07(r: Roles) -> DataFrame:
    bins = intervals.make_bins(r.features, 50_000)
    return intervals.interval_join(bins, r.features.select("chr", "feature_id", "start", "end"), ["chr"], how="left").groupBy("bin").agg(F.count("r_feature_id").alias("n"))


@query("jn08_arms", with_roles("SELECT ft.f AS feature_id, arms.arm FROM ft LEFT JOIN arms ON ft.g = arms.g AND ft.a <= arms.b AND arms.a <= ft.b", "arms"))
def jn08(r: Roles) -> DataFrame:
    return intervals.label_overlaps(r.features, r.arms, ["chr"]).select("feature_id", F.col("r_arm").alias("arm"))


@query("jn09_10_membership", with_roles("SELECT f AS feature_id, COUNT(*) AS n FROM m WHERE s IN (SELECT s FROM smp WHERE c) AND f NOT IN (SELECT f FROM ft WHERE z > 40) GROUP BY f", "m", "smp", "ft"))
def jn09(r: Roles) -> DataFrame:
    kept = R.not_members_of(R.members_of(r.matrix, r.controls, ["sample_id"]), r.features.filter("size > 40"), ["feature_id"])
    return kept.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))


@query("jn11_anti_two_keys", with_roles("SELECT s AS sample_id, g AS chr FROM rv WHERE NOT (g = 'Brand#12' AND s % 15 = 0)", "rv"))
def jn11(r: Roles) -> DataFrame:
    listed = r.samples.filter("sample_id % 15 = 0").select("sample_id", F.lit("Brand#12").alias("chr"))
    return R.not_members_of(r.values, listed, ["sample_id", "chr"]).select("sample_id", "chr")


@query("jn12_matrix_lookup", with_roles(f"SELECT lb.s AS sample_id, lb.g AS chr, lb.cn, {_R('tpm')} AS tpm FROM lb LEFT JOIN rv ON rv.s = lb.s AND rv.g = lb.g", "lb", "rv"))
def jn12(r: Roles) -> DataFrame:
    return rounded(R.lookup(r.labelled, r.values.select("sample_id", "chr", "tpm"), ["sample_id", "chr"]).select("sample_id", "chr", "cn", "tpm"), "tpm")


@query("jn13_14_full_join", "WITH x AS (SELECT TRUE AS here, s_suppkey AS key, NULLIF(s_nationkey, 3) AS nation, s_acctbal AS a FROM supplier), y AS (SELECT c_custkey + 3 AS key, NULLIF(c_nationkey, 3) AS nation, c_acctbal * 2 AS b FROM customer) SELECT CASE WHEN x.here THEN x.key ELSE y.key END AS key, CASE WHEN x.here THEN x.nation ELSE y.nation END AS nation, a, b FROM x FULL JOIN y ON x.key IS NOT DISTINCT FROM y.key AND x.nation IS NOT DISTINCT FROM y.nation")
def jn13(r: Roles) -> DataFrame:
    x = r.table("supplier").select(F.col("s_suppkey").alias("key"), F.nullif("s_nationkey", F.lit(3)).alias("nation"), F.col("s_acctbal").alias("a"))
    y = r.table("customer").select((F.col("c_custkey") + 3).alias("key"), F.nullif("c_nationkey", F.lit(3)).alias("nation"), (F.col("c_acctbal") * 2).alias("b"))
    return R.full_join_on_common(x, y)


@query("jn15_27_key_joins", with_roles("SELECT family, g AS chr, COUNT(*) AS n, round(SUM(tpm), 6) AS tpm FROM rv JOIN fam USING (s) GROUP BY ALL", "rv", "fam"))
def jn15(r: Roles) -> DataFrame:
    joined = R.lookup(r.values, r.family, ["sample_id"], "inner")
    return rounded(joined.groupBy("family", "chr").agg(F.count(F.lit(1)).alias("n"), F.sum("tpm").alias("tpm")), "tpm")


@query("jn20_family_fill", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, c AS cell FROM (SELECT *, first_value(x IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_partkey END AS x FROM lineitem)) WHERE c IS NOT NULL")
def jn20(r: Roles) -> DataFrame:
    rows = r.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("cell")).distinct()
    return R.fill_from_group(rows, ["l_orderkey"], "cell", ["l_partkey", "l_suppkey", "l_linenumber"])


@query("jn28_29_cross", with_roles("SELECT smp.s AS sample_id, g AS chr, arm FROM smp CROSS JOIN (SELECT DISTINCT g FROM ft) CROSS JOIN (VALUES ('p'), ('q')) t(arm) WHERE c", "smp", "ft"))
def jn28(r: Roles) -> DataFrame:
    two = r.spark.createDataFrame([("p",), ("q",)], "arm string")
    return r.controls.crossJoin(r.features.select("chr").distinct()).crossJoin(two)


# ---- aggregates


@query("ag01_03_sums", "SELECT l_suppkey AS sample_id, SUM(l_quantity) AS total, COUNT(*) FILTER (WHERE l_quantity > 9) AS th10, COUNT(*) FILTER (WHERE l_quantity > 4) AS th5 FROM lineitem GROUP BY ALL")
def ag01(r: Roles) -> DataFrame:
    return r.table("lineitem").groupBy(F.col("l_suppkey").alias("sample_id")).agg(F.sum("l_quantity").alias("total"), F.count_if(F.col("l_quantity") > 9).alias("th10"), F.count_if(F.col("l_quantity") > 4).alias("th5"))


@query("ag04_06_controls", with_roles(f"SELECT f AS feature_id, round(AVG(v) FILTER (WHERE c), 9) AS mean, {_R('VAR_SAMP(v) FILTER (WHERE c)')} AS variance, round(COALESCE(SUM(v) FILTER (WHERE c), 0) / (SELECT COUNT(*) FROM smp WHERE c), 9) AS zero_mean FROM m JOIN smp USING (s) GROUP BY f", "m", "smp"))
def ag04(r: Roles) -> DataFrame:
    own = r.matrix.join(r.samples, "sample_id").groupBy("feature_id").agg(R.mean_where("value", "is_control").alias("mean"), R.variance_where("value", "is_control").alias("variance"))
    zeros = control_mean_with_zeros(r.matrix, r.samples).withColumnRenamed("control_mean", "zero_mean")
    return rounded(rounded(own.join(zeros, "feature_id"), "variance"), "mean", "zero_mean", digits=9)  # enough digits that no mean of cents is a tie


@query("ag06_merged_moments", with_roles(
    f"SELECT f AS feature_id, c AS is_control, COUNT(v) AS n, COUNT(*) FILTER (WHERE v = 0) AS zeros, {_R('AVG(v)')} AS mean, {_R('VAR_SAMP(v)')} AS variance, {_R('SUM(v) / n_all')} AS mean_with_zeros,"
    f" {_R('(SUM(v * v) - SUM(v) * SUM(v) / n_all) / NULLIF(n_all - 1, 0)')} AS variance_with_zeros, {_R('COALESCE(AVG(v) * AVG(v) / NULLIF(VAR_SAMP(v), 0), 0)')} AS weight FROM m JOIN smp USING (s) JOIN (SELECT c, COUNT(*) AS n_all FROM smp GROUP BY c) k USING (c) GROUP BY f, c, n_all", "m", "smp"))  # fmt: skip
def ag06_moments(r: Roles) -> DataFrame:
    """Moments by feature and group: nine tenths of the samples are summarised and stored, the rest is merged in."""
    by = ["feature_id", "is_control"]
    rows = r.matrix.join(r.samples, "sample_id")
    old = stored(moments.summarise(rows.filter("sample_id % 10 <> 3"), by), "moments")
    merged = moments.merge(old, moments.summarise(rows.filter("sample_id % 10 = 3"), by), by=by)
    size = r.samples.groupBy("is_control").agg(F.count(F.lit(1)).alias("n_all"))
    both = merged.join(size, "is_control")
    filled = moments.with_absent_as_zero(both, F.col("n_all")).select(*by, F.col("mean").alias("mean_with_zeros"), moments.variance().alias("variance_with_zeros"))
    own = both.select(*by, "n", "zeros", "mean", moments.variance().alias("variance"), moments.ratio_weight().alias("weight"))
    return rounded(own.join(filled, by), "mean", "variance", "mean_with_zeros", "variance_with_zeros", "weight")


@query("ag07_08_weighted_mean", with_roles(f"SELECT g AS chr, {_R('SUM(tc * af) / NULLIF(SUM(tc) FILTER (WHERE af IS NOT NULL), 0)')} AS weighted, {_R('AVG(af)')} AS plain FROM al JOIN ft USING (f) GROUP BY g", "al"))
def ag07(r: Roles) -> DataFrame:
    rows = r.alleles.join(r.features, "feature_id")
    return rounded(rows.groupBy("chr").agg(R.weighted_mean("af", "tc").alias("weighted"), F.avg("af").alias("plain")), "weighted", "plain")


@query("ag09_10_quantiles", with_roles(f"SELECT g AS chr, {_R('QUANTILE_CONT(tpm, 0.05)')} AS lower, {_R('QUANTILE_CONT(tpm, 0.5)')} AS middle, {_R('QUANTILE_CONT(tpm, 0.95)')} AS upper FROM rv GROUP BY g", "rv"))
def ag09(r: Roles) -> DataFrame:
    return rounded(ordered.quantiles(r.values, "tpm", {"lower": 0.05, "middle": 0.5, "upper": 0.95}, ["chr"]), "lower", "middle", "upper")


@query("ag11_15_reference", with_roles(f"SELECT {_R('AVG(hb)')} AS x_factor, {_R('AVG(tpm)')} AS mean, {_R('STDDEV_SAMP(tpm)')} AS sd, {_R('MAX(GREATEST(ha, hb))')} AS high, {_R('MIN(LEAST(ha, hb))')} AS low, {_R('AVG((ha + hb) / 2)')} AS middle FROM rv WHERE g = '{X}'", "rv"))
def ag11(r: Roles) -> DataFrame:
    x = r.values.filter(F.col("chr") == X)
    out = x.agg(F.avg("hap_b").alias("x_factor"), F.avg("tpm").alias("mean"), F.stddev_samp("tpm").alias("sd"), F.max(F.greatest("hap_a", "hap_b")).alias("high"), F.min(F.least("hap_a", "hap_b")).alias("low"), F.avg(C.midpoint("hap_a", "hap_b")).alias("middle"))
    return rounded(out, "x_factor", "mean", "sd", "high", "low", "middle")


@query("ag13_23_extents", with_roles("SELECT g AS chr, MAX(b) AS len, COUNT(DISTINCT z) AS sizes FROM ft GROUP BY g", "ft"))
def ag13(r: Roles) -> DataFrame:
    return r.features.groupBy("chr").agg(F.max("end").alias("len"), F.count_distinct("size").alias("sizes"))


@query("ag16_last_first", "SELECT l_suppkey AS key, arg_max(x, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber) FILTER (WHERE x IS NOT NULL) AS last, arg_min(x, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber) FILTER (WHERE x IS NOT NULL) AS first FROM (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, MAX(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS x FROM lineitem GROUP BY ALL) GROUP BY ALL")
def ag16(r: Roles) -> DataFrame:
    order = ["l_orderkey", "l_partkey", "l_linenumber"]
    rows = r.table("lineitem").groupBy(F.col("l_suppkey").alias("key"), *order).agg(F.max(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("x"))
    last, first = R.pick_non_null(rows, ["key"], order), R.pick_non_null(rows, ["key"], order, "first")
    return last.withColumnRenamed("x", "last").join(first.withColumnRenamed("x", "first"), "key")


@query("ag17_18_frequency", "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY ALL")
def ag17(r: Roles) -> DataFrame:
    return R.frequency(r.table("customer"), ["c_mktsegment", "c_nationkey"])


@query("ag19_chunk_means", "SELECT chunk, round(AVG(c_acctbal), 6) AS mean, COUNT(*) AS n FROM (SELECT c_acctbal, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) // 10 + 1 AS chunk FROM customer) GROUP BY chunk")
def ag19(r: Roles) -> DataFrame:
    chunks = ordered.rank_chunks(r.table("customer"), ["c_acctbal", "c_custkey"], 10, ["c_nationkey"])
    return rounded(chunks.groupBy("chunk").agg(F.avg("c_acctbal").alias("mean"), F.count(F.lit(1)).alias("n")), "mean")


@query("ag21_five_numbers", with_roles(
    f"SELECT g AS chr, {_R('q1')} AS q1, {_R('median')} AS median, {_R('q3')} AS q3, {_R('MIN(tpm) FILTER (WHERE tpm BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS low, {_R('MAX(tpm) FILTER (WHERE tpm BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS high FROM rv JOIN q USING (g) GROUP BY g, q1, median, q3",
    "rv", q="SELECT g, QUANTILE_CONT(tpm, 0.25) AS q1, QUANTILE_CONT(tpm, 0.5) AS median, QUANTILE_CONT(tpm, 0.75) AS q3 FROM rv GROUP BY g"))
def ag21(r: Roles) -> DataFrame:
    return rounded(ordered.five_numbers(r.values, "tpm", ["chr"]), "q1", "median", "q3", "low", "high")


# ---- windows


@query("wn01_running_sum", with_roles("SELECT f AS feature_id, s AS sample_id, round(SUM(v) OVER (PARTITION BY s ORDER BY v, f ROWS UNBOUNDED PRECEDING), 6) AS run FROM m", "m"))
def wn01(r: Roles) -> DataFrame:
    return rounded(ordered.running_sum(r.matrix, {"run": "value"}, ["value", "feature_id"], ["sample_id"]).select("feature_id", "sample_id", "run"), "run")


@query("wn02_rank_chunks", with_roles("SELECT f AS feature_id, s AS sample_id, (row_number() OVER (PARTITION BY s ORDER BY v, f) - 1) // 10 + 1 AS chunk FROM m", "m"))
def wn02(r: Roles) -> DataFrame:
    return ordered.rank_chunks(r.matrix, ["value", "feature_id"], 10, ["sample_id"]).select("feature_id", "sample_id", "chunk")


@query("wn03_05_group_stats", with_roles(f"SELECT s AS sample_id, g AS chr, {_R('SUM(tpm) OVER w')} AS total, {_R('AVG(tpm) OVER w')} AS mean, {_R('STDDEV_SAMP(tpm) OVER w')} AS sd, {_R('abs((tpm - AVG(tpm) OVER w) / NULLIF(STDDEV_SAMP(tpm) OVER w, 0))')} AS z FROM rv WINDOW w AS (PARTITION BY g)", "rv"))
def wn03(r: Roles) -> DataFrame:
    out = R.with_group_zscore(R.with_group_total(r.values, "tpm", ["chr"]), "tpm", ["chr"])
    return rounded(out.select("sample_id", "chr", "total", "mean", "sd", "z"), "total", "mean", "sd", "z")


@query("wn06_07_ranked", "SELECT a.c_nationkey AS nation, a.c_custkey AS first, b.c_custkey AS second, z.c_custkey AS last FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS n FROM customer) a JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS n FROM customer) b ON b.c_nationkey = a.c_nationkey AND b.n = 2 JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) AS n FROM customer) z ON z.c_nationkey = a.c_nationkey AND z.n = 1 WHERE a.n = 1")
def wn06(r: Roles) -> DataFrame:
    c = r.table("customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal", "c_custkey")
    up, down = [F.col("c_acctbal"), F.col("c_custkey")], [F.desc("c_acctbal"), F.desc("c_custkey")]
    parts = [R.keep_ranked(c, ["nation"], o, n).select("nation", F.col("c_custkey").alias(name)) for o, n, name in ((up, 1, "first"), (up, 2, "second"), (down, 1, "last"))]
    return parts[0].join(parts[1], "nation").join(parts[2], "nation")


@query("wn09_uniform_groups", "SELECT l_orderkey, MAX(l_returnflag) AS flag, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey HAVING COUNT(DISTINCT l_returnflag) = 1")
def wn09(r: Roles) -> DataFrame:
    rows = R.groups_with_one_value(r.table("lineitem").select("l_orderkey", "l_returnflag"), ["l_orderkey"], "l_returnflag")
    return rows.groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag"), F.count(F.lit(1)).alias("n"))


# ---- order, sets, reshaping


@query("so01_04_orders", "SELECT s_suppkey, CAST(CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS INT) AS place FROM supplier")
def so01(r: Roles) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ("A", "B", "c1", "other"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return r.table("supplier").select("s_suppkey", C.order_rank(role, ("A", "B", "c1")).alias("place")).orderBy("place", "s_suppkey")


@query("so03_ordered_like", "SELECT n_nationkey AS key, -r_regionkey AS place FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def so03(r: Roles) -> DataFrame:
    order = r.table("region").select(F.col("r_regionkey").alias("key"), (-F.col("r_regionkey")).alias("place"))
    return R.ordered_like(r.table("nation").select(F.col("n_nationkey").alias("key")), order, "key", "place").select("key", "place")


@query("st01_03_append", "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def st01(r: Roles) -> DataFrame:
    a = r.table("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = r.table("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    assert R.common_columns(a, b) == ["key", "name", "balance"]
    return R.append(a, b, fill=True)


@query("st04_06_sets", "SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0")
def st04(r: Roles) -> DataFrame:
    key = lambda t, c: r.table(t).select(F.col(c).alias("key"))
    both = R.members_of(key("customer", "c_nationkey"), key("supplier", "s_nationkey"), ["key"])
    return R.not_members_of(both, r.table("nation").filter("n_regionkey = 1 AND n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key")), ["key"]).distinct()


@query("st07_all_regions", with_roles(f"SELECT k.g AS chr, smp.s AS sample_id, {_R('tpm')} AS tpm FROM (SELECT DISTINCT g FROM ft) k CROSS JOIN smp LEFT JOIN rv ON rv.g = k.g AND rv.s = smp.s AND rv.tpm > 1", "rv", "smp"))
def st07(r: Roles) -> DataFrame:
    high = r.values.filter("tpm > 1").select("sample_id", "chr", "tpm")
    return rounded(R.with_all_regions(high, r.features, r.samples, "chr", "sample_id"), "tpm")


_REGIONS = [f"Brand#{i + 1}" for i in range(N_REGIONS)]


@query("rs01_02_widen", with_roles("SELECT s AS sample_id, " + ", ".join(f"round(MAX({c}) FILTER (WHERE g = '{g}'), 6) AS \"{g}_{c}\"" for g in _REGIONS for c in ("tpm", "af")) + " FROM rv GROUP BY s", "rv"))
def rs01(r: Roles) -> DataFrame:
    wide = R.widen(r.values, ["sample_id"], "chr", _REGIONS, ["tpm", "af"])
    return wide.select("sample_id", *(F.round(F.col(f"`{g}_{c}`"), 6).alias(f"{g}_{c}") for g in _REGIONS for c in ("tpm", "af")))


@query("rs03_melt", with_roles("SELECT s AS sample_id, g AS chr, k AS variable, round(CASE k WHEN 'hap_a' THEN ha WHEN 'hap_b' THEN hb ELSE tpm END, 6) AS value FROM rv CROSS JOIN (VALUES ('hap_a'), ('hap_b'), ('tpm')) t(k)", "rv"))
def rs03(r: Roles) -> DataFrame:
    return rounded(R.melt(r.values, ["sample_id", "chr"], ["hap_a", "hap_b", "tpm"]), "value")


@query("rs04_06_stack", with_roles("SELECT s AS sample_id, g AS chr, 'A' AS hap, round(ha, 6) AS value FROM rv UNION ALL SELECT s, g, 'B', round(hb, 6) FROM rv", "rv"))
def rs04(r: Roles) -> DataFrame:
    return rounded(R.stack_labelled(r.values, ["sample_id", "chr"], {"A": "hap_a", "B": "hap_b"}, "hap", "value"), "value")


# ---- scalar functions


@query("sc01_04_text", "SELECT p_partkey, regexp_replace(p_brand, '^Brand#', '') AS bare, regexp_matches(p_name, '(?i)RED') AS red, p_type || '_' || p_size AS built, contains('_' || lower(p_name) || '_', '_red widget_') AS word, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda t: t <> 'red'))), ' ') AS tokens FROM part")
def sc01(r: Roles) -> DataFrame:
    return r.table("part").select(
        "p_partkey", F.regexp_replace("p_brand", "^Brand#", "").alias("bare"), F.col("p_name").rlike("(?i)RED").alias("red"), F.concat_ws("_", "p_type", F.col("p_size").cast("string")).alias("built"),
        C.matches_word(F.concat(F.lit("_"), "p_name", F.lit("_")), F.lit("Red Widget")).alias("word"), F.concat_ws(" ", F.sort_array(C.tokens_other_than("p_name", "red"))).alias("tokens"),
    )


@query("sc05_11_numbers", "SELECT p_partkey, round_even(p_size / 4.0, 0) AS even, round(log2(p_size), 6) AS lg, round(pow(2, p_size / 10.0), 6) AS p2, round(sqrt(p_size), 6) AS root, abs(p_size - 25) AS dist, p_size // 7 AS whole, len(range(p_size // 7 + 1)) AS steps, p_size IS NULL AS none, round(p_retailprice / NULLIF(p_size % 3, 0), 6) AS ratio, (p_size + p_partkey) / 2 AS mid, round(sqrt(p_size * p_size + 9.0) / 2, 6) AS half FROM part")
def sc05(r: Roles) -> DataFrame:
    n = F.col("p_size")
    out = r.table("part").select(
        "p_partkey", C.rounded_even(n / 4.0).alias("even"), C.log2_positive(n).alias("lg"), F.pow(F.lit(2.0), n / 10).alias("p2"), F.sqrt(n).alias("root"), F.abs(n - 25).alias("dist"), F.floor(n / 7).cast("int").alias("whole"),
        F.size(F.sequence(F.lit(0), F.floor(n / 7).cast("int"))).cast("long").alias("steps"), n.isNull().alias("none"), C.safe_div("p_retailprice", n % 3).alias("ratio"), C.midpoint("p_size", "p_partkey").alias("mid"), C.half_hypotenuse(n.cast("double"), F.lit(3.0)).alias("half"),
    )
    return rounded(out, "lg", "p2", "root", "ratio", "half")


@query("sc07_normal_tail", "SELECT p_partkey, round(" + tail_sql("((p_partkey % 161 - 80) / 10.0)") + ", 6) AS p FROM part")
def sc07(r: Roles) -> DataFrame:
    return rounded(r.table("part").select("p_partkey", C.normal_two_sided((F.col("p_partkey") % 161 - 80) / 10).alias("p")), "p")
