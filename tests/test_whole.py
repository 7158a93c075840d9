"""Queries whose rows were cut, against brute force on the whole of the smallest tables."""

import random
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from haplolake.plans import registry

DATA = "/root/testdata/sf0.001"


def table(name, *columns):
    return [tuple(r[c] for c in columns) for r in pq.read_table(f"{DATA}/{name}.parquet", columns=list(columns)).to_pylist()]


def test_densify_has_every_feature_and_sample(spark):
    want = defaultdict(float)
    for f, s, v in table("lineitem", "l_partkey", "l_suppkey", "l_extendedprice"):
        want[f, s] += v / 1000
    got = registry.QUERIES["prj05_densify"](spark, DATA).collect()
    grid = [(f, s) for (f,) in table("part", "p_partkey") for (s,) in table("supplier", "s_suppkey")]
    assert max(grid)[0] >= 100
    assert sorted((r.feature_id, r.sample_id) for r in got) == sorted(grid)
    assert all(r.value == pytest.approx(want.get((r.feature_id, r.sample_id), 0), abs=1e-6) for r in got)


def test_uniform_families_over_all_regions(spark, monkeypatch):
    labels = [(1, "Brand#1", "A"), (1, "Brand#20", "B"), (2, "Brand#1", "A"), (2, "Brand#20", "A"), (3, "Brand#30", "normal"), (4, "Brand#30", "NA"), (4, "Brand#31", "B")]
    monkeypatch.setattr(registry.domain_queries, "_affected", lambda r: spark.createDataFrame(labels, "family long, chr string, affected string"))
    got = registry.QUERIES["dom39_uniform_families"](spark, DATA).collect()
    assert sorted((r.family, r.affected) for r in got) == [(2, "A"), (3, "normal")]


def test_control_distribution_has_points_of_all_families(spark):
    got = registry.QUERIES["rp05_control_distribution"](spark, DATA).collect()
    brand = dict(table("part", "p_partkey", "p_brand"))
    cells = {(s, brand[f]) for f, s in table("lineitem", "l_partkey", "l_suppkey") if f in brand}
    suppliers = {s for (s,) in table("supplier", "s_suppkey")}
    points = sorted((s, g, h, s // 4, "related" if s % 4 in (0, 1) else "unrelated") for s, g in cells if s in suppliers for h in "AB")
    assert sorted((r.sample_id, r.chr, r.hap, r.family, r.kind) for r in got if r.kind != "control") == points
    assert len({p[3] for p in points}) > 1
    assert sorted((r.sample_id, r.chr, r.hap) for r in got if r.kind == "control") == sorted(p[:3] for p in points if p[0] % 5 == 0)
    assert all((r.family is None) == (r.kind == "control") for r in got)


def test_region_and_arm_values_make_no_bins(spark, monkeypatch):
    """F8, F12, F13, F19, F20, F22: bins have as many rows as the matrix, and neither regions nor arms depend on them."""

    def bins(*_, **__):
        raise AssertionError("bins were made")

    monkeypatch.setattr(registry.domain_queries.regions, "place_by_bin", bins)
    assert registry.QUERIES["analysis_values"](spark, DATA).count() > 0
    registry.QUERIES["analysis_arm_p"](spark, DATA)


def test_the_chain_stores_lines_once(spark, monkeypatch):
    """F8, F12, F13, F19 to F22: before the grid, phased sites are the only stored rows of the size of the lines; lanes are counted, not copied."""
    sizes, dq = [], registry.domain_queries
    for module in (dq, dq.allelic):
        monkeypatch.setattr(module, "stored", lambda df, name, real=module.stored: sizes.append((name, real(df, name))) or sizes[-1][1])
    a = dq.Analysis(spark, DATA)
    assert a.matrix.count() > 0
    suppliers = len(table("supplier", "s_suppkey"))
    assert sum(name == "lanes" for name, _ in sizes) == 2
    assert all(df.count() <= suppliers for name, df in sizes if name == "lanes")
    assert sum(len({"lane", "pos"} & set(df.columns)) > 0 for df in {id(d): d for _, d in sizes}.values()) == 1


def test_own_phase_equals_a_joined_phase(spark):
    sites = [
        (1, "a", "x", 10, 5.0, 2.0, 1, 0.04), (2, "b", "x", 10, 7.0, None, -1, 0.01), (1, "b", "x", 10, 1.0, 3.0, None, None),  # phase 1
        (1, "a", "x", 20, 5.0, 2.0, -1, 0.05), (3, "a", "x", 20, 4.0, 9.0, -1, 0.02),  # phase -1
        (1, "a", "x", 30, 5.0, 2.0, 0, 0.05), (2, "a", "x", 30, 5.0, 2.0, -1, 0.05),  # phase 0
        (1, "a", "y", 10, 5.0, 2.0, 1, 0.05),  # one row
        (1, "a", "y", 20, 5.0, 2.0, 1, 0.03), (2, "a", "y", 20, 5.0, 2.0, 1, 0.03),  # not common enough
        (1, "a", None, 10, 5.0, 2.0, 1, 0.05), (2, "a", None, 10, 5.0, 2.0, 1, 0.05), (1, "a", "x", None, 5.0, 2.0, 1, 0.05), (2, "a", "x", None, 5.0, 2.0, 1, 0.05),
    ]
    df = spark.createDataFrame(sites, "sample_id long, lane string, chr string, pos long, ref double, alt double, haplotype int, maf double")
    allelic, columns = registry.domain_queries.allelic, ("sample_id", "lane", "chr", "pos", "a", "b")
    phase = df.groupBy("chr", "pos").agg(F.max("haplotype").alias("Haplotype"), F.max("maf").alias("MAF"), F.count(F.lit(1)).alias("sample_count"))
    want = allelic.assign_haplotype(df.drop("haplotype", "maf"), allelic.usable_phase(phase, 0.03, 1))
    got = allelic.assign_own_phase(df, 0.03, 1)
    assert set(got.columns) == set(columns)
    listed = lambda d: sorted(map(tuple, d.select(*columns).collect()), key=str)
    assert listed(got) == listed(want) == sorted([(1, "a", "x", 10, 5.0, 2.0), (2, "b", "x", 10, 7.0, None), (1, "b", "x", 10, 1.0, 3.0), (1, "a", "x", 20, 2.0, 5.0), (3, "a", "x", 20, 9.0, 4.0)], key=str)


def _records_sent(df):
    sent, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.nodeName()
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if kind == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStage"):
            todo.append(p.plan())
        elif kind == "Exchange":
            sent.append(p.metrics().apply("shuffleRecordsWritten").value())
    return sent


def test_levels_with_small_places_send_a_row_once(spark, monkeypatch):
    """with bins, each row of the matrix was sent as sums for each of its places, and the result again to drop arms; now a row once, with all its places."""
    regions = registry.domain_queries.regions
    monkeypatch.setattr(regions, "spread", lambda df, *keys: df.repartition(4, *keys))
    rng = random.Random(7)
    # Samples 18 and 19 aren't listed; feature 38 has none but these, 39 no place, 30 to 33 no fractions, 34 a variance of 0.
    cells = [(f, s, 1.0 if f == 34 else rng.choice([None, rng.random() + 0.5]), None if 30 <= f < 34 else rng.choice([None, rng.random()])) for f in range(40) for s in (range(18, 20) if f == 38 else range(20)) if rng.random() < 0.9]
    placed = [(level, place, f"c{f // 20}", f) for f in range(39) for level, place in (("bin", str(f // 2)), ("chr", f"c{f // 20}"), ("arm", f"c{f // 20}{'pq'[f % 20 >= 10]}"))] + [("arm", "c1p", "c1", 30)]
    placed = [p for p in placed if p[:2] != ("arm", "c1q") or 30 <= p[3] < 34]  # an arm without fractions
    matrix = spark.createDataFrame(cells, "feature_id long, sample_id long, tpm double, af double")
    places = spark.createDataFrame(placed, "level string, place string, chr string, feature_id long")
    samples = spark.createDataFrame([(s, s % 3 == 0) for s in range(18)], "sample_id long, is_control boolean")
    names = dict(simple={"af": ("c1", "c1p", "c1q")}, exclude=("c1",))
    fine = regions.haplotype_levels(matrix, places, samples, fine=True, **names)
    rows = lambda df: sorted([(r.level, r.place, r.sample_id, *(None if v is None else round(v, 9) for v in (r.tpm, r.af, r.hap_a, r.hap_b))) for r in df.collect()], key=str)
    got = rows(fine)
    assert got == rows(regions.haplotype_levels(matrix, places, samples, **names))
    # Arms as the means themselves tell: none without a value of each kind.
    plain = regions.aggregate_levels(matrix, places, samples, ("tpm", "af"), names["simple"], exclude=("c1",)).collect()
    kept = {r.place for r in plain if r.level == "arm" and r.tpm is not None} & {r.place for r in plain if r.level == "arm" and r.af is not None}
    assert {g[:3] for g in got} == {(r.level, r.place, r.sample_id) for r in plain if r.level != "arm" or r.place in kept}
    assert "c1q" not in kept and kept and len(got) < len(plain)
    assert max(_records_sent(fine)) <= len(cells)
