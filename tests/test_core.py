"""Hand-worked cases and invariants of the core operators."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from haplolake.functions import columns as C
from haplolake.operators import allelic, annotate, expression, families, intervals, ordered, qc, reference, regions, relational, states
from haplolake.plans import reports
from haplolake.sources import tables


def rows(df, *order):
    return sorted((tuple(r) for r in (df.select(*order) if order else df).collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_normal_tail(spark):
    zs = [0.0, 1e-300, 0.5, -1.0, 0.7, 1.96, 3.2790243, -6.0, 8.4, 8.5, 12.0, *(k / 7 for k in range(1, 260)), 37.0, 38.4]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", C.normal_two_sided("z").alias("p"), C.log_normal_two_sided("z").alias("l")).collect():
        want = math.erfc(abs(r.z) / math.sqrt(2))
        # math.erfc is given a rounded quotient; at z that alone changes the tail by z^2 roundings.
        assert r.p == pytest.approx(want, rel=1e-14 + 2.4e-16 * r.z**2, abs=1e-320)
        assert r.p <= 1 and (want == 0 or r.l == pytest.approx(math.log(want), rel=1e-13, abs=1e-14) or want < 1e-307)
    from fractions import Fraction

    def exact(z, terms=200):  # continued fraction in exact numbers, the exponential apart
        x2, t = Fraction(z) ** 2 / 2, Fraction(0)
        for n in range(terms, 0, -1):
            t = Fraction(n, 2) / ((1 if n % 2 else x2) + t)
        return math.sqrt(float(x2) / math.pi) / float(x2 + t)

    for z in (5.0, 12.5, 25.0, 37.0):
        got = one(spark, C.normal_two_sided(F.lit(z)))
        assert got == pytest.approx(math.exp(-z * z / 2) * exact(z), rel=1e-14)
    far = one(spark, C.log_normal_two_sided(F.lit(1000.0)))
    assert far == pytest.approx(-500_000 - math.log(1000 * math.sqrt(math.pi / 2)), rel=1e-11) and one(spark, C.normal_two_sided(F.lit(1000.0))) == 0


def test_scalars(spark):
    assert one(spark, C.normal_two_sided(F.lit(None).cast("double"))) is None
    assert one(spark, C.safe_div(F.lit(1), F.lit(0))) is None
    assert one(spark, C.finite_or_null(F.lit(float("inf")))) is None
    assert one(spark, C.weight_or_zero(F.lit(float("nan")))) == 0
    assert [one(spark, C.rounded_even(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert [one(spark, C.chr_number(F.lit(x))) for x in ("chr10b", "X", "7", "MT")] == [10.2, 23, 7, None]
    assert one(spark, C.order_rank(F.lit("q"), ("a", "b"))) is None
    assert C.CHROMOSOMES.index("10b") == 10 and len(C.CHROMOSOMES) == 24


def test_qc_rounds_half_to_even_and_counts_thresholds(spark):
    counts = [("s", "N_unmapped", 1), ("s", "N_ambiguous", 9), *[("s", f"g{i}", n) for i, n in enumerate([0, 1, 4, 5, 9, 10, 161])], ("t", "g0", 0), ("u", "g0", 3)]
    got = {r.sample_id: r for r in qc.qc_profile(spark.createDataFrame(counts, "sample_id string, feature_id string, count long"), spark.createDataFrame([("s",), ("t",)], "sample_id string")).collect()}
    assert got["s"].totalReads == 200 and (got["s"].N_unmapped, got["s"].N_ambiguous, got["s"].geneCounts) == (0, 4, 95)  # .5, 4.5, 95
    assert (got["s"].th1, got["s"].th5, got["s"].th10) == (6, 4, 2)
    assert got["t"].geneCounts is None and "u" not in got
    anno = spark.createDataFrame([("s", "c1"), ("t", "c2"), ("s", "x")], "sample_id string, key_pairs string")
    assert rows(qc.select_controls(anno, spark.createDataFrame([("s", 4), ("t", 3)], "sample_id string, th5 long"), above=3)) == [("s",)]


def test_qc_percentages_that_end_in_a_half_are_rounded_to_even(spark):
    # 23 of 40 is 57.5 %, but 100 * (23 / 40) is 57.49999999999999 in doubles; 109 of 200 is 54.5 %, not 54.50000000000001.
    counts = [("s", "N_unmapped", 23), ("s", "g", 17), ("t", "N_unmapped", 91), ("t", "g", 109)]
    got = {r.sample_id: r for r in qc.qc_profile(spark.createDataFrame(counts, "sample_id string, feature_id string, count long")).collect()}
    assert (got["s"].N_unmapped, got["s"].geneCounts) == (58, 42)
    assert (got["t"].N_unmapped, got["t"].geneCounts) == (46, 54)


def test_alleles_phase_lanes_and_rollup(spark):
    counts = spark.createDataFrame([("s", "1", "chr1", 10, 5, 2), ("s", "1", "chr1", 20, 5, 2), ("s", "1", "chr1", 30, 1, 1), ("s", "1", "chr1", 40, 9, 9), ("t", "1", "chr1", 10, 3, 1), ("t", "2", "chr1", 20, 6, 4)], "sample_id string, lane string, chr string, pos long, ref long, alt long")
    phase = spark.createDataFrame([("chr1", 10, 1), ("chr1", 20, -1), ("chr1", 30, 0)], "chr string, pos long, Haplotype int")
    a = allelic.assign_haplotype(counts, phase)
    assert rows(a, "sample_id", "pos", "a", "b") == [("s", 10, 5, 2), ("s", 20, 2, 5), ("t", 10, 3, 1), ("t", 20, 4, 6)]
    merged = allelic.merge_lanes(a, ["chr", "pos"], ["a", "b"])
    assert rows(merged, "sample_id", "pos", "a", "b") == [("s", 10, 5, 2), ("s", 20, 2, 5), ("t", 10, 1.5, 0.5), ("t", 20, 2, 3)]
    exons = spark.createDataFrame([("g1", "chr1", 5, 12), ("g1", "chr1", 10, 15), ("g2", "chr1", 10, 20), ("g3", "chr1", 100, 200), ("g4", "chr2", 1, 50)], "gene_id string, chr string, start long, end long")
    s = merged.filter("sample_id = 's'")
    assert rows(allelic.rollup_to_gene(s, exons), "gene_id", "a", "b") == [("g1", 10, 4), ("g2", 7, 7)]
    assert rows(allelic.rollup_to_gene(s, exons, multiplicity="site"), "gene_id", "a", "b") == [("g1", 5, 2), ("g2", 7, 7)]
    with pytest.raises(ValueError):
        allelic.rollup_to_gene(s, exons, multiplicity="x")
    af = allelic.allele_fraction(spark.createDataFrame([(0.0, 0.0), (1.0, 3.0)], "a double, b double"))
    assert rows(af, "af", "tc") == [(None, 0.0), (0.25, 4.0)]


def test_monoallelic_bands(spark):
    samples = spark.createDataFrame([("c", True), ("t", False)], "sample_id string, is_control boolean")
    af = [("none", None), ("low", 0.3), ("high", 0.7), ("out", 0.71), ("left", 0.71), ("right", 0.21), ("x", 0.0)]
    alleles = spark.createDataFrame([(g, "c", v) for g, v in af] + [("test_only", "t", 0.5)], "feature_id string, sample_id string, af double")
    features = spark.createDataFrame([(g, "chrX" if g == "x" else "chr10" if g in ("left", "right") else "chr1", 61_000_000 if g == "right" else 5) for g in ("none", "low", "high", "out", "left", "right", "x", "test_only", "no_data")], "feature_id string, chr string, start long")
    band = F.when((F.col("chr") == "chr10") & (F.col("start") >= 61_000_000), "10b").otherwise("other")
    got = allelic.monoallelic_genes(alleles, samples, features, {"10b": (0.2, 0.4)}, band_of=band)
    assert {r.feature_id for r in got.collect()} == {"none", "out", "left", "test_only"}


def test_a_mean_on_a_bands_edge_does_not_depend_on_the_order_of_rows(spark):
    # In doubles (4/5 + 5/6) + 11/12 is 2.5500000000000003 and 4/5 + (5/6 + 11/12) is 2.55, of which a third is the edge.
    parts = [4 / 5, 5 / 6, 11 / 12]
    orders = [[*p] for p in itertools.permutations(parts)]
    alleles = spark.createDataFrame([(f, s, v) for f, p in enumerate(orders) for s, v in enumerate(p)] + [(9, 0, 0.8), (9, 1, 0.9), (8, 0, 0.1), (8, 1, None)], "feature_id long, sample_id long, af double").coalesce(1)
    samples = spark.createDataFrame([(s, True) for s in range(3)], "sample_id long, is_control boolean")
    features = spark.createDataFrame([(f, "chr1") for f in range(10)], "feature_id long, chr string")
    got = {r.feature_id: r.control_af for r in allelic.monoallelic_genes(alleles, samples, features, {}, (0.5, 0.85)).collect()}
    assert got == {9: (0.8 + 0.9) / 2, 8: 0.1}  # two values have one sum only


def test_expression_filters_and_ratios(spark):
    samples = spark.createDataFrame([("a", True), ("b", True), ("t", False)], "sample_id string, is_control boolean")
    m = spark.createDataFrame([("g", "a", 50.0), ("g", "t", 100.0), ("h", "a", 49.0), ("z", "a", 0.0), ("z", "t", 5.0), ("n", "t", 5.0)], "feature_id string, sample_id string, value double")
    assert {r.feature_id for r in expression.min_expression(m, samples, 25).collect()} == {"g"}
    assert rows(expression.ratio_to_controls(m, samples), "feature_id", "sample_id", "value") == [("g", "a", 1.0), ("g", "t", 2.0), ("h", "a", 1.0), ("n", "t", None), ("z", "a", None), ("z", "t", None)]
    dense = expression.densify(m, m.select("feature_id"), samples)
    assert dense.count() == 12 and dense.filter("value = 0").count() == 7
    assert rows(expression.control_mean_with_zeros(m, samples)) == rows(expression.control_mean_with_zeros(dense, samples))


def test_weights_and_adjustment(spark):
    samples = spark.createDataFrame([("a", True), ("b", True), ("t", False)], "sample_id string, is_control boolean")
    data = [("one", "a", 1.0), ("one", "t", 4.0), ("flat", "a", 1.0), ("flat", "b", 1.0), ("flat", "t", 2.0), ("v", "a", 0.5), ("v", "b", 1.5), ("v", "t", 3.0), ("w", "a", 0.8), ("w", "b", 1.2), ("w", "t", None)]
    m = spark.createDataFrame(data, "feature_id string, sample_id string, value double")
    w = {r.feature_id: r.weight for r in expression.inverse_variance(m, samples).collect()}
    assert w["one"] == 0 and w["flat"] == 0 and w["v"] == pytest.approx(2) and w["w"] == pytest.approx(12.5)
    adjusted = {(r.feature_id, r.sample_id): r.value for r in expression.adjust_by_invvar(m, samples).collect()}
    assert adjusted["flat", "t"] == pytest.approx(2 / 3) and adjusted["w", "t"] is None
    features = spark.createDataFrame([(f, "chr1") for f in ("one", "flat", "v", "w")], "feature_id string, chr string")
    capped = {r.feature_id: r.weight for r in regions.invvar_weights(m.join(features, "feature_id"), samples, ["feature_id"]).collect()}
    cap = 2 + 0.9 * 10.5  # 95 % of 0, 2, 12.5; the infinite weight gets the cap
    assert capped == pytest.approx({"one": 0, "v": 2, "w": cap, "flat": cap})
    mean = {(r.chr, r.sample_id): r.value for r in regions.agg_by_chr(m, features, samples).collect()}
    assert mean["chr1", "t"] == pytest.approx((2 * cap + 3 * 2) / (cap + 2))
    # After adjustment the weighted mean of every sample is 1.
    again = expression.adjust_by_invvar(m, samples)
    factor = again.join(expression.inverse_variance(m, samples), "feature_id").groupBy("sample_id").agg(relational.weighted_mean("value", "weight").alias("k"))
    assert all(r.k == pytest.approx(1) for r in factor.collect())


def test_bins_and_edges(spark):
    features = spark.createDataFrame([("a", "chr1", 1, 10), ("b", "chr1", 95, 100), ("c", "chr1", 100, 100), ("d", "chr2", 1, 40), ("e", "chr3", 5, 250)], "feature_id string, chr string, start long, end long")
    bins = rows(intervals.make_bins(features, 100), "bin", "chr", "start", "end", "mid")
    assert bins == [(1, "chr1", 0, 100, 50), (2, "chr2", 0, 40, 20), (3, "chr3", 0, 100, 50), (4, "chr3", 100, 250, 175)]
    samples = spark.createDataFrame([("s", True), ("t", True)], "sample_id string, is_control boolean")
    m = spark.createDataFrame([(f, s, v) for f, v in (("a", 1.0), ("e", 2.0)) for s in "st"] + [("e", "t", 4.0)][:0], "feature_id string, sample_id string, value double")
    out = rows(regions.agg_by_bin(m, features, samples, 100), "bin", "sample_id", "value")
    assert len(out) == 8 and {b for b, _, v in out if v is None} == {2}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_equals_nested_loop(spark, how):
    rng = random.Random(1)
    make = lambda n: [(i, rng.choice("ab"), s := rng.randint(0, 500), s + rng.choice([0, 3, 60, 200])) for i in range(n)]
    left, right = make(80), make(80) + [(99, "a", None, 3), (98, "a", 9, 2)]
    schema = "id long, chr string, start long, end long"
    got = rows(intervals.interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["chr"], how=how, range_rows=7), "id", "r_id")
    want = [(i, j) for i, c, s, e in left for j, d, x, y in right if c == d and x is not None and x <= y and s <= y and x <= e]
    if how == "left":
        want += [(i, None) for i, *_ in left if i not in {a for a, _ in want}]
    assert got == sorted(want, key=lambda t: tuple((v is not None, str(v)) for v in t))


def test_arm_of_a_feature_across_the_centromere(spark):
    features = spark.createDataFrame([("x", "chr10a", 90, 110), ("y", "chr10b", 150, 160), ("z", "chr7", 1, 5)], "feature_id string, chr string, start long, end long")
    arms = spark.createDataFrame([("chr10", 1, 100, "10p"), ("chr10", 100, 200, "10q")], "chr string, start long, end long, arm string")
    samples = spark.createDataFrame([("s", True), ("t", True)], "sample_id string, is_control boolean")
    m = spark.createDataFrame([("x", "s", 1.0), ("x", "t", 3.0), ("y", "s", 2.0), ("y", "t", 2.5), ("z", "s", 9.0)], "feature_id string, sample_id string, value double")
    got = {(r.arm, r.sample_id): r.value for r in regions.agg_by_arm(m, features, arms, samples).collect()}
    assert set(got) == {("10p", "s"), ("10p", "t"), ("10q", "s"), ("10q", "t")} and got["10p", "t"] == 3


def test_joint_tests_equal_single_ones(spark):
    """All p-values from one aggregation, nulls in a group included, as from one z-test each."""
    values = spark.createDataFrame([("g", 1.0, 2.5, 1.2), ("g", None, 1.0, 0.9), ("n", 1.0, 1.5, 1.1), ("x", 0.5, 0.7, 1.0)], "chr string, hap_a double, hap_b double, tpm double")
    rows = [(r, cn, h, v) for r in ("g", "x") for cn, h, vs in ((1, "A", (1.0, 1.2, 0.7)), (1, "B", (0.9, 1.4, 1.0)), (2, "A&B", (2.0, 2.2, 1.7)), (None, None, (9.0, 8.0))) for v in vs]
    rows += [("n", 1, "A", 1.0), ("n", 1, "A", None), ("n", 1, "A", 1.3), ("n", 1, "B", 1.0)]
    ref = spark.createDataFrame(rows, "chr string, cn int, hap string, vals double")
    near = lambda p: None if p is None else round(p, 9)
    got = reference.region_p(values, ref, ("x",)).collect()
    for name, hap, cn, column in (("p1_a", "A", 1, "hap_a"), ("p1_b", "B", 1, "hap_b"), ("p2_a", "A&B", 2, "hap_a"), ("p2_b", "A&B", 2, "hap_b")):
        own = ref.filter((F.col("hap") == hap) & (F.col("cn") == cn) & ((F.col("chr") != "x") | (F.col("cn") == 1)))
        want = {(r.chr, r.tpm): near(r.p) for r in reference.ztest(values, own, ["chr"], column).collect()}
        assert {(r.chr, r.tpm): near(r[name]) for r in got} == want
    by_cn = reference.unspecific_p(values, ref, numbers=(1, 2)).collect()
    want = {(r.chr, r.tpm): near(r.p) for r in reference.ztest(values, ref.filter("cn = 2"), value="tpm").collect()}
    assert {(r.chr, r.tpm): near(r.p2) for r in by_cn} == want and all(r.p1 is None for r in by_cn)


def test_ztest_nulls(spark):
    ref = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None), ("b", 2.0), ("c", 5.0)], "g string, vals double")
    v = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 5.0), ("d", 1.0), ("a", None)], "g string, value double")
    got = {(r.g, r.value): r.p for r in reference.ztest(v, ref, ["g"]).collect()}
    assert got["a", 2.0] == pytest.approx(1) and all(got[k] is None for k in got if k != ("a", 2.0))
    skipping = {(r.g, r.value): r.p for r in reference.ztest(v, ref, ["g"], na="skip").collect()}
    assert skipping["b", 2.0] == pytest.approx(math.erfc(0.5 / math.sqrt(0.5) / math.sqrt(2)), rel=1e-6)
    with pytest.raises(ValueError):
        reference.ztest(v, ref, na="x")


def test_states(spark):
    alpha = 0.05 / 48
    low = alpha / 2
    cases = {  # (chr, a, b, p1_a, p1_b, p2_a, p2_b): (state_a, state_b), None if the row goes
        ("chr1", 0.1, 1.0, low, 0.5, 0.5, 0.5): ("0", "1"),
        ("chr1", 0.5, 2.0, low, low, low, 0.5): ("1-", "2"),
        ("chr1", 0.2, 1.5, low, low, 0.5, low): (".", "1+"),
        ("chr1", 1.0, 1.0, low, 0.5, 0.5, 0.5): None,
        ("chr1", 2.0, 1.0, alpha, alpha, 0.5, 0.5): ("1", "1"),
        ("chr1", 2.0, 1.0, low, None, 0.5, 0.5): None,
        ("chrX", 0.5, 1.0, low, 0.5, None, 0.5): ("1+", "1"),
        ("chr10b", 1.0, 1.5, 0.5, low, 0.5, 0.5): ("1", "1-"),
    }
    df = spark.createDataFrame(list(cases), "chr string, hap_a double, hap_b double, p1_a double, p1_b double, p2_a double, p2_b double")
    threshold = spark.createDataFrame([(0.2,)], "threshold double")
    got = {(r.chr, r.hap_a, r.hap_b, r.p1_a, r.p1_b, r.p2_a, r.p2_b): (r.state_a, r.state_b) for r in states.call_states(df, threshold).collect()}
    assert got == {k: v for k, v in cases.items() if v is not None}


def test_families(spark):
    schema = "family string, chr string, relationship string, cell string, tpm double, state_a string, state_b string, var_a double, var_b double, p1_a double, p1_b double, p2_a double, p2_b double"
    row = lambda f, role, a, b: (f, "chr1", role, f + role, 2.5, a, b, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
    calls = [row("two", "A", "0", "1"), row("two", "B", "1", "1"), *[row("four", r, "1", "2" if r == "c1" else "1") for r in families.ROLES], row("both", "A", "0", "2"), row("calm", "A", "1", "1")]
    profile = families.family_profile(spark.createDataFrame(calls, schema), ("family", "chr"))
    out = families.affected_readout(families.affected_haplotype(families.transcription_pattern(families.cn_pattern(profile))))
    got = {r.family: r for r in out.collect()}
    assert (got["two"].cn_pattern, got["two"].pattern_a, got["two"].affected, got["two"].affected_state, got["two"].affected_value) == ("2 2", "0 1", "A", "0", 0.1)
    assert (got["four"].pattern_b, got["four"].affected, got["four"].affected_pattern) == ("1 1 2 1", "B", "0 0 0 0")
    assert got["both"].affected == "NA" and got["both"].affected_state is None and got["calm"].affected == "normal"
    events, normal = families.split_events(out, ["family", "chr"])
    assert len(families.event_columns()) == 38 and set(families.event_columns(("family", "chr"))) <= set(out.columns)
    assert [r.family for r in events.collect()] == ["both", "four", "two"] and rows(normal, "family") == [("calm",)]
    assert families.uniform_families(out).count() == 4
    with pytest.raises(Exception, match="more than one row"):
        families.family_profile(spark.createDataFrame([row("x", "A", "1", "1")] * 2, schema), ("family", "chr")).collect()


def by_hand(cells, controls, labelled):
    """Calls from the formulas: raw values are tested, rescaled ones are called. cells: {(cell, chr): (tpm, a, b)}."""
    mean = lambda v: sum(v) / len(v)

    def p(x, group):
        m = mean(group)
        sd = math.sqrt(sum((v - m) ** 2 for v in group) / (len(group) - 1))
        return math.erfc(abs((x - m) / sd) / math.sqrt(2))

    chroms = {c for _, c in cells}
    lost = sorted(min(cells[k][1:]) for k, cn in labelled.items() if cn == 1)
    place = (len(lost) - 1) * 0.95
    threshold = lost[int(place)] + (lost[min(len(lost) - 1, int(place) + 1)] - lost[int(place)]) * (place - int(place))
    xb = mean([v[2] for (_, c), v in cells.items() if c == "chrX"])
    scale = lambda v, c: v * 1.5 if c == "chr10b" else v / xb if c == "chrX" else v
    xt = mean([v[1] / xb for (_, c), v in cells.items() if c == "chrX"]) + 1
    out, alpha = {}, 0.05 / (2 * len(chroms))
    for (cell, c), (tpm, *haps) in cells.items():
        own = [[cells[k, c][i] for k in controls] for i in (1, 2)]
        double = [2 * cells[k, c][0] for k in controls]
        marks = []
        for i, (v, center) in enumerate(zip(haps, (0.23 if c == "chrX" else 1, 2 if c == "chr10b" else 1))):
            s = scale(v, c)
            full = c not in ("chrX", "chr10b") and p(v, double) >= alpha
            if p(v, own[i]) >= alpha:
                marks.append("1")
            elif s > center:
                marks.append("2" if full else "1+")
            else:
                marks.append("0" if s < threshold else "1-")
        total = tpm * (3 if c == "chr10b" else xt if c == "chrX" else 2)
        out[cell, c] = (round(total, 9), *(round(scale(v, c), 9) for v in haps), *marks)
    return out


def test_calls_are_made_on_rescaled_values(spark):
    rng = random.Random(8)
    base = {"chr1": (0.5, 0.5), "chr2": (0.5, 0.5), "chr10b": (0.34, 0.66), "chrX": (0.12, 0.55)}  # of the total
    controls = [f"c{i}" for i in range(25)]
    cells = {}
    for cell in [*controls, *(f"f{f}{r}" for f in range(6) for r in ("A", "B", "c1", "c2"))]:
        for c, (a, b) in base.items():
            t = rng.gauss(1, 0.03)
            v = [2 * t * a + rng.gauss(0, 0.02), 2 * t * b + rng.gauss(0, 0.02)]
            if cell[0] == "f" and rng.random() < 0.3:
                v[rng.randint(0, 1)] *= rng.choice([0.02, 0.5, 2.1, 1.4])
            cells[cell, c] = (sum(v) / 2, *v)
    labelled = {}
    for i in range(10):
        cells[f"l{i}", "chr1"] = (0.5, *rng.sample([rng.uniform(0.01, 0.1), 1.0], 2))
        labelled[f"l{i}", "chr1"] = 1 if i < 8 else 3
    values = spark.createDataFrame([(s, c, *v) for (s, c), v in cells.items()], "sample_id string, chr string, tpm double, hap_a double, hap_b double")
    control_ids = spark.createDataFrame([(c,) for c in controls], "sample_id string")
    marks = spark.createDataFrame([(*k, cn) for k, cn in labelled.items()], "sample_id string, chr string, cn int")
    wide, _ = reference.reference_aneuploid(values, marks, control_ids)
    assert {r.chr for r in wide.filter("cn = 1").collect()} == {"chr1", "chr2"}
    tested = reference.region_p(values, reference.reference_haplotype(values, control_ids))
    calls = states.call_states(states.rescale_cn(tested), states.full_loss_threshold(wide), n_regions=4)
    want = by_hand(cells, controls, labelled)
    got = {(r.sample_id, r.chr): (round(r.tpm, 9), round(r.hap_a, 9), round(r.hap_b, 9), r.state_a, r.state_b) for r in calls.collect()}
    assert got == want and {m for v in want.values() for m in v[3:]} == {"0", "1-", "1", "1+", "2"}
    roles = spark.createDataFrame([(s, s[1], s[2:]) for s in {s for s, _ in cells if s[0] == "f"}], "sample_id string, family string, relationship string")
    profile = families.family_profile(calls.join(roles, "sample_id").withColumnsRenamed({"sample_id": "cell", "hap_a": "var_a", "hap_b": "var_b"}), ("family", "chr"))
    out = families.affected_readout(families.affected_haplotype(families.transcription_pattern(families.cn_pattern(profile)))).collect()
    assert len(out) == 24
    for r in out:
        v = [want[f"f{r.family}{x}", r.chr] for x in families.ROLES]
        a, b = (any(x[i] != "1" for x in v) for i in (3, 4))
        hap = "NA" if a and b else "A" if a else "B" if b else "normal"
        assert (r.affected, r.cn_pattern) == (hap, " ".join(str(round(x[0])) for x in v))
        assert r.affected_pattern == (" ".join(str(round(x[1 if hap == "A" else 2])) for x in v) if hap in ("A", "B") else None)
        assert r.affected_value == (pytest.approx(v[0][1 if hap == "A" else 2]) if hap in ("A", "B") else None)
    assert any(r.cn_pattern == "2 2 2 2" for r in out)


def test_annotation(spark):
    a = spark.createDataFrame([("k1", "x", None, 1), ("k1", None, "u", 2), ("k2", None, None, 3)], "key string, p string, q string, row long")
    b = spark.createDataFrame([("k1", "y", 1), ("k3_", "z", 2)], "key string, p string, row long")
    assert rows(annotate.consolidate([a, b], "key", "last", "row"), "key", "p", "q") == [("k1", "y", "u"), ("k2", None, None), ("k3_", "z", None)]
    assert rows(annotate.consolidate([a, b], "key", "first", "row"), "key", "p", "q") == [("k1", "x", "u"), ("k2", None, None), ("k3_", "z", None)]
    assert rows(annotate.consolidate_strict([a, b], "key", "row"), "key", "p") == [("k1", "y"), ("k2", None), ("k3_", "z")]
    x = spark.createDataFrame([("k1_", None, ""), ("k2", "n", "v")], "key string, n string, m string")
    y = spark.createDataFrame([("k1", None, 5), ("k9", "n", 6)], "key string, n string, o int")
    order = spark.createDataFrame([("k9", 1), ("k2", 2)], "key string, pos int")
    out = annotate.finalise_annotation(x, y, spark.createDataFrame([("k2", 7)], "key string, th long"), "key", order, "pos").collect()
    assert [(r.key, r.n, r.m, r.o, r.th) for r in out] == [("k9", "n", None, 6, None), ("k2", "n", "v", None, 7), ("k1", None, None, 5, None)]


def test_small_relational_pieces(spark):
    df = spark.createDataFrame([(i, i % 3, float(i * i)) for i in range(9)], "i long, g long, v double")
    five = {r.g: (r.low, r.q1, r.median, r.q3, r.high) for r in ordered.five_numbers(df, "v", ["g"]).collect()}
    assert five[0] == (0.0, 4.5, 9.0, 22.5, 36.0)
    assert relational.groups_with_one_value(spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (2, "b"), (3, None)], "g long, x string"), ["g"], "x").select("g").distinct().count() == 2
    assert rows(ordered.rank_chunks(df, ["i"], 4), "i", "chunk")[0:5] == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)]


@pytest.mark.parametrize("cell_rows", [1, 7, 10**6])
def test_ranks_and_running_sums_equal_one_sort(spark, cell_rows):
    rng = random.Random(cell_rows)
    data = [(i, rng.choice(["p", "p", "p", None, "q"]), rng.choice([None, 1.0, 1.0, 2.5, -3.0, rng.random(), 1e300, 1 + rng.random() / 1e6]), rng.choice([None, 1.0, 2.0])) for i in range(400)]
    df = spark.createDataFrame(data, "i long, g string, v double, x double").repartition(5)
    for by in ([], ["g"]):
        want = {}
        for g in {d[1] for d in data} if by else {0}:
            run = None
            for k, (i, _, _, x) in enumerate(sorted((d for d in data if not by or d[1] == g), key=lambda t: (t[2] is not None, t[2] or 0, t[0]))):
                run = x if run is None else run if x is None else run + x
                want[i] = (k + 1, run)
        got = ordered.ranked(df, ["v", "i"], by, cell_rows=cell_rows).collect()
        assert {r.i: r["rank"] for r in got} == {i: k for i, (k, _) in want.items()}
        sums = ordered.running_sum(df, {"s": "x"}, ["v", "i"], by, cell_rows).collect()
        assert {r.i: r.s for r in sums} == {i: pytest.approx(s) if s is not None else None for i, (_, s) in want.items()}
    assert ordered.ranked(df.limit(0), ["v"]).count() == 0


def test_text_orders(spark):
    words = ["", "a", "ab", "abcdefgh", "abcdefghi", "b", "é", None, "zz"] * 3
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w string")
    want = sorted(enumerate(words), key=lambda t: (t[1] is not None, (t[1] or "").encode(), t[0]))
    for cell_rows in (1, 100):
        got = sorted(ordered.ranked(df, ["w", "i"], cell_rows=cell_rows).collect(), key=lambda r: r["rank"])
        assert [(r.i, r.w) for r in got] == want


def test_reports_mark_families_and_families_list(spark):
    anno = spark.createDataFrame([("Gen1", "f", ""), ("Gen1", "f", ""), ("Gen2", "h", ""), ("Gen1", "g", ""), ("Gen1", "e", "bad"), ("c1", "z", "")], "key_pairs string, family string, exclusion string")
    assert [tuple(r) for r in reports.family_list(anno).collect()] == [("Gen2", "h", 1), ("Gen1", "f", 2), ("Gen1", "g", 1)]
    ref = spark.createDataFrame([(0, "aneuploid"), (0, "normal"), (1, "aneuploid"), (2, "aneuploid")], "cn int, hap string")
    assert [r.label for r in reports.labelled_distribution(ref).collect()] == ["loss", "normal", "normal", "gain"]


def test_sources_on_files(spark, tmp_path):
    (tmp_path / "e1").mkdir()
    files = {"a_S1_x.ReadsPerGene.out.tab": "N_unmapped\t3\t0\t0\ng1\t5\t1\t1\n", "b_s1_y.ReadsPerGene.out.tab": "g1\t7\t1\t1\n", "zz_other.ReadsPerGene.out.tab": "g1\t1\t1\t1\n", "q_S10q.ReadsPerGene.out.tab": "g2\t9\t1\t1\n", "empty.ReadsPerGene.out.tab": ""}
    for name, text in files.items():
        (tmp_path / "e1" / name).write_text(text)
    listed = tables.list_files(spark, [str(tmp_path / "e1")], tables.SUFFIXES["gene_counts"])
    anno = spark.createDataFrame([(1, "S1", "cell1"), (2, "S10", "cell2"), (3, "S10", "cell3"), (4, "", "no"), (5, None, "no")], "row_no long, fastq string, sample_id string")
    got = {r.file.split(".")[0]: (r.sample_id, r.lane) for r in tables.resolve_samples(listed, anno).collect()}
    assert got == {"a_S1_x": ("cell1", 1), "b_s1_y": ("cell1_L2", 2), "q_S10q": ("cell3", 1)}
    counts = tables.read_gene_counts(spark, [str(tmp_path / "e1")])
    assert rows(tables.with_samples(counts, tables.resolve_samples(listed, anno)), "sample_id", "feature_id", "count") == [("cell1", "N_unmapped", 3), ("cell1", "g1", 5), ("cell1_L2", "g1", 7), ("cell3", "g2", 9)]
    (tmp_path / "s.table").write_text("contig\tposition\tvariantID\trefAllele\taltAllele\trefCount\taltCount\nchr1\t5\tv\tA\tC\t3\t4\n")
    assert rows(tables.read_allele_counts(spark, [str(tmp_path)]), "chr", "pos", "ref", "alt") == [("chr1", 5, 3, 4)]
    (tmp_path / "p.txt").write_text('"chr" "pos" "Haplotype" "MAF" "sample_count"\n"1" "chr1" 5 -1 0.4 12\n"2" "chr2" 6 1 NA 3\n')
    assert rows(tables.read_phase(spark, str(tmp_path / "p.txt"))) == [("chr1", 5, -1, 0.4, 12), ("chr2", 6, 1, None, 3)]
    (tmp_path / "g.gtf").write_text('#!v\nchr1\tsrc\tgene\t5\t9\t.\t+\t.\tgene_id "G1"; gene_type "protein_coding"; level 2;\nchr1\tsrc\ttranscript\t5\t9\t.\t+\t.\tgene_id "G1";\n')
    assert rows(tables.read_gtf(spark, str(tmp_path / "g.gtf"))) == [("chr1", 5, 9, 5, "+", "gene", "G1", "protein_coding")]
    (tmp_path / "m.tsv").write_text("samples\nx\nx\ny\n")
    manifest = tables.read_manifest(spark, {"e": str(tmp_path / "m.tsv")})
    assert rows(manifest) == [("e", "x"), ("e", "y")]
    missing = tables.missing_outputs(manifest, spark.createDataFrame([("x.table",)], "file string"), {"t": F.concat("sample_id", F.lit(".table"))})
    assert rows(missing) == [("e", "y", "t")]


def test_running_counts_over_arriving_files(spark, tmp_path):
    from haplolake.streaming import running

    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.tsv").write_text(f"s{i}\tN_unmapped\t2\ns{i}\tg\t{i + 6}\n")
    stream = running.running_counts(running.stream_gene_counts(spark, str(folder), "*.tsv", files_per_trigger=1))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        q.processAllAvailable()
        (folder / "late.tsv").write_text("s0\tg\t4\n")
        q.processAllAvailable()
        got = running.running_profile(spark.table("running"))
        assert {r.sample_id: r.totalReads for r in got.collect()} == {"s0": 12, "s1": 9, "s2": 10}
    finally:
        q.stop()


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = random.Random(6)
    make = {"many": lambda: rng.gauss(0, 5), "ties": lambda: 0.5, "few": lambda: rng.choice([1.0, 2.0, -2.0, None]), "close": lambda: 1 + rng.random() / 1e7, None: lambda: rng.choice([rng.random(), 0.0, -0.0, 1e-300])}
    data = [(g, f()) for g, f in make.items() for _ in range(301)] + [("one", 3.0), ("nulls", None), ("nulls", None)]
    shares = {"low": 0.0, "a": 0.05, "mid": 0.5, "b": 0.95, "top": 1.0}
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in ordered.quantiles(df, "v", shares, ["g"]).collect()}
    for g in {g for g, _ in data}:
        given = [v for h, v in data if h == g and v is not None]
        for name, share in shares.items():
            assert got[g][name] == (pytest.approx(float(np.quantile(given, share)), abs=1e-12) if given else None)
    whole = ordered.quantiles(df, "v", shares).first()
    every = [v for _, v in data if v is not None]
    assert all(whole[n] == pytest.approx(float(np.quantile(every, q)), abs=1e-12) for n, q in shares.items())
    assert ordered.quantiles(df.limit(0), "v", {"m": 0.5}).first().m is None and ordered.quantiles(df.limit(0), "v", {"m": 0.5}, ["g"]).count() == 0


def test_interval_join_with_a_third_of_all_points_in_one_gene(spark):
    rng = random.Random(4)
    genes = [(i, "c", 100_000 * i, 100_000 * i + 3000) for i in range(60)] + [(99, "c", 0, 7_000_000), (98, "d", 5, 5)]
    points = [(i, "c", p := rng.randint(300_000, 303_000) if i % 3 == 0 else rng.randint(0, 7_000_000), p) for i in range(6000)] + [(9000, "d", 5, 5), (9001, "d", 6, 6), (9002, None, 6, 6), (9003, "e", 1, 1)]
    schema = "id long, chr string, start long, end long"
    left, right = spark.createDataFrame(points, schema), spark.createDataFrame(genes, schema)
    cuts = intervals._cuts(left.unionByName(right).select("chr", F.col("start").cast("double").alias("_p"), F.lit(None).cast("double").alias("_right")), ["chr"], 100)
    assert max(len(r["_cuts"]) for r in cuts.collect()) > 40
    for how in ("inner", "left"):
        got = intervals.interval_join(left, right, ["chr"], how=how, range_rows=100).select("id", "r_id").collect()
        want = [(i, j) for i, c, s, e in points for j, d, x, y in genes if c == d and s <= y and x <= e]
        if how == "left":
            want += [(i, None) for i in {p[0] for p in points} - {i for i, _ in want}]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_cuts_are_bounded_over_all_keys(spark, monkeypatch):
    rng = random.Random(6)
    schema = "id long, chr string, start long, end long"
    points = [(i, "hot" if i % 3 == 0 else f"k{i % 200}", p := rng.randint(0, 9000), p + rng.choice([0, 0, 40])) for i in range(3000)]
    genes = [(i, rng.choice(["hot", "k7", "k8", "none"]), 150 * i, 150 * i + 300) for i in range(60)]
    left, right = spark.createDataFrame(points, schema), spark.createDataFrame(genes, schema)
    starts = left.unionByName(right).select("chr", F.col("start").cast("double").alias("_p"), F.lit(None).cast("double").alias("_right"))
    want = sorted(((i, j) for i, c, s, e in points for j, d, x, y in genes if c == d and s <= y and x <= e), key=str)
    for most in (5, 300):
        monkeypatch.setattr(intervals, "MAX_RANGES", most)
        cuts = intervals._cuts(starts, ["chr"], 1).collect()
        assert min(len(r["_cuts"]) for r in cuts) > 1 and sum(len(r["_cuts"]) for r in cuts) <= 2 * most
        joined = intervals.interval_join(left, right, ["chr"], range_rows=1).select("id", "r_id")
        assert sorted(map(tuple, joined.collect()), key=str) == want
    assert not intervals._cuts(starts, ["chr"], 100_000).collect()


def test_interval_join_moves_each_side_once(spark):
    schema = "id long, chr string, start long, end long"
    left = spark.createDataFrame([(i, f"c{i % 3}", i, i + 2) for i in range(300)], schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = intervals.interval_join(left, left.withColumnRenamed("id", "j"), ["chr"], range_rows=10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert plan.count("REPARTITION_BY_COL") == 1


def test_strict_levels_ask_for_both_values(spark):
    samples = spark.createDataFrame([(i, i < 3) for i in range(4)], "sample_id long, is_control boolean")
    placed = spark.createDataFrame([("arm", "1p", "chr1", 1), ("arm", "1q", "chr1", 2), ("chr", "chr1", "chr1", 1), ("chr", "chr2", "chr2", 3)], "level string, place string, chr string, feature_id long")
    # Feature 2 has expression only, feature 3 fractions only; both values are linear in the sample, with variances 1 and 4 over the controls.
    cells = [(f, s, None if f == 3 else float(s), None if f == 2 else 2.0 * s) for f in (1, 2, 3) for s in range(4)]
    out = regions.haplotype_levels(spark.createDataFrame(cells, "feature_id long, sample_id long, tpm double, af double"), placed, samples)
    got = rows(out.withColumns({c: F.round(c, 9) for c in ("tpm", "af", "hap_a")}), "level", "place", "sample_id", "tpm", "af", "hap_a")
    want = [(lv, pl, s, float(s), 2.0 * s, 4.0 * s * s) for lv, pl in (("arm", "1p"), ("chr", "chr1")) for s in range(4)] + [("chr", "chr2", s, None, 2.0 * s, None) for s in range(4)]
    assert got == want


def test_no_job_runs_before_the_result_is_used(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    samples = spark.createDataFrame([(i, i < 3) for i in range(6)], "sample_id long, is_control boolean")
    features = spark.createDataFrame([(i, "chr1" if i < 5 else "chrX", 10 * i, 10 * i + 15) for i in range(9)], "feature_id long, chr string, start long, end long")
    m = features.select("feature_id").crossJoin(samples.select("sample_id")).withColumn("value", 1 + F.col("feature_id") * F.col("sample_id"))
    built = [regions.agg_by_chr(m, features, samples), regions.agg_by_bin(m, features, samples, 20), expression.adjust_by_invvar(m, samples, 0.95, features), ordered.five_numbers(m, "value", ["feature_id"])]
    assert not tracker.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(b.count() for b in built)
