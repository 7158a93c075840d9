"""Grids of rows and samples."""

import random

import pytest
from pyspark.sql import functions as F

from haplolake.operators.grid import on_grid
from haplolake.plans import registry


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_a_grid_equals_a_left_join_of_all_pairs(spark, block):
    rng = random.Random(block)
    rows = [(None, "null")] + [(k, f"r{k}") for k in range(12)]
    samples = [None, *range(0, 40, 2)]
    cells = [(rng.choice([None, *range(14)]), rng.choice([None, *range(44)]), rng.choice([None, rng.random()])) for _ in range(200)]
    cells += [(3, 0, 1.0), (3, 0, 2.0), (3, 38, 3.0), (4, 38, None)] + [(5, s, float(s)) for s in range(0, 40, 2)]
    left, listed = spark.createDataFrame(rows, "k long, name string"), spark.createDataFrame([(s,) for s in samples + samples[:3]], "sample_id long")
    values = spark.createDataFrame(cells, "k long, sample_id long, v double")
    got = on_grid(left, listed, values, ["k"], block=block)
    want = left.crossJoin(listed.distinct()).join(values, ["k", "sample_id"], "left")
    plain = lambda df: sorted(map(str, df.select("k", "name", "sample_id", "v").collect()))
    assert plain(got) == plain(want) and got.columns == ["k", "name", "sample_id", "v"]


def test_a_grid_is_not_sent(spark):
    rows, samples = spark.range(300).withColumnRenamed("id", "k"), spark.range(400).withColumnRenamed("id", "sample_id")
    df = on_grid(rows, samples, spark.range(900).selectExpr("id % 310 AS k", "id % 410 AS sample_id", "id AS v"), ["k"])
    assert len(df.collect()) == 300 * 400
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
    assert 300 <= max(sent) < 2000


def test_what_is_done_with_a_cell_is_done_once_for_a_stretch(spark):
    """each() sees lists of samples, and gives what the same steps on single cells give, also several rows for a cell."""
    rows, samples = spark.createDataFrame([(1, "a"), (2, "b")], "k long, name string"), spark.range(9).withColumnRenamed("id", "sample_id")
    values = spark.createDataFrame([(1, 0, 0.125), (1, 4, 0.25), (2, 8, None), (2, 8, 1.5), (3, 1, 9.0)], "k long, sample_id long, v double")

    def steps(df):
        return df.withColumn("v", F.coalesce(F.round("v", 2), F.lit(-1.0))).withColumn("track", F.explode(F.array(F.lit("x"), F.lit("y"))))

    kinds = []
    got = on_grid(rows, samples, values, ["k"], block=4, each=lambda df: kinds.append(df.schema["sample_id"].dataType.typeName()) or steps(df))
    want = steps(on_grid(rows, samples, values, ["k"], block=4))
    listed = lambda df: sorted(map(tuple, df.select("k", "name", "sample_id", "v", "track").collect()))
    assert kinds == ["array"] and listed(got) == listed(want) and got.count() == 2 * (9 + 10)


@pytest.mark.parametrize("name", ["dom15_agg_by_bin", "rp02_bin_track", "prj05_densify", "rp03_ratio_by_expression"])
def test_nothing_is_computed_for_single_cells(spark, name):
    """the samples' lists are unrolled last; no join and no rounding comes after that."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        assert "round" not in plan.toString().split("\n")[0]
        plan = plan.children().apply(0)
    assert plan.nodeName() == "Generate" and "sample_id" in plan.toString().split("\n")[0]
