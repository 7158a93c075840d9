"""Running sums of small and large groups."""

import random

from haplolake.operators.ordered import running_sum


def records_sent(df):
    total, todo, seen = 0, [df._jdf.queryExecution().executedPlan()], set()
    while todo:
        p = todo.pop()
        kind = p.nodeName()
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if kind == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStage"):
            todo.append(p.plan())
        elif kind == "Exchange" and p.id() not in seen:
            seen.add(p.id())
            total += p.metrics().apply("shuffleRecordsWritten").value()
    return total


def test_running_sums_of_groups_on_both_sides_of_the_bound(spark):
    rng = random.Random(4)
    rows = [(g, k, rng.randrange(9), i, float(rng.randrange(100))) for i in range(3000) for g in [rng.choice([None, "a", "b", *range(40)])] for k in [rng.choice([None, 1])]]
    rows = [(None if g is None else str(g), *r) for g, *r in rows] + [("big", 1, i % 3, 9000 + i, 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, x long, i long, v double")
    got = {r.i: r.s for r in running_sum(df, {"s": "v"}, ["x", "i"], ["g", "k"], cell_rows=60).collect()}
    want, sums = {}, {}
    for g, k, x, i, v in sorted(rows, key=lambda r: (r[2], r[3])):
        want[i] = sums[g, k] = sums.get((g, k), 0.0) + v
    assert got == want


def test_small_groups_are_sent_once_and_counted(spark):
    df = spark.range(20_000).selectExpr("id % 700 AS g", "hash(id) AS x", "id AS i", "1.0D AS v")
    out = running_sum(df, {"s": "v"}, ["x", "i"], ["g"])
    assert len(out.collect()) == 20_000
    assert records_sent(out) < 1.5 * 20_000  # the rows, and counts of 700 groups for each task
