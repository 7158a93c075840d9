"""Malformed rows, incremental stages, wide files and merged moments on hand-made data."""

import csv
import math
import os
import random
import statistics
import uuid
from glob import glob

import pytest
from pyspark.sql import functions as F

from haplolake.operators import moments
from haplolake.sources import many_files, scratch, stages, tables


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.table").write_text("contig\tposition\tvariantID\trefAllele\taltAllele\trefCount\taltCount\nchr1\t5\tv\tA\tC\t3\t4\nchr1\tfive\tv\tA\tC\t3\t4\nchr1\t6\tv\tA\tC\t3\nchr2\t7\tv\tA\tC\t-3\t4\n\t8\tv\tA\tC\t3\t4\n")
    (tmp_path / "b.table").write_text("contig\tposition\tvariantID\trefAllele\taltAllele\trefCount\taltCount\nchr1\t9\tv\tA\tC\t1\t2\n")
    (tmp_path / "empty.table").write_text("")
    c = tables.check_allele_counts(spark, [str(tmp_path)])
    assert sorted((r.contig, r.position, r.refCount) for r in c.good.collect()) == [("chr1", 5, 3), ("chr1", 9, 1)]
    bad = {(r.reason, r.record) for r in c.quarantined.collect()}
    assert {r for r, _ in bad} == {"unreadable", "out of range", "no contig"} and ("unreadable", "chr1\tfive\tv\tA\tC\t3\t4") in bad and len(bad) == 4
    assert {(r.file, r["rows"], r.malformed) for r in c.errors.collect()} == {("a.table", 5, 4), ("b.table", 1, 0)}
    assert [r.file for r in c.over_budget(0.5).collect()] == ["a.table"] and c.over_budget(0.5, 4).count() == 0
    assert [r.position for r in c.within_budget(0.5).good.collect()] == [9]
    assert c.enforced(0.8).count() == 2
    with pytest.raises(Exception, match="too many malformed rows in a.table"):
        c.enforced(0.5).count()


def test_a_stage_reads_only_what_changed(spark, tmp_path):
    root, out, asked = tmp_path / "in", str(tmp_path / "stage"), []
    root.mkdir()
    put = lambda name, text: (root / f"{name}.tsv").write_text(text)

    def compute(paths):
        asked.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        rows = spark.read.schema("v long").csv(paths)
        return rows.select(F.regexp_extract("_metadata.file_name", "^([^.]*)", 1).alias("sample_id"), "v")

    def run(fail=False):
        files = stages.list_with_sizes(spark, [str(root)], "*.tsv", F.regexp_extract("file", "^([^.]*)", 1))
        def broken(paths):
            raise RuntimeError("broken")
        return sorted((r.sample_id, r.v) for r in stages.run_stage(spark, out, files, broken if fail else compute).collect())

    put("a", "1\n2\n")
    put("b", "3\n")
    assert run() == [("a", 1), ("a", 2), ("b", 3)] and asked.pop() == ["a.tsv", "b.tsv"]
    assert run() == [("a", 1), ("a", 2), ("b", 3)] and not asked
    put("c", "4\n")
    assert run() == [("a", 1), ("a", 2), ("b", 3), ("c", 4)] and asked.pop() == ["c.tsv"]
    put("b", "5\n66\n")
    with pytest.raises(RuntimeError):
        run(fail=True)
    assert run() == [("a", 1), ("a", 2), ("b", 5), ("b", 66), ("c", 4)] and asked.pop() == ["b.tsv"]
    (root / "a.tsv").unlink()
    assert run() == [("b", 5), ("b", 66), ("c", 4)] and not asked
    put("a", "7\n")
    assert run() == [("a", 7), ("b", 5), ("b", 66), ("c", 4)] and asked.pop() == ["a.tsv"]


def test_a_changed_file_is_the_only_input(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\n")
    (tmp_path / "b.tsv").write_text("2\n")
    out = str(tmp_path / "stage")
    unit = F.regexp_extract("file", "^([^.]*)", 1)
    seen = []

    def compute(paths):
        rows = spark.read.schema("v long").csv(paths)
        seen.append(rows.inputFiles())
        return rows.select(F.regexp_extract("_metadata.file_name", "^([^.]*)", 1).alias("sample_id"), "v")

    for _ in range(2):
        stages.run_stage(spark, out, stages.list_with_sizes(spark, [str(tmp_path)], "?.tsv", unit), compute)
        (tmp_path / "c.tsv").write_text("3\n")
    assert [len(s) for s in seen] == [2, 1] and seen[1][0].endswith("c.tsv")


@pytest.mark.parametrize("parts", [1, 5])
def test_wide_file_of_any_number_of_names(spark, tmp_path, parts):
    rng = random.Random(parts)
    names = [f"s{i}" for i in range(400)] + ['a "b"', "c,d", "é"]
    cells = {(f"g{f},x", n): rng.random() for f in range(20) for n in names if rng.random() < 0.3 or f == 0}
    df = spark.createDataFrame([(f, n, None if v < 0.02 else v) for (f, n), v in cells.items()], "gene string, name string, v double")
    tables.write_wide_csv(df, str(tmp_path / "w"), ["gene"], "name", "v", parts=parts)
    files = [f for f in glob(str(tmp_path / "w" / "part-*"))]
    got, headers = {}, set()
    for f in files:
        with open(f, encoding="utf-8", newline="") as h:
            lines = list(csv.reader(h))
        headers.add(tuple(lines[0]))
        for line in lines[1:]:
            assert len(line) == len(names) + 1
            got |= {(line[0], n): float(v) for n, v in zip(lines[0][1:], line[1:]) if v}
    assert headers == {("gene", *sorted(names, key=lambda n: n.encode()))} and len(files) == parts
    assert got == {k: v for k, v in cells.items() if v >= 0.02}
    assert "Pivot" not in df.groupBy("gene").count()._jdf.queryExecution().toString()
    twice = spark.createDataFrame([("g", "n", 1.0), ("g", "n", 2.0)], "gene string, name string, v double")
    with pytest.raises(Exception, match="two values for one field"):
        tables.write_wide_csv(twice, str(tmp_path / "x"), ["gene"], "name", "v")


def test_a_sparse_wide_file_is_compressed_and_read_back(spark, tmp_path):
    names = [f"s{i:04}" for i in range(3000)] + ['a "b"', "c,d"]
    cells = {(f"g{f},x" if f % 2 else f"g{f}", names[(f * 37 + k * 611) % len(names)]): f + k / 8 for f in range(50) for k in range(3)} | {("first", n): 1.0 for n in names}
    df = spark.createDataFrame([(f, n, v) for (f, n), v in cells.items()], "gene string, name string, v double")
    tables.write_wide_csv(df, str(tmp_path / "w"), ["gene"], "name", "v", parts=3, compression="gzip")
    files = glob(str(tmp_path / "w" / "part-*"))
    assert len(files) == 3 and sum(os.path.getsize(f) for f in files) < 51 * len(names)  # commas alone would be more
    place = {n: i for i, n in enumerate(sorted(names), 1)}
    got = sorted((r.gene, r["column"], r.place, float(r.value)) for r in tables.read_wide_csv(spark, str(tmp_path / "w")).collect())
    assert got == sorted((f, n, place[n], v) for (f, n), v in cells.items())


def test_filled_fields_of_a_wide_file_are_found_by_their_bytes(spark, tmp_path):
    """lines without ids or fields, neighbours, several bytes to a letter, quotes, and fields at either end."""
    (tmp_path / "w.csv").write_text('é,k,a,"b,c",d,é2\ng,h,1,2,,\ng,h,,,,é\n,,,,,\n,h,1,,,2\nü,"x,y",,,é é,\n\n', encoding="utf-8")
    got = tables.read_wide_csv(spark, str(tmp_path / "w.csv"), 2).collect()
    want = [("g", "h", "a", 1, "1"), ("g", "h", "b,c", 2, "2"), ("g", "h", "é2", 4, "é"), (None, "h", "a", 1, "1"), (None, "h", "é2", 4, "2"), ("ü", "x,y", "d", 3, "é é")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_moments_merge_to_a_full_recompute(spark):
    rng = random.Random(2)
    data = [(f, s, rng.choice([None, 0.0, 1e9 + rng.random(), rng.random()]) if f < 3 else 1e9 + rng.random()) for f in range(5) for s in range(60)] + [(9, 1, None)]
    df = spark.createDataFrame(data, "f long, s long, v double")
    parts = [moments.summarise(df.filter(f"s % 3 = {i}"), ["f"], "v") for i in range(3)]
    merged = moments.merge(*parts, by=["f"])
    for r in merged.withColumn("var", moments.variance()).collect():
        v = [x for f, _, x in data if f == r.f and x is not None]
        assert (r.n, r.nulls, r.zeros) == (len(v), sum(f == r.f and x is None for f, _, x in data), v.count(0.0))
        assert r.mean == (pytest.approx(statistics.fmean(v), rel=1e-12) if v else None)
        assert r["var"] == (pytest.approx(statistics.variance(v), rel=1e-6) if len(v) > 1 else None)
    for r in moments.with_absent_as_zero(merged, 70).withColumn("var", moments.variance()).collect():
        v = [x or 0.0 for f, _, x in data if f == r.f]
        v += [0.0] * (70 - len(v))
        assert (r.n, r.zeros) == (70, v.count(0.0)) and r.mean == pytest.approx(statistics.fmean(v)) and r["var"] == pytest.approx(statistics.variance(v), rel=1e-9)


def test_a_matrix_stored_by_feature_is_not_exchanged_by_feature(spark):
    from haplolake.operators import expression, regions
    from haplolake.sources.by_feature import store_by_feature

    rng = random.Random(3)
    samples = spark.createDataFrame([(s, s < 4) for s in range(10)], "sample_id long, is_control boolean")
    features = spark.createDataFrame([(f, "chr1") for f in range(50)], "feature_id long, chr string")
    m = spark.createDataFrame([(f, s, rng.random()) for f in range(50) for s in range(10)], "feature_id long, sample_id long, value double")
    table = store_by_feature(m, buckets=3)

    def weights(matrix):
        rows = expression.ratio_to_controls(matrix, F.broadcast(samples)).join(F.broadcast(features), "feature_id")
        return regions.invvar_weights(rows, F.broadcast(samples), ["feature_id"])

    plan = weights(table)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(feature_id" in weights(m)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(feature_id" not in plan and "SelectedBucketsCount: 3 out of 3" in plan
    got, want = ({r.feature_id: pytest.approx(r.weight) for r in weights(x).collect()} for x in (table, m))
    assert got == want and len(got) == 50


def test_stored_tables_can_be_removed(spark):
    from pathlib import Path

    t = scratch.stored(spark.range(3), "small")
    folder = Path(t.inputFiles()[0].removeprefix("file://")).parents[1]
    assert folder.exists() and t.count() == 3
    scratch.removed(t)
    assert not folder.exists()


def test_a_stage_of_many_units_is_a_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "MAX_GENERATIONS", 2)
    root, out = tmp_path / "in", tmp_path / "stage"
    root.mkdir()
    held = {f"{i:03}": i for i in range(60)}  # a unit's name stays text, with its zeros
    asked = []

    def compute(paths):
        asked.append(len(paths))
        rows = spark.read.schema("v long").csv(paths)
        return rows.select(F.regexp_extract("_metadata.file_name", "^([^.]*)", 1).alias("sample_id"), "v")

    for step in range(5):
        changed = {k: 1000 * step + v for k, v in held.items() if not step or int(k) % 7 == step}
        held |= changed
        for k, v in changed.items():
            (root / f"{k}.tsv").write_text(f"{v}\n")
        got = stages.run_stage(spark, str(out), stages.list_with_sizes(spark, [str(root)], "*.tsv", F.regexp_extract("file", "^([^.]*)", 1)), compute)
        assert {r.sample_id: r.v for r in got.collect()} == held and got.count() == 60 and asked[-1] == len(changed)
        live = {r.generation for r in stages.manifest(spark, str(out)).collect()}
        assert max(live) == step + 1 and len(live) <= 3
        assert len(glob(f"{out}/generations/stage_run={step + 1}/part-*")) <= 4
    for f in root.iterdir():
        f.unlink()
    gone = stages.run_stage(spark, str(out), stages.list_with_sizes(spark, [str(root)], "*.tsv", F.regexp_extract("file", "^([^.]*)", 1)), compute)
    assert gone.columns == ["sample_id", "v"] and gone.isEmpty()


def test_folders_are_listed_by_a_few_tasks(spark, tmp_path):
    for i in range(80):
        (tmp_path / f"sample_id={i}").mkdir()
        (tmp_path / f"sample_id={i}" / "part-0").write_text(f"{i}\t1\n")
    conf = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tracker = spark.conf.get(conf), spark.sparkContext.statusTracker()

    def tasks(work):
        spark.sparkContext.setJobGroup(group := uuid.uuid4().hex, group)
        work()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]

    few = many_files.PER_CORE * spark.sparkContext.defaultParallelism
    for work in (
        lambda: tables.read_per_sample(spark, [str(tmp_path)], "part-*", "feature string, count long", sep="\t"), lambda: tables.list_files(spark, [str(tmp_path)], "part-*"),
        lambda: stages.list_with_sizes(spark, [str(tmp_path)], "part-*", F.col("path")), lambda: tables.check_gene_counts(spark, [str(tmp_path)], "part-*"),
    ):
        listing = tasks(work)
        assert listing and max(listing) <= few
    assert spark.conf.get(conf) == before
    assert tables.read_per_sample(spark, [str(tmp_path)], "part-*", "feature string, count long", sep="\t").count() == 80


def test_spread_grows_with_the_bytes_of_files(spark, tmp_path):
    """the number of partitions follows the input, not the session's number nor compressed bytes sent."""
    from haplolake.sources.scratch import spread

    path = f"file://{tmp_path}/a table"
    spark.range(20_000).selectExpr("id", "id % 7 AS k").write.parquet(path)
    df = spark.read.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "a table").glob("*.parquet"))
    for parts in (10, 40):
        out = spread(df, "id", size=math.ceil(size / parts))
        assert parts - 1 <= out.rdd.getNumPartitions() <= parts + 1
        assert out.join(df.withColumnRenamed("k", "j"), "id").agg({"j": "sum"}).first()[0] == sum(i % 7 for i in range(20_000))
    assert spread(df, "id", size=size + 1) is df
    made = spark.range(3)
    assert spread(made, "id") is made
