"""Incremental stages: a manifest tells which files a stage has read, and only new or changed ones are read again.

A run lists the files, compares path, size and time with the stage's manifest, computes the units (samples) that have
new, changed or vanished files, writes their rows as a generation of the stage's table, and then the manifest, which names
the generation that holds each unit's rows. The manifest comes last, so a broken run is simply made again: its units
still differ from the last manifest. A generation is a few files, however many units it has. Rows that a later generation
replaces stay beside the others until no unit is read from there, or until the units are spread over MAX_GENERATIONS:
then the run writes all of them again as one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haplolake.sources.many_files import listed_by_few
from haplolake.sources.scratch import stored

_FILES = "path string, unit string, size long, modified timestamp, generation long"
#: Generations that a stage's units may be read from.
MAX_GENERATIONS = 16


def list_with_sizes(spark: SparkSession, roots: Sequence[str], pattern: str, unit: Column) -> DataFrame:
    """path, unit, size, modified of the files that fit the pattern; unit is made from ``path`` and ``file``. Contents aren't read."""
    with listed_by_few(spark):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(list(roots))
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
    return named.select("path", unit.alias("unit"), "size", "modified")


def _generations(spark: SparkSession, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests")
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(p):
        return []
    done = [s.getPath() for s in files.listStatus(p)]
    return sorted(int(d.getName()) for d in done if d.getName().isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, unit, size, modified, generation (with the unit's rows) as of the last complete run; empty before the first."""
    runs = _generations(spark, path)
    return spark.read.schema(_FILES).parquet(f"{path}/_manifests/{runs[-1]}") if runs else spark.createDataFrame([], _FILES)


def changed_units(files: DataFrame, known: DataFrame) -> DataFrame:
    """unit, gone: units whose files are new, changed or fewer than the manifest says; gone if no file of theirs is left."""
    old = known.select("path", F.col("unit").alias("_unit"), F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    both = files.join(old, "path", "full")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified")) & F.col("unit").eqNullSafe(F.col("_unit"))
    touched = both.filter(~same).select(F.explode(F.array_distinct(F.array_compact(F.array("unit", "_unit")))).alias("unit")).distinct()
    return touched.join(files.select("unit").distinct().withColumn("_here", F.lit(True)), "unit", "left").select("unit", F.col("_here").isNull().alias("gone"))


def _held(spark: SparkSession, path: str, places: DataFrame, unit: str) -> DataFrame:
    """The rows of units, each from its generation. places: unit, generation, a row for each unit."""
    live = sorted(r.generation for r in places.select("generation").distinct().collect())
    folders = [f"{path}/generations/stage_run={g}" for g in live] or [f"{path}/generations"]  # the whole if no unit is left, for its columns
    rows = spark.read.option("basePath", f"{path}/generations").parquet(*folders)
    return rows.join(places.select(F.col("unit").alias(unit), F.col("generation").alias("stage_run")), [unit, "stage_run"], "left_semi").drop("stage_run")


def run_stage(spark: SparkSession, path: str, files: DataFrame, compute: Callable[[list[str]], DataFrame], unit: str = "sample_id") -> DataFrame:
    """Bring the stage's table up to date and return it (SRC3, SRC15, SRC18).

    files: as list_with_sizes gives; compute(paths) reads exactly those files and returns rows with the unit's column.
    Names of changed files go through the driver, as every reader's paths do. A run without changes computes nothing.
    """
    files = stored(files, "files")
    known = manifest(spark, path).filter("generation IS NOT NULL")
    units = stored(changed_units(files, known), "units")
    if not units.isEmpty():
        runs = _generations(spark, path)
        new = runs[-1] + 1 if runs else 1
        old = known.join(units, "unit", "left_anti").select("unit", "generation").distinct()
        full = old.select("generation").distinct().count() >= MAX_GENERATIONS
        wanted = [r.path for r in files.join(units.filter("NOT gone"), "unit", "left_semi").select("path").collect()]
        if wanted:
            with listed_by_few(spark):
                rows = compute(wanted)
            rows = rows.withColumn(unit, F.col(unit).cast("string"))
            if full:
                rows = rows.unionByName(_held(spark, path, old, unit))
            rows.repartition(unit).write.mode("overwrite").parquet(f"{path}/generations/stage_run={new}")
        places = old.filter(F.lit(not (full and wanted))).select("unit", F.col("generation").alias("_g"))
        placed = files.join(places, "unit", "left").select("path", "unit", "size", "modified", F.coalesce("_g", F.lit(new).cast("long")).alias("generation"))
        placed.write.mode("overwrite").parquet(f"{path}/_manifests/{new}")
    return _held(spark, path, manifest(spark, path).select("unit", "generation").distinct(), unit)
