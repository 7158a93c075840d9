"""Readers with explicit schemas for manifests, per-sample tables, annotations and regions; sinks."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haplolake.functions.columns import recode
from haplolake.operators.ordered import ranked
from haplolake.sources.many_files import listed_by_few
from haplolake.sources.quarantine import Checked, read_checked

GENE_COUNTS = "feature_id string, count long, _s1 long, _s2 long"
SUFFIXES = {"gene_counts": "*.ReadsPerGene.out.tab", "alleles": "*.table", "expression": "*.genes.results"}  # fixed file name endings


def read_manifest(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """experiment, sample_id from one TSV per experiment with the header ``samples``; without repeats (SRC1)."""
    out = None
    for experiment, path in paths.items():
        one = spark.read.csv(path, sep="\t", header=True, schema="samples string").select(F.lit(experiment).alias("experiment"), F.col("samples").alias("sample_id")).filter("sample_id IS NOT NULL").distinct()
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no experiment is given")
    return out


def all_samples(manifest: DataFrame) -> DataFrame:
    """Sample ids over all experiments; one that several experiments name stays as often (SRC2)."""
    return manifest.select("sample_id")


def list_files(spark: SparkSession, roots: Sequence[str], pattern: str) -> DataFrame:
    """path, file of the files under the roots whose name fits the pattern (SRC3). Contents aren't read."""
    with listed_by_few(spark):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(list(roots))
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))


def read_per_sample(spark: SparkSession, roots: Sequence[str], pattern: str, schema: str, **options: object) -> DataFrame:
    """Rows of all files that fit the pattern, with the file's path and name (SRC3); empty files add none."""
    with listed_by_few(spark):
        rows = spark.read.schema(schema).options(**{"pathGlobFilter": pattern, "recursiveFileLookup": True, **options}).csv(list(roots))
    return rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))


def resolve_samples(files: DataFrame, annotation: DataFrame, fastq: str = "fastq", sample: str = "sample_id", order: str = "row_no") -> DataFrame:
    """path, file, sample_id, lane of every file that an annotation row claims (SRC4).

    A row claims the files whose name holds ``_<fastq>_``, ignoring case; if there are none, those that
    hold ``<fastq>``. Its first file in order of name is lane 1, the second lane 2, named <sample>_L2; the
    rest are unclaimed. Of two rows that claim a file, the later one gets it.
    """
    rows = annotation.filter(F.col(fastq).isNotNull() & (F.col(fastq) != "")).select(F.lower(fastq).alias("_q"), F.col(sample).alias("_sample"), F.col(order).alias("_order"))
    name = F.lower("file")
    # Containment has no key to join on, so names are cut into all their pieces of the lengths that occur
    # (one row, at most as many as a name is long), and pieces are joined.
    lengths = rows.agg(F.collect_set(F.length("_q")).alias("_lengths"))
    starts = lambda n: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("file") - n + 1))
    pieces = F.flatten(F.transform("_lengths", lambda n: F.transform(starts(n), lambda i: F.substring(name, i, n))))
    cut = files.crossJoin(F.broadcast(lengths)).select("path", "file", F.explode(F.array_distinct(pieces)).alias("_q"))
    close = name.contains(F.concat(F.lit("_"), F.col("_q"), F.lit("_")))
    hits = cut.join(rows, "_q").withColumn("_tier", F.when(close, 1).otherwise(2))
    own = Window.partitionBy("_sample", "_order")
    best = hits.withColumn("_best", F.min("_tier").over(own)).filter("_tier = _best")
    laned = best.withColumn("lane", F.row_number().over(own.orderBy("file", "path"))).filter("lane <= 2")
    last = laned.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("_order"), "_sample"))).filter("_n = 1")
    return last.select("path", "file", F.when(F.col("lane") == 2, F.concat("_sample", F.lit("_L2"))).otherwise(F.col("_sample")).alias("sample_id"), "lane")


def with_samples(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per-sample rows with the sample of their file; rows of unresolved files go (SRC4)."""
    return rows.join(resolved.select("path", "sample_id", "lane"), "path").drop("path", "file")


def read_allele_counts(spark: SparkSession, roots: Sequence[str], pattern: str = SUFFIXES["alleles"], schema: str = "contig string, position long, variantID string, refAllele string, altAllele string, refCount long, altCount long") -> DataFrame:
    """chr, pos, ref, alt, path, file (SRC5)."""
    rows = read_per_sample(spark, roots, pattern, schema, sep="\t", header=True, enforceSchema=False)
    return rows.select(F.col("contig").alias("chr"), F.col("position").alias("pos"), F.col("refCount").alias("ref"), F.col("altCount").alias("alt"), "path", "file")


def read_tpm(spark: SparkSession, roots: Sequence[str], pattern: str = SUFFIXES["expression"], schema: str = "gene_id string, `transcript_id(s)` string, length double, effective_length double, expected_count double, TPM double, FPKM double") -> DataFrame:
    """feature_id, value, path, file (SRC6)."""
    rows = read_per_sample(spark, roots, pattern, schema, sep="\t", header=True, enforceSchema=False)
    return rows.select(F.col("gene_id").alias("feature_id"), F.col("TPM").alias("value"), "path", "file")


def read_gene_counts(spark: SparkSession, roots: Sequence[str], pattern: str = SUFFIXES["gene_counts"]) -> DataFrame:
    """feature_id, count (first count column), path, file of headerless tables (SRC7)."""
    return read_per_sample(spark, roots, pattern, GENE_COUNTS, sep="\t").select("feature_id", "count", "path", "file")


def check_allele_counts(spark: SparkSession, roots: Sequence[str], pattern: str = SUFFIXES["alleles"], schema: str = "contig string, position long, variantID string, refAllele string, altAllele string, refCount long, altCount long") -> Checked:
    """As read_allele_counts, with malformed rows apart: places and counts must be given, and counts not be negative."""
    return read_checked(spark, roots, pattern, schema, ("contig", "position", "refCount", "altCount"), (F.col("refCount") >= 0) & (F.col("altCount") >= 0), sep="\t", header=True, enforceSchema=False)


def check_tpm(spark: SparkSession, roots: Sequence[str], pattern: str = SUFFIXES["expression"], schema: str = "gene_id string, `transcript_id(s)` string, length double, effective_length double, expected_count double, TPM double, FPKM double") -> Checked:
    """As read_tpm, with malformed rows apart."""
    return read_checked(spark, roots, pattern, schema, ("gene_id", "TPM"), F.col("TPM") >= 0, sep="\t", header=True, enforceSchema=False)


def check_gene_counts(spark: SparkSession, roots: Sequence[str], pattern: str = SUFFIXES["gene_counts"]) -> Checked:
    """As read_gene_counts, with malformed rows apart."""
    return read_checked(spark, roots, pattern, GENE_COUNTS, ("feature_id", "count"), F.col("count") >= 0, sep="\t")


def read_gtf(spark: SparkSession, path: str, types: Sequence[str] = ("gene", "exon", "UTR")) -> DataFrame:
    """chr, start, end, width, strand, type, gene_id, gene_type (SRC8)."""
    schema = "chr string, source string, type string, start long, end long, score string, strand string, frame string, attributes string"
    rows = spark.read.csv(path, sep="\t", schema=schema, comment="#", quote="").filter(F.col("type").isin(*types))
    of = lambda name: F.nullif(F.regexp_extract("attributes", f'(?:^|; ?){name} "([^"]*)"', 1), F.lit(""))
    return rows.select("chr", "start", "end", (F.col("end") - F.col("start") + 1).alias("width"), "strand", "type", of("gene_id").alias("gene_id"), of("gene_type").alias("gene_type"))


def read_phase(spark: SparkSession, path: str) -> DataFrame:
    """chr, pos, Haplotype, MAF, sample_count from a white-space separated table with a header (SRC9).

    Columns are found by their names in the first line, which is the only one that goes to the driver.
    """
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r'["\t]', " ")), r"\s+").alias("f"))
    names = lines.filter(F.array_contains("f", "Haplotype")).first().f
    kinds = {"chr": "string", "pos": "long", "Haplotype": "int", "MAF": "double", "sample_count": "long"}
    extra = F.size("f") - F.lit(len(names))  # a row name may lead each data line
    rows = lines.filter(~F.array_contains("f", "Haplotype") & (F.size("f") >= len(names)))
    return rows.select(*(F.element_at("f", (F.lit(names.index(c) + 1) + extra).cast("int")).try_cast(t).alias(c) for c, t in kinds.items()))


def read_annotation(spark: SparkSession, path: str, strings: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """Listed columns of a CSV with header, as strings; ``numbers`` as double, null where they aren't (SRC10, PRJ3)."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    return rows.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in strings), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in numbers))


def read_offset_csv(spark: SparkSession, path: str, header_row: int, skip: int, take: int, n_columns: int, names: Sequence[str] | None = None, key: str | None = None) -> DataFrame:
    """A CSV whose header is data row ``header_row`` (from 1): rows after ``skip``, ``take`` of them, the
    first ``n_columns`` columns, names overridden, rows with a blank key dropped (SRC11, SO5)."""
    schema = ", ".join(f"c{i} string" for i in range(n_columns))
    rows = spark.read.csv(path, schema=schema, quote='"', escape='"').coalesce(1).withColumn("_n", F.monotonically_increasing_id())
    header = rows.filter(F.col("_n") == header_row).first()
    titles = list(names or [(header[f"c{i}"] or f"c{i}") for i in range(n_columns)])
    kept = rows.filter((F.col("_n") > skip) & (F.col("_n") <= skip + take))
    out = kept.select(*(F.col(f"c{i}").alias(t) for i, t in enumerate(titles)))
    return out if key is None else out.filter(F.col(f"`{key}`").isNotNull() & (F.trim(f"`{key}`") != ""))


def read_regions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Centromeres, arms, gene ranges: Parquet, or CSV with header (SRC12)."""
    return spark.read.schema(schema).parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, schema=schema)


def labelled_samples(listed: DataFrame, drop_rows: Sequence[int] = (), exclude_chr: Sequence[int] = (), row: str = "row_no") -> DataFrame:
    """Hand-labelled (ID, CN, chr) rows without listed row numbers and chromosomes (SRC13)."""
    return listed.filter(~F.col(row).isin(*drop_rows) & ~F.col("chr").isin(*exclude_chr)) if drop_rows else listed.filter(~F.col("chr").isin(*exclude_chr))


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """Manual review result; chr X is 23, as a number (SRC14)."""
    rows = spark.read.csv(path, header=True)
    return rows.withColumn("chr", recode("chr", {"X": "23"}).try_cast("double"))


def checkpoint(df: DataFrame, path: str) -> DataFrame:
    """Write a stage's result as Parquet and go on from there (SRC15)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header (SRC16)."""
    df.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def _cell(c: Column) -> Column:
    """A CSV field: quoted if it holds a comma, a quote or a line end; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_wide_csv(df: DataFrame, path: str, ids: Sequence[str], column: str, value: str, names: DataFrame | None = None, parts: int | None = None, compression: str = "none") -> None:
    """A long matrix as CSV with one line for each id and a field for every name of ``column``, in order of name (SRC16, SO2, RS1).

    Names get ordinal numbers (from ``names``, or from all that occur), a line is put together from the sorted
    entries of its id, and gaps are filled with as many commas; there is no pivot, so the number of names has no
    bound but the length of a line. Every part begins with the header. Two values for one field are an error.
    Lines of a sparse matrix are mostly commas: compression (gzip) takes those away from the disk. Entries are sent and
    sorted, and lines are put together from them only as they are written.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = (df if names is None else names).select(F.col(column).cast("string").alias("_name")).distinct()
    numbered = ranked(listed, ["_name"], name="_no")
    head = numbered.agg(F.sort_array(F.collect_list(F.struct("_no", _cell(F.col("_name")).alias("n")))).alias("h"), F.count(F.lit(1)).alias("_all"))
    entries = df.select(*ids, F.col(column).cast("string").alias("_name"), _cell(F.col(value)).alias("_v")).join(numbered, "_name")
    lines = entries.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("_no", "_v"))).alias("_e")).crossJoin(F.broadcast(head.select("_all")))
    before = lambda i: F.when(i > 0, F.get(F.col("_e"), i - 1)["_no"]).otherwise(F.lit(1))
    gap = lambda x, i: F.when((i > 0) & (x["_no"] == before(i)), F.raise_error(F.lit("two values for one field")).cast("string")).otherwise(F.lit(""))
    piece = lambda x, i: F.concat(gap(x, i), F.repeat(F.lit(","), (x["_no"] - before(i)).cast("int")), x["_v"])
    tail = F.repeat(F.lit(","), (F.col("_all") - F.element_at("_e", -1)["_no"]).cast("int"))
    line = F.concat(F.array_join(F.transform("_e", piece), ""), tail)
    key = F.concat_ws(",", *(_cell(F.col(c)) for c in ids))
    body = lines.select(key.alias("value"), "_e", "_all", F.pmod(F.xxhash64(*ids), F.lit(parts)).cast("int").alias("_part"), F.lit(1).alias("_k"))
    title = head.select(F.concat_ws(",", *(_cell(F.lit(c)) for c in ids), F.array_join(F.col("h.n"), ",")).alias("value"))
    titles = title.crossJoin(spark.range(parts).select(F.col("id").cast("int").alias("_part"))).withColumn("_k", F.lit(0))  # a row for each part
    dealt = titles.unionByName(body, allowMissingColumns=True).repartitionById(parts, F.col("_part")).sortWithinPartitions("_k", "value")
    dealt.select(F.when(F.col("_k") == 0, F.col("value")).otherwise(F.concat_ws(",", "value", line)).alias("value")).write.mode("overwrite").text(path, compression=compression)


def read_wide_csv(spark: SparkSession, path: str, n_ids: int = 1) -> DataFrame:
    """What write_wide_csv wrote, long again: the id columns, column (the field's name), place (from 1), value (text), without empty fields.

    A line is searched for its filled fields, so that it doesn't become as many columns as there are names. A row
    for each line needs no line end inside a field. The header goes through the driver.
    """
    head = spark.read.text(path).first().value
    names, first = next(csv.reader([head])), head.encode()
    ids, fields = names[:n_ids], names[n_ids:]
    schema = ", ".join(f"`{c}` string" for c in ids) + ", column string, place long, value string"
    kinds = pa.schema([*((c, pa.string()) for c in ids), ("column", pa.string()), ("place", pa.int64()), ("value", pa.string())])

    def filled(line: bytes) -> list[tuple[int, str]]:
        at = np.flatnonzero(np.frombuffer(line, np.uint8) != ord(","))
        if not len(at):
            return []
        starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        ends = np.append(starts[1:], len(at)) - 1
        # Before the i-th byte that is no comma come i such bytes, the rest are commas.
        found = [(int(at[i]) - int(i), line[at[i] : at[j] + 1].decode()) for i, j in zip(starts, ends, strict=True)]
        if any('"' in v for _, v in found):
            return [(i, v) for i, v in enumerate(next(csv.reader([line.decode()]))) if v]
        return found

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                line = text.as_buffer().to_pybytes()
                if line == first:
                    continue
                found = filled(line)
                own = dict(found[:n_ids])
                held = [(i - n_ids, v) for i, v in found if i >= n_ids]
                columns = [pa.array([own.get(i)] * len(held), pa.string()) for i in range(n_ids)]
                columns += [pa.array([fields[i] for i, _ in held], pa.string()), pa.array([i + 1 for i, _ in held], pa.int64()), pa.array([v for _, v in held], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return spark.read.text(path).mapInArrow(cells, schema)


def missing_outputs(manifest: DataFrame, files: DataFrame, kinds: Mapping[str, Column]) -> DataFrame:
    """experiment, sample_id, kind of every expected file that is not there (SRC18).

    kinds: file name expected of a manifest row, by kind.
    """
    expected = None
    for kind, name in kinds.items():
        one = manifest.select("experiment", "sample_id", F.lit(kind).alias("kind"), name.alias("file"))
        expected = one if expected is None else expected.unionByName(one)
    return expected.join(files.select("file").distinct(), "file", "left_anti").select("experiment", "sample_id", "kind")
