"""Interval joins and genomic bins. Intervals are closed at both ends; points are intervals of length 0.

A plain overlap condition with few equal keys gives hash joins with huge buckets. Here each key's axis is cut
into ranges of about equally many starts, found from the data: starts are counted in cells of 22 significant
bits, and the counts are summed along the axis. Only keys with more starts than a range holds have cuts, so there
are at most 2 MAX_RANGES of them in all, and they are broadcast. An interval goes to every range that it touches,
each side in one exchange, sorted by start. Within a range, a sweep in start order meets each pair once: where the
right one starts inside the left one, or the left one inside the right one. A pair comes out in the first
range that both touch. A left row is alone if it met nothing in its first range and no right one starts between
that range's end and its own, which the cuts tell; so outer rows come out of the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from haplolake.functions.columns import midpoint
from haplolake.operators.relational import with_scalar

#: Starts in a range, and a bound on all keys' ranges (16 bytes each), which makes them larger on very large tables.
RANGE_ROWS, MAX_RANGES = 100_000, 200_000
#: Pairs in an output batch, give or take those of one row.
BATCH_PAIRS = 100_000
_SPLITTER = float(2**31 + 1)


def _cuts(starts: DataFrame, keys: Sequence[str], range_rows: int) -> DataFrame:
    """Per key with more than one range: _cuts, where ranges begin, and _later, the first right start after each range (both arrays, of 2 MAX_RANGES over all keys at most), and _steps for a search in them."""
    y = F.col("_p") * _SPLITTER
    cells = starts.groupBy(*keys, (y - (y - F.col("_p"))).alias("_c")).agg(F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_p"), F.min("_right").alias("_right"))
    # Every cell has a position; asking for all columns lets Spark take the total from the cells' own exchange.
    total = cells.agg(F.sum(F.when(F.col("_p").isNotNull() | F.col("_right").isNotNull(), F.col("_n"))).alias("_total"))
    along = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    size = F.greatest(F.lit(range_rows), F.ceil(F.col("_total") / MAX_RANGES))
    parts = with_scalar(cells, total).withColumn("_part", F.floor(F.coalesce(F.sum("_n").over(along), F.lit(0)) / size))
    ranges = parts.groupBy(*keys, "_part").agg(F.min("_p").alias("_p"), F.min("_right").alias("_right"))
    later = F.min("_right").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(1, Window.unboundedFollowing))
    listed = ranges.withColumn("_later", later).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_p", "_later"))).alias("_r")).filter(F.size("_r") > 1)
    bits = F.ceil(F.log2(F.size("_r").cast("double"))).cast("int")
    steps = F.transform(F.sequence(bits, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return listed.select(*keys, F.col("_r._p").alias("_cuts"), F.col("_r._later").alias("_later"), steps.alias("_steps"))


def _range_of(position: str) -> Column:
    """Number of cuts at or before a position, by binary search; 0 for a key without cuts."""
    found = F.aggregate("_steps", F.lit(0), lambda at, step: F.when(F.get(F.col("_cuts"), at + step - 1) <= F.col(position), at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def _pairs(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Overlaps of intervals (a, b) with (x, y), both sorted by start, in batches."""
    for owner, low, high in (
        (0, np.searchsorted(x, a, "left"), np.searchsorted(x, b, "right")),
        (1, np.searchsorted(a, x, "right"), np.searchsorted(a, y, "right")),
    ):
        total = np.cumsum(high - low)
        at = 0
        while at < len(total):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + BATCH_PAIRS, "right")))
            n = (high - low)[at:to]
            one = np.repeat(np.arange(at, to), n)
            other = np.repeat(low[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            if len(one):
                yield (one, other) if owner == 0 else (other, one)
            at = to


def _swept(group: pa.Table, left_columns: Sequence[str], right_columns: Sequence[str], outer: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Output rows of one range."""
    side, home, here = (group.column(c).to_numpy() for c in ("_side", "_lo", "_range"))
    s, e, more = (group.column(c).to_numpy() for c in ("_s", "_e", "_more"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    left, right = left[np.argsort(s[left], kind="stable")], right[np.argsort(s[right], kind="stable")]
    met = np.zeros(len(left), dtype=bool)
    take = lambda names, rows: [group.column(c).take(pa.array(rows)).combine_chunks() for c in names]
    as_batch = lambda columns: pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)
    for i, j in _pairs(s[left], e[left], s[right], e[right]):
        met[i] = True
        i, j = left[i], right[j]
        own = np.maximum(home[i], home[j]) == here[0]
        if own.any():
            yield as_batch(take(left_columns, i[own]) + take(right_columns, j[own]))
    if outer:
        alone = left[~met & (home[left] == here[0]) & ~more[left].astype(bool)]
        if len(alone):
            yield as_batch(take(left_columns, alone) + [pa.nulls(len(alone), schema.field(c).type) for c in right_columns])


def interval_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end"),
    how: str = "inner", prefix: str = "r_", range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Overlapping pairs; the right side's columns get a prefix, but for the keys (JN5, JN6, JN7).

    how="left" keeps left rows without a partner. Spans with a null or a start after the end, and null keys,
    overlap nothing. Positions are compared as doubles.
    """
    r = right.withColumnsRenamed({c: f"{prefix}{c}" for c in right.columns if c not in keys})
    spans = (left_span, tuple(f"{prefix}{c}" for c in right_span))
    lefts, rights = (_given(df, keys).filter(_usable(df, keys, span)).withColumns({"_s": F.col(span[0]).cast("double"), "_e": F.col(span[1]).cast("double"), "_side": F.lit(n)}) for n, (df, span) in enumerate(zip((left, r), spans, strict=True)))
    starts = lefts.select(*keys, F.col("_s").alias("_p"), F.lit(None).cast("double").alias("_right"))
    starts = starts.unionByName(rights.select(*keys, F.col("_s").alias("_p"), F.col("_s").alias("_right")))
    cuts = _cuts(starts, keys, range_rows)
    own = [c for c in r.columns if c not in keys]
    columns = ["_side", *keys, "_s", "_e", "_lo", "_range", "_more", *(c for c in left.columns if c not in keys), *own]

    def dealt(df: DataFrame) -> DataFrame:
        known = df.join(F.broadcast(cuts), list(keys), "left").withColumn("_lo", _range_of("_s"))
        spread = known.withColumn("_range", F.explode(F.sequence("_lo", F.when(F.col("_s") == F.col("_e"), F.col("_lo")).otherwise(_range_of("_e")))))
        return spread.withColumn("_more", F.coalesce(F.get("_later", F.col("_lo") - 1) <= F.col("_e"), F.lit(False)))

    both = dealt(lefts).unionByName(dealt(rights), allowMissingColumns=True).select(*columns)
    out = StructType([StructField(f.name, f.dataType) for f in left.schema.fields] + [StructField(f.name, f.dataType) for f in r.schema.fields if f.name in own])
    left_columns, groups, outer = left.columns, [*keys, "_range"], how == "left"

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        schema = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from _swept(pa.Table.from_batches(held), left_columns, own, outer, schema)
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema([batch.schema.field(c) for c in [*left_columns, *own]])
            change = np.zeros(batch.num_rows, dtype=bool)
            for g in groups:
                c = batch.column(g)
                change[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            if held and any(held[-1].column(g)[-1] != batch.column(g)[0] for g in groups):
                yield from flush()
            at = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for k, (x, y) in enumerate(zip(at, at[1:])):
                if k:
                    yield from flush()
                held.append(batch.slice(x, y - x))
        yield from flush()

    pairs = both.repartition(*groups).sortWithinPartitions(*groups, "_s").mapInArrow(sweep, out)
    if not outer:
        return pairs
    return pairs.unionByName(left.filter(~_usable(left, keys, left_span)), allowMissingColumns=True)


def _given(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with all keys. Said as a filter of its own, joins on the keys add none, so that equal parts of the plan stay equal and are run once."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def _usable(df: DataFrame, keys: Sequence[str], span: tuple[str, str]) -> Column:
    """Whether a row's keys are given and its span isn't empty."""
    ok = F.col(span[0]).cast("double") <= F.col(span[1]).cast("double")
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return F.coalesce(ok, F.lit(False))


def label_overlaps(left: DataFrame, regions: DataFrame, keys: Sequence[str], span: tuple[str, str] = ("start", "end"), prefix: str = "r_") -> DataFrame:
    """Left outer overlap with a table of few regions, such as arms: one equality and a residual, no blocks (JN8)."""
    r = regions.select(*(F.col(c).alias(f"_k_{c}") for c in keys), *(F.col(c).alias(f"{prefix}{c}") for c in regions.columns if c not in keys))
    condition = (F.col(span[0]) <= F.col(f"{prefix}end")) & (F.col(f"{prefix}start") <= F.col(span[1]))
    for k in keys:
        condition = condition & (left[k] == r[f"_k_{k}"])
    return left.join(r, condition, "left").drop(*(f"_k_{k}" for k in keys))


def make_bins(features: DataFrame, size: int, region: str = "chr", end: str = "end") -> DataFrame:
    """bin (numbered over regions), region, start, end, mid of equal bins of each region (DOM14).

    A region of length L has floor(L / size) bins, at least one; edges are shared, the last bin runs to L.
    """
    lengths = features.groupBy(region).agg(F.max(end).cast("long").alias("_len")).filter("_len IS NOT NULL")
    counted = lengths.withColumn("_n", F.greatest(F.lit(1), F.floor(F.col("_len") / size)))
    # One row a region: a running sum gives the bins of those before it.
    earlier = Window.orderBy(region).rowsBetween(Window.unboundedPreceding, -1)
    offset = counted.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    rows = offset.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    last = F.when(F.col("_i") == F.col("_n") - 1, F.col("_len")).otherwise((F.col("_i") + 1) * size)
    out = rows.select((F.col("_before") + F.col("_i") + 1).cast("long").alias("bin"), region, (F.col("_i") * size).cast("long").alias("start"), last.cast("long").alias("end"))
    return out.withColumn("mid", midpoint("start", "end"))
