"""Packing of tokenised documents into sequences: first-fit decreasing in randomised groups.

Every document becomes its token ids and one separator id. It is cut into pieces of the sequence length
and one shorter rest; a full piece is a sequence of its own and needs no group. The rests are dealt at
random into groups of bounded size, and each group is packed by itself: the longest rest first, into the
first sequence that has room for it. A tournament tree over the capacities of the open sequences finds
that in logarithmic time. Only piece lengths and checksums are kept, never the ids.

The pieces are numbered and written before they are dealt: a number depends on a row's place in its task,
so repeated rows get different ones and spread over all groups, and once the table is complete a lost
task can't number them anew. The number of groups follows from the number of rests in that table.

Defined cases: a null text is the empty one, whose only token is the separator; ids may be null or
repeat, each row is packed once; texts of any length are cut whole, and their full pieces never meet in
one task; other columns are not carried; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplolake.llm.bpe import SLICE_BYTES, codec
from haplolake.llm.ragged import offsets_of, slices
from haplolake.llm.storage import written

#: Rests per group, about; a document has one at most.
GROUP_DOCS = 4096
_PIECE = "_id long, start long, length long, ids_crc32 long, doc_tokens long, _row long"
#: Ids of sequences that are one full piece start here; below are group * 2^24 + number within the group.
FULL = 1 << 62


class Tournament:
    """Capacities of bins 0, 1, ... as leaves of a complete binary tree whose nodes hold their larger child."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Place an item into the first bin with room for it; the bin and its capacity before."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        place, before = at - self.leaves, tree[at]
        tree[at] = before - size
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
        return place, before


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; no item may be larger than the capacity."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    if len(sizes):
        tree = Tournament(len(sizes), capacity)
        for i in np.argsort(-sizes, kind="stable").tolist():
            bins[i], before = tree.put(int(sizes[i]))
            offsets[i] = capacity - before
    return bins, offsets


def cut_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, separator: int = 0) -> DataFrame:
    """One row per piece: _id, start, length, ids_crc32, doc_tokens and a number that no other piece has (_row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                ids, offs = codec(path).encode(part.column("_text"))
                n = offs[1:] - offs[:-1] + 1
                at = offsets_of(n)
                stream = np.full(at[-1], separator, dtype="<u4")
                own = np.ones(at[-1], dtype=bool)
                own[at[1:] - 1] = False
                stream[own] = ids
                pieces = -(-n // length)
                doc = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(doc)) - np.repeat(offsets_of(pieces)[:-1], pieces)) * length
                size = np.minimum(length, n[doc] - start)
                raw = memoryview(stream).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((at[doc] + start).tolist(), (at[doc] + start + size).tolist(), strict=True)]
                rows = np.arange(row, row + len(doc)) + (partition << 40)
                row += len(doc)
                yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, size, crc, n[doc], rows))], names=["_id", "start", "length", "ids_crc32", "doc_tokens", "_row"])

    kept = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return kept.mapInArrow(run, _PIECE)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, separator: int = 0, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    pieces = written(cut_documents(docs, path, id_col, text_col, length, separator), "pieces")
    rests = pieces.filter(F.col("length") < length)
    groups = max(1, -(-rests.count() // group_docs))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        number, offset = first_fit_decreasing(table.column("length").to_numpy(), length)
        sequence = table.column("_group").to_numpy() * (1 << 24) + number
        kept = table.select(["_id", "start", "length", "ids_crc32", "doc_tokens"])
        return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = rests.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    schema = "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = dealt.groupBy("_group").applyInArrow(run, schema)
    full = pieces.filter(F.col("length") == length).select("_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_row") + FULL).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed).withColumnRenamed("_id", id_col)
