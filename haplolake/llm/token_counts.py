"""Exact length histogram of a corpus in tokens, and what it answers for every context limit.

Each task encodes its documents and sends one row per distinct length that it met; summed over tasks
that is the exact histogram. Suffix sums over it give, for every length as a context limit, how many
documents are at least that long and how many tokens are left if all are cut there. They are taken in
two levels (within blocks of neighbouring lengths, then over the blocks), so no window sees more than
one block, or more rows than there are blocks.

Defined cases: a null text has 0 tokens and counts as a document, like the empty text; a null group
value is a group of its own; an empty table gives an empty histogram; repeated rows all count; other
columns are not carried, and a group column that bears the name of a result column is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplolake.llm.bpe import SLICE_BYTES, codec
from haplolake.llm.ragged import slices
from haplolake.llm.storage import written

#: Neighbouring lengths that one window of the suffix sums spans.
BLOCK = 1024
#: Columns of the result of context_limits.
LIMITS = ("n_tokens", "n_docs", "tokens", "docs_at_least", "tokens_at_least", "truncated_total", "corpus_tokens", "share_that_fits")


def token_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                _, offs = codec(path).encode(part.column("_text"))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(offs[1:] - offs[:-1], pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` long, n_tokens long")


def length_histogram(docs: DataFrame, path: str, text_col: str = "text", by: str | None = None) -> DataFrame:
    """n_tokens, n_docs (and group, if ``by`` names a column): how many documents have each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                _, offs = codec(path).encode(part.column("_text"))
                table = pa.table({"group": part.column("_group"), "n_tokens": pa.array(offs[1:] - offs[:-1], pa.int64())})
                yield from table.group_by(["group", "n_tokens"]).aggregate([([], "count_all")]).select(["group", "n_tokens", "count_all"]).rename_columns(["group", "n_tokens", "n_docs"]).to_batches()

    group = (F.col(by) if by else F.lit(None)).cast("string").alias("_group")
    parts = docs.select(group, F.col(text_col).alias("_text")).mapInArrow(run, "group string, n_tokens long, n_docs long")
    keys = ["group", "n_tokens"] if by else ["n_tokens"]
    return parts.groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"))


def context_limits(histogram: DataFrame, by: str | None = None, block: int = BLOCK) -> DataFrame:
    """For every length that occurs, as a context limit: documents and tokens at least that long, the
    total if all documents are cut there, and the share of documents that fit whole (quantile)."""
    if by in LIMITS:
        raise ValueError(f"the group column may not be named {by}")
    keys = ["_key"] if by else []
    named = histogram.select(F.col(by).alias("_key"), "n_tokens", "n_docs") if by else histogram.select("n_tokens", "n_docs")
    histogram = written(named, "lengths")  # read twice below, and far smaller than the corpus behind it
    h = histogram.withColumns({"_block": F.floor(F.col("n_tokens") / block), "tokens": F.col("n_tokens") * F.col("n_docs")})
    later = Window.partitionBy(*keys, F.lit(0)).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys, F.lit(0))
    blocks = h.groupBy(*keys, "_block").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t"))
    blocks = blocks.select(*keys, "_block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("_d", "_t")), *(F.sum(c).over(everything).alias(f"{c}_all") for c in ("_d", "_t")))
    own = Window.partitionBy(*keys, "_block").orderBy(F.desc("n_tokens"))
    on = [h["_block"] == blocks["_block"]] + [h[k].eqNullSafe(blocks[k]) for k in keys]
    j = h.join(blocks, on).select(h["*"], *(blocks[f"{c}_{x}"] for c in ("_d", "_t") for x in ("later", "all")))
    docs_ge, tokens_ge = F.sum("n_docs").over(own) + F.col("_d_later"), F.sum("tokens").over(own) + F.col("_t_later")
    return j.select(
        *(F.col(k).alias(by) for k in keys),
        "n_tokens",
        "n_docs",
        "tokens",
        docs_ge.alias("docs_at_least"),
        tokens_ge.alias("tokens_at_least"),
        (F.col("_t_all") - tokens_ge + F.col("n_tokens") * docs_ge).alias("truncated_total"),
        F.col("_t_all").alias("corpus_tokens"),
        ((F.col("_d_all") - docs_ge + F.col("n_docs")) / F.col("_d_all")).alias("share_that_fits"),
    )


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left if every document is cut at ``limit``, which need not be a length that occurs."""
    cut = F.when(F.col("n_tokens") > limit, F.lit(limit)).otherwise(F.col("n_tokens")) * F.col("n_docs")
    return limits.agg(F.coalesce(F.sum(cut), F.lit(0)).alias("truncated_total"))


def length_quantiles(limits: DataFrame, shares: Sequence[float]) -> DataFrame:
    """One row: for every share, the least length that at least this share of the documents does not exceed."""
    return limits.agg(*(F.min(F.when(F.col("share_that_fits") >= s, F.col("n_tokens"))).alias(f"q{s:g}") for s in shares))
