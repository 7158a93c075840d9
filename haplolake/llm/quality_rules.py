"""Quality rules as a ledger: every rule is judged once, policies are applied to the stored bits.

The ledger has, per document, the measurements and a bitmask with one bit for each rule that the text
fails. A policy is a version name and the mask of the rules it enforces; a document passes if it fails
none of them. Policies and ablations read the ledger only, never the texts: ablations come from the
counts of distinct masks, at most two to the number of rules, by bitwise AND.

Only DataFrame functions are used. Words are runs of characters other than ASCII white space. Windows
of eight words are compared by 64-bit hashes within their own text only: every word is hashed once, and
hashes of 2, 4 and 8 words come from pairs of the ones before.

Defined cases: a null text has no words, lines or symbols, and fails the word rules; so does the empty
text. Ids may be null or repeat; every row is judged by itself. Whole texts are measured. The ledger
carries other columns only where asked to, in one struct, so no name can clash; keep_passing keeps them
all. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.llm.storage import written

WINDOW = 8
#: Rules in bit order: name and SQL condition, over the measurements, under which a text fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_dup_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
    ("shouting", "4 * n_marks > n_words"),
]
BASE_RULES = ("few_words", "repeated_windows")


def mask_of(*names: str) -> int:
    bit = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bit[n] for n in set(names))


#: Versioned policies; the last is the one in force.
POLICIES: dict[str, int] = {
    "v1": mask_of(*BASE_RULES),
    "v2": mask_of(*BASE_RULES, "many_symbols", "repeated_lines"),
    "v3": mask_of(*(name for name, _ in RULES)),
}
CURRENT = "v3"
_SPACE = "[\\x20\\x09-\\x0D]"


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once though the body's lambdas use it at every element."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words that lie in windows whose hash occurs twice or more. hashes: one per window, in order."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        pairs = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
    return F.aggregate(_let(placed, positions), start, step, lambda acc: acc["n"])


def _windows(hashes: Column) -> Column:
    """Hashes of all runs of WINDOW neighbours, by doubling: a run of 2 n is a run of n and the one n further on."""

    def pairs(gap: int):
        return lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - gap), F.slice(h, F.lit(1 + gap), F.size(h) - gap), lambda a, b: F.xxhash64(a, b))

    gap = 1
    while gap < WINDOW:
        hashes, gap = _let(hashes, pairs(gap)), 2 * gap
    return hashes


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and measurements of every row; carries the columns of docs in the struct ``row``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(id_col).alias("_id"), text.alias("_text"))
    cut = base.withColumn("_words", F.filter(F.split("_text", f"{_SPACE}+"), lambda w: w != ""))
    # An expression tree that may fold into one projection must not repeat the split: sizes come from it once.
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    measured = cut.select(
        "row",
        "_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit("!!")).cast("long").alias("n_marks"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_lines"),
        F.when(F.size("_words") > WINDOW, _windows(F.transform("_words", lambda w: F.xxhash64(w)))).alias("_hashes"),
    )
    repeated = F.when(F.size("_hashes") > F.size(F.array_distinct("_hashes")), _covered(F.col("_hashes"))).otherwise(F.lit(0))
    return measured.select("row", "_id", "n_words", "word_chars", "n_symbols", "n_marks", F.col("_lines.n").alias("n_lines"), F.col("_lines.dup").alias("n_dup_lines"), repeated.cast("long").alias("n_repeat_words"))


def _failures() -> Column:
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, condition) in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("long")


def passes(mask: int) -> Column:
    """Whether a row of the ledger fails no rule of the mask."""
    return F.col("failures").bitwiseAND(F.lit(mask)) == 0


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The stored ledger: id, measurements and failures (a bit for each rule that the text fails) of every row.

    It is written to the shared folder and read again, so no policy and no ablation measures a text anew.
    carry: also keep all columns of docs, in the struct ``row``.
    """
    judged = measure(docs, id_col, text_col).withColumn("failures", _failures())
    named = judged.withColumnRenamed("_id", id_col) if not carry else judged.drop("_id")
    return written(named if carry else named.drop("row"), "rule-ledger")


def keep_passing(docs: DataFrame, policy: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that pass the policy, with all their columns: the policy's mask on the stored bits."""
    return ledger(docs, id_col, text_col, carry=True).filter(passes(POLICIES[policy])).select("row.*")


def ablations(rows: DataFrame, policies: Mapping[str, int] | None = None) -> DataFrame:
    """policy, rule, n_docs, n_kept, n_failed (fail the rule), n_only (fail no other rule of the policy:
    kept again if the rule is taken out), for every rule of every policy, from a ledger."""
    masks = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p, mask, name, 1 << i) for p, mask in (policies or POLICIES).items() for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    listed = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(m).alias("mask"), F.lit(r).alias("rule"), F.lit(b).alias("bit")) for p, m, r, b in cases)))
    hit = lambda bits: F.col("failures").bitwiseAND(F.col(bits))
    n = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    wide = masks.select("*", listed.alias("c")).select("failures", "n", "c.*")
    return wide.groupBy("policy", "rule").agg(F.sum("n").alias("n_docs"), n(hit("mask") == 0).alias("n_kept"), n(hit("bit") != 0).alias("n_failed"), n(hit("mask") == F.col("bit")).alias("n_only"))
