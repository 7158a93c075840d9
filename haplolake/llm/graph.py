"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplolake.llm.storage import drop, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node of it) for every node of the undirected links; loops are ignored.

    In each round every node joins its least neighbour, links are renamed and folded, and the table of
    names follows. Each round's links and names are written, so lineage stays short, and the tables of the
    round before are dropped; only whether links are left goes to the driver. Null ends are ignored; an
    empty table has no nodes.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = written(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    names = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        parent = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "parents")
        renamed_names = written(names.join(parent, F.col("component") == F.col("a"), "left").select("node", F.coalesce("to", "component").alias("component")), "names")
        left, right = (parent.select(F.col("a").alias(x), F.col("to").alias(f"{x}_to")) for x in ("a", "b"))
        renamed = edges.join(left, "a").join(right, "b").select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b"))
        contracted = written(renamed.filter("a <> b").distinct(), "links")
        drop(parent, names, edges)
        names, edges = renamed_names, contracted
    return names
