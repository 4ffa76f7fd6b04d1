"""Connected components of a graph that is too large for one machine.

Alternates large-star and small-star: every node's larger neighbours, then every node's
smaller ones, are attached to the least node that it sees. Each round writes its edges to
the shared folder, so a lost executor costs one round at most; nothing but counters comes to
the driver. A node with very many neighbours is handled by an aggregate with partial sums
and a join that the planner can split.

Defined results: self links and repeated links change nothing; nodes are known by their
numbers alone; no links give no rows; links are rows (a, b), other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import discard, written


def _toward_least(edges: DataFrame, with_self: bool) -> DataFrame:
    """For rows (u, v): every v, and u itself if asked, attached to the least of u and its v."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = edges.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if with_self:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(spark: SparkSession, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of links (a, b): component is its least node."""
    edges = written(spark, links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # only larger neighbours are moved, but the least is taken over all of them
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        old, edges = edges, written(spark, _toward_least(large, True), "edges")
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
