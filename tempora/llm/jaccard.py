"""Size-aware heavy-light Jaccard self-join on word 5-gram sets.

Two sets of sizes a <= b are similar only if they share at least o = ceil(3 (a + b) / 7)
shingles. Light sets enumerate, for every partner size, all of their subsets of that fixed
size o as keys: two light sets share a key exactly if they are similar. Heavy sets are found
through inverted lists: a set's keys are its 1 + n - ceil(3 n / 4) shingles that are rarest
in the corpus, and two similar sets share one of these, whatever order is used, as long as
it is the same for all. The order comes from a sketch of shingle counts over the whole
corpus, of fixed size. The n-th key of a set can only be the first one in common with sets
up to a size, its reach, as what follows must make up the whole overlap.

The boundary is chosen by cost: a size is light while its subsets are no more than its keys
times the mean length of the lists they would be looked up in, as the sketch has it. Sets
that may be similar to a heavy one, sizes from 3/4 of the first heavy size, make list keys too.

Defined results: null texts and texts without words have an empty set, link with nothing and
are their own component; fewer than five words are one shingle; repeated rows each get a row;
rows with equal doc_id are told apart by their texts; an empty table gives no row.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import table, written
from tempora.llm.setjoin import Keys, Sets, Units, clustered, mixed, whole


def overlap(a: int, b: int) -> int:
    return -(-3 * (a + b) // 7)


def partners(n: int) -> list[tuple[int, int]]:
    """Size pairs (a, b), a <= b, with n in them, whose sets can be similar."""
    return [(min(n, m), max(n, m)) for m in range(1, 2 * n + 2) if 4 * min(n, m) >= 3 * max(n, m)]


def subset_cost(n: int) -> int:
    return sum(math.comb(n, overlap(a, b)) for a, b in partners(n) if overlap(a, b) <= a)


def prefix(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def boundary(counts: np.ndarray) -> int:
    """The largest light size."""
    c = counts.astype(np.float64)
    length = max(2.0, float((c * c).sum() / max(c.sum(), 1)) - float(c.mean()))
    n = 1
    while subset_cost(n + 1) <= prefix(n + 1) * length and n < 64:
        n += 1
    return n


def heavy_light(counts: np.ndarray) -> Keys:
    light = boundary(counts)
    heavy_from = -(-3 * (light + 1) // 4)
    mask = np.uint64(len(counts) - 1)

    def of_one(s: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        n, keys, reach = len(s), [], []
        if n >= heavy_from:
            often, p = counts[(s & mask).astype(np.int64)], prefix(n)
            # rarest first, equal counts by hash (s is sorted)
            order = np.argsort(often, kind="stable")[:p]
            keys.append(s[order])
            # sets that have their first common shingle here share no more than what follows
            reach.append((4 * n - 7 * np.arange(p)) // 3)
        if n <= light:
            for a, b in partners(n):
                o = overlap(a, b)
                if b <= light and o <= a:
                    tag = np.uint64((a << 8 | b) * 0x9E3779B97F4A7C15 % 2**64)
                    picked = np.array(list(combinations(s.tolist(), o)), np.uint64)
                    keys.append(mixed(mixed(picked + tag).sum(1) + tag))
                    reach.append(np.full(len(picked), b if n == a else a))
        return keys, reach

    def keys(sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        made, far, owner, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
        for k in np.flatnonzero(sets.sizes).tolist():
            some, reach = of_one(sets[k])
            made += some
            far += reach
            owner.append(k)
            lengths.append(sum(map(len, some)))
        return np.concatenate(made), np.concatenate(far), np.repeat(np.array(owner, np.int64), np.array(lengths, np.int64))

    return keys


def linked_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    units, classes = clustered(spark, docs, Units(whole), heavy_light, sketch=True)
    rows = units.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = rows.where(F.col("component").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("component_id"))
    copies = rows.where(F.col("component").isNull() & F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    # written, so that the join has two plain exchanges, of which the planner can split a hot class
    least = written(spark, least.unionByName(copies), "least")
    # rows that are alone in their class, or have none, keep to themselves under a key of their own
    rows = rows.withColumn("class", F.coalesce("class", F.xxhash64("doc_id", "digest")))
    own = F.when((F.col("size") > 0) & F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(least, "class", "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(spark, table(spark, sf_dir, "documents"))
