"""Clustering of series: agglomeration, linkage trees, k-medoids and k-means with barycenters."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.kernels import dtw
from tempora.operators import average, pairwise
from tempora.operators.pairwise import _values
from tempora.settings import DistanceSettings
from tempora.sources.interim import written

#: Series whose merges are kept on the driver.
MAX_MERGED = 200_000


def agglomerate(pairs: DataFrame, max_dist: float = math.inf, merge_hook: Callable[[int, int, float], int | None] | None = None, order_hook: Callable[[list[tuple[int, int]]], tuple[int, int]] | None = None) -> tuple[dict[int, set[int]], list[tuple[int, int, float, int]]]:
    """({prototype: members}, merges: (kept, gone, distance, size)).

    The closest pair merges, the second into the first, whose distances stand for both. As
    no distance changes, one pass over the pairs in order does it, skipping those of which
    one is gone; the pass reads them from the cluster piece by piece. A merge hook may say
    which of the two stays, an order hook which of several equally close pairs is next; without
    one it is the pair of the least ids. Pairs of one distance are held together for it.
    """
    members: dict[int, set[int]] = {}
    gone: set[int] = set()
    merges = []

    def merge(i: int, j: int, d: float) -> None:
        if len(gone) >= MAX_MERGED:
            raise ValueError(f"more than {MAX_MERGED} merges")
        kept, lost = i, j
        if merge_hook is not None and (chosen := merge_hook(i, j, d)) in (i, j):
            kept, lost = (i, j) if chosen == i else (j, i)
        group = members.pop(kept, {kept}) | members.pop(lost, {lost})
        members[kept] = group
        gone.add(lost)
        merges.append((kept, lost, d, len(group)))

    near = pairs.where((F.col("distance") <= max_dist) & (F.col("distance") != math.inf)).orderBy("distance", "i", "j").select("i", "j", "distance")
    if order_hook is None:
        for i, j, d in near.toLocalIterator():
            if i not in gone and j not in gone:
                merge(i, j, d)
        return members, merges
    for d, rows in itertools.groupby(near.toLocalIterator(), key=lambda r: r["distance"]):
        tied = [(r["i"], r["j"]) for r in rows]
        while tied := [(i, j) for i, j in tied if i not in gone and j not in gone]:
            merge(*order_hook(tied), d)
    return members, merges


def weight_hook(weights: dict[int, float], lengths: dict[int, int]) -> Callable[[int, int, float], int]:
    """A merge hook that keeps the heavier series, of equal ones the shorter, and adds the other's weight to it."""

    def chosen(i: int, j: int, distance: float) -> int:
        heavier = (weights[i], -lengths[i]) >= (weights[j], -lengths[j])
        kept = i if heavier else j
        weights[kept] = weights[i] + weights[j]
        return kept

    return chosen


def order_hook(weights: dict[int, float]) -> Callable[[list[tuple[int, int]]], tuple[int, int]]:
    """An order hook that takes the pair of the largest weight, the first of equal ones."""
    return lambda tied: max(tied, key=lambda p: weights[p[0]] + weights[p[1]])


def last_node(rows: list[tuple], n: int) -> int:
    """The number of a tree's root."""
    return n + len(rows) - 1


def linkage(distances: np.ndarray, method: str = "complete") -> np.ndarray:
    """(n - 1) x 4 rows (left, right, distance, size) by Lance-Williams updates on a dense matrix."""
    n = len(distances)
    d = distances.astype(float).copy()
    squared = method in ("centroid", "median", "ward")
    if squared:
        d = d * d
    np.fill_diagonal(d, np.inf)
    label, size, alive = list(range(n)), [1] * n, np.ones(n, bool)
    out = np.zeros((max(0, n - 1), 4))
    for step in range(n - 1):
        at = int(d.argmin())
        a, b = divmod(at, n)
        a, b = min(a, b), max(a, b)
        dab, na, nb = d[a, b], size[a], size[b]
        left, right = sorted((label[a], label[b]))
        out[step] = left, right, math.sqrt(dab) if squared else dab, na + nb
        da, db, nk = d[a].copy(), d[b].copy(), np.array(size)
        if method == "single":
            new = np.minimum(da, db)
        elif method == "complete":
            new = np.maximum(da, db)
        elif method == "average":
            new = (na * da + nb * db) / (na + nb)
        elif method == "weighted":
            new = (da + db) / 2
        elif method == "centroid":
            new = (na * da + nb * db) / (na + nb) - na * nb * dab / (na + nb) ** 2
        elif method == "median":
            new = (da + db) / 2 - dab / 4
        elif method == "ward":
            new = ((na + nk) * da + (nb + nk) * db - nk * dab) / (na + nb + nk)
        else:
            raise ValueError(method)
        alive[b] = False
        new[~alive] = np.inf
        new[a] = np.inf
        d[a], d[:, a] = new, new
        d[b], d[:, b] = np.inf, np.inf
        label[a], size[a] = n + step, na + nb
    return out


def tree_of(merges: list[tuple[int, int, float, int]], n: int) -> list[tuple[int, int, int, float, int]]:
    """(step, left, right, distance, size) of an agglomeration: inner nodes are numbered from n; what never merged joins at an infinite distance."""
    node = {k: k for k in range(n)}
    size = dict.fromkeys(range(n), 1)
    rows = []
    for kept, gone, d, _ in merges:
        size[kept] += size.pop(gone)
        rows.append((len(rows), node[kept], node.pop(gone), d, size[kept]))
        node[kept] = n + len(rows) - 1
    roots = sorted(node)
    for other in roots[1:]:
        size[roots[0]] += size.pop(other)
        rows.append((len(rows), node[roots[0]], node[other], math.inf, size[roots[0]]))
        node[roots[0]] = n + len(rows) - 1
    return rows


def to_dot(rows: list[tuple[int, int, int, float, int]], n: int) -> str:
    """A tree's rows as a Graphviz graph."""
    lines = [f"  {n + step} -> {child};" for step, left, right, _, _ in rows for child in (left, right)]
    return "digraph tree {\n" + "\n".join(lines) + "\n}\n"


def k_medoids(pairs: DataFrame, medoids: list[int], max_it: int = 20) -> tuple[DataFrame, list[int]]:
    """(series_id, cluster) with the medoid as cluster, and the medoids. Alternates assignment and choice of medoids; infinite distances count as 0.

    The pairs are written once: every round and the result read them.
    """
    pairs = written(pairs)
    d = F.when(F.col("distance") == math.inf, 0.0).otherwise(F.col("distance")).alias("distance")
    both = pairs.select("i", "j", d).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), d))
    ids = both.select("i").distinct()
    both = both.unionByName(ids.select("i", F.col("i").alias("j"), F.lit(0.0).alias("distance")))
    for _ in range(max_it):
        assigned = both.where(F.col("j").isin(medoids)).groupBy("i").agg(F.min(F.struct("distance", "j")).alias("m")).select("i", F.col("m.j").alias("cluster"))
        inner = both.join(assigned, "i").join(assigned.select(F.col("i").alias("j"), F.col("cluster").alias("other")), "j").where("cluster = other")
        best = inner.groupBy("cluster", "i").agg(F.sum("distance").alias("t")).groupBy("cluster").agg(F.min(F.struct("t", "i")).alias("m"))
        new = sorted(r[0] for r in best.select("m.i").collect())  # one row a cluster
        if new == sorted(medoids):
            break
        medoids = new
    return assigned.select(F.col("i").alias("series_id"), "cluster"), medoids


def medoid_centers(series: DataFrame, k: int, settings: DistanceSettings = DistanceSettings(), sample: int = 200) -> list:
    """k-means starts: the medoids of a sample that is drawn by a hash of the ids."""
    some = series.orderBy(F.xxhash64("series_id"), "series_id").limit(sample).select("series_id", "values").persist()
    try:
        first = [r[0] for r in some.orderBy("series_id").select("series_id").limit(k).collect()]
        _, medoids = k_medoids(pairwise.distances(some, settings), first)
        return [r[0] for r in some.where(F.col("series_id").isin(medoids)).orderBy("series_id").select("values").collect()]
    finally:
        some.unpersist()


def assign(series: DataFrame, centers: dict[int, np.ndarray], settings: DistanceSettings) -> DataFrame:
    """series_id, values, cluster, distance: the nearest center, the smaller number on ties."""
    shared = series.sparkSession.sparkContext.broadcast(centers)
    deep = dict(series.dtypes)["values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = sorted(shared.value)
        for batch in batches:
            values = _values(pa.chunked_array([batch.column(1)]))
            far = np.stack([dtw.distances(values, [shared.value[c]] * len(values), settings) for c in keys])
            best = far.argmin(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([keys[b] for b in best], pa.int64()), pa.array(far.min(0))], ["series_id", "values", "cluster", "distance"])

    return series.select("series_id", "values").mapInArrow(run, f"series_id long, values {deep}, cluster long, distance double")


def spread_centers(series: DataFrame, k: int, settings: DistanceSettings, seed: int = 0) -> list:
    """k-means++ starts. Each round draws 2 + ln k candidates, likelier the farther from all centers, and keeps the one that leaves the least total.

    Draws are by a hash of id, round and seed, so they don't depend on partitions.
    """
    tries = 2 + int(math.log(k))
    u = lambda n: (F.pmod(F.xxhash64("series_id", F.lit(seed), F.lit(n)), F.lit(1_000_003)) + 1) / 1_000_004.0
    first = series.orderBy(u(0), "series_id").select("values").first()
    if first is None:
        raise ValueError("no series to cluster")
    centers = [np.array(first[0], float)]
    for n in range(1, k):
        held = assign(series, dict(enumerate(centers)), settings).withColumn("w", F.col("distance") ** 2)
        drawn = held.where("w > 0").orderBy(-F.log(u(n)) / F.col("w"), "series_id").limit(tries).select("values").collect()
        if not drawn:
            drawn = series.orderBy(u(n), "series_id").limit(1).select("values").collect()
        options = [np.array(r[0], float) for r in drawn]
        totals = [assign(series, dict(enumerate([*centers, o])), settings).agg(F.sum(F.col("distance") ** 2)).first()[0] for o in options]
        centers.append(options[int(np.argmin(totals))])
    return centers


def k_means(series: DataFrame, k: int, settings: DistanceSettings = DistanceSettings(), max_it: int = 10, max_dba_it: int = 10, threshold: float = 1e-4, drop_stddev: float | None = None, start: list | None = None, seed: int = 0, average_uses_settings: bool = False, monitor: Callable[[list[tuple], bool], bool] | None = None) -> tuple[DataFrame, dict[int, np.ndarray], int]:
    """(series_id, cluster, distance), the centers, and the number of rounds.

    Every round assigns, leaves out of the averages what is farther than the mean by a factor
    times the deviation (the factor nears drop_stddev by half each round), gives an empty
    cluster the series that is farthest from its center, and averages. It ends when the
    centers hardly move. monitor sees (cluster, size, mean distance) rows and may end it.
    """
    points = start or spread_centers(series, k, settings, seed)
    centers = {c: np.asarray(v, float) for c, v in enumerate(points)}
    factor, rounds = None if drop_stddev is None else max(drop_stddev, 4.0), 0
    inner = settings if average_uses_settings else DistanceSettings()
    for rounds in range(1, max_it + 1):
        held = assign(series, centers, settings).persist()
        try:
            rows = held.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("distance").alias("m"), F.stddev_pop("distance").alias("s"), F.min(F.struct("distance", "series_id", "values")).alias("near"))
            stats = {r["cluster"]: r for r in rows.collect()}  # one row a cluster
            if monitor is not None and not monitor([(c, r["n"], r["m"]) for c, r in sorted(stats.items())], False):
                break
            used = held
            if factor is not None:
                limit = F.create_map(*[x for c, r in stats.items() for x in (F.lit(c), F.lit(r["m"] + factor * r["s"]))])
                used = held.where(F.col("distance") <= limit[F.col("cluster")])
                factor = drop_stddev + (factor - drop_stddev) / 2
            new = {c: np.array(r["near"]["values"], float) for c, r in stats.items()}
            for _ in range(max_dba_it):
                moved = average.step(used, new, inner)
                far = max(average.shift(moved[c], new[c]) for c in new)
                new = moved
                if far <= threshold:
                    break
            empty = [c for c in centers if c not in stats]
            if empty:
                for c, r in zip(empty, held.orderBy(F.desc("distance"), "series_id").limit(len(empty)).select("values").collect(), strict=False):
                    new[c] = np.array(r[0], float)
        finally:
            held.unpersist()
        moved_by = [average.shift(new[c], centers[c]) if new[c].shape == centers[c].shape else math.inf for c in new]
        centers = {**centers, **new}
        if not empty and max(moved_by) <= threshold:
            break
    final = assign(series, centers, settings).select("series_id", "cluster", "distance")
    return final, centers, rounds
