"""Barycenter averaging under warping, distributed as a two-phase aggregate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.kernels import dtw
from tempora.operators import pairwise
from tempora.operators.pairwise import _values
from tempora.settings import DistanceSettings


def step(series: DataFrame, centers: dict[int, np.ndarray], settings: DistanceSettings = DistanceSettings(), samples: int = 0, seed: int = 0) -> dict[int, np.ndarray]:
    """New centers: at each point, the mean of all values that the cluster's series have aligned with it.

    series: (series_id, values) and cluster, if there are several centers. With samples, so
    many random paths of each series count instead of its cheapest one, drawn by its id.
    Tasks emit sums for each center's points, so what is shuffled doesn't grow with the series.
    """
    many = "cluster" in series.columns
    rows = series.select("series_id", "values", (F.col("cluster") if many else F.lit(next(iter(centers)))).cast("long").alias("cluster"))
    shared = series.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = {c: np.zeros((len(v), v.shape[1] if v.ndim == 2 else 1)) for c, v in known.items()}
        count = {c: np.zeros(len(v), np.int64) for c, v in known.items()}
        for batch in batches:
            values, clusters = _values(pa.chunked_array([batch.column(1)])), batch.column(2).to_pylist()
            use = [k for k, c in enumerate(clusters) if c in known]
            if samples:
                paths = [(k, dtw.sampled_path(values[k], known[clusters[k]], settings, 1.0, seed + batch.column(0)[k].as_py() * samples + n)) for k in use for n in range(samples)]
            else:
                _, found = dtw.warped([values[k] for k in use], [known[clusters[k]] for k in use], settings)
                paths = list(zip(use, found, strict=True))
            for k, path in paths:
                c = clusters[k]
                np.add.at(total[c], path[:, 1], np.asarray(values[k], float).reshape(len(values[k]), -1)[path[:, 0]])
                np.add.at(count[c], path[:, 1], 1)
        out = [(c, p, d, float(total[c][p, d]), int(count[c][p])) for c in known for p in range(len(known[c])) for d in range(total[c].shape[1]) if count[c][p]]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in enumerate(kinds)], ["cluster", "p", "d", "s", "n"])

    sums = rows.mapInArrow(run, "cluster long, p int, d int, s double, n long").groupBy("cluster", "p", "d").agg((F.sum("s") / F.sum("n")).alias("v"))
    out = {c: np.array(v, float) for c, v in centers.items()}
    for c, p, d, v in sums.collect():  # as many rows as the centers have values
        if out[c].ndim == 2:
            out[c][p, d] = v
        else:
            out[c][p] = v
    return out


def shift(a: np.ndarray, b: np.ndarray) -> float:
    """Mean distance between two centers' points; of vectors, the largest over dimensions."""
    off = np.abs(a - b)
    return float(off.mean()) if off.ndim == 1 else float(off.mean(0).max())


def barycenter(series: DataFrame, start: Sequence | None = None, max_it: int = 10, threshold: float = 0.001, settings: DistanceSettings = DistanceSettings(), samples: int = 0, initial_sample: int = 0, keep: bool = False) -> np.ndarray | list[np.ndarray]:
    """The average series. Starts from `start`, the medoid of a sample, or the series of least id."""
    if "mask" in series.columns:
        series = series.where("mask")
    if start is None:
        start = sample_medoid(series, initial_sample, settings) if initial_sample else None
        if start is None:
            first = series.orderBy("series_id").select("values").first()
            if first is None:
                raise ValueError("no series to average")
            start = first[0]
    center, all_ = np.asarray(start, float), []
    for n in range(max_it):
        new = step(series, {0: center}, settings, samples, seed=n)[0]
        moved = shift(center, new)
        center = new
        all_.append(center)
        if moved <= threshold:
            break
    return all_ if keep else center


def medoid(pairs: DataFrame) -> DataFrame:
    """(series_id, total): the series with the least sum of distances; the smaller id on ties."""
    both = pairs.select(F.explode(F.array("i", "j")).alias("series_id"), "distance")
    return both.groupBy("series_id").agg(F.sum("distance").alias("total")).orderBy("total", "series_id").limit(1)


def sample_medoid(series: DataFrame, n: int, settings: DistanceSettings) -> list | None:
    sample = series.orderBy(F.xxhash64("series_id"), "series_id").limit(n).select("series_id", "values")
    best = medoid(pairwise.distances(sample, settings)).first()
    return None if best is None else sample.where(F.col("series_id") == best[0]).first()["values"]


def warp(pairs: DataFrame) -> DataFrame:
    """(i, j, values): the first series warped onto the second, from rows (i, j, path, a): the mean of what each point is aligned with."""
    points = pairs.select("i", "j", "a", F.explode("path").alias("p")).select("i", "j", F.col("p.j").alias("at"), F.get("a", F.col("p.i")).alias("x"))
    means = points.groupBy("i", "j", "at").agg(F.avg("x").alias("x"))
    return means.groupBy("i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("values"))
