"""Nearest neighbours, matches of queries within long series, and recurring patterns."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import columns
from tempora.kernels import dtw, subsequence
from tempora.operators.pairwise import _values
from tempora.settings import ConcurrenceSettings, DistanceSettings

#: Queries that go to every task with the plan: their number is checked.
MAX_QUERIES = 10_000
#: Candidates that a task compares before its bound is tightened again.
STRIDE = 256
#: Points of paths that a task holds before it hands them on.
POINTS = 500_000


def nearest(queries: Sequence[tuple[int, Sequence]], candidates: DataFrame, k: int, settings: DistanceSettings = DistanceSettings(), use_bound: bool = True, max_value: float | None = None) -> DataFrame:
    """(query_id, rank, series_id, distance, value) of the k nearest candidates of each query.

    Every task keeps its k best for each query; their k-th distance bounds what it still has
    to compare, by the envelope bound first where that is valid. Ties go to the smaller id.
    A task emits k rows a query at most, and a window over these picks the final k.
    """
    if len(queries) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries: use a join of two sets instead")
    queries = [(q, np.asarray(v, float)) for q, v in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {q: [] for q, _ in queries}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            values = _values(pa.chunked_array([batch.column(1)]))
            for at in range(0, len(ids), STRIDE):
                for q, v in queries:
                    limit = max_value * len(v) if max_value is not None else settings.max_dist
                    heap = best[q]
                    if len(heap) == k and (limit is None or -heap[0][0] < limit):
                        limit = -heap[0][0]
                    part = range(at, min(at + STRIDE, len(ids)))
                    if use_bound and limit is not None and settings.lower_bound_holds and v.ndim == 1 and settings.window:
                        near = dtw.envelope_bounds(v, [values[c] for c in part], settings) <= limit
                        part = [c for c, use in zip(part, near.tolist(), strict=True) if use]
                    s = settings if limit is None else settings.with_(max_dist=limit)
                    found = dtw.distances([v] * len(part), [values[c] for c in part], s)
                    for c, d in zip(part, found.tolist(), strict=True):
                        if np.isfinite(d):
                            (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (-d, -ids[c]))
        rows = [(q, -i, -d) for q, heap in best.items() for d, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "series_id", "distance"])

    lengths = F.create_map(*[x for q, v in queries for x in (F.lit(q), F.lit(len(v)))])
    part = candidates.select("series_id", "values").mapInArrow(run, "query_id long, series_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "series_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "series_id", "distance", (F.col("distance") / lengths[F.col("query_id")]).alias("value"))


def windows(series: DataFrame, width: int, stride: int) -> DataFrame:
    """Candidates from long series, with source and begin; series_id holds both, for sources below 2^32."""
    w = series.select(F.col("series_id").alias("source"), F.explode(columns.windows(F.col("values"), width, stride)).alias("w"))
    return w.select((F.shiftleft(F.col("source").cast("long"), 31) + F.col("w.begin")).alias("series_id"), "source", F.col("w.begin").alias("begin"), F.col("w.values").alias("values"))


def _each(series: DataFrame, work, schema: str) -> DataFrame:
    """Rows that a kernel makes of every series alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            rows = [r for i, v in zip(batch.column(0).to_pylist(), _values(pa.chunked_array([batch.column(1)])), strict=True) for r in work(i, v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t.type) for n, t in enumerate(arrow)], [t.name for t in arrow])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = list(to_arrow_schema(series.sparkSession.createDataFrame([], schema).schema))
    return series.select("series_id", "values").mapInArrow(run, schema)


def matching_function(query_id: int, query: Sequence, series: DataFrame, penalty: float = 0.1) -> DataFrame:
    """(query_id, series_id, idx, value): the least cost per query point of a match that ends at idx."""

    def work(i: int, v: np.ndarray):
        found = subsequence.Alignment(query, v, penalty).matching
        return [(query_id, i, k, float(x)) for k, x in enumerate(found)]

    return _each(series, work, "query_id long, series_id long, idx long, value double")


def matches(query_id: int, query: Sequence, series: DataFrame, penalty: float = 0.1, **options) -> DataFrame:
    """(query_id, series_id, rank, idx, value, begin, end, path) of a query's matches in each series.

    options as in kernels.subsequence.Alignment.matches.
    """

    def work(i: int, v: np.ndarray):
        found = subsequence.Alignment(query, v, penalty).matches(**options)
        return [(query_id, i, m.rank, m.idx, m.value, m.begin, m.end, [{"i": a, "j": b} for a, b in m.path]) for m in found]

    return _each(series, work, "query_id long, series_id long, rank int, idx int, value double, begin int, end int, path array<struct<i: int, j: int>>")


def concurrences(series: DataFrame, settings: ConcurrenceSettings | None = None, k: int | None = 10, min_length: int = 5, buffer: int = 0, factor: float = 1.0, knee_alpha: float | None = None) -> DataFrame:
    """(series_id, rank, begin_i, end_i, begin_j, end_j, path): recurring patterns within each series; parameters from the series if none are given."""

    schema = "series_id long, rank int, begin_i int, end_i int, begin_j int, end_j int, path array<struct<i: int, j: int>>"
    chosen = lambda v: settings or subsequence.concurrence_settings(v, factor, only_triu=True)

    def work(i: int, v: np.ndarray):
        found = subsequence.Concurrences(v, None, chosen(v)).matches(k, min_length, buffer, knee_alpha)
        return [(i, n, p[0][0], p[-1][0], p[0][1], p[-1][1], [{"i": a, "j": b} for a, b in p]) for n, p in enumerate(found)]

    if buffer:
        return _each(series, work, schema)

    def rows(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        paths = [p for _, _, p in found]
        points = np.concatenate(paths).astype(np.int32)
        ends = np.cumsum([0, *map(len, paths)])
        begins, lasts = points[ends[:-1]], points[ends[1:] - 1]
        ids, ranks = np.array([n for n, _, _ in found], np.int64), np.array([n for _, n, _ in found], np.int32)
        heads = [ids, ranks, begins[:, 0], lasts[:, 0], begins[:, 1], lasts[:, 1]]
        trail = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], fields=list(arrow[-1].type.value_type))
        held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), trail, type=arrow[-1].type)
        return pa.RecordBatch.from_arrays([*map(pa.array, heads), held], [t.name for t in arrow])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), _values(pa.chunked_array([batch.column(1)]))
            found, points = [], 0
            for at, paths in subsequence.concurrences_among(values, [chosen(v) for v in values], k, min_length, knee_alpha):
                found += [(ids[at], n, p) for n, p in enumerate(paths)]
                points += sum(map(len, paths))
                if points > POINTS:
                    yield rows(found)
                    found, points = [], 0
            if found:
                yield rows(found)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = list(to_arrow_schema(series.sparkSession.createDataFrame([], schema).schema))
    return series.select("series_id", "values").mapInArrow(run, schema)


def similarity_cells(series: DataFrame, settings: ConcurrenceSettings) -> DataFrame:
    """(series_id, row, col, value): point similarities within each series, `delta` where points aren't alike; in the JVM."""
    s, at = settings, F.posexplode("values")
    cells = series.select("series_id", "values", at.alias("row", "x")).select("series_id", "row", "x", at.alias("col", "y"))
    if s.window:
        cells = cells.where((F.col("col") >= F.col("row") - s.window) & (F.col("col") < F.col("row") + s.window))
    alike = F.exp(-s.gamma * (F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))
    return cells.select("series_id", "row", "col", F.when(alike < s.tau, s.delta).otherwise(alike).alias("value"))


def coverage(segments: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, covered, coverage): points in any of the segments (series_id, begin, end inclusive), and their share."""
    points = segments.select("series_id", F.explode(F.sequence("begin", "end")).alias("p")).distinct().groupBy("series_id").agg(F.count("*").alias("covered"))
    return series.select("series_id", F.size("values").alias("n")).join(points, "series_id", "left").select("series_id", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"), (F.coalesce("covered", F.lit(0)) / F.col("n")).alias("coverage"))


def missing_segments(segments: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, begin, end): the longest runs that no segment covers, up to the series' end."""
    order = Window.partitionBy("series_id").orderBy("begin", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    ends = series.select("series_id", F.size("values").alias("begin"), F.size("values").alias("end"))
    rows = segments.select("series_id", "begin", "end").unionByName(ends).withColumn("reach", reach)
    return rows.where(F.col("begin") > F.col("reach") + 1).select("series_id", (F.col("reach") + 1).alias("begin"), (F.col("begin") - 1).alias("end"))
