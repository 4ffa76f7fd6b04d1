"""Streams of points: sliding windows against known queries, and knees as they happen. An extension beyond batch operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.kernels import dtw
from tempora.kernels.subsequence import Knee
from tempora.settings import DistanceSettings


def window_distances(points: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], length: str, slide: str, late: str = "10 minutes", settings: DistanceSettings = DistanceSettings()) -> DataFrame:
    """For a stream (series_id, ts, value): each sliding window's distance to every query (few: they go to every task)."""
    known = [(q, np.asarray(v, float)) for q, v in queries]

    @F.pandas_udf("array<struct<query_id: long, distance: double>>")
    def compared(values: pd.Series) -> pd.Series:
        far = [dtw.distances(list(values), [v] * len(values), settings) for _, v in known]
        return pd.Series([[{"query_id": q, "distance": float(d[k])} for (q, _), d in zip(known, far, strict=True)] for k in range(len(values))])

    held = points.withWatermark("ts", late).groupBy("series_id", F.window("ts", length, slide).alias("w"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda s: s["value"])
    found = held.agg(values.alias("values")).select("series_id", "w", F.explode(compared("values")).alias("m"))
    return found.select("series_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "m.query_id", "m.distance")


def knees(points: DataFrame, alpha: float = 0.3) -> DataFrame:
    """For a stream (series_id, ts, value): the points at which a series leaves its run. Its state is four numbers a series."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        knee = Knee(alpha)
        if state.exists:
            knee.first, knee.mean, knee.spread, knee.count = state.get
        rows = pd.concat(list(batches)).sort_values("ts")
        stops = [r for r in rows.itertuples() if knee.stop(float(r.value))]
        state.update((knee.first, knee.mean, knee.spread, knee.count))
        yield pd.DataFrame({"series_id": [key[0]] * len(stops), "ts": [r.ts for r in stops], "value": [float(r.value) for r in stops]})

    return points.groupBy("series_id").applyInPandasWithState(follow, "series_id long, ts timestamp, value double", "first double, mean double, spread double, count long", "append", "NoTimeout")
