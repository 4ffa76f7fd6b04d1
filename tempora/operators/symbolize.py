"""Series to symbols, runs of symbols, and explanations of warping paths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.kernels import explain, symbols
from tempora.operators import pairwise
from tempora.operators.search import _each
from tempora.settings import DistanceSettings

#: Motifs that go to every task: their number is checked.
MAX_CODES = 10_000


def codes(series: DataFrame, codebook: Sequence[Sequence[float]], **options) -> DataFrame:
    """(series_id, codes): a code for each point, by a greedy cover with matches; options as in kernels.symbols.cover."""
    if len(codebook) > MAX_CODES:
        raise ValueError(f"more than {MAX_CODES} codes")
    book = [np.asarray(m, float) for m in codebook]

    def work(i: int, v: np.ndarray):
        return [(i, symbols.cover(v, book, **options).tolist())]

    return _each(series, work, "series_id long, codes array<int>")


def pointwise_codes(series: DataFrame, codebook: Sequence[Sequence[float]], window: int | None = None) -> DataFrame:
    """(series_id, codes): the code of least cost at each point, or by a vote over the points of a window."""
    book = [np.asarray(m, float) for m in codebook]

    def work(i: int, v: np.ndarray):
        table = symbols.pointwise(v, book)
        return [(i, (symbols.by_least(table) if window is None else symbols.by_vote(table, window)).tolist())]

    return _each(series, work, "series_id long, codes array<int>")


def hangover(coded: DataFrame, threshold: int = 4) -> DataFrame:
    """(series_id, symbol, begin, end) of long runs of a code that differ from the one kept before, in windows of built-in functions."""
    order = Window.partitionBy("series_id").orderBy("p")
    points = coded.select("series_id", F.posexplode("codes").alias("p", "c"), F.size("codes").alias("n"))
    begins = F.coalesce((F.col("c") != F.lag("c").over(order)).cast("int"), F.lit(1))
    runs = points.withColumn("run", F.sum(begins).over(order)).groupBy("series_id", "run").agg(F.first("c").alias("c"), F.min("p").alias("begin"), (F.max("p") + 1).alias("end"), F.first("n").alias("n"))
    # a run of `threshold` repeats after its first has threshold + 2 points and more; one that is open at the end isn't kept
    long_ = runs.where((F.col("end") - F.col("begin") >= threshold + 2) & (F.col("end") < F.col("n")))
    before = F.lag("c").over(Window.partitionBy("series_id").orderBy("begin"))
    return long_.withColumn("last", before).where("last is null or last <> c").select("series_id", (F.col("c") + 1).cast("long").alias("symbol"), F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


SEGMENT = "struct<s_from: int, e_from: int, s_to: int, e_to: int, angle: double, shift: int, elasticity: int>"


def explanations(series: DataFrame, other: DataFrame | None = None, settings: DistanceSettings = DistanceSettings(), **options) -> DataFrame:
    """(i, j, distance, distance_straight, segments): each pair's path as straight pieces; options as in kernels.explain.Explanation."""

    def kernel(a: list, b: list) -> list:
        from tempora.kernels import dtw

        _, paths = dtw.warped(a, b, settings)
        out = []
        for x, y, path in zip(a, b, paths, strict=True):
            e = explain.Explanation(x, y, path=path, settings=settings, **options)
            parts = [{"s_from": s.s_from, "e_from": s.e_from, "s_to": s.s_to, "e_to": s.e_to, "angle": s.angle, "shift": s.shift, "elasticity": s.elasticity} for s in e.segments]
            out.append({"distance": e.distance(), "distance_straight": e.distance_straight(), "segments": parts})
        return out

    found = pairwise.block_pairs(series, other, kernel, f"e struct<distance: double, distance_straight: double, segments: array<{SEGMENT}>>")
    return found.select("i", "j", "e.distance", "e.distance_straight", "e.segments")
