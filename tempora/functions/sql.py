"""The operators as functions of SQL queries, by name."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tempora.kernels import dtw, filters, measures, subsequence, symbols
from tempora.settings import DistanceSettings


def _settings(window, penalty) -> DistanceSettings:
    return DistanceSettings(window=int(window) if window else None, penalty=float(penalty or 0))


PATH = "array<struct<i: int, j: int>>"


def register(spark: SparkSession) -> list[str]:
    """Registers the ts_ functions in a session and returns their names. Python ones take whole Arrow batches."""

    @F.pandas_udf("double")
    def ts_dtw(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(dtw.distances(list(a), list(b), DistanceSettings()))

    @F.pandas_udf("double")
    def ts_dtw_band(a: pd.Series, b: pd.Series, window: pd.Series, penalty: pd.Series) -> pd.Series:
        out = np.empty(len(a))
        for (w, p), rows in pd.DataFrame({"w": window, "p": penalty}).groupby(["w", "p"]).groups.items():
            out[rows] = dtw.distances([a[k] for k in rows], [b[k] for k in rows], _settings(w, p))
        return pd.Series(out)

    @F.pandas_udf("double")
    def ts_msm(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(measures.split_merge_all(list(a), list(b)))

    @F.pandas_udf("double")
    def ts_nw_score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([measures.global_alignment(x, y)["score"] for x, y in zip(a, b, strict=True)], dtype=float)

    @F.pandas_udf(PATH)
    def ts_warping_path(a: pd.Series, b: pd.Series) -> pd.Series:
        _, paths = dtw.warped(list(a), list(b), DistanceSettings())
        return pd.Series([[{"i": int(i), "j": int(j)} for i, j in p] for p in paths])

    @F.pandas_udf("array<double>")
    def ts_warp(a: pd.Series, b: pd.Series) -> pd.Series:
        _, paths = dtw.warped(list(a), list(b), DistanceSettings())
        out = []
        for x, p in zip(a, paths, strict=True):
            total = np.bincount(p[:, 1], np.asarray(x)[p[:, 0]])
            out.append((total / np.bincount(p[:, 1])).tolist())
        return pd.Series(out)

    @F.pandas_udf("array<struct<rank: int, idx: int, value: double, begin: int, end: int>>")
    def ts_subseq_matches(query: pd.Series, values: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([[{"rank": m.rank, "idx": m.idx, "value": m.value, "begin": m.begin, "end": m.end} for m in subsequence.Alignment(q, v).matches(k=int(n))] for q, v, n in zip(query, values, k, strict=True)])

    @F.pandas_udf(f"array<{PATH}>")
    def ts_loco_matches(values: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for v, n in zip(values, k, strict=True):
            s = subsequence.concurrence_settings(v, 0.25, only_triu=True)
            out.append([[{"i": i, "j": j} for i, j in p] for p in subsequence.Concurrences(v, None, s).matches(k=int(n))])
        return pd.Series(out)

    @F.pandas_udf("array<double>")
    def ts_smooth(values: pd.Series, cutoff: pd.Series) -> pd.Series:
        return pd.Series([filters.smoothed(v, float(c)).tolist() for v, c in zip(values, cutoff, strict=True)])

    @F.pandas_udf("array<struct<symbol: int, begin: int, end: int>>")
    def ts_hangover(codes: pd.Series, threshold: pd.Series) -> pd.Series:
        return pd.Series([[{"symbol": s, "begin": b, "end": e} for s, b, e in symbols.hangover(list(c), int(t))] for c, t in zip(codes, threshold, strict=True)])

    python = [ts_dtw, ts_dtw_band, ts_msm, ts_nw_score, ts_warping_path, ts_warp, ts_subseq_matches, ts_loco_matches, ts_smooth, ts_hangover]
    for f in python:
        spark.udf.register(f.__name__, f)
    # the others are SQL expressions, which the optimizer sees through
    total = "aggregate({}, 0D, (s, x) -> s + x)"
    mean = total.format("v") + " / size(v)"
    # two passes: squares of large or nearly equal values would cancel each other
    spread = f"y -> named_struct('v', y.v, 'm', y.m, 's', sqrt({total.format('transform(y.v, u -> pow(u - y.m, 2))')} / size(y.v)))"
    # the band of envelope_bound: as wide as the lengths differ, and empty where it leaves b
    low, high = "greatest(0, i - greatest(0, size(a) - size(b)) - w + 1)", "least(size(b), i + greatest(0, size(b) - size(a)) + w)"
    part = f"slice(b, {low} + 1, greatest(0, {high} - {low}))"
    outside = f"transform(a, (x, i) -> if({high} <= {low}, 0D, greatest(x - array_max({part}), array_min({part}) - x, 0D)))"
    expressions = {
        "ts_ed(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(" + total.format("transform(sequence(0, greatest(size(a), size(b)) - 1), i -> pow(a[least(i, size(a) - 1)] - b[least(i, size(b) - 1)], 2))") + ")",
        "ts_lb_keogh(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, w INT) RETURNS DOUBLE": f"sqrt({total.format(f'transform({outside}, x -> x * x)')})",
        "ts_znorm(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": f"transform(transform(array(named_struct('v', v, 'm', {mean})), {spread}), z -> transform(z.v, x -> if(z.s > 0, (x - z.m) / z.s, 0D)))[0]",
        "ts_diff(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "zip_with(slice(v, 2, greatest(size(v) - 1, 0)), slice(v, 1, greatest(size(v) - 1, 0)), (y, x) -> y - x)",
        "ts_derivative(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "if(size(v) < 2, transform(v, x -> 0D), transform(v, (x, i) -> case when i = 0 then get(v, 1) - x when i = size(v) - 1 then x - get(v, i - 1) else ((x - get(v, i - 1)) + (get(v, i + 1) - get(v, i - 1)) / 2) / 2 end))",
        "ts_logdomain(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "transform(v, x -> signum(x) * log1p(abs(x)))",
        "ts_squash(x DOUBLE, r DOUBLE, x0 DOUBLE) RETURNS DOUBLE": "1 / (1 + exp(-(x - x0) / r))",
        "ts_similarity(d DOUBLE, r DOUBLE) RETURNS DOUBLE": "exp(-d / r)",
    }
    for head, body in expressions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [f.__name__ for f in python] + [h.split("(")[0] for h in expressions]
