"""Operators on DataFrames: sources, joins, search, averages, clusters, SQL functions and streams."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions import columns, sql
from tempora.kernels import dtw, subsequence
from tempora.operators import average, cluster, pairwise, search, symbolize
from tempora.settings import DistanceSettings as S
from tempora.sources import series

SIX = [[0, 0, 1, 2, 1, 0, 1, 0, 0], [0, 1, 2, 0, 0, 0, 0, 0, 0], [1, 2, 0, 0, 0, 0, 0, 1, 1]] * 2


@pytest.fixture(scope="module")
def six(spark):
    return series.from_rows(spark, SIX)


@pytest.fixture(scope="module")
def walks(spark):
    r = np.random.default_rng(5)
    return series.from_rows(spark, [r.normal(size=n).cumsum().tolist() for n in r.integers(5, 20, 30)])


def as_dict(df, value="distance"):
    return {(r["i"], r["j"]): r[value] for r in df.collect()}


def test_all_pairs_once_and_right(walks, monkeypatch):
    rows = {r[0]: r[1] for r in walks.collect()}
    for block in (4, 128):
        monkeypatch.setattr(pairwise, "BLOCK", block)
        found = pairwise.distances(walks).collect()
        assert len(found) == 435 == len({(r["i"], r["j"]) for r in found})
        assert all(r["i"] < r["j"] and r["distance"] == pytest.approx(float(dtw.distances([rows[r["i"]]], [rows[r["j"]]], S())[0])) for r in found)
        folds = as_dict(pairwise.column_pairs(walks, lambda a, b: columns.warping_distance(a, b, S(window=3, penalty=0.1))))
        kernel = as_dict(pairwise.distances(walks, S(window=3, penalty=0.1)))
        assert folds.keys() == kernel.keys() and all(folds[k] == pytest.approx(kernel[k]) or folds[k] == kernel[k] for k in kernel)


def test_rectangle_of_pairs(six):
    found = as_dict(pairwise.distances(six, block=((1, 4), (3, 5))))
    want = {(1, 3): 1.4142, (1, 4): 0, (2, 3): 1.7320, (2, 4): 1.7320, (3, 4): 1.4142}
    assert found.keys() == want.keys() and found[(1, 4)] == 0
    assert len(as_dict(pairwise.distances(six, block=((1, 4), (3, 5)), triangle=False))) == 6 == pairwise.pair_count(6, ((1, 4), (3, 5)), False)
    assert pairwise.pair_count(6) == 15 and pairwise.pair_count(6, ((1, 4), (3, 5))) == 5


def test_two_sets_and_matrix(six):
    assert len(pairwise.distances(six, other=six).collect()) == 36
    m = pairwise.matrix(pairwise.distances(six), 6)
    assert (m == m.T).all() and (np.diag(m) == 0).all()


def test_sources(spark):
    rows = spark.createDataFrame([(1, 3, 0.5), (1, 1, 0.25), (2, 1, 9.0)], "k long, t int, v double")
    assert {r[0]: r[1] for r in series.from_long(rows, "k", ("t",), "v").collect()} == {1: [0.25, 0.5], 2: [9.0]}
    holes = spark.createDataFrame([(1, [1.0, None, 3.0, float("nan")]), (2, [1.0])], "series_id long, values array<double>")
    assert {r[0]: r[1] for r in series.checked(holes, "interpolate").collect()} == {1: [1.0, 2.0, 3.0, 3.0], 2: [1.0]}
    assert [r[0] for r in series.checked(holes, "drop").collect()] == [2]
    with pytest.raises(Exception, match="null or NaN"):
        series.checked(holes).collect()
    assert len(series.bursts(spark, 3, 40, 10).first()[1]) == 40
    assert series.transients(spark, 3, 40, 10).collect() == series.transients(spark, 3, 40, 10).repartition(2).orderBy("series_id").collect()


def test_substitution_matrix(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# scores\n   A  B\n\nA  1 -2  # a\nB -3  4\n")
    found = {(a, b): s for a, b, s in series.substitution_matrix(spark, str(tmp_path / "m.txt")).collect()}
    assert found == {("A", "A"): 1, ("B", "A"): -2, ("A", "B"): -3, ("B", "B"): 4}


def test_nearest_with_and_without_bound(walks):
    q = [(7, walks.first()[1])]
    full = [tuple(r) for r in search.nearest(q, walks, 4, S(window=5), use_bound=False).collect()]
    assert full == [tuple(r) for r in search.nearest(q, walks.repartition(5), 4, S(window=5)).collect()]
    assert full[0][3] == 0 and [r[1] for r in full] == [1, 2, 3, 4]


def test_windows_cover_whole_steps(spark):
    w = search.windows(series.from_rows(spark, [list(range(10))]), 4, 3).collect()
    assert [(r["begin"], r["values"]) for r in w] == [(0, [0, 1, 2, 3]), (3, [3, 4, 5, 6]), (6, [6, 7, 8, 9])]


def test_segments(spark):
    s = series.from_rows(spark, [[0.0] * 10, [0.0] * 5])
    segments = spark.createDataFrame([(0, 1, 3), (0, 3, 4), (0, 7, 8)], "series_id long, begin int, end int")
    assert {r[0]: r[1] for r in search.coverage(segments, s).collect()} == {0: 6, 1: 0}
    assert sorted(map(tuple, search.missing_segments(segments, s).collect())) == [(0, 0, 0), (0, 5, 6), (0, 9, 9), (1, 0, 4)]


def test_barycenter_known(spark):
    s = series.from_rows(spark, [[0, 1, 1, 1], [0, 2, 0, 0], [1, 0, 0, 0]] * 2)
    assert average.barycenter(s, start=[0, 2, 0, 0], max_it=10) == pytest.approx(average.barycenter(s.repartition(3), start=[0, 2, 0, 0], max_it=10))
    with pytest.raises(ValueError, match="no series"):
        average.barycenter(s.where("false"))


def test_clusters(six):
    members, _ = cluster.agglomerate(pairwise.distances(six), max_dist=1.5)
    assert sorted(map(sorted, members.values())) == [[0, 1, 3, 4], [2, 5]]
    pairs = pairwise.distances(six)
    assigned, medoids = cluster.k_medoids(pairs, [0, 2])
    assert len({r["cluster"] for r in assigned.collect()}) == 2 and len(medoids) == 2
    means, centers, _ = cluster.k_means(six, 2, seed=1, max_it=4)
    got = {r["series_id"]: r["cluster"] for r in means.collect()}
    assert len(got) == 6 and got[2] == got[5] and len(centers) == 2


def test_transforms(spark):
    df = series.from_rows(spark, [[0.1, 0.15, 0.27, 0.3, 0.26, 0.24, 0.2, 0.1]])
    v = F.col("values")
    d = df.select(columns.derivative(v), columns.differences(v), columns.normalised(v), columns.mixed_log(v, 0.2)).first()
    assert d[0] == pytest.approx([0.05, 0.0675, 0.0975, 0.0125, -0.035, -0.025, -0.055, -0.1])
    assert len(d[1]) == 7 and np.mean(d[2]) == pytest.approx(0, abs=1e-9) and np.std(d[2]) == pytest.approx(1)
    assert series.from_rows(spark, [[2.0, 2.0]]).select(columns.normalised(v)).first()[0] == [0, 0]


def test_paths_and_warp(six):
    p = pairwise.paths(six)
    a, b = six.select(F.col("series_id").alias("i"), F.col("values").alias("a")), six.select(F.col("series_id").alias("j"), F.col("values").alias("b"))
    rows = p.join(a, "i").join(b, "j").select("distance", columns.path_distance(F.col("path"), F.col("a"), F.col("b")).alias("again"), columns.path_distance(F.col("path"), F.col("a"), F.col("b"), relaxed=True).alias("less"), columns.warping_amount(F.col("path")).alias("turns")).collect()
    assert all(r["again"] == pytest.approx(r["distance"]) and r["less"] <= r["distance"] + 1e-9 and r["turns"] >= 0 for r in rows)
    assert all(len(r["values"]) == 9 for r in average.warp(p.join(a, "i")).collect())


def test_explanations(six):
    rows = symbolize.explanations(six).collect()
    assert len(rows) == 15 and all(r["segments"][0]["s_from"] == 0 and r["segments"][-1]["e_to"] == 8 for r in rows)


def test_sql_functions(spark):
    names = sql.register(spark)
    assert "ts_dtw" in names and "ts_ed" in names
    row = spark.sql("select ts_dtw(a, b) d, ts_ed(a, b) e, ts_lb_keogh(array(1D, 2D, 1D, 3D), array(3D, 4D, 3D, 0D), 2) l, ts_znorm(a) z, size(ts_warping_path(a, b)) p, ts_nw_score('GATTACA', 'GCATGCU') n, ts_dtw_band(a, b, 3, 0D) w, ts_derivative(a) v from values (array(0D,0D,1D,2D,1D,0D,1D,0D,0D), array(0D,1D,2D,0D,0D,0D,0D,0D,0D)) t(a, b)").first()
    assert row["d"] == pytest.approx(math.sqrt(2)) and row["e"] == pytest.approx(math.sqrt(8)) and row["l"] == pytest.approx(2.23606797749979)
    assert row["p"] >= 9 and row["n"] == 0 and len(row["z"]) == 9


def test_stream_of_windows(spark, tmp_path):
    from tempora.streaming import online

    points = spark.range(40).select(F.lit(1).cast("long").alias("series_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.when(F.col("id") == 39, 50.0).otherwise(1.0 + F.col("id") % 3).alias("value"))
    points.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    q = online.window_distances(read(), [(0, [1.0, 2, 3])], "10 minutes", "10 minutes").writeStream.format("memory").queryName("w").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").where("query_id = 0").count() >= 1
    q = online.knees(read()).writeStream.format("memory").queryName("k").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["value"] for r in spark.table("k").collect()][-1:] == [50.0]


def test_sql_functions_on_ragged_and_constant_series(spark):
    from tempora.functions import sql
    from tempora.kernels import dtw
    from tempora.settings import DistanceSettings

    sql.register(spark)
    a, b = [1.0, 5.0, 2.0, 8.0, 1.0], [3.0, 4.0]
    for x, y in ((a, b), (b, a), (a, a)):
        got = spark.sql(f"select ts_lb_keogh(array({','.join(f'{v}D' for v in x)}), array({','.join(f'{v}D' for v in y)}), 2)").first()[0]
        assert got == pytest.approx(dtw.envelope_bound(np.array(x), np.array(y), DistanceSettings(window=2)))
    for v in ([0.1] * 4, [0.7] * 4):
        assert spark.sql(f"select ts_znorm(array({','.join(f'{x}D' for x in v)}))").first()[0] == [0.0] * 4
    assert spark.sql("select ts_znorm(array(1000000001D, 1000000002D, 1000000003D))").first()[0] == pytest.approx([-1.224744871391589, 0, 1.224744871391589])


def test_expressions_meet_every_pair_once_in_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tempora.operators import pairwise

    monkeypatch.setattr(pairwise, "BLOCK", 5)
    s = spark.createDataFrame([(k, [float(k)]) for k in range(23)], "series_id long, values array<double>")
    got = pairwise.column_pairs(s, lambda a, b: F.get(b, F.lit(0)) - F.get(a, F.lit(0))).collect()
    assert sorted((r.i, r.j, r.distance) for r in got) == [(i, j, float(j - i)) for i in range(23) for j in range(i + 1, 23)]


def test_euclidean_pairs_by_tiles_equal_the_fold(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [r.normal(size=n).tolist() for n in r.integers(3, 9, 40)]
    rows += rows[:7] * 3 + [[1.0, None, 2.0]]
    s = spark.createDataFrame([*enumerate(rows), (None, [1.0, 2.0])], "series_id long, values array<double>")
    want = as_dict(pairwise.column_pairs(s, columns.euclidean))
    assert len(want) == 62 * 61 // 2 and sum(d is None for d in want.values()) == 61
    for block, copies in ((4, 1), (4, 128), (128, 128)):
        monkeypatch.setattr(pairwise, "BLOCK", block)
        monkeypatch.setattr(pairwise, "COPIES", copies)
        assert as_dict(pairwise.euclidean_distances(s)) == want


def test_blocks_grow_with_the_series_and_no_pairs_are_joined(spark, six):
    assert [pairwise.block_count(n) for n in (0, 1, 128, 129, 3072, 24_576, 90_000)] == [1, 1, 1, 2, 24, 24, 88]
    assert "Join" not in pairwise.euclidean_distances(six)._jdf.queryExecution().toString()


def test_warped_pairs_by_tiles_equal_the_sweep(spark, monkeypatch):
    r = np.random.default_rng(9)
    rows = [r.normal(size=n).cumsum().tolist() for n in r.integers(2, 40, 30)]
    rows += rows[:5] * 2
    s = spark.createDataFrame([*enumerate(rows), (None, [1.0, 2.0])], "series_id long, values array<double>")
    monkeypatch.setattr(pairwise, "BLOCK", 8)
    monkeypatch.setattr(dtw, "TILE_CELLS", 64)
    p, q = np.triu_indices(len(rows), 1)
    for settings in (S(), S(penalty=0.3), S(inner="euclidean"), S(window=3)):
        want = dtw.distances_among([np.array(v) for v in rows], p, q, settings)
        assert as_dict(pairwise.distances(s, settings)) == dict(zip(zip(p.tolist(), q.tolist()), want.tolist(), strict=True))
    assert dtw.across_holds([np.array(rows[0])], S(penalty=0.3)) and not dtw.across_holds([np.array(rows[0])], S(window=3))
    tiled = dtw.distances_across([np.array(v) for v in rows], [np.array(v) for v in rows], S())
    assert (tiled[p, q] == dtw.distances_among([np.array(v) for v in rows], p, q, S())).all() and (tiled == tiled.T).all()


def test_concurrences_in_batches(spark, walks, monkeypatch):
    monkeypatch.setattr(search, "POINTS", 20)
    fields = ["series_id", "rank", "begin_i", "end_i", "begin_j", "end_j"]
    want = []
    for i, v in walks.collect():
        s = subsequence.concurrence_settings(v, 0.5, only_triu=True)
        want += [(i, n, p[0][0], p[-1][0], p[0][1], p[-1][1], [*p]) for n, p in enumerate(subsequence.Concurrences(v, None, s).matches(3, 2))]
    found = search.concurrences(walks, k=3, min_length=2, factor=0.5).collect()
    assert sorted((*(r[f] for f in fields), [tuple(x) for x in r["path"]]) for r in found) == sorted(want)
    assert search.concurrences(walks, k=3, min_length=99).count() == 0 < search.concurrences(walks, k=3, min_length=2, buffer=1).count()
