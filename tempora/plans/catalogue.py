"""Registered queries over the test tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import columns
from tempora.operators import pairwise
from tempora.plans import oracle, tables
from tempora.settings import DistanceSettings
from tempora.sources import series
from tempora.sources.interim import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, name: str = "distance") -> DataFrame:
    return df.withColumn(name, F.round(name, 6))


def values_out(df: DataFrame) -> DataFrame:
    """series_id, pos, value: a row for each point."""
    return df.select("series_id", F.posexplode("values").alias("pos", "value")).select("series_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


_OUT = "SELECT id AS series_id, unnest(range(len(w))) AS pos, round(unnest(w), 6) AS value FROM ({})"


def out(name: str, value: str) -> str:
    return f"WITH {oracle.series(name)} " + _OUT.format(f"SELECT id, {value} AS w FROM s")


# ---- series


@query(out("raw", "v"))
def series_build(spark, sf_dir):
    return values_out(tables.raw(spark, sf_dir))


@query(out("suppliers", "v"))
def series_calendar(spark, sf_dir):
    return values_out(tables.suppliers(spark, sf_dir))


@query(f"WITH {oracle.series('raw')} SELECT round(min(list_min(v)), 6) AS min_value, round(max(list_max(v)), 6) AS max_value, max(len(v))::BIGINT AS max_length, round(avg(len(v)), 6) AS avg_length, count(*) AS n_series FROM s")
def series_statistics(spark, sf_dir):
    s = series.statistics(tables.raw(spark, sf_dir))
    return s.select(F.round("min_value", 6).alias("min_value"), F.round("max_value", 6).alias("max_value"), F.col("max_length").cast("long").alias("max_length"), F.round("avg_length", 6).alias("avg_length"), "n_series")


@query(f"WITH {oracle.series('raw')} SELECT series_id, b AS \"begin\", w_pos AS pos, round(x, 6) AS value FROM (SELECT series_id, b, unnest(range(12)) AS w_pos, unnest(v[b + 1 : b + 12]) AS x FROM (SELECT id AS series_id, v, unnest(range(0, len(v) - 12 + 1, 6)) AS b FROM s))")
def sliding_windows(spark, sf_dir):
    w = tables.raw(spark, sf_dir).select("series_id", F.explode(columns.windows(F.col("values"), 12, 6)).alias("w"))
    w = w.select("series_id", F.col("w.begin").cast("long").alias("begin"), F.posexplode("w.values").alias("pos", "value"))
    return w.select("series_id", "begin", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


# ---- point transforms


def _transform(f):
    return lambda spark, sf_dir, name: values_out(getattr(tables, name)(spark, sf_dir).withColumn("values", f(F.col("values"))))


@query(out("raw", "list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i])"))
def differencing(spark, sf_dir):
    return _transform(columns.differences)(spark, sf_dir, "raw")


_D = "CASE WHEN i = 1 THEN v[2] - v[1] WHEN i = len(v) THEN v[i] - v[i - 1] ELSE ((v[i] - v[i - 1]) + (v[i + 1] - v[i - 1]) / 2) / 2 END"


@query(out("raw", f"list_transform(range(1, len(v) + 1), lambda i: {_D})"))
def derivative(spark, sf_dir):
    return _transform(columns.derivative)(spark, sf_dir, "raw")


@query(out("raw", "list_transform(v, lambda x: CASE WHEN list_stddev_pop(v) > 0 THEN (x - list_avg(v)) / list_stddev_pop(v) ELSE 0 END)"))
def z_normalise(spark, sf_dir):
    return _transform(columns.normalised)(spark, sf_dir, "raw")


@query(out("raw", "list_transform(v, lambda x: sign(x) * ln(1 + abs(x)))"))
def log_domain(spark, sf_dir):
    return _transform(columns.log_domain)(spark, sf_dir, "raw")


@query(out("raw", "list_transform(v, lambda x: CASE WHEN x > 50 THEN 50 + ln(x - 50 + 1) WHEN x < 10 THEN 10 - ln(10 - x + 1) ELSE x END)"))
def mixed_linear_log(spark, sf_dir):
    return _transform(lambda v: columns.mixed_log(v, 50.0, 10.0))(spark, sf_dir, "raw")


# ---- all pairs


@query(oracle.all_pairs("daily", "sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda k: (a[k] - b[k]) ** 2)))"))
def ed_pairs(spark, sf_dir):
    return rounded(pairwise.euclidean_distances(tables.daily(spark, sf_dir)))


@query(oracle.all_pairs("ragged", "sqrt(list_sum(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda k: (a[least(k, len(a))] - b[least(k, len(b))]) ** 2)))"))
def ed_ragged(spark, sf_dir):
    return rounded(pairwise.euclidean_distances(tables.ragged(spark, sf_dir)))


def _dtw(name: str, settings: DistanceSettings = DistanceSettings()):
    return lambda spark, sf_dir: rounded(pairwise.distances(getattr(tables, name)(spark, sf_dir), settings))


@query(oracle.all_pairs("daily", f"sqrt(list_last({oracle.last_row()}))"))
def dtw_pairs(spark, sf_dir):
    return _dtw("daily")(spark, sf_dir)


@query(oracle.all_pairs("slots", f"sqrt(list_last({oracle.last_row(window=4)}))"))
def dtw_window(spark, sf_dir):
    return _dtw("slots", DistanceSettings(window=4))(spark, sf_dir)


@query(oracle.all_pairs("slots", f"sqrt(list_last({oracle.last_row(penalty=900.0)}))"))
def dtw_penalty(spark, sf_dir):
    return _dtw("slots", DistanceSettings(penalty=30.0))(spark, sf_dir)


_STEP = f"list_last({oracle.last_row(max_step=90000.0)})"


@query(oracle.all_pairs("slots", f"CASE WHEN isinf({_STEP}) THEN NULL ELSE sqrt({_STEP}) END"))
def dtw_max_step(spark, sf_dir):
    d = _dtw("slots", DistanceSettings(max_step=300.0))(spark, sf_dir)
    return d.withColumn("distance", F.when(F.col("distance") != float("inf"), F.col("distance")))


@query(f"SELECT * FROM ({oracle.all_pairs('slots', f'sqrt(list_last({oracle.last_row()}))')}) WHERE distance <= 600")
def dtw_max_dist(spark, sf_dir):
    d = _dtw("slots", DistanceSettings(max_dist=600.0, use_pruning=True))(spark, sf_dir)
    return d.where(F.col("distance") != float("inf"))


@query(oracle.all_pairs("slots", f"list_last({oracle.last_row(cost='abs(x - y)')})"))
def dtw_absolute_cost(spark, sf_dir):
    return _dtw("slots", DistanceSettings(inner="euclidean"))(spark, sf_dir)


@query(oracle.all_pairs("ragged", f"sqrt(list_last({oracle.last_row()}))", where=" WHERE abs(len(a) - len(b)) <= 2"))
def dtw_ragged(spark, sf_dir):
    d = _dtw("ragged", DistanceSettings(max_length_diff=2))(spark, sf_dir)
    return d.where(F.col("distance") != float("inf"))


@query(oracle.all_pairs("slots", f"sqrt(list_min(list_slice({oracle.last_row(skip=2)}, -3, -1)))"))
def dtw_psi(spark, sf_dir):
    return _dtw("slots", DistanceSettings(psi=(0, 0, 2, 2)))(spark, sf_dir)


@query(oracle.all_pairs("vectors", "sqrt(list_last(" + oracle.nested_last_row("((cur[1] - b[q[1]::INT][1]) ** 2 + (cur[2] - b[q[1]::INT][2]) ** 2)") + "))"))
def dtw_dependent(spark, sf_dir):
    return _dtw("vectors")(spark, sf_dir)


def _dim(k: int) -> str:
    return oracle.last_row(a=f"list_transform(a, lambda z: z[{k}])", b=f"list_transform(b, lambda z: z[{k}])")


@query(oracle.all_pairs("vectors", f"sqrt(list_last({_dim(1)})) + sqrt(list_last({_dim(2)}))"))
def dtw_independent(spark, sf_dir):
    return rounded(pairwise.independent_distances(tables.vectors(spark, sf_dir)))


@query(oracle.all_pairs("slots", f"sqrt(list_last({oracle.last_row()}))", condition="x.id < y.id AND x.id >= 10 AND x.id < 40 AND y.id >= 30 AND y.id < 60"))
def dtw_block(spark, sf_dir):
    return rounded(pairwise.distances(tables.slots(spark, sf_dir), block=((10, 40), (30, 60))))


@query(oracle.all_pairs("slots", f"sqrt(list_last({oracle.last_row()}))"))
def dtw_expression(spark, sf_dir):
    """The same measure as nested folds inside the JVM."""
    return rounded(pairwise.column_pairs(tables.slots(spark, sf_dir), columns.warping_distance))


_ENVELOPE = """sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda k: greatest(0, a[k] - list_max(b[greatest(1, k - 3) : least(len(b), k + 3)]), list_min(b[greatest(1, k - 3) : least(len(b), k + 3)]) - a[k]) ** 2)))"""


@query(oracle.all_pairs("slots", _ENVELOPE, "bound"))
def lb_keogh_pairs(spark, sf_dir):
    return rounded(pairwise.envelope_bounds(tables.slots(spark, sf_dir), 4), "bound")


_MSM = """list_last(list_reduce(list_transform(range(2, len(a) + 1), lambda i: [i::DOUBLE]), lambda prev, cur: list_reduce(list_transform(range(2, len(b) + 1), lambda k: [k::DOUBLE]),
lambda row, q: list_append(row, least(prev[q[1]::INT - 1] + abs(a[cur[1]::INT] - b[q[1]::INT]), prev[q[1]::INT] + {up}, list_last(row) + {left})), [prev[1] + {edge}]),
list_reduce(list_transform(range(2, len(b) + 1), lambda k: [k::DOUBLE]), lambda row, q: list_append(row, list_last(row) + {top}), [abs(a[1] - b[1])::DOUBLE])))"""


def _change(v: str, p: str, q: str) -> str:
    return f"(0.1 + CASE WHEN {v} BETWEEN least({p}, {q}) AND greatest({p}, {q}) THEN 0 ELSE least(abs({v} - {p}), abs({v} - {q})) END)"


_I, _J = "cur[1]::INT", "q[1]::INT"


@query(
    oracle.all_pairs(
        "slots",
        _MSM.format(up=_change(f"a[{_I}]", f"a[{_I} - 1]", f"b[{_J}]"), left=_change(f"b[{_J}]", f"a[{_I}]", f"b[{_J} - 1]"), edge=_change(f"a[{_I}]", f"a[{_I} - 1]", "b[1]"), top=_change(f"b[{_J}]", f"b[{_J} - 1]", "a[1]")),
    )
)
def msm_pairs(spark, sf_dir):
    return rounded(pairwise.split_merge_distances(tables.slots(spark, sf_dir), 0.1))


_NW = """-list_last(list_reduce(list_transform(range(1, len(a) + 1), lambda i: [i::DOUBLE]), lambda prev, cur: list_reduce(list_transform(range(1, len(b) + 1), lambda k: [k::DOUBLE]),
lambda row, q: list_append(row, least(prev[q[1]::INT] + CASE WHEN a[cur[1]::INT] = b[q[1]::INT] THEN -1 ELSE 1 END, prev[q[1]::INT + 1] + 1, list_last(row) + 1)), [cur[1]]), list_transform(range(len(b) + 1), lambda k: k::DOUBLE)))"""


@query(oracle.all_pairs("names", _NW, "score"))
def alignment_pairs(spark, sf_dir):
    return rounded(pairwise.alignment_scores(tables.names(spark, sf_dir)), "score")


@query(oracle.all_pairs("slots", f"sqrt(list_last({oracle.last_row()}))").replace("SELECT i, j,", "SELECT i, j, (i * (SELECT count(*) FROM s) - i * (i + 1) // 2 + (j - i - 1))::BIGINT AS place,"))
def condensed_matrix(spark, sf_dir):
    d, n = _dtw("slots")(spark, sf_dir), tables.slots(spark, sf_dir).count()
    return d.select("i", "j", columns.condensed_index(F.col("i"), F.col("j"), n).alias("place"), "distance")


# ---- similarities

_DIST = oracle.all_pairs("slots", f"sqrt(list_last({oracle.last_row()}))")


def _similar(method: str):
    def f(spark, sf_dir):
        d = written(pairwise.distances(tables.slots(spark, sf_dir)))
        r = d.agg(columns.default_range(method, F.min("distance"), F.max("distance"))).first()[0]
        return rounded(d.select("i", "j", columns.similarity(F.col("distance"), method, F.lit(r)).alias("similarity")), "similarity")

    return f


_EXACT = _DIST.replace("round(", "(").replace(", 6) AS distance", ") AS distance")
for _name, _formula in {"exponential": "exp(-distance / (max(distance) OVER ()))", "gaussian": "exp(-(distance ** 2) / (max(distance) OVER ()) ** 2)", "reciprocal": "1 / (1 + distance)", "reverse": "(min(distance) OVER () + max(distance) OVER () - distance) / (min(distance) OVER () + max(distance) OVER ())"}.items():
    QUERIES[f"similarity_{_name}"] = _similar(_name)
    ORACLE_SQL[f"similarity_{_name}"] = f"SELECT i, j, round({_formula}, 6) AS similarity FROM ({_EXACT})"


def _squashed(method: str):
    def f(spark, sf_dir):
        d = written(pairwise.distances(tables.slots(spark, sf_dir)))
        middle = F.lit(d.agg(F.avg("distance")).first()[0])
        x0 = middle if method == "logistic" else F.lit(0.0)
        r = middle / 6 if method == "logistic" else middle
        return rounded(d.select("i", "j", columns.squash(F.col("distance"), method, r, x0).alias("squashed")), "squashed")

    return f


for _name, _formula in {"logistic": "1 / (1 + exp(-(distance - m) / (m / 6)))", "gaussian": "1 - exp(-(distance ** 2) / m ** 2)", "exponential": "1 - exp(-distance / m)"}.items():
    QUERIES[f"squash_{_name}"] = _squashed(_name)
    ORACLE_SQL[f"squash_{_name}"] = f"SELECT i, j, round({_formula}, 6) AS squashed FROM (SELECT *, avg(distance) OVER () AS m FROM ({_EXACT}))"


# ---- search

import numpy as np  # noqa: E402

from tempora.operators import average, cluster, search, symbolize  # noqa: E402

#: A motif that is looked for in the hourly series.
MOTIF = (0.0, 50.0, 100.0, 50.0, 0.0)


def type_means(spark, sf_dir) -> list[tuple[int, list[float]]]:
    """Mean daily series of each event type: 5 rows, whatever the scale."""
    points = tables.slots(spark, sf_dir).select(F.floor(F.col("series_id") / 24).alias("type"), F.posexplode("values").alias("p", "x"))
    means = points.groupBy("type", "p").agg(F.avg("x").alias("x")).groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("v"))
    return sorted((int(t), list(v)) for t, v in means.collect())


_MEANS = "m AS (SELECT t AS id, list(x ORDER BY p) AS v FROM (SELECT id // 24 AS t, p, avg(x) AS x FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM s) GROUP BY ALL) GROUP BY t)"
_NEAR = f"WITH {oracle.series('slots')}, {_MEANS}, p AS (SELECT m.id AS query_id, s.id AS series_id, m.v AS a, s.v AS b FROM m, s), d AS (SELECT query_id, series_id, sqrt(list_last({oracle.last_row(window=4)})) AS distance FROM p)"
_KNN = f"{_NEAR} SELECT query_id::BIGINT AS query_id, rank::BIGINT AS rank, series_id::BIGINT AS series_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, series_id) AS rank FROM d) WHERE rank <= 5"


def _nearest(use_bound: bool):
    def f(spark, sf_dir):
        found = search.nearest(type_means(spark, sf_dir), tables.slots(spark, sf_dir), 5, DistanceSettings(window=4), use_bound)
        return rounded(found).select("query_id", F.col("rank").cast("long").alias("rank"), "series_id", "distance")

    return f


for _name, _bound in (("knn_topk", False), ("knn_lb_pruned", True)):
    QUERIES[_name], ORACLE_SQL[_name] = _nearest(_bound), _KNN


_SA_ROW = oracle.last_row(a=f"{list(MOTIF)}::DOUBLE[]", b="v", penalty=0.01, skip="len(v)")


@query(f"WITH {oracle.series('hourly')}, r AS (SELECT id, {_SA_ROW} AS row FROM s) SELECT 0::BIGINT AS query_id, id AS series_id, unnest(range(len(row) - 1)) AS idx, round(unnest(list_transform(row[2:], lambda x: sqrt(x) / {len(MOTIF)})), 6) AS value FROM r")
def subsequence_matching_function(spark, sf_dir):
    return rounded(search.matching_function(0, MOTIF, tables.hourly(spark, sf_dir)), "value")


@query()
def subsequence_matches(spark, sf_dir):
    return search.matches(0, MOTIF, tables.hourly(spark, sf_dir), k=5)


@query()
def subsequence_matches_knee(spark, sf_dir):
    return search.matches(0, MOTIF, tables.hourly(spark, sf_dir), k=50, knee_alpha=0.3, max_range_factor=3.0)


@query()
def local_concurrences(spark, sf_dir):
    return search.concurrences(tables.raw(spark, sf_dir), k=3, factor=0.25)


def _high(s: DataFrame) -> DataFrame:
    """Runs of three hours that begin with a high value, as segments."""
    points = s.select("series_id", (F.size("values") - 1).alias("last"), F.posexplode("values").alias("begin", "x"))
    return points.where("x > 150").select("series_id", "begin", F.least(F.col("begin") + 2, F.col("last")).alias("end"))


_SEG = f"WITH {oracle.series('hourly')}, g AS (SELECT id, b - 1 AS b, least(b + 1, n - 1) AS e FROM (SELECT id, len(v) AS n, unnest(v) AS x, generate_subscripts(v, 1) AS b FROM s) WHERE x > 150), c AS (SELECT DISTINCT id, unnest(range(b, e + 1)) AS p FROM g)"


@query(f"{_SEG} SELECT s.id AS series_id, count(c.p) AS covered, round(count(c.p) / len(any_value(s.v)), 6) AS coverage FROM s LEFT JOIN c ON s.id = c.id GROUP BY s.id")
def segments_coverage(spark, sf_dir):
    s = tables.hourly(spark, sf_dir)
    return rounded(search.coverage(_high(s), s), "coverage")


@query(f"{_SEG}, f AS (SELECT id, p, p - row_number() OVER (PARTITION BY id ORDER BY p) AS k FROM (SELECT id, unnest(range(len(v))) AS p FROM s) WHERE (id, p) NOT IN (SELECT id, p FROM c)) SELECT id AS series_id, min(p) AS \"begin\", max(p) AS \"end\" FROM f GROUP BY id, k")
def missing_segments(spark, sf_dir):
    s = tables.hourly(spark, sf_dir)
    return search.missing_segments(_high(s), s).select("series_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


# ---- averages and clusters


@query(f"WITH d AS ({_DIST}) SELECT id AS series_id, round(sum(distance), 4) AS total FROM (SELECT i AS id, distance FROM d UNION ALL SELECT j, distance FROM d) GROUP BY id ORDER BY sum(distance), id LIMIT 1")
def medoid(spark, sf_dir):
    found = average.medoid(rounded(pairwise.distances(tables.slots(spark, sf_dir))))
    return found.withColumn("total", F.round("total", 4))


@query(f"{_NEAR} SELECT series_id, arg_min(query_id, distance)::BIGINT AS cluster, round(min(distance), 6) AS distance FROM d GROUP BY series_id")
def assign_to_prototypes(spark, sf_dir):
    centers = {k: np.array(v) for k, v in type_means(spark, sf_dir)}
    return rounded(cluster.assign(tables.slots(spark, sf_dir), centers, DistanceSettings(window=4)).select("series_id", "cluster", "distance"))


@query()
def barycenter(spark, sf_dir):
    center = average.barycenter(tables.slots(spark, sf_dir), max_it=5, initial_sample=20)
    return spark.createDataFrame([(p, float(x)) for p, x in enumerate(center)], "pos int, value double")


_D = f"WITH RECURSIVE d AS MATERIALIZED ({_EXACT}), n AS (SELECT 24 * count(DISTINCT event_type) AS n FROM events)"
_TREE = 'SELECT (step - 1)::INT AS step, l::INT AS "left", r::INT AS "right", round(distance, 6) AS distance, total::INT AS size FROM st WHERE step > 0'
_MERGED = f"""{_D}, st AS (SELECT 0 AS step, n, range(n) AS node, list_transform(range(n), lambda x: 1::BIGINT) AS size, []::BIGINT[] AS gone, 0::BIGINT AS l, 0::BIGINT AS r, 0::DOUBLE AS distance, 0::BIGINT AS total FROM n UNION ALL
SELECT step + 1, n, list_transform(node, lambda x, k: CASE WHEN k = i + 1 THEN n + step ELSE x END), list_transform(size, lambda x, k: CASE WHEN k = i + 1 THEN x + size[j + 1] ELSE x END), list_append(gone, j), node[i + 1], node[j + 1], distance, size[i + 1] + size[j + 1]
FROM (SELECT st.step, st.n, st.node, st.size, st.gone, d.i, d.j, d.distance FROM st, d WHERE NOT list_contains(gone, i) AND NOT list_contains(gone, j) ORDER BY d.distance, d.i, d.j LIMIT 1)) {_TREE}"""
_LINKED = f"""{_D}, st AS (SELECT 0 AS step, n, range(n) AS label, 0::BIGINT AS l, 0::BIGINT AS r, 0::DOUBLE AS distance, 0::BIGINT AS total FROM n UNION ALL
SELECT step + 1, n, list_transform(label, lambda x: CASE WHEN x = p OR x = q THEN n + step ELSE x END), p, q, m, len(list_filter(label, lambda x: x = p OR x = q))
FROM (SELECT step, n, label, least(la, lb) AS p, greatest(la, lb) AS q, max(distance) AS m FROM (SELECT st.step, st.n, st.label, label[i + 1] AS la, label[j + 1] AS lb, d.distance FROM st, d) WHERE la <> lb GROUP BY ALL ORDER BY m, p, q LIMIT 1)) {_TREE}"""
_MEDOIDS = f"""{_D}, ways AS MATERIALIZED (SELECT i, j, distance FROM d UNION ALL SELECT j, i, distance FROM d UNION ALL SELECT x, x, 0 FROM (SELECT unnest(range(n)) AS x FROM n)),
st AS (SELECT 0 AS step, [0, 24, 48, 72, 96]::BIGINT[] AS medoids, []::BIGINT[] AS home, false AS done UNION ALL
SELECT step + 1, list(m ORDER BY m), home, list(m ORDER BY m) = old FROM (SELECT step, old, home, c, arg_min(x, t) AS m FROM (SELECT step, old, home, home[i + 1] AS c, i AS x, sum(distance) AS t
FROM (SELECT step, medoids AS old, list(c ORDER BY x) AS home FROM (SELECT step, medoids, i AS x, arg_min(j, distance) AS c FROM st, ways WHERE list_contains(medoids, j) AND NOT done AND step < 20 GROUP BY ALL) GROUP BY ALL), ways
WHERE home[i + 1] = home[j + 1] GROUP BY ALL) GROUP BY ALL) GROUP BY step, old, home)
SELECT unnest(range(len(home))) AS series_id, unnest(home) AS cluster FROM (SELECT home FROM st ORDER BY step DESC LIMIT 1)"""


@query(_MERGED)
def hierarchical(spark, sf_dir):
    _, merges = cluster.agglomerate(pairwise.distances(tables.slots(spark, sf_dir)))
    rows = cluster.tree_of(merges, tables.slot_count(spark, sf_dir))
    return rounded(spark.createDataFrame(rows, "step int, left int, right int, distance double, size int"))


@query(_LINKED)
def linkage_complete(spark, sf_dir):
    d = pairwise.matrix(pairwise.distances(tables.slots(spark, sf_dir)), tables.slot_count(spark, sf_dir))
    rows = [(n, int(a), int(b), float(x), int(k)) for n, (a, b, x, k) in enumerate(cluster.linkage(d))]
    return rounded(spark.createDataFrame(rows, "step int, left int, right int, distance double, size int"))


@query(_MEDOIDS)
def k_medoids(spark, sf_dir):
    return cluster.k_medoids(pairwise.distances(tables.slots(spark, sf_dir)), [0, 24, 48, 72, 96])[0]


@query()
def k_means(spark, sf_dir):
    return cluster.k_means(tables.slots(spark, sf_dir), 5, DistanceSettings(window=4), max_it=4, max_dba_it=3)[0]


# ---- paths


_WHOLE = "forall(sequence(0, size(path) - 2), k -> path[k + 1].i - path[k].i between 0 and 1 and path[k + 1].j - path[k].j between 0 and 1 and path[k] <> path[k + 1])"


@query(f"SELECT i, j, distance, distance AS along, true AS whole FROM ({oracle.all_pairs('vectors', f'sqrt(list_last({_dim(1)}))')})")
def warping_paths(spark, sf_dir):
    """Cheapest paths, whichever of equal ones: from corner to corner in allowed steps, at the pair's distance."""
    s = tables.vectors(spark, sf_dir).withColumn("values", F.transform("values", lambda v: v[0]))
    p = _with_series(pairwise.paths(s), s)
    ends = F.expr("path[0].i = 0 and path[0].j = 0 and path[size(path) - 1].i = size(a) - 1 and path[size(path) - 1].j = size(b) - 1")
    return rounded(p.select("i", "j", "distance", F.round(columns.path_distance(F.col("path"), F.col("a"), F.col("b")), 6).alias("along"), (ends & F.expr(_WHOLE)).alias("whole")))


def _with_series(p: DataFrame, s: DataFrame) -> DataFrame:
    a, b = s.select(F.col("series_id").alias("i"), F.col("values").alias("a")), s.select(F.col("series_id").alias("j"), F.col("values").alias("b"))
    return p.join(a, "i").join(b, "j")


def _paths_with_series(spark, sf_dir) -> DataFrame:
    s = tables.hourly(spark, sf_dir)
    return _with_series(pairwise.paths(s, DistanceSettings(window=12)), s)


@query(f"SELECT i, j, distance, distance AS along, true AS less FROM ({oracle.all_pairs('slots', f'sqrt(list_last({oracle.last_row(window=4)}))')})")
def path_distances(spark, sf_dir):
    """Along a pair's cheapest path, the plain cost is its distance again; relaxed, it isn't more."""
    s = tables.slots(spark, sf_dir)
    p = _with_series(pairwise.paths(s, DistanceSettings(window=4)), s)
    along, relaxed = (columns.path_distance(F.col("path"), F.col("a"), F.col("b"), relaxed=r) for r in (False, True))
    return rounded(p.select("i", "j", "distance", F.round(along, 6).alias("along"), (relaxed <= along + 1e-9).alias("less")))


@query(oracle.all_pairs("slots", f"sqrt(list_last({oracle.last_row(window=4)}))", condition="x.id < 48 AND y.id >= 48"))
def dtw_two_sets(spark, sf_dir):
    """Every series of one set with every one of another."""
    s = tables.slots(spark, sf_dir)
    return rounded(pairwise.distances(s.where("series_id < 48"), DistanceSettings(window=4), s.where("series_id >= 48")))


@query(oracle.all_pairs("vectors", "list_last(" + oracle.nested_last_row("sqrt((cur[1] - b[q[1]::INT][1]) ** 2 + (cur[2] - b[q[1]::INT][2]) ** 2)") + ")"))
def dtw_dependent_euclidean(spark, sf_dir):
    return rounded(pairwise.distances(tables.vectors(spark, sf_dir), DistanceSettings(inner="euclidean")))


@query(oracle.all_pairs("slots", f"sqrt(list_last({oracle.last_row()})) <= sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda k: (a[k] - b[k]) ** 2))) AS within, sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda k: (a[k] - b[k]) ** 2)))", "bound").replace("round(", "", 1).replace("AS within, sqrt", "AS within, round(sqrt", 1))
def euclidean_upper_bounds(spark, sf_dir):
    """The Euclidean distance bounds warping from above."""
    s = tables.slots(spark, sf_dir)
    upper = pairwise.euclidean_distances(s).withColumnRenamed("distance", "bound")
    both = pairwise.distances(s).join(upper, ["i", "j"])
    return rounded(both.select("i", "j", (F.col("distance") <= F.col("bound") + 1e-9).alias("within"), "bound"), "bound")


@query()
def warped_series(spark, sf_dir):
    return average.warp(_paths_with_series(spark, sf_dir)).select("i", "j", F.posexplode("values").alias("pos", "value"))


_FLAT = f"{oracle.series('vectors')}, p AS (SELECT x.id AS i, y.id AS j, list_transform(x.v, lambda z: z[1]) AS a, list_transform(y.v, lambda z: z[1]) AS b FROM s x JOIN s y ON x.id < y.id), {oracle.best_paths('p')}"


def _vector_paths(spark, sf_dir) -> DataFrame:
    s = tables.vectors(spark, sf_dir).withColumn("values", F.transform("values", lambda v: v[0]))
    return _with_series(pairwise.paths(s), s)


@query(f"WITH RECURSIVE {_FLAT} SELECT i, j, (max(k) OVER (PARTITION BY i, j) - k)::INT AS pos, (r - 1)::INT AS at_i, (c - 1)::INT AS at_j FROM w")
def best_paths(spark, sf_dir):
    """The steps of every pair's cheapest path."""
    return _vector_paths(spark, sf_dir).select("i", "j", F.posexplode("path").alias("pos", "p")).select("i", "j", "pos", F.col("p.i").alias("at_i"), F.col("p.j").alias("at_j"))


@query(f"WITH RECURSIVE {_FLAT} SELECT w.i, w.j, (c - 1)::INT AS pos, round(avg(a[r]), 6) AS value FROM w JOIN t ON w.i = t.i AND w.j = t.j GROUP BY w.i, w.j, c")
def warped_vectors(spark, sf_dir):
    """Every series warped onto the others, with its points."""
    return rounded(average.warp(_vector_paths(spark, sf_dir)).select("i", "j", F.posexplode("values").alias("pos", "value")), "value")


@query(f"WITH RECURSIVE {oracle.series('slots')}, p AS (SELECT s.id AS i, o.id AS j, s.v AS a, o.v AS b FROM s, (SELECT * FROM s ORDER BY id LIMIT 1) o), {oracle.best_paths('p')} SELECT (c - 1)::INT AS pos, round(avg(a[r]), 6) AS value FROM w JOIN t ON w.i = t.i AND w.j = t.j GROUP BY c")
def barycenter_step(spark, sf_dir):
    """One round of averaging, from the first series."""
    s = tables.slots(spark, sf_dir)
    center = average.step(s, {0: np.array(s.orderBy("series_id").first()["values"])})[0]
    return rounded(spark.createDataFrame([(p, float(x)) for p, x in enumerate(center)], "pos int, value double"), "value")


#: Knots of one point's weight, from far negative to far positive differences.
KNOTS = (400.0, 150.0, 60.0, 5.0, 10.0, 50.0, 200.0, 500.0)


def _weigh(d: str) -> str:
    def side(u: str, v0: float, v1: float, v2: float, v3: float) -> str:
        return f"CASE WHEN {u} <= {v0} THEN 0 WHEN {u} < {v1} THEN {u} * ({u} - {v0}) / {v1 - v0} WHEN {u} < {v2} THEN {u} ELSE {u} * (1 + 2 * ({u} - {v2}) / {v3 - v2}) END"

    return f"(CASE WHEN {d} < 0 THEN {side(f'-({d})', *KNOTS[3::-1])} ELSE {side(f'({d})', *KNOTS[4:])} END) ** 2"


@query(oracle.all_pairs("slots", f"sqrt(least(list_last({oracle.last_row(cost=_weigh('(x - y)'))}), list_last({oracle.last_row(a='b', b='a', cost=_weigh('(x - y)'))})))"))
def weighted_pairs(spark, sf_dir):
    """The smaller weighted distance of both directions, with the same knots at each point."""
    s = tables.slots(spark, sf_dir)
    knots = s.select("series_id", F.transform("values", lambda x: F.array(*map(F.lit, KNOTS))).alias("knots"))
    return rounded(pairwise.weighted_distances(s, knots))


@query()
def path_segments(spark, sf_dir):
    return symbolize.explanations(tables.slots(spark, sf_dir))


# ---- symbols


@query()
def symbols_cover(spark, sf_dir):
    book = [list(MOTIF), [100.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0]]
    return symbolize.codes(tables.slots(spark, sf_dir), book)


_CODES = f"WITH {oracle.series('hourly')}, x AS (SELECT id, size, p, c, lead(c) OVER w AS n, p - row_number() OVER (PARTITION BY id, c ORDER BY p) AS k FROM (SELECT id, len(v) AS size, generate_subscripts(v, 1) - 1 AS p, CASE WHEN unnest(v) > 60 THEN 1 ELSE 0 END AS c FROM s) WINDOW w AS (PARTITION BY id ORDER BY p)), r AS (SELECT id, size, c, min(p) AS b, max(p) + 1 AS e FROM x GROUP BY id, size, c, k), l AS (SELECT *, lag(c) OVER (PARTITION BY id ORDER BY b) AS last FROM r WHERE e - b >= 4 AND e < size)"


@query(f"{_CODES} SELECT id AS series_id, (c + 1)::BIGINT AS symbol, b AS \"begin\", e AS \"end\" FROM l WHERE last IS NULL OR last <> c")
def hangover_runs(spark, sf_dir):
    coded = tables.hourly(spark, sf_dir).select("series_id", F.transform("values", lambda x: F.when(x > 60, 1).otherwise(0)).alias("codes"))
    return symbolize.hangover(coded, 2)


# ---- tables, alignments, learned weights, smoothing and the SQL surface

from tempora.functions import sql  # noqa: E402
from tempora.operators import learn  # noqa: E402
from tempora.settings import ConcurrenceSettings  # noqa: E402


@query(f"WITH {oracle.pairs('vectors')}, r AS (SELECT i, j, {_dim(1)} AS row, len(a) - 1 AS n FROM p) SELECT i, j, n AS row, unnest(range(len(row) - 1)) AS col, round(sqrt(unnest(row[2:])), 6) AS cost FROM r")
def cost_table_last_rows(spark, sf_dir):
    """The last rows of the pairs' cost tables, in long form."""
    s = tables.vectors(spark, sf_dir).withColumn("values", F.transform("values", lambda v: v[0]))
    cells = pairwise.table_cells(pairwise.cost_tables(s))
    last = s.select(F.col("series_id").alias("i"), (F.size("values") - 1).alias("n"))
    return cells.join(last, "i").where("row = n").select("i", "j", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("cost", 6).alias("cost"))


_SIM = "exp(-100.0 * (cur[1] - b[q[1]::INT][1]) ** 2)"
_BEST = "greatest(0.0, prev[q[1]::INT + 1], prev[q[1]::INT + 2], list_last(row))"
_AFFINE = f"list_reduce(list_transform(range(1, len(b) + 1), lambda k: [k::DOUBLE]), lambda row, q: list_append(row, CASE WHEN {_SIM} < 0.5 THEN greatest(0.0, -1.0 + 0.9 * {_BEST}) ELSE {_SIM} + {_BEST} END), [0.0::DOUBLE])"
#: Rows of the table behind the highest value so far.
_HIGHEST = f"list_reduce(list_transform(a, lambda z: [z[1]::DOUBLE]), lambda prev, cur: list_prepend(greatest(prev[1], list_max({_AFFINE})), {_AFFINE}), list_transform(range(len(b) + 2), lambda k: 0.0::DOUBLE))[1]"


@query(oracle.all_pairs("vectors", _HIGHEST, "highest"))
def affinity_tables(spark, sf_dir):
    s = tables.vectors(spark, sf_dir).withColumn("values", F.transform("values", lambda v: v[0]))
    t = pairwise.affinity_tables(s, ConcurrenceSettings(gamma=100.0, tau=0.5, delta=-1.0, delta_factor=0.9))
    return t.select("i", "j", F.round(F.array_max(F.transform("table", lambda r: F.array_max(r))), 6).alias("highest"))


@query(f"WITH {oracle.series('vectors')}, x AS (SELECT id, k, u, v, unnest(range(len(v))) AS c FROM (SELECT id, k, list_transform(v, lambda z: z[1]) AS v, v[k + 1][1] AS u FROM (SELECT id, v, unnest(range(len(v))) AS k FROM s))) SELECT id AS series_id, k::INT AS row, c::INT AS col, round(CASE WHEN exp(-100.0 * (u - v[c + 1]) ** 2) < 0.5 THEN -1.0 ELSE exp(-100.0 * (u - v[c + 1]) ** 2) END, 6) AS value FROM x WHERE c >= k - 8 AND c < k + 8")
def similarity_cells(spark, sf_dir):
    """Point similarities within each series, in a band."""
    s = tables.vectors(spark, sf_dir).withColumn("values", F.transform("values", lambda v: v[0]))
    return rounded(search.similarity_cells(s, ConcurrenceSettings(gamma=100.0, tau=0.5, delta=-1.0, delta_factor=0.9, window=8)), "value")


@query(oracle.all_pairs("names", _NW, "score").replace(" FROM p", f", round({_NW}, 6) AS along, array_to_string(a, '') AS first, array_to_string(b, '') AS second FROM p"))
def alignments(spark, sf_dir):
    """Alignments, whichever of equal ones: they spell both strings, and score what the pair does."""
    found = pairwise.alignments(tables.names(spark, sf_dir))
    along = F.aggregate(F.zip_with("first", "second", lambda x, y: F.when(x == y, 1.0).otherwise(-1.0)), F.lit(0.0), lambda s, x: s + x)
    spelled = [F.array_join(F.array_remove(c, "-"), "").alias(c) for c in ("first", "second")]
    return rounded(found.select("i", "j", "score", along.alias("along"), *spelled), "score")


@query()
def learned_weights(spark, sf_dir):
    """Weights that tell the slots of the busiest event type from the others, around its mean."""
    label = F.when(F.col("series_id") < 24, 1).otherwise(0).cast("int")
    knots, importance = learn.weights(tables.slots(spark, sf_dir).withColumn("label", label), type_means(spark, sf_dir)[0][1])
    return spark.createDataFrame([(k, float(a), float(b), [float(x) for x in row]) for k, ((a, b), row) in enumerate(zip(importance, knots, strict=True))], "pos int, negative double, positive double, knots array<double>")


@query()
def smoothing(spark, sf_dir):
    sql.register(spark)
    return values_out(tables.raw(spark, sf_dir).withColumn("values", F.expr("ts_smooth(values, 0.1D)")))


@query(oracle.all_pairs("slots", "sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda k: (a[k] - b[k]) ** 2)))"))
def sql_functions(spark, sf_dir):
    """Pairs joined and measured in SQL text."""
    sql.register(spark)
    tables.slots(spark, sf_dir).createOrReplaceTempView("slots")
    return spark.sql("SELECT x.series_id AS i, y.series_id AS j, round(ts_ed(x.values, y.values), 6) AS distance FROM slots x JOIN slots y ON x.series_id < y.series_id")
