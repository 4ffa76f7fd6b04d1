"""All-pairs operators: self-joins, joins of two sets, rectangles of the pair space.

Series are dealt to blocks of about BLOCK, or up to WIDEST times that if there are many, and
every pair of blocks is one group of at most two blocks that a task turns into all of its pairs.
So a series is moved once for each block, not once for each partner, and a group's size is
bounded whatever the number of series. Pair rows exist only as (i, j, result).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tempora.functions import columns
from tempora.kernels import dtw, measures
from tempora.settings import ConcurrenceSettings, DistanceSettings

BLOCK = 128
#: From ENOUGH blocks on, blocks grow rather than become more, up to WIDEST times BLOCK.
ENOUGH, WIDEST = 24, 8
#: Equal series that are kept together, so that a group compares them once.
COPIES = 128
#: Groups that a task works off one after the other, if there are more than shuffle partitions.
GROUPS = 8
#: Pairs of series that a task hands to a kernel at once.
PAIRS = 16_384

Kernel = Callable[[list, list], Sequence]
Rectangle = tuple[tuple[int, int], tuple[int, int]]


def block_count(n: int) -> int:
    """Blocks that n series are dealt to."""
    return max(1, -(-n // min(max(BLOCK, -(-n // ENOUGH)), WIDEST * BLOCK)))


def block_pairs(series: DataFrame, other: DataFrame | None, kernel: Kernel, result: str, block: Rectangle | None = None, triangle: bool = True, column: str = "values") -> DataFrame:
    """(i, j, result...) of the kernel over pairs of series and other; of series with itself, i < j, if there is no other.

    result: the schema of one kernel result, e.g. `distance double`; a kernel gives one value
    for each pair, or a tuple if result has several columns. A kernel with an attribute `among`
    gives this instead from all series of a group and two arrays of their numbers. One with an
    attribute `across` gives a self-join's groups as a matrix of two lists of series, or None
    if it doesn't hold for them; it takes no account of which of a pair comes first. `nulls`:
    pairs of series that hold nulls have no result. With a rectangle of ids the triangle
    applies as well unless it is turned off.
    """
    among, across, nulls = (getattr(kernel, name, None) for name in ("among", "across", "nulls"))
    left = series.select(F.col("series_id").alias("id"), F.col(column).alias("v"))
    right = left if other is None else other.select(F.col("series_id").alias("id"), F.col(column).alias("v"))
    if block:
        (rb, re), (cb, ce) = block
        left, right = left.where(f"id >= {rb} and id < {re}"), right.where(f"id >= {cb} and id < {ce}")
    left, right = left.where("id is not null"), right.where("id is not null")
    same = other is None and block is None
    n = left.count()
    m = n if same else right.count()
    rows, cols = block_count(n), block_count(m)
    deal = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    if same and across and rows > 1:
        # equal series meet in a block, but no more than COPIES of them
        copies = left.groupBy(F.xxhash64("v").alias("h")).agg(F.ceil(F.count("*") / COPIES).alias("parts")).where("parts > 1")
        left = left.withColumn("h", F.xxhash64("v")).join(copies, "h", "left")
        deal = lambda k: F.pmod(F.pmod("h", F.lit(k)) + F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))), F.lit(k)).cast("int")
    if same:
        # block b meets all blocks: as the smaller or as the larger of the two
        met = F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
        sent = left.withColumn("own", deal(rows)).withColumn("met", met).select(F.least("own", "met").alias("r"), F.greatest("own", "met").alias("c"), (F.col("own") <= F.col("met")).alias("first"), (F.col("own") >= F.col("met")).alias("second"), "id", "v")
    else:
        a = left.withColumn("r", deal(rows)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))).select("r", "c", F.lit(True).alias("first"), F.lit(False).alias("second"), "id", "v")
        b = right.withColumn("c", deal(cols)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).select("r", "c", F.lit(False).alias("first"), F.lit(True).alias("second"), "id", "v")
        sent = a.unionByName(b)
    ordered = other is None and triangle
    fields = [f.split()[0] for f in result.split(", ")] if "<" not in result else [result.split()[0]]
    arrow = pa.schema([("i", pa.int64()), ("j", pa.int64())])

    def work(table: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
        ids = table.column("id").to_pylist()
        values = _values(table.column("v"))
        firsts = np.flatnonzero(np.array(table.column("first").to_pylist()))
        seconds = np.flatnonzero(np.array(table.column("second").to_pylist()))
        key = np.array(ids, np.int64)
        diagonal = same and table.column("r")[0] == table.column("c")[0]
        gaps = _gaps(table.column("v")) if nulls else np.zeros(len(key), bool)
        if same and across:
            (a, x), (b, y) = (_distinct([values[k] for k in side]) for side in (firsts, seconds))
            whole = across(a, b)
            if whole is not None:
                whole = whole[np.ix_(x, y)]
                i, j = np.broadcast_to(key[firsts][:, None], whole.shape), np.broadcast_to(key[seconds][None], whole.shape)
                empty = gaps[firsts][:, None] | gaps[seconds][None]
                # two blocks hold different series: the smaller id goes first
                keep = i < j if diagonal else i != j
                if not keep.all():
                    i, j, whole, empty = i[keep], j[keep], whole[keep], empty[keep]
                columns = [pa.array(np.minimum(i, j).ravel()), pa.array(np.maximum(i, j).ravel()), pa.array(whole.ravel(), target[0], mask=empty.ravel() if empty.any() else None)]
                return pa.Table.from_arrays(columns, [*arrow.names, *fields])
        out_i, out_j, out_v, out_gaps = [], [], [], []

        def flush(p: np.ndarray, q: np.ndarray) -> None:
            got = among(values, p, q) if among else kernel([values[k] for k in p], [values[k] for k in q])
            out_i.append(key[p])
            out_j.append(key[q])
            out_v.append(got)
            out_gaps.append(gaps[p] | gaps[q])

        p, q = (x.ravel() for x in np.meshgrid(firsts, seconds, indexing="ij"))
        if diagonal:
            keep = key[p] < key[q]
            p, q = p[keep], q[keep]
        elif same:  # two blocks hold different series: the smaller id goes first
            swap = key[p] > key[q]
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            keep = key[p] != key[q]
            p, q = p[keep], q[keep]
        elif ordered:
            keep = key[p] < key[q]
            p, q = p[keep], q[keep]
        for at in range(0, len(p), PAIRS):
            flush(p[at : at + PAIRS], q[at : at + PAIRS])
        i = np.concatenate(out_i) if out_i else np.zeros(0, np.int64)
        j = np.concatenate(out_j) if out_j else np.zeros(0, np.int64)
        if out_v and all(isinstance(v, np.ndarray) for v in out_v):
            results = [pa.array(np.concatenate(out_v), target[0], mask=np.concatenate(out_gaps))]
        else:
            rows = [v for got in out_v for v in got]
            results = [pa.array(rows, target[0])] if len(fields) == 1 else [pa.array([v[k] for v in rows], t) for k, t in enumerate(target)]
        return pa.Table.from_arrays([pa.array(i), pa.array(j), *results], [*arrow.names, *fields])

    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"i long, j long, {result}"
    empty = series.sparkSession.createDataFrame([], schema)
    target = [to_arrow_type(f.dataType) for f in empty.schema.fields[2:]]
    groups = rows * (rows + 1) // 2 if same else rows * cols
    tasks = min(groups, max(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // GROUPS))
    # a fixed number of tasks: they compute far longer than the bytes that they read suggest
    return sent.repartition(tasks, "r", "c").groupBy("r", "c").applyInArrow(work, schema)


def _distinct(values: list) -> tuple[list, np.ndarray]:
    """The different arrays among values, and the place of each value's own."""
    places: dict[bytes, int] = {}
    at = np.array([places.setdefault(np.asarray(v, np.float64).tobytes(), len(places)) for v in values], np.int64)
    return [values[k] for k in np.unique(at, return_index=True)[1]], at


def _gaps(column: pa.ChunkedArray) -> np.ndarray:
    """Which rows of a nested column are null or hold nulls."""
    out = np.zeros(len(column), bool)
    if column.null_count + sum(chunk.flatten().null_count for chunk in column.chunks):
        out[:] = [v is None or any(x is None for x in v) for v in column.to_pylist()]
    return out


def _values(column: pa.ChunkedArray) -> list:
    """Rows of a nested column as arrays, without a Python number for each value."""
    out = []
    for chunk in column.chunks:
        if pa.types.is_list(chunk.type.value_type):
            out += [np.array(v, np.float64) for v in chunk.to_pylist()]
        elif pa.types.is_floating(chunk.type.value_type):
            flat, at = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
            out += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        else:
            out += chunk.to_pylist()
    return out


def distances(series: DataFrame, settings: DistanceSettings = DistanceSettings(), other: DataFrame | None = None, block: Rectangle | None = None, triangle: bool = True) -> DataFrame:
    """(i, j, distance): DTW over all pairs; vectors at each time make it the dependent n-dimensional form."""

    def kernel(a: list, b: list) -> np.ndarray:
        return dtw.distances(a, b, settings)

    def across(a: list, b: list) -> np.ndarray | None:
        return dtw.distances_across(a, b, settings) if dtw.across_holds([*a, *b], settings) else None

    kernel.among = lambda values, p, q: dtw.distances_among(values, p, q, settings)
    kernel.across = across
    return block_pairs(series, other, kernel, "distance double", block, triangle)


def independent_distances(series: DataFrame, settings: DistanceSettings = DistanceSettings(), block: Rectangle | None = None) -> DataFrame:
    """The sum of the dimensions' own DTW distances."""

    def kernel(a: list, b: list) -> np.ndarray:
        return sum(dtw.distances([x[:, d] for x in a], [y[:, d] for y in b], settings) for d in range(a[0].shape[1])) if a else np.zeros(0)

    return block_pairs(series, None, kernel, "distance double", block)


def euclidean_distances(series: DataFrame, settings: DistanceSettings = DistanceSettings(), block: Rectangle | None = None) -> DataFrame:
    """Pairs of series that hold nulls have no distance."""
    numbers = isinstance(series.schema["values"].dataType.elementType, NumericType) and not callable(settings.inner)
    if numbers:
        series = series.withColumn("values", F.col("values").cast("array<double>"))

    def kernel(a: list, b: list) -> np.ndarray:
        return np.array([dtw.euclidean(x, y, settings) for x, y in zip(a, b, strict=True)], np.float64)

    def across(a: list, b: list) -> np.ndarray | None:
        return dtw.euclidean_across(a, b, settings) if numbers and all(len(v) for v in [*a, *b]) else None

    kernel.across, kernel.nulls = across, numbers
    return block_pairs(series, None, kernel, "distance double", block)


def split_merge_distances(series: DataFrame, cost: float = 0.1, block: Rectangle | None = None) -> DataFrame:
    return block_pairs(series, None, lambda a, b: measures.split_merge_all(a, b, cost), "distance double", block)


def weighted_distances(series: DataFrame, weights: DataFrame | dict[int, Sequence], window: int | None = None) -> DataFrame:
    """The smaller of both directions, each weighted by its first series; weights: (series_id, knots), eight knots for each point.

    Knots go with their points (as a point's second to ninth value), so none are broadcast; a
    series without knots has no pairs.
    """
    if isinstance(weights, dict):
        rows = [(int(k), np.asarray(w, float).tolist()) for k, w in weights.items()]
        weights = series.sparkSession.createDataFrame(rows, "series_id long, knots array<array<double>>")
    points = F.zip_with("values", "knots", lambda x, k: F.concat(F.array(x), k))
    tagged = series.select("series_id", "values").join(weights.select("series_id", "knots"), "series_id").select("series_id", points.alias("values"))

    return block_pairs(tagged, None, lambda a, b: measures.weighted_all(a, b, window), "distance double")


def alignment_scores(strings: DataFrame, scores: dict[tuple[str, str], float] | None = None, gap: float = 1.0) -> DataFrame:
    """(i, j, score): Needleman-Wunsch over all pairs of (series_id, values array<string>)."""
    cost = measures.substitution(scores, gap) if scores else measures.plain
    return block_pairs(strings, None, lambda a, b: [-measures.accumulate(x, y, cost)[0] for x, y in zip(a, b, strict=True)], "score double")


def paths(series: DataFrame, settings: DistanceSettings = DistanceSettings(), other: DataFrame | None = None, tie: str = "up", block: Rectangle | None = None) -> DataFrame:
    """(i, j, distance, path): the cheapest path of every pair."""

    def kernel(a: list, b: list) -> list:
        d, trails = dtw.warped(a, b, settings, tie)
        return [{"distance": float(x), "path": [{"i": int(i), "j": int(j)} for i, j in t]} for x, t in zip(d, trails, strict=True)]

    out = block_pairs(series, other, kernel, "warp struct<distance: double, path: array<struct<i: int, j: int>>>", block)
    return out.select("i", "j", "warp.distance", "warp.path")


def cost_tables(series: DataFrame, settings: DistanceSettings = DistanceSettings(), block: Rectangle | None = None) -> DataFrame:
    """(i, j, distance, table): accumulated costs as distances, border row and column first; for few, short pairs."""

    def kernel(a: list, b: list) -> list:
        return [{"distance": d, "table": t.tolist()} for d, t in (dtw.table_of(x, y, settings) for x, y in zip(a, b, strict=True))]

    return block_pairs(series, None, kernel, "t struct<distance: double, table: array<array<double>>>", block).select("i", "j", "t.distance", "t.table")


def table_cells(tables: DataFrame) -> DataFrame:
    """(i, j, row, col, cost): the reachable cells of cost tables, without the border."""
    rows = tables.select("i", "j", F.posexplode("table").alias("row", "line")).where("row > 0")
    cells = rows.select("i", "j", F.col("row").alias("r"), F.posexplode("line").alias("c", "cost")).where("c > 0")
    return cells.where(F.col("cost") != float("inf")).select("i", "j", (F.col("r") - 1).alias("row"), (F.col("c") - 1).alias("col"), "cost")


def affinity_tables(series: DataFrame, settings: ConcurrenceSettings, block: Rectangle | None = None) -> DataFrame:
    """(i, j, table): accumulated affinities of every pair."""
    s = settings

    def kernel(a: list, b: list) -> list:
        return [dtw.affinity_table(x, y, s.gamma, s.tau, s.delta, s.delta_factor, s.penalty, s.window, s.only_triu, s.steps).tolist() for x, y in zip(a, b, strict=True)]

    return block_pairs(series, None, kernel, "table array<array<double>>", block)


def alignments(strings: DataFrame, scores: dict[tuple[str, str], float] | None = None, gap: float = 1.0) -> DataFrame:
    """(i, j, score, first, second): the aligned sequences of every pair, with gaps."""
    cost = measures.substitution(scores, gap) if scores else measures.plain

    def kernel(a: list, b: list) -> list:
        return [{k: (float(m[k]) if k == "score" else list(m[k])) for k in ("score", "first", "second")} for m in (measures.global_alignment(x, y, cost) for x, y in zip(a, b, strict=True))]

    return block_pairs(strings, None, kernel, "m struct<score: double, first: array<string>, second: array<string>>").select("i", "j", "m.score", "m.first", "m.second")


def column_pairs(series: DataFrame, expression: Callable[[Column, Column], Column], name: str = "distance", keep: Column | None = None) -> DataFrame:
    """All pairs i < j by an expression of both value columns, in the JVM: an equi-join of block pairs."""
    k = block_count(series.count())
    a = series.select(F.col("series_id").alias("i"), F.col("values").alias("a"), F.pmod(F.xxhash64("series_id"), F.lit(k)).alias("own"))
    sent = a.withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<long>"))).withColumns({"r": F.least("own", "met"), "c": F.greatest("own", "met")})
    # block own meets every block, as the smaller or as the larger of the two
    left = sent.where("own <= met").select("i", "a", "r", "c")
    right = sent.where("own >= met").select(F.col("i").alias("j"), F.col("a").alias("b"), "r", "c")
    met = left.join(right, ["r", "c"]).where((F.col("r") < F.col("c")) | (F.col("i") < F.col("j")))
    turned = F.col("i") > F.col("j")
    pick = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    pairs = met.where("i <> j").select(pick("i", "j", "i"), pick("j", "i", "j"), pick("a", "b", "a"), pick("b", "a", "b"))
    if keep is not None:
        pairs = pairs.where(keep)
    return pairs.select("i", "j", expression(F.col("a"), F.col("b")).alias(name))


def envelope_bounds(series: DataFrame, window: int | None = None) -> DataFrame:
    return column_pairs(series, lambda a, b: columns.envelope_bound(a, b, window), "bound")


def matrix(pairs: DataFrame, n: int, mirror: bool = True, value: str = "distance") -> np.ndarray:
    """A dense matrix on the driver, for small sets only: infinite where there is no pair, 0 on the diagonal if mirrored."""
    if n > 20_000:
        raise ValueError("a dense matrix of more than 20,000 series isn't made on the driver")
    out = np.full((n, n), np.inf)
    for i, j, d in pairs.select("i", "j", value).collect():
        out[i, j] = d
        if mirror:
            out[j, i] = d
    if mirror:
        np.fill_diagonal(out, 0)
    return out


def pair_count(n: int, block: Rectangle | None = None, triangle: bool = True) -> int:
    """Pairs of a self-join of n series, or of a rectangle of it."""
    if block is None:
        return n * (n - 1) // 2
    (rb, re), (cb, ce) = block
    return sum(max(0, ce - max(cb, r + 1)) for r in range(rb, re)) if triangle else (re - rb) * (ce - cb)
