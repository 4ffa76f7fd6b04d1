"""Series from long tables and arrays, and checks of their values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is done with series that hold nulls or NaN.
POLICIES = ("error", "drop", "interpolate")


def from_rows(spark: SparkSession, series: Iterable[Sequence], first_id: int = 0) -> DataFrame:
    """series_id, values of in-memory series of numbers or of vectors."""
    rows = [(k, [list(map(float, x)) if hasattr(x, "__len__") else float(x) for x in s]) for k, s in enumerate(series, first_id)]
    deep = any(v and isinstance(v[0], list) for _, v in rows)
    return spark.createDataFrame(rows, f"series_id long, values {'array<array<double>>' if deep else 'array<double>'}")


def from_long(rows: DataFrame, key: str, order: Sequence[str], value: str | Column) -> DataFrame:
    """One series for each key: its values in the given order; the order should be total."""
    value = F.col(value) if isinstance(value, str) else value
    held = F.array_sort(F.collect_list(F.struct(*order, value.cast("double").alias("__value"))))
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("series_id")).agg(F.transform(held, lambda x: x["__value"]).alias("values"))


def from_calendar(rows: DataFrame, key: str, bucket: Column, buckets: int, value: Column, fill: float = 0.0) -> DataFrame:
    """Series of fixed length: value (an aggregate) for each bucket number 0, 1, ...; buckets without rows hold `fill`."""
    cells = rows.groupBy(F.col(key).cast("long").alias("series_id"), bucket.cast("int").alias("b")).agg(value.cast("double").alias("v"))
    held = F.map_from_entries(F.collect_list(F.struct("b", "v")))
    at = F.sequence(F.lit(0), F.lit(buckets - 1))
    return cells.groupBy("series_id").agg(held.alias("m")).select("series_id", F.transform(at, lambda b: F.coalesce(F.try_element_at("m", b), F.lit(fill))).alias("values"))


def is_nested(series: DataFrame) -> bool:
    return "array<array" in dict(series.dtypes)["values"]


def checked(series: DataFrame, policy: str = "error") -> DataFrame:
    """Series without nulls and NaN: others raise, are left out, or are filled between their neighbours."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    if is_nested(series):
        bad = F.exists("values", lambda p: p.isNull() | F.exists(p, lambda x: x.isNull() | F.isnan(x)))
    else:
        bad = F.exists("values", lambda x: x.isNull() | F.isnan(x))
    if policy == "drop":
        return series.where(~bad)
    if policy == "error" or is_nested(series):
        return series.withColumn("values", F.when(bad, F.raise_error(F.lit("a series holds null or NaN"))).otherwise(F.col("values")))
    v = F.transform("values", lambda x: F.when(~F.isnan(x), x))
    known = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].isNotNull())

    def fill(x: Column, i: Column) -> Column:
        before, after = F.element_at(F.filter("__known", lambda p: p["i"] < i), -1), F.get(F.filter("__known", lambda p: p["i"] > i), F.lit(0))
        between = before["x"] + (after["x"] - before["x"]) * (i - before["i"]) / (after["i"] - before["i"])
        return F.coalesce(x, between, before["x"], after["x"])

    rows = series.withColumn("__known", known).withColumn("values", v)
    return rows.withColumn("values", F.transform("values", fill)).where(F.size("__known") > 0).drop("__known")


def statistics(series: DataFrame) -> DataFrame:
    """Least and largest value, longest and mean length over the set."""
    return series.agg(F.min(F.array_min("values")).alias("min_value"), F.max(F.array_max("values")).alias("max_value"), F.max(F.size("values")).alias("max_length"), F.avg(F.size("values")).alias("avg_length"), F.count("*").alias("n_series"))


def substitution_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, score) of a white-space separated matrix: column symbols first, then one row for each symbol; # starts a comment."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    cells = lines.select("n", F.filter(F.split(F.trim(F.split("line", "#")[0]), r"\s+"), lambda x: x != "").alias("c")).where(F.size("c") > 0)
    head = cells.orderBy("n").limit(1).select(F.col("n").alias("n0"), F.col("c").alias("head"))
    rows = cells.join(F.broadcast(head), F.col("n") > F.col("n0")).select(F.col("c")[0].alias("b"), F.posexplode(F.slice("c", F.lit(2), F.size("c"))).alias("k", "score"), "head")
    return rows.select(F.get("head", F.col("k")).alias("a"), "b", F.col("score").cast("double").alias("score")).where("a is not null")


def bursts(spark: SparkSession, n: int, length: int, wave: int, seed: int = 0) -> DataFrame:
    """n series of zeros with one sine period at a place drawn by series."""
    from tempora.functions.columns import sine_burst

    start = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, length - wave))).cast("int")
    return spark.range(n).select(F.col("id").alias("series_id"), sine_burst(length, start, wave).alias("values"))


def transients(spark: SparkSession, n: int, length: int, pulse: int, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """n series with a damped oscillation after an onset, plus noise; all drawn by series id and seed."""

    def uniform(tag: str, *more: Column) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(tag), F.lit(seed), *more), F.lit(1_000_003)) / 1_000_003.0

    t = F.sequence(F.lit(0), F.lit(length - 1))
    rows = spark.range(n).select("id", F.floor(uniform("onset") * (length - pulse)).alias("x0"), (0.5 + uniform("height")).alias("h"), (3 + 4 * uniform("speed")).alias("w"))

    def point(x: Column) -> Column:
        s = (x - F.col("x0")) / F.lit(float(pulse))
        wave = F.when(s >= 0, F.col("h") * F.exp(-3 * s) * F.sin(F.col("w") * s * 6.283185307179586)).otherwise(0.0)
        return wave + noise * (2 * F.pmod(F.xxhash64("id", x, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0 - 1)

    return rows.select(F.col("id").alias("series_id"), F.transform(t, point).alias("values"))
