"""Series that the registered queries are run on, each from a whole table, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.sources import series


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _extent(spark: SparkSession, sf_dir: str) -> tuple[Column, int, list[str]]:
    """The number of each event's day, from 0; how many days the events span; and all their types: a handful."""
    row = read(spark, sf_dir, "events").agg(F.to_date(F.min("ts")), F.to_date(F.max("ts")), F.array_sort(F.collect_set("event_type"))).first()
    first, last, types = row
    return F.datediff(F.col("ts"), F.lit(first)), (last - first).days + 1 if first else 0, types


def slot_count(spark: SparkSession, sf_dir: str) -> int:
    return 24 * len(_extent(spark, sf_dir)[2])


def _typed(spark: SparkSession, sf_dir: str, types: list[str]) -> DataFrame:
    """Events with the number of their type; those without a type belong to no series."""
    known = F.array(*map(F.lit, types)).cast("array<string>")
    return read(spark, sf_dir, "events").where("event_type is not null").withColumn("type", F.array_position(known, F.col("event_type")) - 1)


def _slot() -> Column:
    return F.col("type") * 24 + F.hour("ts")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's event values in order."""
    return series.from_long(read(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), "value")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's daily sums."""
    day, days, _ = _extent(spark, sf_dir)
    return series.from_calendar(read(spark, sf_dir, "events"), "user_id", day, days, F.sum("value"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of each event type in each hour of the day: 24 series a type."""
    day, days, types = _extent(spark, sf_dir)
    return series.from_calendar(_typed(spark, sf_dir, types).withColumn("slot", _slot()), "slot", day, days, F.sum("value"))


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As slots, but only the days that have events: series of unequal length."""
    rows = _typed(spark, sf_dir, _extent(spark, sf_dir)[2]).withColumn("slot", _slot())
    cells = rows.groupBy("slot", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return series.from_long(cells, "slot", ("day",), "v")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of each event type: one long series a type."""
    day, days, types = _extent(spark, sf_dir)
    return series.from_calendar(_typed(spark, sf_dir, types), "type", day * 24 + F.hour("ts"), days * 24, F.sum("value"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly quantities of each supplier."""
    rows = read(spark, sf_dir, "lineitem")
    number = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    first, last = rows.agg(F.min(number), F.max(number)).first()
    return series.from_calendar(rows, "l_suppkey", number - F.lit(first), last - first + 1 if first else 0, F.sum("l_quantity"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean embeddings by label as series of 2-dimensional points."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("series_id"), F.posexplode("embedding").alias("p", "x"))
    cells = rows.groupBy("series_id", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    flat = cells.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("v"))
    return flat.select("series_id", F.expr("transform(sequence(0, size(v) div 2 - 1), i -> array(v[2 * i], v[2 * i + 1]))").alias("values"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names as arrays of characters."""
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("series_id"), F.split("n_name", "").alias("values"))


def _filled(key: str, source: str, bucket: str, n: str, value: str) -> str:
    return f"""SELECT k AS id, list(coalesce(v, 0)::DOUBLE ORDER BY b) AS v FROM (SELECT DISTINCT {key} AS k FROM {source}) CROSS JOIN (SELECT unnest(range({n})) AS b)
LEFT JOIN (SELECT {key} AS k, {bucket} AS b, {value} AS v FROM {source} GROUP BY ALL) USING (k, b) GROUP BY k"""


_DAY = "date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE)"
_DAYS = "(SELECT date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 FROM events)"
_TYPE = "list_position((SELECT list(DISTINCT event_type ORDER BY event_type) FROM events), event_type) - 1"
_SLOT = f"(SELECT *, ({_TYPE}) * 24 + hour(ts) AS slot, {_TYPE} AS type FROM events WHERE event_type IS NOT NULL)"
_MONTH = "year(l_shipdate) * 12 + month(l_shipdate)"
_MONTHS = f"(SELECT max({_MONTH}) - min({_MONTH}) + 1 FROM lineitem)"
SQL = {
    "raw": "SELECT user_id AS id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id",
    "daily": _filled("user_id", "events", _DAY, _DAYS, "sum(value)"),
    "slots": _filled("slot", _SLOT, _DAY, _DAYS, "sum(value)"),
    "ragged": f"SELECT slot AS id, list(v ORDER BY d) AS v FROM (SELECT slot, {_DAY} AS d, avg(value) AS v FROM {_SLOT} GROUP BY ALL) GROUP BY slot",
    "hourly": _filled("type", _SLOT, f"{_DAY} * 24 + hour(ts)", f"{_DAYS} * 24", "sum(value)"),
    "suppliers": _filled("l_suppkey", "lineitem", f"{_MONTH} - (SELECT min({_MONTH}) FROM lineitem)", _MONTHS, "sum(l_quantity)"),
    "vectors": "SELECT label AS id, list_transform(range(len(v) // 2), lambda i: [v[2 * i + 1], v[2 * i + 2]]) AS v FROM (SELECT label, list(x ORDER BY p) AS v FROM (SELECT label, p, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY ALL) GROUP BY label)",
    "names": "SELECT n_nationkey::BIGINT AS id, string_split(n_name, '') AS v FROM nation",
}
