"""What the corpus operators share: table access, shared folders, Arrow streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker turns over at once; bounds its memory, not what it reads.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see: below spark.checkpoint.dir, or else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tempora-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage durably."""
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._tempora_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing is to be computed from it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tempora_path.rpartition("/")[0])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: Iterable[str], name: str) -> str:
    """`name`, or it with underscores after it, such that none of the columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their names, whatever characters are in them."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


_caches: list[dict] = []


def cached(cache: dict) -> dict:
    """Registers what a Python worker keeps between tasks."""
    _caches.append(cache)
    return cache


def only(*caches: dict) -> None:
    """Empties all other caches of this worker: it is used again for other operators, and keeps one's at a time."""
    for c in _caches:
        if not any(c is k for k in caches):
            c.clear()


def by_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a record batch whose column holds about `limit` bytes, one row at least."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > begin and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def stream(df: DataFrame, columns: list[str], step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """Applies `step` to blocks of the named columns, Arrow to Arrow, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in by_blocks(batch, text):
                yield step(block)
            pa.default_memory_pool().release_unused()

    return df.select(*columns).mapInArrow(run, schema)
