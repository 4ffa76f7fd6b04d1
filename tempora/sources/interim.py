"""Intermediate tables that are written once and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df, written below spark.checkpoint.dir (else the warehouse), which driver and executors share.

    What is read from it several times is computed once and outlives lost executors. The
    folder stays, as the result may be read at any time.
    """
    conf = df.sparkSession.conf
    root = conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/tempora-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
