"""Position weights from series labelled as alike or not: features by tasks, trees on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tempora.kernels import tree
from tempora.operators.pairwise import _values

#: Labelled series whose features come to the driver: their number is checked.
MAX_LABELLED = 50_000


def features(labelled: DataFrame, prototype: Sequence[float], window: int | None = None) -> DataFrame:
    """(series_id, features, label): mean negative and positive deviation from each point of the prototype."""
    first = np.asarray(prototype, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = tree.deviations(first, _values(pa.chunked_array([batch.column(1)])), window)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows.tolist(), pa.list_(pa.float64())), batch.column(2)], ["series_id", "features", "label"])

    return labelled.select("series_id", "values", "label").mapInArrow(run, "series_id long, features array<double>, label int")


def weights(labelled: DataFrame, prototype: Sequence[float], window: int | None = None, **options) -> tuple[np.ndarray, np.ndarray]:
    """(knots, importance) for a prototype, from rows (series_id, values, label): 1 must link, 0 can't."""
    rows = features(labelled, prototype, window).orderBy("series_id").limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled series")
    return tree.weights_from(np.array([r["features"] for r in rows]).reshape(len(rows), -1), np.array([r["label"] for r in rows]), **options)
