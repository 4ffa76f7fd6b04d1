"""Plain callables for libraries that take a distance function of two series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tempora.kernels import dtw
from tempora.settings import DistanceSettings


def distance_function(**settings) -> Callable[[object, object], float]:
    """f(x, y) of two arrays or tables; of tables, the first column counts."""
    s = DistanceSettings(**settings)

    def first_column(x) -> np.ndarray:
        values = np.asarray(x, float)
        return values if values.ndim == 1 else values[:, 0]

    return lambda x, y: float(dtw.distances([first_column(x)], [first_column(y)], s)[0])
