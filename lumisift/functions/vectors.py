"""Feature-vector expressions and Arrow-batch helpers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(vec: Column) -> Column:
    """L2-normalised copy as doubles; null for a null, empty or all-zero vector, and for one with NaN or infinity."""
    # The last function of `aggregate` sees the finished sum, so it is added up once.
    return F.aggregate(
        vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"),
        lambda s: F.when((s > 0) & (s < float("inf")), F.transform(vec, lambda x: x.cast("double") / F.sqrt(s))))


def matrix(series: pd.Series) -> np.ndarray:
    """Series of equal-length arrays -> 2-d float64 array."""
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def nearest_rows(x: np.ndarray, centroids: np.ndarray, strip_bytes: int = 32 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of the nearest centroid of each row, ties to the lowest place.

    Worked in strips of rows and of centroids, so that no table of distances is above
    `strip_bytes`, whatever the batch and the number of centroids.
    """
    best, least = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    wide = max(1, min(len(centroids), strip_bytes // 8 // 256))
    tall = max(1, strip_bytes // 8 // wide)
    for r in range(0, len(x), tall):
        rows = slice(r, r + tall)
        for c in range(0, len(centroids), wide):
            d = squared_distances(x[rows], centroids[c:c + wide])
            at = d.argmin(1)
            found = d[np.arange(len(at)), at]
            closer = found < least[rows]
            best[rows][closer], least[rows][closer] = at[closer] + c, found[closer]
    return best, least


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Rounded to 9 places, so that the order of additions cannot decide a tie."""
    d = (x * x).sum(1)[:, None] - 2.0 * (x @ centroids.T) + (centroids * centroids).sum(1)[None, :]
    return np.round(np.maximum(d, 0.0), 9)
