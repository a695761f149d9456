"""Pixel work on decoded images, as Arrow-batched functions.

Images are structs of Spark's `image` source: rows of interleaved 8-bit channels,
in BGR order when there are three or four.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumisift.schemas import IMAGE


def pixel_array(height, width, channels, data) -> np.ndarray | None:
    """height x width x channels bytes, or None when the image was not decoded."""
    if data is None or pd.isna(height) or min(height, width, channels) < 1:
        return None
    height, width, channels = int(height), int(width), int(channels)
    if len(data) != height * width * channels:
        return None
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def area_mean(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of each target cell; source pixels cut by a cell border count in part."""
    out = pixels.astype(np.float64)
    for axis, size in ((0, rows), (1, columns)):
        n = out.shape[axis]
        edges = np.arange(size + 1) * (n / size)
        total = np.concatenate([np.zeros_like(out.take([0], axis)), out.cumsum(axis)], axis)
        low = np.minimum(np.floor(edges).astype(int), n)
        part = np.expand_dims(edges - low, tuple(i for i in range(out.ndim) if i != axis))
        at = total.take(low, axis) + part * out.take(np.minimum(low, n - 1), axis)
        out = np.diff(at, axis=axis) * (size / n)
    return out


def grey_grid(rows: int, columns: int):
    """Pandas UDF: image struct -> flat grey grid of rows x columns doubles."""
    # ITU-R BT.601 luma weights, in BGR order.
    weights = np.array([0.114, 0.587, 0.299])

    @F.pandas_udf("array<double>")
    def grid(image: pd.DataFrame) -> pd.Series:
        cells = []
        for h, w, c, data in zip(image["height"], image["width"], image["nChannels"], image["data"]):
            pixels = pixel_array(h, w, c, data)
            if pixels is None:
                cells.append(None)
                continue
            small = area_mean(pixels, rows, columns)
            grey = small[:, :, :3] @ weights if small.shape[2] >= 3 else small[:, :, 0]
            # Rounded, so that the order of additions cannot flip a comparison.
            cells.append(np.round(grey, 6).ravel())
        return pd.Series(cells, dtype=object)

    return grid


def resize(max_resolution: int):
    """Pandas UDF: image struct -> struct no larger than `max_resolution`, never enlarged."""

    @F.pandas_udf(IMAGE)
    def shrink(image: pd.DataFrame) -> pd.DataFrame:
        sizes, data = [], []
        for h, w, c, raw in zip(image["height"], image["width"], image["nChannels"], image["data"]):
            pixels = pixel_array(h, w, c, raw)
            if pixels is None:
                sizes.append((h, w))
                data.append(None)
                continue
            new_h, new_w = (target_size(x, max(h, w), max_resolution) for x in (h, w))
            sizes.append((new_h, new_w))
            if (new_h, new_w) == (h, w):
                data.append(bytes(raw))
            else:
                data.append(np.floor(area_mean(pixels, new_h, new_w) + 0.5).astype(np.uint8).tobytes())
        out = image.copy()
        out["height"] = pd.array([s[0] for s in sizes], dtype="Int32")
        out["width"] = pd.array([s[1] for s in sizes], dtype="Int32")
        out["data"] = pd.Series(data, index=out.index, dtype=object)
        return out

    return shrink


def target_size(side: int, longest: int, max_resolution: int) -> int:
    scale = min(1.0, max_resolution / longest)
    return max(1, int(np.floor(side * scale + 0.5)))
