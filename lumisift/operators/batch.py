"""Running a user's model over rows in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumisift.schemas import require

BatchFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def infer_batch(df: DataFrame, fn: BatchFn, schema: str | T.StructType, id_col: str = "id") -> DataFrame:
    """Apply `fn`, an iterator of frames to an iterator of frames, inside each task.

    `fn` loads its model once, before its first batch. It must return exactly the
    ids it was given: counts and an order-free checksum are compared per task, in
    constant memory, and the job fails when they differ.
    """
    require(df, id_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {"in": (0, 0), "out": (0, 0)}

        def note(side: str, ids: pd.Series) -> None:
            n, total = seen[side]
            hashes = pd.util.hash_pandas_object(ids.reset_index(drop=True), index=False)
            seen[side] = n + len(ids), (total + int(hashes.sum())) % (1 << 64)

        def given() -> Iterator[pd.DataFrame]:
            for batch in batches:
                note("in", batch[id_col])
                yield batch

        for result in fn(given()):
            note("out", result[id_col])
            yield result
        if seen["in"] != seen["out"]:
            raise ValueError(f"model returned {seen['out'][0]} ids for {seen['in'][0]}, or other ones")

    return df.mapInPandas(run, schema)
