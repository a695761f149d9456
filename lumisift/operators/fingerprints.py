"""Perceptual hashes of images and similarity hashes of token sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumisift.functions import hashing as hs
from lumisift.functions.pixels import grey_grid
from lumisift.schemas import require

# Counters packed into one bigint: two of 30 bits. A text would need 2**30 words
# to overflow one, more than a 2 GB string can hold.
_STRIDE = 30
# Tokens whose counters a task adds up at a time.
_HELD_TOKENS = 1 << 18


def grid_fingerprint(df: DataFrame, grid: str = "grid", kind: str = "average") -> DataFrame:
    """Add `hi`, `lo` (32 bits each) and their 64-bit `hash` from a grey grid."""
    require(df, grid)
    hi, lo = hs.grid_halves("_cells", "_mean", kind)
    # Cells and mean are columns of their own, computed once and not once per bit.
    return (df.withColumn("_cells", F.col(grid).cast("array<double>"))
            .withColumn("_mean", hs.grid_mean(F.col("_cells")))
            .withColumns({"hi": hi, "lo": lo})
            .withColumn("hash", hs.join_halves(F.col("hi"), F.col("lo"))).drop("_cells", "_mean"))


def image_fingerprint(df: DataFrame, kind: str = "average", image: str = "image") -> DataFrame:
    """Perceptual hash of decoded images; an undecodable image has a null hash."""
    require(df, image)
    rows, columns = (8, 9) if kind == "difference" else (8, 8)
    gridded = df.withColumn("_grid", grey_grid(rows, columns)(F.col(image)))
    return grid_fingerprint(gridded, "_grid", kind).drop("_grid")


def simhash(df: DataFrame, tokens: Column, id_col: str = "id") -> DataFrame:
    """60-bit similarity hash per id: bit set if more token occurrences have it than not.

    Tasks hash each different token of an Arrow batch once and add up packed counters per
    row. Column j counts the bits j and j + 30 of all tokens at once, so 30 sums do the
    work of 60 and 32 numbers per row are all that is shuffled. An id without tokens has
    no hash.
    """
    require(df, id_col)
    rows = df.select(F.col(id_col).alias("id"), tokens.cast("array<string>").alias("_t"))
    sums = [f"_s{j}" for j in range(_STRIDE)]
    schema = StructType([rows.schema["id"], *(StructField(c, LongType()) for c in ("_n", *sums))])
    low = (1 << _STRIDE) - 1
    # Long expressions are written as SQL text: one call to the JVM instead of hundreds.
    votes = [f"(_s{j} & {low}L)" for j in range(_STRIDE)] + [f"shiftright(_s{j}, {_STRIDE})" for j in range(_STRIDE)]
    bits = [f"if({v} * 2 > _n, {1 << j}L, 0L)" for j, v in enumerate(votes)]
    return (rows.mapInArrow(_token_votes, schema).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("_n", *sums)])
            .select("id", F.expr(" | ".join(bits)).alias("hash")))


def _token_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens) -> (id, number of tokens, packed counters) of the rows that have any."""
    mask = (1 << _STRIDE) | 1
    for batch in batches:
        ids, tokens = batch.columns
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        some = sizes > 0
        ids, sizes = ids.filter(pa.array(some)), sizes[some]
        words = tokens.flatten().dictionary_encode()
        # The last place is that of a null token, which has no bit.
        hashes = np.array([hs.md5_bits(w) for w in words.dictionary.cast(pa.binary()).to_pylist()] + [0], np.int64)
        codes = pc.fill_null(words.indices, len(hashes) - 1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            begin = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, begin + _HELD_TOKENS, "right")))
            h = hashes[codes[begin:ends[to - 1]]]
            starts = ends[at:to] - sizes[at:to] - begin
            sums = [pa.array(np.add.reduceat((h >> j) & mask, starts)) for j in range(_STRIDE)]
            yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), pa.array(sizes[at:to]), *sums], ["id", "_n", *(f"_s{j}" for j in range(_STRIDE))])
            at = to
