"""Row shapes shared by the operators, and the check made at operator entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("root", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
])

# Same fields, in the same order, as Spark's `image` source.
IMAGE = T.StructType([
    T.StructField("origin", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("nChannels", T.IntegerType()),
    T.StructField("mode", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
])

MEMBERS = T.StructType([
    T.StructField("archive", T.StringType()),
    T.StructField("member", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("error", T.StringType()),
])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Return `df`, or raise when it lacks one of `columns`."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; found {df.columns}")
    return df
