"""What has changed below some folders, from repeated listings of them, as a stream with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from lumisift.schemas import require
from lumisift.sources.files import scan_files

LISTING = "path string, length bigint, mtime timestamp, listed_at timestamp"
CHANGES = "path string, length bigint, mtime timestamp, change string, seen_at timestamp"
_SEEN = StructType([StructField(c, LongType()) for c in ("length", "mtime", "listed_at")])
# Fixed value: the state store that keyed state with timers needs.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def available() -> bool:
    """Whether Python processes can keep state here: Spark's protocol for it needs protobuf."""
    try:
        import google.protobuf  # noqa: F401
    except ModuleNotFoundError:
        return False
    return True


def add_listing(files: DataFrame, listings: str, listed_at: datetime) -> None:
    """Append one listing, files(path, length, mtime), to the folder that a watch reads.

    A listing is complete: what is not in it is gone. Its time must be later than that of
    the one before. Its files appear together, when the write commits.
    """
    require(files, "path", "length", "mtime")
    at = F.timestamp_micros(F.lit(_micros(listed_at)))
    # A listing of nothing still tells that time has passed: a row without a path.
    clock = files.sparkSession.createDataFrame([(None, None, None)], "path string, length bigint, mtime timestamp")
    rows = files.select("path", F.col("length").cast("long").alias("length"), "mtime").filter("path IS NOT NULL").unionByName(clock)
    rows.withColumn("listed_at", at).write.mode("append").parquet(listings)


def list_folders(spark: SparkSession, roots: list[str], listings: str, glob: str = "*", listed_at: datetime | None = None) -> None:
    """List folders now and append what was found."""
    add_listing(scan_files(spark, roots, glob).select("path", "length", "mtime"), listings, listed_at or datetime.now(timezone.utc))


def changes(spark: SparkSession, listings: str, grace_seconds: float = 0) -> DataFrame:
    """Streaming changes(path, length, mtime, change, seen_at): each new, changed or deleted file once.

    State is one row per path: the length and time it was last listed with. A path listed
    again moves its timer past the listing; a timer that the watermark reaches, because a
    later listing has come without the path, makes it deleted, and its state is dropped.
    The watermark is the latest listing less `grace_seconds`. A trigger must see whole
    listings, so their files are not dealt over triggers. Where a trigger finds several,
    a path that only one in the middle lacks counts as there all the time.
    """
    stream = spark.readStream.schema(LISTING).parquet(listings).withWatermark("listed_at", f"{grace_seconds} seconds")
    # Times as whole microseconds, which mean the same in a row and in the state.
    stream = stream.select("path", "length", F.unix_micros("mtime").alias("mtime"), F.unix_micros("listed_at").alias("at"), "listed_at")
    found = stream.groupBy("path").transformWithState(_Watch(), "path string, length bigint, mtime bigint, change string, at bigint", "append", "EventTime")
    return found.select("path", "length", F.timestamp_micros("mtime").alias("mtime"), "change", F.timestamp_micros("at").alias("seen_at"))


def index_changes(spark: SparkSession, listings: str, table: str, checkpoint: str, grace_seconds: float = 0,
                  each_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write the changes of all listings so far to the Parquet table `table`, then stop.

    A batch has its own folder, overwritten when the batch is retried; state and progress
    are in `checkpoint`, so a later run goes on where this one, or a failed one, stopped.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        if each_batch is not None:
            each_batch(spark.read.parquet(f"{table}/batch={batch_id}"), batch_id)

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, _STORE)
    try:  # the query takes the settings of its session when it starts
        return (changes(spark, listings, grace_seconds).writeStream.outputMode("append").foreachBatch(save)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def snapshot(spark: SparkSession, table: str) -> DataFrame:
    """files(path, length, mtime): what is there after all changes of a table."""
    rows = spark.read.schema(CHANGES).option("recursiveFileLookup", True).parquet(table)
    # A deletion and a new file under the same path at one time: the file was found last.
    latest = rows.groupBy("path").agg(F.max_by(F.struct("length", "mtime", "change"), F.struct("seen_at", F.col("change") != "deleted")).alias("last"))
    return latest.filter("last.change <> 'deleted'").select("path", "last.length", "last.mtime")


def _micros(at: datetime) -> int:
    return (at.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def _expiry(listed_at: int) -> int:
    """The first whole millisecond after a listing, whose time is in microseconds."""
    return listed_at // 1000 + 1


class _Watch(StatefulProcessor):
    """Compares each path with what it was, and notices when it is listed no more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        path = key[0]
        if path is None:
            return
        was = self.seen.get() if self.seen.exists() else None
        first = was
        for row in sorted(rows, key=lambda r: r["at"]):
            now = (row["length"], row["mtime"], row["at"])
            if was is None or tuple(was[:2]) != now[:2]:
                yield Row(path=path, length=now[0], mtime=now[1], change="new" if was is None else "changed", at=now[2])
            was = now
        if was is not None:
            if first is not None:
                self.handle.deleteTimer(_expiry(first[2]))
            self.handle.registerTimer(_expiry(was[2]))
            self.seen.update(tuple(was))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        length, mtime, _ = self.seen.get()
        self.seen.clear()
        yield Row(path=key[0], length=length, mtime=mtime, change="deleted", at=timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass
