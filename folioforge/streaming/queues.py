"""Structured Streaming versions of lease expiry, interval rates, worker health and upsert.

Each maps a streaming (or static) frame of events to a frame; sinks and triggers are the
caller's. State is bounded by the watermark in every one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioforge.operators import store
from folioforge.operators.dedupe import keep_first


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def interval_rates(events: DataFrame, keys: Sequence[str], value: str, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Count and mean of each tumbling interval; intervals close once the watermark passes them."""
    x = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), *keys)
    return x.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def worker_sessions(events: DataFrame, worker: str, gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Spells of activity of each worker: a worker silent for ``gap`` ends its spell."""
    x = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), worker)
    return x.agg(F.count("*").alias("n")).select(worker, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Events delivered again within the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def expired_leases(events: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """(id, leased_at) of items taken up ("processing") without another event for ``seconds``.

    events: id string, ts timestamp, status string. The state is one time stamp an item that is
    being processed; other statuses end a lease.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (since,) = state.get
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "leased_at": [pd.Timestamp(since, unit="us")]})
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        last = rows.iloc[-1]
        at = int(last["ts"].value // 1000)
        if state.exists and at < state.get[0]:
            return  # older than what is known
        if last["status"] == "processing":
            state.update((at,))
            state.setTimeoutTimestamp(max(at // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    x = events.withWatermark("ts", late).groupBy("id")
    return x.applyInPandasWithState(run, "id string, leased_at timestamp", "since long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], keys: Sequence[str], protected: Sequence[str] = (), order: str = "ts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts the latest row of each key into a table; replaying a
    batch gives the same table, so restarts are safe."""

    def run(batch: DataFrame, number: int) -> None:
        latest = keep_first(batch, keys, [F.col(order).desc()])
        base = read()
        write(store.upsert(base, latest.select(*base.columns), keys, protected), number)

    return run
