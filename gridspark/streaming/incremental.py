"""Incremental inventories, latest requests and telemetry windows, as Structured Streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridspark.operators.storage import shared_dir


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files (a folder, or one file) as a stream; timestamps without a zone are read as UTC, so that they can carry a watermark."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a single file is only taken as a pattern
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in stream.schema.fields if f.dataType.simpleString() == "timestamp_ntz"})


def stream_inventory(events: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Running counts (or sums of a weight) by key, as rows arrive."""
    return events.groupBy(*by).agg((F.sum(weight) if weight else F.count("*")).alias("cells"))


def latest_request(events: DataFrame, session: str, revision: str, columns: Sequence[str]) -> DataFrame:
    """The newest revision of each session; older ones that arrive late never replace it."""
    newest = events.groupBy(session).agg(F.max_by(F.struct(revision, *columns), F.col(revision)).alias("_r"))
    return newest.select(session, *[F.col(f"_r.{c}").alias(c) for c in (revision, *columns)])


class _Newest(StatefulProcessor):
    """Keeps each session's newest revision, and forgets a session that was silent for ``keep_ms`` of event time."""

    def __init__(self, session: str, revision: str, columns: Sequence[str], time: str, keep_ms: int, kinds: str) -> None:
        self.session, self.revision, self.columns, self.time, self.keep_ms, self.kinds = session, revision, list(columns), time, keep_ms, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.kinds)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, seen = self.newest.get(), None
        changed = False
        for batch in rows:
            last = batch.sort_values(self.revision).iloc[-1]
            if best is None or last[self.revision] > best[0]:
                best, changed = tuple(_plain(last[c]) for c in (self.revision, *self.columns)), True
            at = int(batch[self.time].max().timestamp() * 1000)
            seen = at if seen is None else max(seen, at)
        until = seen + self.keep_ms
        old = self.timer.get()
        if old is None or until > old[0]:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.handle.registerTimer(until)
            self.timer.update((until,))
        if changed:
            self.newest.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=[self.session, self.revision, *self.columns])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def _plain(v):
    return v.item() if hasattr(v, "item") else v


def latest_with_expiry(events: DataFrame, session: str, revision: str, columns: Sequence[str], time: str, delay: str, keep_ms: int) -> DataFrame:
    """latest_request with bounded state: a row whenever a session has a newer revision than all before; revisions that come late change nothing. State is one row a
    session, deleted by a timer when no event of it came for ``keep_ms`` of event time; a session that comes back begins anew. The stream needs the RocksDB
    state store (see with_rocksdb). A restart from the checkpoint goes on with the state."""
    fields = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    kinds = ", ".join(f"{c} {fields[c]}" for c in (revision, *columns))
    processor = _Newest(session, revision, columns, time, keep_ms, kinds)
    keyed = events.select(session, revision, *columns, time).withWatermark(time, delay).groupBy(session)
    return keyed.transformWithStateInPandas(processor, f"{session} {fields[session]}, {kinds}", outputMode="Update", timeMode="EventTime")


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB; the session's setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def without_repeats(events: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Repeated deliveries within the watermark are dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def telemetry_windows(samples: DataFrame, time: str, value: str, budget: float, width: str, slide: str | None = None, by: Sequence[str] = (), delay: str = "1 hour") -> DataFrame:
    """Samples, peak and budget breaches of each window; later than the watermark: dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return _peaks(samples.withWatermark(time, delay), window, value, budget, by)


def telemetry_sessions(samples: DataFrame, time: str, value: str, budget: float, gap: str, by: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """The same for sessions that end after a gap."""
    return _peaks(samples.withWatermark(time, delay), F.session_window(time, gap), value, budget, by)


def _peaks(samples: DataFrame, window, value: str, budget: float, by: Sequence[str]) -> DataFrame:
    found = samples.groupBy(window.alias("_w"), *by).agg(F.count("*").alias("samples"), F.max(value).alias("peak"), F.count_if(F.col(value) > budget).alias("breaches"))
    return found.select(*by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "samples", "peak", "breaches")


def run_available(stream: DataFrame, mode: str, keys: Sequence[str] = (), base: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its result as a table in the shared folder. ``base``: the folder of an earlier run, which
    it goes on with.

    ``complete``: the last batch's table; ``update``: the last version of each key; ``append``: all rows.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number:06d}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(save).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    out = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
    if mode == "complete":
        last = out.agg(F.max("_batch")).first()[0]
        return out.where(F.col("_batch") == last).drop("_batch")
    if mode == "update":
        rest = [c for c in out.columns if c not in keys]
        newest = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("_r"))
        return newest.select(*keys, "_r.*").drop("_batch")
    return out.drop("_batch")
