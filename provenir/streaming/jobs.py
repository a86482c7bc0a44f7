"""Structured Streaming jobs over the audit and scan streams.

Windowed counts carry a ten-minute watermark, which bounds their state.
Aggregating jobs run in update mode into an append-only table keyed by batch;
``latest`` reduces that table to the current value of each key. Jobs that keep
the last row of a key (``latest_stream``, ``change_stream``) have no state in
the engine: each batch is merged with a table of one row for each key, and keys
idle for longer than ``expire`` leave it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import iso_ts
from ..operators.ordered import dense_index, second_cell
from ..operators.stores import detect_changes
from ..session import scratch_dir
from ..sources.sinks import SERVICE, VERSION, with_day

WATERMARK = "10 minutes"


def read_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream the files of a Parquet table."""
    schema = spark.read.parquet(path).schema
    # A pattern accepts both a folder of files and a table of a single file.
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, WATERMARK)


def newest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row of each key by the columns of ``order``; partial maxima go into the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Newest rows of a state table written by ``write_state``."""
    t = spark.read.parquet(f"{path}/state")
    return t.join(F.broadcast(t.agg(F.max("batch_id").alias("batch_id"))), "batch_id").drop("batch_id", "slot")


def _before(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
    """State that the batch before left."""
    if batch_id == 0:
        return batch.limit(0)
    return batch.sparkSession.read.parquet(f"{path}/state/slot={(batch_id - 1) % 2}").select(*batch.columns)


def write_state(state: DataFrame, path: str, batch_id: int, ts: str, expire: str | None) -> None:
    """Write the state after a batch. Two slots take turns, so a batch that is run again still finds what it started from."""
    if expire:
        newest_ts = state.agg((F.max(ts) - F.expr(f"INTERVAL {expire}")).alias("_old"))
        state = state.join(F.broadcast(newest_ts), F.col(ts) >= F.col("_old")).drop("_old")
    state.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/state/slot={batch_id % 2}")


def latest_stream(stream: DataFrame, key: str, order: list[str], cols: list[str], path: str, checkpoint: str, expire: str | None = None) -> StreamingQuery:
    """Keep the last row of each key in a table (``read_state``).

    ``order``: event time, then columns that break ties. ``expire``: interval
    such as ``30 days``; a key whose last row is that much older than the
    newest of all leaves the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        both = batch.unionByName(_before(batch, path, batch_id))
        write_state(newest(both, key, order), path, batch_id, order[0], expire)

    rows = stream.select(key, *dict.fromkeys([*order, *cols]))
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_stream(stream: DataFrame, name: str, sha: str, order: list[str], path: str, checkpoint: str, expire: str | None = None) -> StreamingQuery:
    """Append the rows whose content differs from the last seen of their name to ``path``/changes.

    ``order``: event time, then columns that break ties. The first row of a
    name is a change, and so is a return to earlier content. Rows at or before
    the last one seen of their name are late and left out, as are rows without
    a name or time. A name back after ``expire`` counts as new.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        known = _before(batch, path, batch_id).withColumn("_new", F.lit(False))
        last = known.select(F.col(name).alias("_n"), F.struct(*order).alias("_last"))
        fresh = batch.join(last, F.col(name) == F.col("_n"), "left").filter(F.col("_last").isNull() | (F.struct(*order) > F.col("_last")))
        both = fresh.select(*batch.columns, F.lit(True).alias("_new")).unionByName(known)
        placed = dense_index(both, [name], second_cell(F.col(order[0])), [F.col(c) for c in order], "_idx")
        changed = detect_changes(placed, name, "_idx", sha).filter("changed and _new")
        changed.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")
        write_state(newest(both.drop("_new"), name, order), path, batch_id, order[0], expire)
        batch.unpersist()

    rows = stream.select(name, *dict.fromkeys([*order, sha]))
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limit(stream: DataFrame, key: str, ts: str, limit: int = 10) -> DataFrame:
    """Requests per address and minute, and whether they pass the limit."""
    w = F.window(F.col(ts), "1 minute")
    g = event_time(stream, ts).groupBy(key, w).agg(F.count(F.lit(1)).alias("requests"))
    return g.select(
        key, F.col("window.start").alias("minute"), "requests", (F.col("requests") > limit).alias("limited")
    )


def live_counters(stream: DataFrame, dims: list[str]) -> DataFrame:
    return stream.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))


def live_histogram(stream: DataFrame, dims: list[str], v: str, buckets: tuple[float, ...]) -> DataFrame:
    return stream.groupBy(*dims).agg(
        F.count(v).alias("n"),
        F.sum(v).alias("total"),
        *[F.sum((F.col(v) <= b).cast("bigint")).alias(f"le_{i}") for i, b in enumerate(buckets)],
    )


def task_state(stream: DataFrame, session: str, order: list[str], state: Column, stage: Column, path: str, checkpoint: str, expire: str | None = None) -> StreamingQuery:
    """Keep the current state and stage of each session."""
    s = stream.withColumns({"state": state, "stage": stage})
    return latest_stream(s, session, order, ["state", "stage"], path, checkpoint, expire)


def audit_entries(stream: DataFrame, ts: str, event: Column, cols: list[str]) -> DataFrame:
    return with_day(
        stream.select(
            iso_ts(ts).alias("timestamp"), F.lit(SERVICE).alias("service"), F.lit(VERSION).alias("version"),
            event.alias("event"), *cols,
        )
    )


def audit_stream(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write audit entries as JSON lines, one folder per day."""
    return (
        entries.writeStream.format("json").partitionBy("day").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def watch_files(spark: SparkSession, path: str, scan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Scan every new file of a table folder and write its results."""
    return append_stream(scan(read_table_stream(spark, path)), out, checkpoint)


def update_stream(agg: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the updates of each batch; a replayed batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        agg.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current value of each key of an update table."""
    t = spark.read.parquet(path)
    rest = [c for c in t.columns if c not in (*keys, "batch_id")]
    best = F.max_by(F.struct(*rest), "batch_id").alias("_b")
    return t.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def split_failures(stream: DataFrame, error: Column, good_path: str, dead_path: str, checkpoint: str) -> StreamingQuery:
    """Route rows with an error code to the dead-letter table."""
    marked = stream.withColumn("error_code", error)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.filter("error_code IS NULL").drop("error_code").write.mode("overwrite").parquet(
            f"{good_path}/batch_id={batch_id}"
        )
        batch.filter("error_code IS NOT NULL").withColumn("status", F.lit("dead_letter")).write.mode(
            "overwrite"
        ).parquet(f"{dead_path}/batch_id={batch_id}")

    return (
        marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_update(agg: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an aggregating stream over what is there and return its state."""
    spark = agg.sparkSession
    base = scratch_dir(spark, name)
    update_stream(agg, f"{base}/out", f"{base}/cp").awaitTermination()
    return latest(spark, f"{base}/out", keys)
