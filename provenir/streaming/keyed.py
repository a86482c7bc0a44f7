"""Operators with state for the keys of a stream, in event-time order.

Rows wait in a state until the watermark has passed them; only
then can nothing earlier arrive, and what they lead to is settled once and for
all, however the rows were dealt into micro-batches. A state holds the rows of
the watermark's delay and what the operator remembers of the past, both bounded
in time, and is removed when neither is left. Rows without a key, a time
or a value the operator reads are left out, but move the watermark.

A state stands for a shard of keys, since a call for each key costs more than
its rows; where the past that counts is bounded, a shard is cut into blocks of
time too, so that the rows of a hot key spread over tasks. Rows are kept as
columns, in a call as in a state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stores import BASE_WEIGHTS, CORES, valid_weights
from ..session import materialize, scratch_dir

#: Micros after which a state that is never dropped is looked at again.
FOREVER = 3650 * 86_400_000_000

SHARDS = 64

#: Length of a block of time, in spans of the past that counts.
BLOCK_SPANS = 24

#: Rows of a micro-batch when a table is replayed.
BATCH_ROWS = 4_000_000

#: The same when tables are replayed in step, with the copies that an operator makes of a row, and the cells of time that slices are made of.
STEP_ROWS, STEP_CELLS = 1_000_000, 1 << 16

#: ``advance(memory, rows, now, group)`` takes ready rows (_us, columns) in order, the watermark in micros and
#: the values of the group; it changes ``memory`` and returns output rows (None: none), the rows that it wants
#: to see again (None: none) and the micros from which it wants to go on without new rows (None: never).
Advance = Callable[[dict, pd.DataFrame, int, tuple], tuple[pd.DataFrame | None, pd.DataFrame | None, int | None]]


def timed(c: str, ts: str) -> Column:
    """Whether a column and the time are there.

    It reads the time, so the optimizer leaves it above the watermark: a row
    that is left out still moves the watermark.
    """
    return F.when(F.col(ts).isNotNull(), F.col(c)).isNotNull()


def shard_of(key: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_pandas()


def _ordered(rows: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """Rows in the order of ``names``; a column is only looked at where those before it are shared."""
    order, first = np.arange(len(rows)), np.zeros(len(rows), bool)  # first: of rows that share all columns so far
    first[:1] = True
    for c in names:
        places = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(places):
            break
        v = rows[c].to_numpy()[order[places]]
        if v.dtype == object:
            v = pd.factorize(v, sort=True, use_na_sentinel=True)[0]
            v[v < 0] = len(v)
        at = np.lexsort((v, np.cumsum(first)[places]))
        order[places], v = order[places][at], v[at]
        first[places[1:]] |= v[1:] != v[:-1]
    return rows.iloc[order].reset_index(drop=True)


def in_order(stream: DataFrame, groups: list[str], ts: str, columns: list[str], out: str, advance: Advance) -> DataFrame:
    """Run ``advance`` for each group over its rows in the order of (ts, columns); ``out``: the output columns.

    ``stream`` has a watermark on ``ts``.
    """
    names = ["_us", *columns]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, memory = (_unpacked(state.get[0]), json.loads(state.get[1])) if state.exists else (None, {})
        found = [p[names] for p in parts if len(p)]
        rows = pd.concat(([held] if held is not None and (len(held) or not found) else []) + found, ignore_index=True)
        del held, found  # several tasks of an executor hold a shard each
        now_ms = state.getCurrentWatermarkMs()
        now = now_ms * 1000
        rest = rows[rows["_us"] > now]
        ready = _ordered(rows[rows["_us"] <= now], names)
        del rows
        done, again, due = advance(memory, ready, now, k)
        due = min(([int(rest["_us"].min())] if len(rest) else []) + ([due] if due is not None else []), default=None)
        if due is None:
            if state.exists:
                state.remove()
        else:
            rest = rest if again is None or not len(again) else pd.concat([again, rest]) if len(rest) else again
            state.update((_packed(rest), json.dumps(memory)))
            state.setTimeoutTimestamp(max(now_ms + 1, -(-due // 1000)))
        if done is not None and len(done):
            yield done

    s = stream.select(*groups, ts, F.unix_micros(ts).alias("_us"), *columns)
    return s.groupBy(*groups).applyInPandasWithState(run, out, "rows binary, memory string", "append", GroupStateTimeout.EventTimeTimeout)


def kept(stream: DataFrame, ts: str, delay: str, columns: list[str]) -> DataFrame:
    """A stream with its watermark, without rows that lack one of the columns."""
    s = stream.withWatermark(ts, delay)
    for c in columns:
        s = s.filter(timed(c, ts))
    return s


def kind_of(stream: DataFrame, c: str) -> str:
    return stream.schema[c].dataType.simpleString()


def live_scores(stream: DataFrame, key: str, ts: str, input_id: str, micros: str, delay: str, queue: int = 2, drain: bool = True, shards: int = SHARDS) -> DataFrame:
    """Which inputs of each key one worker scores, and when: (key, id, started, finished, dropped).

    ``micros``: column with the time that an input takes to score. An input that
    arrives while the worker is busy waits. With ``drain`` it takes the place of
    those that wait, which are stale: the worker goes on with the newest. Without,
    up to ``queue`` inputs wait in line and a further one pushes out the oldest.
    ``dropped`` counts the inputs given up since the one scored before. Inputs of
    the same moment come in the order of their ids.
    """
    keep = 1 if drain else queue
    names = [key, input_id, "_start", "_end", "dropped"]

    def advance(m: dict, rows: pd.DataFrame, now: int, group: tuple) -> tuple[pd.DataFrame | None, None, int | None]:
        # for each key of the shard with work: [free, lost, inputs that wait]
        busy = {k: w for k, *w in m.get("keys", [])}
        out = []

        def take(k, w: list, us: int, i, took: int) -> None:
            at = us if w[0] is None else max(w[0], us)
            w[0] = at + took
            out.append((k, i, at, w[0], w[1]))
            w[1] = 0

        for us, i, took, k in zip(rows["_us"].tolist(), rows["_id"].tolist(), rows["_took"].tolist(), rows["_key"].tolist()):
            w = busy.get(k)
            if w is None:
                w = busy[k] = [None, 0, []]
            wait = w[2]
            while wait and w[0] < us:
                take(k, w, *wait.pop(0))
            if not wait and (w[0] is None or w[0] < us):
                take(k, w, us, i, took)
                continue
            wait.append((us, i, took))
            while len(wait) > keep:
                wait.pop(0)
                w[1] += 1
        for k, w in busy.items():
            while w[2] and w[0] <= now:
                take(k, w, *w[2].pop(0))
        left = [[k, *w] for k, w in busy.items() if w[0] > now]
        m["keys"] = left
        return pd.DataFrame(out, columns=names) if out else None, None, min((x[1] for x in left), default=None)

    s = stream.withColumns({"_id": F.col(input_id), "_took": F.col(micros).cast("bigint"), "_key": F.col(key), "_shard": shard_of(key, shards)})
    s = kept(s, ts, delay, ["_key", "_id", "_took"])
    got = in_order(s, ["_shard"], ts, ["_id", "_took", "_key"], f"{key} {kind_of(stream, key)}, {input_id} {kind_of(stream, input_id)}, _start bigint, _end bigint, dropped bigint", advance)
    return got.select(key, input_id, F.timestamp_micros("_start").alias("started"), F.timestamp_micros("_end").alias("finished"), "dropped")


def admit_stream(stream: DataFrame, key: str, ts: str, request: str, delay: str, limit: int = 10, seconds: int = 60, shards: int = 16) -> DataFrame:
    """Verdict on each request: (key, request, requests, allowed), as ``operators.stores.admit`` gives it in batch.

    A shard is cut into blocks of ``BLOCK_SPANS`` spans; a request of a block's
    last span is counted in the next block too.
    """
    span = seconds * 1_000_000
    block = span * BLOCK_SPANS

    def advance(m: dict, rows: pd.DataFrame, now: int, group: tuple) -> tuple[pd.DataFrame | None, pd.DataFrame | None, int | None]:
        end = (int(group[1]) + 1) * block
        if not len(rows):
            return None, None, end if now < end else None
        us = rows["_us"].to_numpy(np.int64)
        own = rows["_own"].to_numpy(bool)
        code = pd.factorize(rows["_key"])[0].astype(np.int64)
        # one line of places on which the spans of different keys do not meet
        place = us - us.min() + code * (us.max() - us.min() + span + 1)
        line, mine = np.sort(place), place[own]
        n = np.searchsorted(line, mine, "right") - np.searchsorted(line, mine - span, "left")
        done = pd.DataFrame({key: rows["_key"][own], request: rows["_id"][own], "requests": n, "allowed": n <= limit})
        if now >= end:
            return done, None, None
        return done, rows[us >= now - span].assign(_own=0), end

    at = F.unix_micros(ts)
    first, last = (F.floor((x - F.pmod(x, F.lit(block))) / block) for x in (at, at + span))
    s = kept(stream.withColumns({"_id": F.col(request), "_key": F.col(key), "_shard": shard_of(key, shards)}), ts, delay, ["_key", "_id"])
    s = s.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_own", (F.col("_block") == first).cast("int"))
    return in_order(s, ["_shard", "_block"], ts, ["_id", "_key", "_own"], f"{key} {kind_of(stream, key)}, {request} {kind_of(stream, request)}, requests bigint, allowed boolean", advance)


def weights_stream(scans: DataFrame, versions: DataFrame, scan: str, ts: str, valid_from: str, delay: str, shards: int = SHARDS) -> DataFrame:
    """Weights in force at each scan: (scan, version, weights), as ``operators.stores.weights_as_of`` gives them in batch.

    Both sides are streams under one watermark, so a version that comes late, but
    within ``delay``, still counts; stored tables are replayed in step. Scans are dealt into ``shards`` by a hash;
    every shard gets all versions and keeps the one in force and those to come.
    """
    id_type = scans.schema[scan].dataType
    good = valid_weights(versions).filter("is_valid")
    v = good.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"), F.col(valid_from).alias("_ts"), F.lit(0).alias("_kind"),
        F.coalesce(F.col("version").cast("string"), F.lit("")).alias("_name"), F.lit(0).cast(id_type).alias("_id"), *[F.col(k).cast("double").alias(k) for k in CORES],
        F.col("version").isNotNull().alias("_there"),
    )
    s = scans.select(
        shard_of(scan, shards).alias("_shard"), F.col(ts).alias("_ts"), F.lit(1).alias("_kind"), F.lit("").alias("_name"), F.col(scan).alias("_id"),
        *[F.lit(0.0).alias(k) for k in CORES], F.col(scan).isNotNull().alias("_there"),
    )

    def advance(m: dict, rows: pd.DataFrame, now: int, group: tuple) -> tuple[pd.DataFrame | None, pd.DataFrame | None, int | None]:
        # at one moment versions come first, the last of them by name counts
        kind = rows["_kind"].to_numpy()
        at = np.maximum.accumulate(np.where(kind == 0, np.arange(len(rows)), -1)) if len(rows) else np.empty(0, np.int64)
        mine = at[kind == 1]
        known = mine >= 0
        done = pd.DataFrame({"_scan": rows["_id"][kind == 1].to_numpy()})
        names = rows["_name"].to_numpy(object)
        done["version"] = np.where(known, names[mine], None) if len(names) else None
        for k in CORES:
            done[k] = np.where(known, rows[k].to_numpy()[mine], float(BASE_WEIGHTS[k])) if len(names) else 0.0
        if not len(rows) or at[-1] < 0:
            return done, None, None
        return done, rows.iloc[[at[-1]]], now + FOREVER

    both = kept(v.unionByName(s).withColumn("_there", F.when(F.col("_there"), 1)), "_ts", delay, ["_shard", "_there"])
    weights = ", ".join(f"{k} double" for k in CORES)
    got = in_order(both, ["_shard"], "_ts", ["_kind", "_name", "_id", *CORES], f"_scan {id_type.simpleString()}, version string, {weights}", advance)
    return got.select(F.col("_scan").alias(scan), "version", *CORES)


def work_outcomes(starts: DataFrame, ends: DataFrame, key: str, started: str, ended: str, delay: str, limit: str) -> DataFrame:
    """Every piece of work with its end: (key, started, ended, outcome), one row once it is known.

    A stream-stream join under both watermarks: work that has not ended ``limit``
    after its start comes out as ``timed_out`` at that time, when the watermark
    has passed it; a later end is no longer looked at. A key stands for one start.
    """
    s = starts.select(key, started).withWatermark(started, delay).filter(timed(key, started))
    e = ends.select(F.col(key).alias("_key"), F.col(ended).alias("_e")).withWatermark("_e", delay)
    e = e.select(F.when(F.col("_e").isNotNull(), F.col("_key")).alias("_k"), "_e")  # see timed(): the join implies that _k is there
    last = F.col(started) + F.expr(f"INTERVAL {limit}")
    j = s.join(e, (F.col(key) == F.col("_k")) & (F.col("_e") >= F.col(started)) & (F.col("_e") <= last), "left_outer")
    lost = F.col("_e").isNull()
    return j.select(key, started, F.when(lost, last).otherwise(F.col("_e")).alias("ended"), F.when(lost, "timed_out").otherwise("finished").alias("outcome"))


def replay(df: DataFrame, ts: str, name: str, batches: int = 3, after: str = "1000 days") -> DataFrame:
    """A finite table as a stream in ``batches`` slices of time, each a micro-batch, and a closing row.

    More slices are made where they would hold more than ``BATCH_ROWS`` rows on average. The closing row has only a time, ``after`` the last one, so that the watermark
    passes everything. For tests, back-fills and queries over stored tables.
    """
    spark: SparkSession = df.sparkSession
    path, cut = scratch_dir(spark, name), scratch_dir(spark, f"{name}-cut")
    low, high, n = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts)), F.count(ts)).first()
    low, high = (0, 0) if low is None else (low, high)
    batches = max(batches, -(-n // BATCH_ROWS))
    # floor(x / y) of longs goes through doubles; div does not
    place = F.expr(f"cast((unix_micros(`{ts}`) - {low}L) div {(high - low) // batches + 1}L as int)")
    df.filter(F.col(ts).isNotNull()).withColumn("_cut", place).write.partitionBy("_cut").parquet(cut)
    pieces = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_cut", T.IntegerType())])).parquet(cut)
    for b in range(batches):
        pieces.filter(F.col("_cut") == b).drop("_cut").repartition(1).write.mode("append").parquet(path)
    close = F.timestamp_micros(F.lit(high)) + F.expr(f"INTERVAL {after}")
    row = [(close if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def replay_in_step(sides: list[tuple[DataFrame, str, int]], name: str, batches: int = 3, rows: int = STEP_ROWS, after: str = "1000 days") -> list[DataFrame]:
    """Finite tables as streams that are at the same time in every micro-batch; ``sides``: (table, its time, copies made of a row).

    For operators under one watermark, which drop what comes later than it. All
    streams read the same files: a file holds a slice of time of every table.
    Slices are of about equal weight, ``rows`` at most with copies, unless one
    cell of time (a 65,536th of the whole) has more. Each table has a closing row as in ``replay``.
    """
    spark: SparkSession = sides[0][0].sparkSession
    path, cut = scratch_dir(spark, name), scratch_dir(spark, f"{name}-cut")
    schemas = [df.schema for df, _, _ in sides]

    def placed(df: DataFrame, side: int) -> DataFrame:
        own = lambda k, s: (F.struct(*[F.col(c) for c in df.columns]) if k == side else F.lit(None).cast(s)).alias(f"_{k}")
        _, ts, copies = sides[side]
        return df.select(F.lit(side).alias("_side"), F.unix_micros(ts).alias("_us"), F.lit(copies).alias("_copies"), *[own(k, s) for k, s in enumerate(schemas)])

    every = reduce(DataFrame.union, [placed(df.filter(F.col(ts).isNotNull()), k) for k, (df, ts, _) in enumerate(sides)])
    low, high, weight = every.agg(F.min("_us"), F.max("_us"), F.sum("_copies")).first()
    low, high, weight = (0, 0, 0) if low is None else (low, high, weight)
    every = every.withColumn("_cell", F.expr(f"(_us - {low}L) div {(high - low) // STEP_CELLS + 1}L"))
    before = F.sum("weight").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))  # a bounded number of cells
    cells = every.groupBy("_cell").agg(F.sum("_copies").alias("weight"))
    cells = cells.withColumn("before", F.coalesce(before, F.lit(0)))
    cells = materialize(cells.select("_cell", F.expr(f"cast(before div {max(1, min(rows, -(-weight // batches)))}L as int)").alias("_cut")), f"{name}-cells")
    every.join(F.broadcast(cells), "_cell").drop("_cell", "_us", "_copies").repartition("_cut").write.partitionBy("_cut").parquet(cut)
    kind = T.StructType([T.StructField("_side", T.IntegerType()), *[T.StructField(f"_{k}", s) for k, s in enumerate(schemas)]])
    pieces = spark.read.schema(T.StructType([*kind.fields, T.StructField("_cut", T.IntegerType())])).parquet(cut)
    for (b,) in cells.select("_cut").distinct().orderBy("_cut").collect():
        pieces.filter(F.col("_cut") == b).drop("_cut").coalesce(1).write.mode("append").parquet(path)
    close = F.timestamp_micros(F.lit(high)) + F.expr(f"INTERVAL {after}")
    ends = [placed(spark.range(1).select(*[(close if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields]), k) for k, (df, ts, _) in enumerate(sides)]
    reduce(DataFrame.union, ends).drop("_us", "_copies").coalesce(1).write.mode("append").parquet(path)
    files = [spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path) for _ in sides]
    return [f.filter(F.col("_side") == k).select(f"_{k}.*") for k, f in enumerate(files)]


def collected(stream: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Run a stream in append mode to the end of what is there, and its output as a table; ``partitions``: of its state, at most."""
    base, conf = scratch_dir(stream.sparkSession, name), stream.sparkSession.conf
    given = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", str(min(int(given), partitions or int(given))))
    try:
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start(f"{base}/out")
    finally:
        conf.set("spark.sql.shuffle.partitions", given)  # the stream has a session of its own
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def micros_of(seconds: Column) -> Column:
    return (F.floor(seconds) * 1_000_000).cast("bigint")
