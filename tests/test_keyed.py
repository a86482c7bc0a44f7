"""Streams with keyed state: several micro-batches against a replay in Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from provenir.catalog import QUERIES
from provenir.catalog.stores import versions
from provenir.operators.stores import admit, weights_as_of
from provenir.session import scratch_dir
from provenir.streaming import keyed as K

START = datetime(2024, 5, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def stream_of(spark, batches, schema):
    """A stream whose micro-batches are the given lists of rows."""
    path = scratch_dir(spark, "t-batches")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def shuffled_batches(rows, size, jitter, rng):
    """Rows in an order that is off by at most ``jitter`` seconds, cut into batches."""
    rows = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, jitter)))
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def replayed(inputs, keep):
    """(id, started, finished, dropped) of one worker; inputs are (seconds, id, took)."""
    inputs, out, wait, free, lost = sorted(inputs), [], [], None, 0
    while inputs or wait:
        if free is None or (not wait and inputs[0][0] > free):
            now = inputs.pop(0)
        else:
            while inputs and inputs[0][0] <= free:
                wait.append(inputs.pop(0))
                if len(wait) > keep:
                    wait.pop(0)
                    lost += 1
            now = wait.pop(0)
        begin = now[0] if free is None else max(free, now[0])
        free = begin + now[2]
        out.append((now[1], begin, free, lost))
        lost = 0
    return out


@pytest.mark.parametrize("drain,queue", [(True, 2), (False, 2), (False, 1), (False, 3)])
def test_live_scores(spark, drain, queue):
    rng = random.Random(queue + drain)
    inputs = {k: [(rng.randrange(400), k * 1000 + i, rng.choice([0, 1, 5, 20, 60])) for i in range(120)] for k in (1, 2)}
    inputs[3] = [(5, 3000, 7)]
    rows = [(k, at(s), i, took * 1_000_000) for k, v in inputs.items() for s, i, took in v] + [(None, at(9), 1, 1), (1, None, 2, 1), (1, at(9), None, 1)]
    timed = [r for r in rows if r[1] is not None]
    batches = shuffled_batches(timed, 60, 20, rng)
    batches[0].append((1, None, 2, 1))
    stream = stream_of(spark, [*batches, [(None, at(10**6), None, None)]], "cam bigint, ts timestamp, frame bigint, took bigint")
    got = K.collected(K.live_scores(stream, "cam", "ts", "frame", "took", "25 seconds", queue, drain), "t-live").collect()
    for k, v in inputs.items():
        mine = sorted((r.frame, round((r.started - START).total_seconds()), round((r.finished - START).total_seconds()), r.dropped) for r in got if r.cam == k)
        assert mine == sorted(replayed(v, 1 if drain else queue))
    assert {r.cam for r in got} == {1, 2, 3}


def counted(rows, limit, seconds):
    out = {}
    for key, ts, i in rows:
        if key is not None and ts is not None and i is not None:
            n = sum(k == key and t is not None and j is not None and ts - timedelta(seconds=seconds) <= t <= ts for k, t, j in rows)
            out[i] = (n, n <= limit)
    return out


def request_rows(rng):
    rows = [(rng.choice(["hot", "hot", "a", "b"]), at(rng.randrange(0, 6000) / 10), i) for i in range(400)]
    return rows + [("burst", at(50), 1000 + i) for i in range(15)] + [("burst", at(110), 1100), ("burst", at(110.1), 1101)]


def test_admit_batch_and_stream(spark):
    rng = random.Random(8)
    rows = request_rows(rng)
    want = counted(rows, 10, 60)
    df = spark.createDataFrame(rows + [(None, at(3), 2000), ("a", None, 2001)], "address string, ts timestamp, request bigint").repartition(4)
    got = {r.request: (r.requests, r.allowed) for r in admit(df, "address", "ts").collect()}
    assert got.pop(2000) == (None, True) and got.pop(2001) == (None, True)
    assert got == want and not all(v[1] for v in want.values())
    batches = shuffled_batches(rows, 100, 10, rng)
    stream = stream_of(spark, [*batches, [(None, at(10**6), None)]], "address string, ts timestamp, request bigint")
    live = K.collected(K.admit_stream(stream, "address", "ts", "request", "15 seconds"), "t-admit").collect()
    assert len(live) == len(rows) and {r.request: (r.requests, r.allowed) for r in live} == want


def test_admit_late_request_is_left_out(spark):
    rows = [[("a", at(0), 1)], [("a", at(1000), 2)], [("a", at(1500), 3)], [("a", at(5), 4)], [(None, at(10**6), None)]]
    stream = stream_of(spark, rows, "address string, ts timestamp, request bigint")
    live = K.collected(K.admit_stream(stream, "address", "ts", "request", "1 second"), "t-late")
    assert sorted(r.request for r in live.collect()) == [1, 2, 3]


def test_admit_empty(spark):
    df = spark.createDataFrame([], "address string, ts timestamp, request bigint")
    assert admit(df, "address", "ts").collect() == []


def test_states_are_removed(spark):
    memory = {}
    base = scratch_dir(spark, "t-state")
    stream = stream_of(spark, [[("a", at(0), 1), ("b", at(1), 2)], [("c", at(5000), 3)], [(None, at(10**6), None)], [(None, at(2 * 10**6), None)]], "address string, ts timestamp, request bigint")
    out = K.admit_stream(stream, "address", "ts", "request", "1 second")
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    memory = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert memory == 0


def test_work_outcomes(spark):
    starts = [[(1, at(0)), (2, at(10)), (None, at(5))], [(3, at(700)), (4, at(710))], [(None, at(10**6))]]
    ends = [[(1, at(30))], [(2, at(611)), (4, at(1310)), (9, at(700))], [(None, at(10**6))]]
    s, e = stream_of(spark, starts, "task bigint, started timestamp"), stream_of(spark, ends, "task bigint, ended timestamp")
    got = K.collected(K.work_outcomes(s, e, "task", "started", "ended", "10 seconds", "600 seconds"), "t-work").collect()
    assert sorted((r.task, (r.ended - START).total_seconds(), r.outcome) for r in got) == [(1, 30, "finished"), (2, 610, "timed_out"), (3, 1300, "timed_out"), (4, 1310, "finished")]


def test_replay_has_every_row_once(spark):
    df = spark.range(100).select("id", F.timestamp_seconds(F.col("id") % 7 + 1_700_000_000).alias("ts"))
    got = K.collected(K.replay(df, "ts", "t-replay"), "t-replay-out")
    assert sorted(r.id for r in got.collect() if r.id is not None) == list(range(100))
    none = K.collected(K.replay(df.limit(0), "ts", "t-replay"), "t-replay-out")
    assert [r.id for r in none.collect()] == [None]


def test_weights_of_a_stream_of_scans(spark):
    """Scans and versions come in any order within the delay; a late version still counts."""
    rng = random.Random(5)
    versions = [(at(s), f"v{k:02}", 0.2 + 0.01 * (k % 5), 0.3, (0.5 if k % 4 else 0.9) - 0.01 * (k % 5)) for k, s in enumerate(sorted(rng.choices(range(50, 900), k=30)))]
    versions += [(versions[3][0], "v99", 0.1, 0.1, 0.8), (at(60), "v98", None, 0.5, 0.5)]
    scans = [(k, at(rng.choice([rng.randrange(900), 0, 300]))) for k in range(200)] + [(900 + k, v[0]) for k, v in enumerate(versions)] + [(None, at(5)), (999, None)]
    v_type, s_type = "valid_from timestamp, version string, biosignal double, artifact double, alignment double", "scan bigint, ts timestamp"
    asked = spark.createDataFrame([r for r in scans if None not in r], s_type)
    want = {r.scan: (r.version, r.biosignal, r.artifact, r.alignment) for r in weights_as_of(asked, spark.createDataFrame(versions, v_type), "ts", "valid_from").collect()}
    timed_scans = [r for r in scans if r[1]]
    late = [b + ([scans[-1]] if k == 0 else []) for k, b in enumerate(shuffled_batches(timed_scans, 60, 100, rng))] + [[(None, at(10**8))]]
    v_rows = sorted(versions, key=lambda r: r[0] + timedelta(seconds=rng.uniform(0, 100)))
    published = [v_rows[k : k + 12] for k in range(0, len(v_rows), 12)] + [[(at(10**8), None, None, None, None)]]
    live = K.weights_stream(stream_of(spark, late, s_type), stream_of(spark, published, v_type), "scan", "ts", "valid_from", "900 seconds", 4)
    got = [(r.scan, (r.version, r.biosignal, r.artifact, r.alignment)) for r in K.collected(live, "t-weights").collect()]
    assert len(got) == len(want) and dict(got) == want and len({w[0] for w in want.values()}) > 10


def test_tables_are_replayed_in_step(spark, tmp_path):
    """Versions of the last days only don't move the watermark past scans that are still to come; slices are bounded by rows."""
    rows = [(k, at(k * 600), k % 50, "signup" if k % 3 == 0 and k > 2000 else "view", 61.0 + k % 30, None) for k in range(3000)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    df.write.parquet(str(tmp_path / "events.parquet"))
    want = {r.event_id: r for r in QUERIES["weights_as_of"](spark, str(tmp_path)).collect()}
    got = QUERIES["live_weights"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 3000 and {r.event_id: r for r in got} == want

    burst = df.select("event_id", F.when(F.col("event_id") < 2500, F.col("ts")).otherwise(F.timestamp_micros(F.unix_micros(F.lit(START)) + F.col("event_id"))).alias("ts"))
    one, two = K.replay_in_step([(burst, "ts", 1), (versions(spark, str(tmp_path)), "valid_from", 4)], "t-step", rows=500)
    base = scratch_dir(spark, "t-step-out")
    q = one.unionByName(two.select(F.lit(None).cast("bigint").alias("event_id"), F.col("valid_from").alias("ts")))
    q = q.writeStream.format("parquet").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    assert len(q.recentProgress) >= 6 and max(p.numInputRows for p in q.recentProgress) <= 1100
    out = spark.read.schema("event_id bigint, ts timestamp").parquet(f"{base}/out")
    assert sorted(r[0] for r in out.filter("event_id is not null").collect()) == list(range(3000))
    none = K.replay_in_step([(burst.limit(0), "ts", 1), (versions(spark, str(tmp_path)).limit(0), "valid_from", 4)], "t-step")
    assert [K.collected(n, "t-step-none").collect() for n in none] == [[(None, START.replace(1970, 1, 1) + timedelta(days=1000))], [(START.replace(1970, 1, 1) + timedelta(days=1000), None, None, None, None)]]


def test_rows_are_ordered_by_time_then_by_the_rest():
    rng = random.Random(3)
    for n, span in ((0, 1), (1, 1), (500, 40), (500, 10**6)):
        rows = pd.DataFrame([(rng.randrange(span), rng.choice("abc"), rng.randrange(3)) for _ in range(n)], columns=["_us", "x", "y"])
        rows = rows[rows["y"] < 2] if n > 1 else rows
        pd.testing.assert_frame_equal(K._ordered(rows, list(rows)), rows.sort_values(list(rows), kind="stable", ignore_index=True))


def states(stream):
    """Most state rows that a stream held at once."""
    base = scratch_dir(stream.sparkSession, "t-states")
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    return max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators)


def test_hot_address_spreads_and_rare_keys_share_a_state(spark):
    rows = [(1, at(600 * i), i) for i in range(1000)]
    hot = stream_of(spark, [rows], "address int, ts timestamp, request int")
    assert states(K.admit_stream(hot, "address", "ts", "request", "1 second", 10, 3600)) >= 6
    many = [(k, at(k), k, 5) for k in range(600)]
    cams = stream_of(spark, [many], "cam int, ts timestamp, frame int, took long")
    assert states(K.live_scores(cams, "cam", "ts", "frame", "took", "1 second")) <= 64


def test_spans_cross_blocks(spark):
    rows = [("a", at(86_400 * d + s), 10 * d + k) for d in range(3) for k, s in enumerate((-7200, -3600, -1, 0, 1, 3599, 3600))]
    schema = "address string, ts timestamp, request int"
    want = admit(spark.createDataFrame(rows, schema), "address", "ts", 2, 3600).select("request", "requests", "allowed")
    live = K.collected(K.admit_stream(K.replay(spark.createDataFrame(rows, schema), "ts", "t-cross"), "address", "ts", "request", "1 second", 2, 3600), "t-cross-out")
    assert sorted(live.select("request", "requests", "allowed").collect()) == sorted(want.collect())
