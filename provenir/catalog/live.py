"""Streaming queries. Each runs a stream over the table's files to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import iso_ts
from ..operators.evaluation import exact_quantiles, quantile_values
from ..operators.stores import REQUEST_BUCKETS, active_at, admit
from ..plans.bindings import events, few_files
from ..plans.text_scan import text_scan
from ..session import scratch_dir
from ..streaming import jobs as J
from ..streaming import keyed as K
from .base import query
from .stores import VER, versions
from .text import SCAN_SQL, scan_view


def stream(spark, sf):
    e = J.read_table_stream(spark, f"{sf}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("latest_per_key", "SELECT user_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS last_ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1", "value", 4)
def _(spark, sf):
    base = scratch_dir(spark, "latest")
    J.latest_stream(stream(spark, sf), "user_id", ["ts", "event_id"], ["event_type", "value"], base, f"{base}/cp").awaitTermination()
    return J.read_state(spark, base).select("user_id", iso_ts("ts").alias("last_ts"), "event_type", "value")


@query("rate_limit", "SELECT event_type, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S.%f') AS minute, count(*) AS requests, count(*) > 10 AS limited FROM events GROUP BY 1, 2")
def _(spark, sf):
    r = J.run_update(J.rate_limit(stream(spark, sf), "event_type", "ts"), ["event_type", "minute"], "rate")
    return r.withColumn("minute", iso_ts("minute"))


@query("live_counters", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return J.run_update(J.live_counters(stream(spark, sf), ["event_type"]), ["event_type"], "counters")


@query("live_histogram", "SELECT event_type, count(*) AS n, sum(value) AS total, " + ", ".join(f"sum((value <= {b})::INT)::BIGINT AS le_{i}" for i, b in enumerate(REQUEST_BUCKETS)) + " FROM events GROUP BY 1", "total", 4)
def _(spark, sf):
    return J.run_update(J.live_histogram(stream(spark, sf), ["event_type"], "value", REQUEST_BUCKETS), ["event_type"], "hist")


@query("task_state", "SELECT user_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS last_ts, CASE arg_max(event_type, (ts, event_id)) WHEN 'signup' THEN 'STARTED' WHEN 'purchase' THEN 'SUCCESS' ELSE 'PROCESSING' END AS state, arg_max(event_type, (ts, event_id)) AS stage FROM events GROUP BY 1")
def _(spark, sf):
    base = scratch_dir(spark, "state")
    state = F.when(F.col("event_type") == "signup", "STARTED").when(F.col("event_type") == "purchase", "SUCCESS").otherwise("PROCESSING")
    J.task_state(stream(spark, sf), "user_id", ["ts", "event_id"], state, F.col("event_type"), base, f"{base}/cp").awaitTermination()
    return J.read_state(spark, base).select("user_id", iso_ts("ts").alias("last_ts"), "state", "stage")


@query("audit_stream", "SELECT strftime(ts, '%Y%m%d') AS day, 'auth.' || event_type AS event, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    base = scratch_dir(spark, "audit-stream")
    entries = J.audit_entries(stream(spark, sf), "ts", F.concat(F.lit("auth."), "event_type"), ["user_id"])
    J.audit_stream(entries, f"{base}/log", f"{base}/cp").awaitTermination()
    r = spark.read.schema("timestamp string, event string, user_id bigint, day string").json(f"{base}/log")
    return r.groupBy("day", "event").agg(F.count(F.lit(1)).alias("n"))


@query("watch_files", SCAN_SQL.format(id="doc_id"), "score confidence")
def _(spark, sf):
    base = scratch_dir(spark, "watch")
    small = few_files(spark.read.parquet(f"{sf}/documents.parquet"))
    cores = spark.sparkContext.defaultParallelism

    def scan(df):
        new = df.select("doc_id", "text")
        return text_scan(new.repartition(cores) if small else new)

    J.watch_files(spark, f"{sf}/documents.parquet", scan, f"{base}/out", f"{base}/cp").awaitTermination()
    return scan_view(spark.read.parquet(f"{base}/out"), "doc_id")


@query("stream_changes", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def _(spark, sf):
    base = scratch_dir(spark, "changes")
    J.change_stream(stream(spark, sf), "user_id", "event_type", ["ts", "event_id"], base, f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/changes").select("user_id", "event_id", "event_type")


@query("split_failures", "SELECT CASE WHEN value < 1 THEN 'dead_letter' ELSE 'result' END AS route, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    base = scratch_dir(spark, "failures")
    error = F.when(F.col("value") < 1, "E_EMPTY")
    J.split_failures(stream(spark, sf), error, f"{base}/good", f"{base}/dead", f"{base}/cp").awaitTermination()
    good = spark.read.parquet(f"{base}/good").select(F.lit("result").alias("route"), "event_type")
    dead = spark.read.parquet(f"{base}/dead").select(F.col("status").alias("route"), "event_type")
    return good.unionByName(dead).groupBy("route", "event_type").agg(F.count(F.lit(1)).alias("n"))


# --- keyed state in event-time order -----------------------------------------------

#: One address sends three fifths of all requests.
ADDRESS_SQL = "CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'shared' ELSE 'u' || user_id END"


def requests(spark, sf):
    """Requests with their address; most come from one."""
    shared = F.col("event_type").isin("view", "click", "purchase")
    address = F.when(shared, "shared").otherwise(F.concat(F.lit("u"), "user_id"))
    return events(spark, sf).select("event_id", "ts", address.alias("address"))


VERDICT_SQL = f"""SELECT event_id, address, n AS requests, n <= 10 AS allowed FROM (SELECT event_id, address,
    count(*) OVER (PARTITION BY address ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, {ADDRESS_SQL} AS address FROM events))"""


@query("request_verdicts", VERDICT_SQL)
def _(spark, sf):
    return admit(requests(spark, sf), "address", "ts", 10, 3600).select("event_id", "address", "requests", "allowed")


@query("live_request_verdicts", VERDICT_SQL)
def _(spark, sf):
    live = K.replay(requests(spark, sf), "ts", "requests")
    return K.collected(K.admit_stream(live, "address", "ts", "event_id", "1 minute", 10, 3600), "verdicts").select("event_id", "address", "requests", "allowed")


@query("live_weights", "SELECT event_id, version, coalesce(b, 0.33) AS biosignal, coalesce(a, 0.33) AS artifact, coalesce(l, 0.34) AS alignment FROM events ASOF LEFT JOIN vg ON events.ts >= vg.vf", "biosignal artifact alignment", extra=VER)
def _(spark, sf):
    shards = 16
    scans, published = K.replay_in_step([(events(spark, sf).select("event_id", "ts"), "ts", 1), (versions(spark, sf), "valid_from", shards)], "scans")
    return K.collected(K.weights_stream(scans, published, "event_id", "ts", "valid_from", "1 minute", shards), "live-weights", shards)


def live_inputs(spark, sf):
    """Frames of a user's camera; each takes ten minutes for every whole unit of its value."""
    return events(spark, sf).select("user_id", "event_id", "ts", K.micros_of(F.floor("value") * 600).alias("took"))


LIVE = {
    "li": "SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, to_seconds(floor(value)::BIGINT * 600) AS took FROM events",
}
LIVE_SQL = """WITH RECURSIVE run AS (SELECT user_id, event_id, ts, i, ts AS started, ts + took AS finished, 0::BIGINT AS dropped FROM li WHERE i = 1
    UNION ALL SELECT r.user_id, n.event_id, n.ts, n.i, greatest(n.ts, r.finished), greatest(n.ts, r.finished) + n.took, n.i - r.i - 1 FROM run r,
    LATERAL (SELECT coalesce(max(struct_pack(ts := li.ts, event_id := li.event_id, i := li.i, took := li.took)) FILTER (li.ts <= r.finished),
      min(struct_pack(ts := li.ts, event_id := li.event_id, i := li.i, took := li.took))) AS n FROM li WHERE li.user_id = r.user_id AND li.i > r.i) x WHERE n IS NOT NULL)
    SELECT user_id, event_id, strftime(started, '%Y-%m-%dT%H:%M:%S.%f') AS started, strftime(finished, '%Y-%m-%dT%H:%M:%S.%f') AS finished, dropped FROM run"""
LIVE_SQL = LIVE_SQL.replace("WITH RECURSIVE", f"WITH RECURSIVE li AS ({LIVE['li']}),", 1)


@query("live_scores", LIVE_SQL)
def _(spark, sf):
    live = K.replay(live_inputs(spark, sf), "ts", "live-inputs")
    r = K.collected(K.live_scores(live, "user_id", "ts", "event_id", "took", "1 minute"), "live-scores")
    return r.select("user_id", "event_id", iso_ts("started").alias("started"), iso_ts("finished").alias("finished"), "dropped")


WORK = {
    "we": "SELECT event_id, ts AS e FROM (SELECT event_id, ts + to_seconds(floor(value)::BIGINT * 60) AS ts FROM events WHERE event_type <> 'error')",
    "wk": "SELECT event_id, ts AS started, coalesce(e, ts + INTERVAL 30 MINUTE) AS ended, CASE WHEN e IS NULL THEN 'timed_out' ELSE 'finished' END AS outcome FROM (SELECT events.event_id, ts, e FROM events LEFT JOIN we ON we.event_id = events.event_id AND e <= ts + INTERVAL 30 MINUTE)",
}


def outcomes(spark, sf):
    """Work started by every event; errors never end, and long work ends too late."""
    e = events(spark, sf).select("event_id", "ts", "event_type", "value")
    done = F.timestamp_micros(F.unix_micros("ts") + K.micros_of(F.floor("value") * 60))
    ends = e.filter("event_type <> 'error'").select("event_id", done.alias("done"))
    starts = K.replay(e.select("event_id", "ts"), "ts", "starts")
    return K.collected(K.work_outcomes(starts, K.replay(ends, "done", "ends"), "event_id", "ts", "done", "1 minute", "30 minutes"), "outcomes")


@query("work_outcomes", "SELECT event_id, strftime(ended, '%Y-%m-%dT%H:%M:%S.%f') AS ended, outcome FROM wk", extra=WORK)
def _(spark, sf):
    return outcomes(spark, sf).select("event_id", iso_ts("ended").alias("ended"), "outcome")


@query("live_active", """SELECT strftime(instant, '%Y-%m-%dT%H:%M:%S.%f') AS instant, sum(d) OVER (ORDER BY instant)::BIGINT AS active FROM (SELECT instant, sum(d) AS d FROM
    (SELECT started AS instant, 1 AS d FROM wk UNION ALL SELECT ended, -1 FROM wk) GROUP BY instant)""", extra=WORK)
def _(spark, sf):
    return active_at(outcomes(spark, sf), "ts", "ended").select(iso_ts("instant").alias("instant"), "active")


QUANTILE_SQL = "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S.%f') AS hour, count(*) AS n, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1, 2"


def hourly(values):
    r = exact_quantiles(values.withColumn("hour", F.date_trunc("hour", "span")), ["event_type", "hour"], {"median": 0.5, "p95": 0.95})
    return r.withColumn("hour", iso_ts("hour"))


@query("sketch_quantiles", QUANTILE_SQL, "median p95")
def _(spark, sf):
    return hourly(quantile_values(events(spark, sf), ["event_type"], "ts", "value"))


@query("live_quantiles", QUANTILE_SQL, "median p95")
def _(spark, sf):
    live = quantile_values(stream(spark, sf), ["event_type"], "ts", "value")
    return hourly(J.run_update(live, ["event_type", "span"], "quantile-values"))
