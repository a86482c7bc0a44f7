"""History, ledger, custody, audit, dimension, report and manifest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import stores as S
from ..plans import bindings as D
from ..session import materialize, scratch_dir
from ..sources import manifest as M
from ..sources import objects as O
from ..sources import sinks as K
from ..sources.history import HistoryStore
from .base import query

# --- history -------------------------------------------------------------------


@query("history_stats", """SELECT count(*) AS total_scans, sum((verdict = 'AUTHENTIC')::INT)::BIGINT AS authentic_count, sum((verdict = 'MANIPULATED')::INT)::BIGINT AS manipulated_count, sum((verdict = 'UNCERTAIN')::INT)::BIGINT AS uncertain_count,
    sum((verdict = 'INCONCLUSIVE')::INT)::BIGINT AS inconclusive_count, round(avg(integrity_score), 2) AS avg_integrity_score FROM hist""", "avg_integrity_score", 2)
def _(spark, sf):
    return S.history_stats(D.history(spark, sf))


@query("history_daily", "SELECT CAST(timestamp AS DATE) AS date, count(*) AS scans, sum((verdict = 'MANIPULATED')::INT)::BIGINT AS threats FROM hist WHERE CAST(timestamp AS DATE) >= DATE '2024-01-23' GROUP BY 1")
def _(spark, sf):
    return S.history_daily(D.history(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp"), 7)


@query("recent", "SELECT session_id, verdict, integrity_score FROM hist ORDER BY timestamp DESC, session_id DESC LIMIT 20", "integrity_score", 2)
def _(spark, sf):
    return S.recent(D.history(spark, sf), 20).select("session_id", "verdict", "integrity_score")


@query("retain_recent", "SELECT session_id FROM hist ORDER BY timestamp DESC, session_id DESC LIMIT 100")
def _(spark, sf):
    return S.retain_recent(D.history(spark, sf), 100).select("session_id")


@query("expired", "SELECT verdict, count(*) AS n FROM hist WHERE session_id NOT IN (SELECT session_id FROM hist ORDER BY timestamp DESC, session_id DESC LIMIT 100) GROUP BY verdict")
def _(spark, sf):
    return S.expired(D.history(spark, sf), "session_id", 100).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def flagged(spark, sf):
    return D.history(spark, sf).filter("verdict = 'MANIPULATED'")


@query("delete_rows", "SELECT verdict, count(*) AS n, count(DISTINCT \"user\") AS users FROM hist WHERE verdict <> 'MANIPULATED' GROUP BY verdict")
def _(spark, sf):
    left = S.delete_rows(D.history(spark, sf), flagged(spark, sf), "session_id")
    return left.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("users"))


@query("deleted_count", "SELECT count(*) AS deleted FROM hist WHERE verdict = 'MANIPULATED'")
def _(spark, sf):
    return S.deleted_count(D.history(spark, sf), flagged(spark, sf), "session_id")


def stored_history(spark, sf):
    store = HistoryStore(spark, scratch_dir(spark, "history"))
    store.add(D.history(spark, sf))
    return store


@query("stored_delete", "SELECT CAST(timestamp AS DATE) AS day, verdict, count(*) AS n, sum(integrity_score) AS score FROM hist WHERE verdict <> 'MANIPULATED' GROUP BY ALL", "score", 2)
def _(spark, sf):
    store = stored_history(spark, sf)
    store.delete(flagged(spark, sf))
    return store.read().groupBy("day", "verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("integrity_score").alias("score"))


@query("stored_retain", "SELECT session_id, verdict FROM hist ORDER BY timestamp DESC, session_id DESC LIMIT 1000")
def _(spark, sf):
    store = stored_history(spark, sf)
    store.retain(1000)
    return store.read().select("session_id", "verdict")


@query("lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7", "o_totalprice", 2)
def _(spark, sf):
    return S.lookup(D.table(spark, sf, "orders"), "o_custkey", 7).select("o_orderkey", "o_totalprice")


# --- ledger ----------------------------------------------------------------------

SC = "((floor(o_totalprice)::BIGINT % 100) / 100)::DECIMAL(4, 2)"
LED = {
    "lg": f"""SELECT o_custkey AS chain, o_orderkey AS seq, '"core_scores":' || to_json('{{"artifact":"' || {SC} || '","biosignal":"' || {SC} || '"}}') || ',"file_hash":"' || sha256(o_orderkey::VARCHAR) || '","integrity_score":' || (100 - floor(o_totalprice)::BIGINT % 100) AS mid,
        '"session_id":"o' || o_orderkey || '","timestamp":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '","verdict":"' || CASE WHEN {SC} <= 0.30::DECIMAL(4,2) THEN 'AUTHENTIC' WHEN {SC} <= 0.50::DECIMAL(4,2) THEN 'UNCERTAIN' WHEN {SC} <= 0.65::DECIMAL(4,2) THEN 'INCONCLUSIVE' ELSE 'MANIPULATED' END
        || '","weights_used":' || to_json('{{"alignment":"0.34","artifact":"0.33","biosignal":"0.33"}}') || '}}' AS tl, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS bi FROM orders""",
}
LEDGER_SQL = (
    "WITH RECURSIVE lgx AS MATERIALIZED (" + LED["lg"] + "), lgr(chain, bi, seq, prev, h) AS (SELECT chain, bi, seq, repeat('0', 64), sha256('{\"block_index\":0,' || mid || ',\"previous_hash\":\"' || repeat('0', 64) || '\",' || tl) FROM lgx WHERE bi = 0 "
    "UNION ALL SELECT x.chain, x.bi, x.seq, r.h, sha256('{\"block_index\":' || x.bi || ',' || x.mid || ',\"previous_hash\":\"' || r.h || '\",' || x.tl) FROM lgr r JOIN lgx x ON x.chain = r.chain AND x.bi = r.bi + 1) "
)


def ledger(spark, sf):
    return S.ledger_append(D.verdict_rows(spark, sf), "chain", ["seq"])


@query("ledger_append", LEDGER_SQL + "SELECT chain, bi AS block_index, seq, prev AS previous_hash, h AS block_hash FROM lgr")
def _(spark, sf):
    return ledger(spark, sf).select("chain", "block_index", "seq", "previous_hash", "block_hash")


@query("ledger_continue", LEDGER_SQL + "SELECT chain, bi AS block_index, h AS block_hash FROM lgr WHERE bi >= (SELECT count(*) // 2 FROM lgx y WHERE y.chain = lgr.chain)")
def _(spark, sf):
    """Append the second half of every chain to a stored first half."""
    rows = D.verdict_rows(spark, sf)
    from ..operators.ordered import dense_index

    placed = dense_index(rows, ["chain"], F.col("seq"), [F.col("seq")], "_p").join(rows.groupBy("chain").agg(F.count(F.lit(1)).alias("_n")), "chain")
    placed = materialize(placed, "ledger-input")
    half = F.floor(F.col("_n") / 2)
    first = S.ledger_append(placed.filter(F.col("_p") < half).drop("_p", "_n"), "chain", ["seq"])
    tails = first.groupBy("chain").agg(F.max("block_index").alias("block_index"), F.max_by("block_hash", "block_index").alias("block_hash"))
    rest = S.ledger_append(placed.filter(F.col("_p") >= half).drop("_p", "_n"), "chain", ["seq"], tails)
    return rest.select("chain", "block_index", "block_hash")


def broken(spark, sf):
    """The ledger with one verdict altered in every chain of three blocks or more."""
    led = materialize(ledger(spark, sf), "ledger")
    hit = F.col("block_index") == 2
    return led.withColumn("verdict", F.when(hit, "ALTERED").otherwise(F.col("verdict")))


@query("ledger_verify", """SELECT o_custkey AS chain, count(*) AS blocks, count(*) < 3 AS valid, CASE WHEN count(*) >= 3 THEN 2::BIGINT END AS broken_at, CASE WHEN count(*) >= 3 THEN 'Block 2 hash mismatch (tampered)' ELSE 'Chain integrity verified' END AS message FROM orders GROUP BY 1""")
def _(spark, sf):
    return S.ledger_verify(broken(spark, sf), "chain")


@query("ledger_verify_intact", "SELECT o_custkey AS chain, count(*) AS blocks, true AS valid FROM orders GROUP BY 1")
def _(spark, sf):
    return S.ledger_verify(materialize(ledger(spark, sf), "ledger"), "chain").select("chain", "blocks", "valid")


@query("ledger_export")
def _(spark, sf):
    return S.ledger_export(materialize(ledger(spark, sf), "ledger"), "chain")


@query("ledger_length", "SELECT o_custkey AS chain, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return S.counts(D.verdict_rows(spark, sf), ["chain"])


@query("class_counts", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def _(spark, sf):
    return S.counts(D.table(spark, sf, "labels"), ["quality", "toxic"])


# --- custody ----------------------------------------------------------------------

STEP = "CASE event_type WHEN 'click' THEN 'original_file' WHEN 'view' THEN 'extracted_frames' ELSE 'analysis_result' END"


def chain_entries(spark, sf):
    label = F.when(F.col("event_type") == "click", "original_file").when(F.col("event_type") == "view", "extracted_frames").otherwise("analysis_result")
    return D.events(spark, sf).select(
        F.col("user_id").alias("session"), label.alias("label"), F.col("event_id").alias("seq"), H.content_hash(F.col("event_id").cast("string")).alias("sha256"),
    )


@query("custody", f"SELECT session, sum(n)::BIGINT AS chain_length, string_agg(label || '=' || sha, ',' ORDER BY label) AS summary FROM (SELECT user_id AS session, {STEP} AS label, count(*) AS n, sha256(max(event_id)::VARCHAR) AS sha FROM events GROUP BY 1, 2) GROUP BY session")
def _(spark, sf):
    c = S.custody(chain_entries(spark, sf), "session", "label", "sha256", "seq")
    text = F.array_join(F.transform(F.map_entries("summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return c.select("session", "chain_length", text.alias("summary"))


@query("verify_hashes", f"SELECT e.user_id AS session, {STEP} AS label, e.event_id AS seq, e.event_id = m.first_id AS match FROM events e JOIN (SELECT user_id, {STEP} AS st, min(event_id) AS first_id FROM events GROUP BY 1, 2) m ON m.user_id = e.user_id AND m.st = {STEP}")
def _(spark, sf):
    e = chain_entries(spark, sf)
    expected = e.withColumnRenamed("sha256", "expected")
    return S.verify_hashes(e, expected, "session", "label", "sha256", "seq").select("session", "label", "seq", "match")


@query("content_hash", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", H.content_hash("text").alias("sha"))


@query("row_hash", """SELECT o_orderkey, sha256('{"cust":' || o_custkey || ',"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS sha FROM orders""")
def _(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.select("o_orderkey", H.row_hash({"status": F.col("o_orderstatus"), "key": F.col("o_orderkey"), "cust": F.col("o_custkey")}).alias("sha"))


@query("origin_proof", """SELECT item, sha256(p) AS origin_hash FROM (SELECT item, '{"metadata":{"frame_count":' || frame_count || ',"height":' || height || ',"width":' || ((height * 16) // 9) || '},"session_id":"' || item || '"}' AS p FROM media0)""")
def _(spark, sf):
    m = D.media_rows(spark, sf)
    meta = {"width": F.col("width"), "height": F.col("height"), "frame_count": F.col("frame_count")}
    return m.select("item", H.origin_proof({"session_id": F.col("item").cast("string")}, meta)["origin_hash"].alias("origin_hash"))


IPAD = "".join(f"\\x{b ^ 0x36:02X}" for b in b"audit-key".ljust(64, b"\0"))
OPAD = "".join(f"\\x{b ^ 0x5C:02X}" for b in b"audit-key".ljust(64, b"\0"))


@query("sign_payload", f"SELECT event_id, 'sha256=' || sha256('{OPAD}'::BLOB || unhex(sha256('{IPAD}'::BLOB || encode(props)))) AS signature FROM events")
def _(spark, sf):
    return D.events(spark, sf).select("event_id", H.sign_payload("props", "audit-key").alias("signature"))


@query("parse_scores", "SELECT event_id, (props->>'k')::DOUBLE AS k FROM events", "k")
def _(spark, sf):
    return D.events(spark, sf).select("event_id", H.parse_scores("props")["k"].alias("k"))


@query("timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-23'")
def _(spark, sf):
    e = D.events(spark, sf).filter(H.since_days("ts", F.lit("2024-01-30").cast("timestamp"), 7))
    return e.select("event_id", H.iso_ts("ts").alias("iso"), H.day("ts").alias("day"))


@query("notification", """SELECT event_id, '{"event":"scan.started","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","data":{"session_id":"' || event_id || '","filename":"' || event_type || '","user":"' || user_id || '"}}' AS payload FROM events""")
def _(spark, sf):
    data = [F.col("event_id").cast("string").alias("session_id"), F.col("event_type").alias("filename"), F.col("user_id").cast("string").alias("user")]
    return D.events(spark, sf).select("event_id", H.notification("scan.started", F.col("ts"), data).alias("payload"))


# --- counters ---------------------------------------------------------------------


@query("counters", "SELECT event_type, (value > 100)::VARCHAR AS success, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    e = D.events(spark, sf).withColumn("success", (F.col("value") > 100).cast("string"))
    return S.counts(e, ["event_type", "success"])


LE = ", ".join(f"('{b}', {b})" for b in S.REQUEST_BUCKETS)


@query("histogram", f"SELECT event_type, le, sum((value <= b)::INT)::BIGINT AS cumulative, sum(value) AS total, count(*) AS count FROM events CROSS JOIN (VALUES {LE}, ('+Inf', 1e308)) t(le, b) GROUP BY 1, 2", "total", 4)
def _(spark, sf):
    return S.histogram(D.events(spark, sf), ["event_type"], "value", S.REQUEST_BUCKETS)


@query("active_at", """SELECT strftime(instant, '%Y-%m-%dT%H:%M:%S.%f') AS instant, sum(d) OVER (ORDER BY instant)::BIGINT AS active FROM (SELECT instant, sum(d) AS d FROM (SELECT ts AS instant, 1 AS d FROM events UNION ALL SELECT ts + to_seconds(floor(value)::BIGINT * 60), -1 FROM events WHERE event_type <> 'error') GROUP BY instant)""")
def _(spark, sf):
    e = D.events(spark, sf)
    end = F.when(F.col("event_type") != "error", F.timestamp_micros(F.unix_micros("ts") + F.floor("value") * 60_000_000))
    return S.active_at(e.withColumn("done", end), "ts", "done").select(H.iso_ts("instant").alias("instant"), "active")


# --- dimensions --------------------------------------------------------------------

KEYS = [t[0] for t in S.THREATS]


def suspects(spark, sf):
    """Items with the threat named by their id; the last names are unknown."""
    names = F.array(*[F.lit(k) for k in KEYS], F.lit("unlisted"))
    return D.media_rows(spark, sf).select("item", F.get(names, (F.col("item") % 11).cast("int")).alias("threat"))


TV = ", ".join(f"('{t[0]}', '{t[2]}', '{t[3]}', {t[5]}, {0.5 if t[6] != 'NONE' else 0.1}, {t[7]})" for t in S.THREATS)
THR = {
    "tv": f"SELECT * FROM (VALUES {TV}) t(threat, category, family, bi, ar, al)",
    "sus": f"SELECT item, [{', '.join(repr(k) for k in KEYS)}, 'unlisted'][item % 11 + 1] AS threat FROM media0",
}


@query("threat_weights", "SELECT item, threat, bi / (bi + ar + al) AS w_biosignal, ar / (bi + ar + al) AS w_artifact, al / (bi + ar + al) AS w_alignment FROM sus LEFT JOIN tv USING (threat)", "w_biosignal w_artifact w_alignment", extra=THR)
def _(spark, sf):
    return S.threat_weights(suspects(spark, sf), S.threats(spark))


@query("threats", "SELECT category, family, count(*) AS items, count(DISTINCT threat) AS threats FROM sus JOIN tv USING (threat) GROUP BY 1, 2", extra=THR)
def _(spark, sf):
    j = suspects(spark, sf).join(F.broadcast(S.threats(spark)), "threat")
    return j.groupBy("category", "family").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("threat").alias("threats"))


@query("fan_out", "SELECT url, count(*) AS n FROM events JOIN (VALUES ('a', 'click'), ('a', 'error'), ('b', 'error'), ('c', 'view')) s(url, ev) ON ev = event_type GROUP BY url")
def _(spark, sf):
    subs = spark.createDataFrame([("a", ["click", "error"]), ("b", ["error"]), ("c", ["view"])], "url string, events array<string>")
    return S.fan_out(D.events(spark, sf).select("event_id", F.col("event_type").alias("event")), subs).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


def versions(spark, sf):
    """Weight versions written by the events of the highest values."""
    e = D.events(spark, sf).filter("event_type = 'signup' AND value > 60")
    a = (F.floor("value") % 10) / 20
    return e.select(
        F.col("ts").alias("valid_from"), F.concat(F.lit("v"), F.col("event_id")).alias("version"),
        a.alias("biosignal"), F.lit(0.3).alias("artifact"), F.when(F.col("user_id") % 3 == 0, F.lit(0.9)).otherwise(0.7 - a).alias("alignment"),
    )


VER = {
    "vr": "SELECT ts AS vf, 'v' || event_id AS version, (floor(value) % 10) / 20 AS b, 0.3 AS a, CASE WHEN user_id % 3 = 0 THEN 0.9 ELSE 0.7 - (floor(value) % 10) / 20 END AS l FROM events WHERE event_type = 'signup' AND value > 60",
    "vo": "SELECT *, b >= 0 AND l >= 0 AND b + a + l BETWEEN 0.99 AND 1.01 AS ok FROM vr",
    "vg": "SELECT * FROM vo WHERE ok",
}


@query("valid_weights", "SELECT version, ok AS is_valid, CASE WHEN ok THEN b ELSE 0.33 END AS biosignal, CASE WHEN ok THEN a ELSE 0.33 END AS artifact, CASE WHEN ok THEN l ELSE 0.34 END AS alignment FROM vo", "biosignal artifact alignment", extra=VER)
def _(spark, sf):
    return S.valid_weights(versions(spark, sf)).drop("valid_from")


@query("weights_as_of", "SELECT event_id, version, coalesce(b, 0.33) AS biosignal, coalesce(a, 0.33) AS artifact, coalesce(l, 0.34) AS alignment FROM events ASOF LEFT JOIN vg ON events.ts >= vg.vf", "biosignal artifact alignment", extra=VER)
def _(spark, sf):
    return S.weights_as_of(D.events(spark, sf).select("event_id", "ts"), versions(spark, sf), "ts", "valid_from").drop("ts")


@query("detect_changes", "SELECT item, idx, coalesce(k <> lag(k) OVER (PARTITION BY item ORDER BY idx), true) AS changed FROM (SELECT user_id AS item, idx, event_type AS k FROM ranked)")
def _(spark, sf):
    r = D.ranked_events(spark, sf).select(F.col("user_id").alias("item"), "idx", H.content_hash("event_type").alias("sha"))
    return S.detect_changes(r, "item", "idx", "sha").select("item", "idx", "changed")


@query("authorised", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'purchase' AND value > 90) OR bool_or(event_type = 'signup' AND value > 90)) GROUP BY 1")
def _(spark, sf):
    e = D.events(spark, sf)
    scope = F.when((F.col("event_type") == "purchase") & (F.col("value") > 90), "write").when((F.col("event_type") == "signup") & (F.col("value") > 90), "admin").otherwise("read")
    # A user holds at most three distinct scopes.
    users = e.groupBy("user_id").agg(F.collect_set(scope).alias("scopes"))
    return S.authorised(e, users, "user_id", "write").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


# --- reports -----------------------------------------------------------------------


@query("recommendations", "SELECT verdict, line, rec AS recommendation, count(*) AS n FROM (SELECT verdict, unnest(CASE verdict " + " ".join(
    f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}{', ' + repr('Primary detection by artifact.') if k == 'MANIPULATED' else ''}]" for k, v in S.RECOMMENDATIONS.items()
) + " END) AS rec, unnest(range(CASE verdict WHEN 'MANIPULATED' THEN 4 ELSE 2 END)) AS line FROM hist) GROUP BY 1, 2, 3")
def _(spark, sf):
    h = D.history(spark, sf).withColumn("leading_core", F.lit("artifact"))
    r = S.recommendations(h, ["session_id", "verdict"]).withColumn("line", F.col("line").cast("bigint"))
    return r.groupBy("verdict", "line", "recommendation").agg(F.count(F.lit(1)).alias("n"))


@query("report_rows", "SELECT session_id, core, score, CASE WHEN score > 0.6 THEN 'FAIL' WHEN score > 0.3 THEN 'WARN' ELSE 'PASS' END AS status, CASE core WHEN 'ALIGNMENT' THEN '34.0%' ELSE '33.0%' END AS weight_text FROM (SELECT session_id, unnest(['BIOSIGNAL', 'ARTIFACT', 'ALIGNMENT']) AS core, unnest([biosignal_score, artifact_score, alignment_score]) AS score FROM hist)", "score")
def _(spark, sf):
    return S.report_rows(D.history(spark, sf), "session_id").select("session_id", "core", "score", "status", "weight_text")


@query("report_metadata", "SELECT session_id, filename, sha256_hash[1:32] || '...' AS sha256, '1280x720' AS resolution, printf('%.2f seconds', duration_seconds) AS duration FROM hist")
def _(spark, sf):
    return S.report_metadata(D.history(spark, sf), "session_id")


# --- manifests and sinks --------------------------------------------------------------


@query("media_manifest")
def _(spark, sf):
    return M.media_manifest(spark, sf, (".parquet",)).select("label", "name", "ext", "length")


@query("file_inventory")
def _(spark, sf):
    return M.file_inventory(spark, sf, (".parquet",))


def objects(spark, sf):
    return D.table(spark, sf, "pages").select(F.col("url").alias("key"), F.octet_length("html").cast("bigint").alias("size"), F.col("page_id").alias("last_modified"))


@query("list_objects", "SELECT url AS key, strlen(html)::BIGINT AS size FROM pages WHERE url LIKE 'https://%' ORDER BY url, strlen(html) LIMIT 1000")
def _(spark, sf):
    return M.list_objects(objects(spark, sf), "https://").select("key", "size")


@query("storage_usage", "SELECT count(*) AS total_files, sum(strlen(html))::BIGINT AS total_size_bytes, round(sum(strlen(html)) / 1048576, 2) AS total_size_mb FROM pages", "total_size_mb", 2)
def _(spark, sf):
    return M.storage_usage(objects(spark, sf))


SPL = "CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END"


def paths(spark, sf):
    l = D.table(spark, sf, "labels")
    split = F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train")
    kind = F.when(F.col("quality") == 1, "real").otherwise("fake")
    tail = F.when(F.col("toxic") == 1, F.concat(F.lit("clip"), F.floor(F.col("doc_id") / 100), F.lit("/f"), "doc_id", F.lit(".jpg"))).otherwise(F.concat(F.lit("i"), "doc_id", F.lit(".PNG")))
    return l.select(F.concat(F.lit("/data/"), split, F.lit("/"), kind, F.lit("/"), tail).alias("path"))


@query("split_manifest", f"SELECT {SPL} AS split, (quality = 0)::INT AS label, CASE WHEN toxic = 1 THEN 'clip' || doc_id // 100 ELSE 'i' || doc_id || '.PNG' END AS sample, toxic = 1 AS is_video FROM labels")
def _(spark, sf):
    return M.split_manifest(paths(spark, sf), "path").drop("path")


@query("split_counts", f"SELECT {SPL} AS split, (quality = 0)::INT AS label, count(*) AS samples FROM labels GROUP BY 1, 2")
def _(spark, sf):
    return M.split_counts(M.split_manifest(paths(spark, sf), "path"))


@query("result_key", "SELECT url, regexp_replace(url, '\\.[^.]*$', '') || '_result.json' AS result_key FROM pages")
def _(spark, sf):
    return D.table(spark, sf, "pages").select("url", K.result_key("url").alias("result_key"))


@query("source_results", "SELECT lang || '_result.json' AS result_key, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def _(spark, sf):
    path = scratch_dir(spark, "results")
    d = D.table(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"), F.concat("lang", F.lit(".txt")).alias("key"))
    K.write_by_source(d, "key", path)
    r = spark.read.schema("doc_id bigint, chars bigint, key string, result_key string").json(path)
    return r.groupBy("result_key").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


def beside(spark, sf):
    """A result for each language and source of documents, written beside its source."""
    root = scratch_dir(spark, "beside")
    d = D.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    O.write_beside(d, F.concat("lang", F.lit("/"), "source", F.lit(".txt")), F.struct("n", "chars"), root)
    return root


BESIDE = "SELECT lang || '/' || source || '_result.json' AS key, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang, source"


@query("results_beside", BESIDE)
def _(spark, sf):
    root = beside(spark, sf)
    r = spark.read.schema("n bigint, chars bigint").option("recursiveFileLookup", "true").json(root)
    return r.select(F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1).alias("key"), "n", "chars")


@query("object_listing", f"""SELECT key, strlen('{{"n":' || n || ',"chars":' || chars || '}}')::BIGINT AS size FROM ({BESIDE}) WHERE key LIKE 'e%'""")
def _(spark, sf):
    listed = O.objects(spark, beside(spark, sf))
    return listed.filter(F.col("key").startswith("e") & F.col("key").endswith("_result.json")).select("key", "size")


def audit_rows(spark, sf):
    e = D.events(spark, sf).select(
        "ts", F.col("event_id").cast("string").alias("session_id"), F.concat(F.lit("u"), "user_id").alias("user"), F.col("event_type").alias("action"),
        F.lit("10.0.0.1").alias("ip_address"), (F.col("value") > 5).alias("success"), F.col("props").alias("details"),
        F.concat("event_type", F.lit(".mp4")).alias("filename"), H.content_hash("props").alias("video_hash"),
        F.lit("AUTHENTIC").alias("verdict"), F.col("value").alias("integrity_score"), F.lit(0.8).alias("confidence"), F.lit("artifact").alias("leading_core"), F.col("value").alias("duration_ms"),
        F.lit("E_DECODE").alias("error_code"), F.lit("decode failed").alias("message"),
    )
    return e


@query("audit_events", """SELECT event, count(*) AS n, count(DISTINCT timestamp) AS stamps FROM (SELECT CASE event_type WHEN 'click' THEN 'analysis_request' WHEN 'view' THEN 'analysis_result' WHEN 'signup' THEN 'auth.signup' WHEN 'purchase' THEN 'admin.purchase' ELSE 'error' END AS event, ts AS timestamp FROM events) GROUP BY event""")
def _(spark, sf):
    kinds = {"click": "request", "view": "result", "signup": "auth", "purchase": "admin", "error": "error"}
    rows = audit_rows(spark, sf)
    out = None
    for t, k in kinds.items():
        part = K.audit_events(rows.filter(F.col("action") == t), k)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("timestamp").alias("stamps"))


@query("write_audit", "SELECT strftime(ts, '%Y%m%d') AS day, 'auth.' || event_type AS event, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    path = scratch_dir(spark, "audit")
    K.write_audit(K.audit_events(audit_rows(spark, sf), "auth"), path)
    r = K.read_audit(spark, path, "user string")
    return r.groupBy("day", "event").agg(F.count(F.lit(1)).alias("n"))


@query("write_results", "SELECT count(*) AS samples, sum((verdict = 'MANIPULATED')::INT)::BIGINT AS manipulated, max(integrity_score) AS top FROM hist", "top", 2)
def _(spark, sf):
    path = scratch_dir(spark, "evaluation")
    h = D.history(spark, sf).select(F.col("filename").alias("file"), "verdict", "integrity_score")
    K.write_results(h, {"samples": F.count(F.lit(1))}, path, "events")
    r = K.read_results(spark, path, "file string, verdict string, integrity_score double")
    return r.agg(F.count(F.lit(1)).alias("samples"), F.sum((F.col("verdict") == "MANIPULATED").cast("bigint")).alias("manipulated"), F.max("integrity_score").alias("top"))
