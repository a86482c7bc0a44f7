"""Ledger, custody, history, signatures, dimensions."""

from __future__ import annotations

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from provenir.functions import hashing as H
from provenir.operators import stores as S
from tests.conftest import rows

COLS = "chain bigint, seq bigint, core_scores string, file_hash string, integrity_score bigint, session_id string, timestamp string, verdict string, weights_used string"


def verdicts(spark, chains=((1, 40), (2, 3), (3, 1))):
    data = [(c, i, '{"a":1}', f"f{i}", 50 + i, f"s{i}", "2024", "AUTHENTIC", "{}") for c, n in chains for i in range(n)]
    return spark.createDataFrame(data, COLS)


def chain_hashes(rows_):
    prev, out = "0" * 64, []
    for i, r in enumerate(rows_):
        body = {
            "block_index": i, "core_scores": r["core_scores"], "file_hash": r["file_hash"], "integrity_score": r["integrity_score"],
            "previous_hash": prev, "session_id": r["session_id"], "timestamp": r["timestamp"], "verdict": r["verdict"], "weights_used": r["weights_used"],
        }
        prev = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        out.append(prev)
    return out


def test_chain_is_linked_and_hashes_canonical_json(spark):
    got = rows(S.ledger_append(verdicts(spark), "chain", ["seq"]), "chain", "block_index")
    for c in (1, 2, 3):
        mine = [r for r in got if r["chain"] == c]
        assert mine[0]["previous_hash"] == "0" * 64
        assert [r["block_hash"] for r in mine] == chain_hashes(mine)
        assert [r["previous_hash"] for r in mine[1:]] == [r["block_hash"] for r in mine[:-1]]


def test_continued_chain_equals_one_pass(spark):
    v = verdicts(spark)
    whole = rows(S.ledger_append(v, "chain", ["seq"]), "chain", "block_index")
    first = S.ledger_append(v.filter("seq < 2"), "chain", ["seq"])
    tails = first.groupBy("chain").agg(F.max("block_index").alias("block_index"), F.max_by("block_hash", "block_index").alias("block_hash"))
    rest = S.ledger_append(v.filter("seq >= 2"), "chain", ["seq"], tails)
    assert rows(first.unionByName(rest), "chain", "block_index") == whole


@pytest.mark.parametrize("chunk", [4096, 4])
def test_tampering_is_found_at_the_first_block(spark, chunk):
    led = S.ledger_append(verdicts(spark), "chain", ["seq"])
    ok = rows(S.ledger_verify(led, "chain", chunk), "chain")
    assert all(r["valid"] for r in ok) and [r["blocks"] for r in ok] == [40, 3, 1]
    hit = (F.col("chain") == 1) & (F.col("block_index") == 17)
    changed = led.withColumn("verdict", F.when(hit, "X").otherwise(F.col("verdict")))
    r = rows(S.ledger_verify(changed, "chain", chunk), "chain")[0]
    assert (r["valid"], r["broken_at"], r["message"]) == (False, 17, "Block 17 hash mismatch (tampered)")
    dropped = led.filter(~hit)
    r = rows(S.ledger_verify(dropped, "chain", chunk), "chain")[0]
    assert (r["broken_at"], r["message"]) == (18, "Chain broken at block 18: previous_hash mismatch")


def test_export_has_every_block(spark):
    led = S.ledger_append(verdicts(spark, ((7, 3),)), "chain", ["seq"])
    got = rows(S.ledger_export(led, "chain"), "block_index")
    assert [json.loads(r["block_json"])["block_index"] for r in got] == [0, 1, 2]
    assert all(r["valid"] for r in got)


@pytest.mark.parametrize("key", ["k", "x" * 80])
def test_signature_is_hmac(spark, key):
    df = spark.createDataFrame([('{"a":"é"}',)], "p string")
    want = "sha256=" + hmac.new(key.encode(), '{"a":"é"}'.encode(), hashlib.sha256).hexdigest()
    assert df.select(H.sign_payload("p", key)).first()[0] == want


def test_custody_keeps_the_last_and_verify_reads_the_first(spark):
    data = [("s", "original_file", 1, "a"), ("s", "original_file", 2, "b"), ("s", "analysis_result", 3, "c")]
    e = spark.createDataFrame(data, "session string, label string, seq int, sha256 string")
    c = S.custody(e, "session", "label", "sha256", "seq").first()
    assert c["chain_length"] == 3 and c["summary"] == {"original_file": "b", "analysis_result": "c"}
    want = spark.createDataFrame([("s", "original_file", "a"), ("s", "original_file", "b"), ("s", "other", "z")], "session string, label string, expected string")
    got = {(r["label"], r["expected"]): r["match"] for r in S.verify_hashes(e, want, "session", "label", "sha256", "seq").collect()}
    assert got == {("original_file", "a"): True, ("original_file", "b"): False, ("other", "z"): False}


def history(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("s"), F.lpad("id", 4, "0")).alias("session_id"), F.when(F.col("id") % 2 == 0, "AUTHENTIC").otherwise("MANIPULATED").alias("verdict"),
        F.col("id").cast("double").alias("integrity_score"), F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"),
    )


def test_history_on_an_empty_table_is_zero(spark):
    r = S.history_stats(history(spark, 0)).first()
    assert tuple(r) == (0, 0, 0, 0, 0, 0.0)


def test_recent_is_clamped_and_expired_is_the_rest(spark):
    h = history(spark, 130)
    assert S.recent(h, 500).count() == 100 and S.recent(h, 0).count() == 1
    assert S.expired(h, "session_id", 100).count() == 30
    keys = h.limit(5).select("session_id")
    assert S.delete_rows(h, keys, "session_id").count() == 125
    assert S.deleted_count(h, keys, "session_id").first()["deleted"] == 5


def test_weights_as_of_uses_last_valid_version(spark):
    v = spark.createDataFrame(
        [(10, "v1", 0.2, 0.3, 0.5), (20, "bad", 0.9, 0.9, 0.9), (30, "v2", 0.5, 0.3, 0.2)], "at bigint, version string, biosignal double, artifact double, alignment double",
    ).withColumn("valid_from", F.timestamp_seconds("at")).drop("at")
    s = spark.createDataFrame([(i, i) for i in (5, 10, 25, 30, 99)], "id bigint, at bigint").withColumn("ts", F.timestamp_seconds("at"))
    got = rows(S.weights_as_of(s, v, "ts", "valid_from"), "id")
    assert [r["version"] for r in got] == [None, "v1", "v1", "v2", "v2"]
    assert got[0]["biosignal"] == 0.33 and got[4]["biosignal"] == 0.5


def test_unknown_threat_has_no_weights(spark):
    items = spark.createDataFrame([("wav2lip",), ("nope",)], "threat string")
    got = rows(S.threat_weights(items, S.threats(spark)), "threat")
    assert got[0]["w_biosignal"] is None
    assert sum(got[1][k] for k in ("w_biosignal", "w_artifact", "w_alignment")) == pytest.approx(1.0)
    assert S.threats(spark).count() == 10


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("a", v) for v in (0.05, 0.1, 3.0, 500.0)], "d string, v double")
    got = {r["le"]: r["cumulative"] for r in S.histogram(df, ["d"], "v").collect()}
    assert (got["0.1"], got["2.5"], got["5.0"], got["120.0"], got["+Inf"]) == (2, 2, 3, 3, 4)


def test_active_gauge(spark):
    df = spark.createDataFrame([(1, 5), (2, 3), (3, None)], "s bigint, e bigint").select(F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    got = [r["active"] for r in rows(S.active_at(df, "s", "e"), "instant")]
    assert got == [1, 2, 2, 1]


def test_report_rows_and_recommendations(spark):
    df = spark.createDataFrame([("s", "MANIPULATED", 0.7, 0.4, 0.1)], "id string, verdict string, biosignal_score double, artifact_score double, alignment_score double")
    got = rows(S.report_rows(df, "id"), "core")
    assert [(r["core"], r["status"], r["weight_text"]) for r in got] == [("ALIGNMENT", "PASS", "34.0%"), ("ARTIFACT", "WARN", "33.0%"), ("BIOSIGNAL", "FAIL", "33.0%")]
    lines = rows(S.recommendations(S.with_report_defaults(df), ["id"]), "line")
    assert len(lines) == 4 and lines[3]["recommendation"] == "Primary detection by N/A."
