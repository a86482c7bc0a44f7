"""Core fusion, attention, detectors and registry rules."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.functions import bands as B
from provenir.operators import fusion as U
from provenir.plans.registry import Detector, Registry, scan, text_detector
from tests.conftest import rows

CORES = ("biosignal", "artifact", "alignment")


def wide(spark, cases):
    data = [(i, *[float(x) for x in sc], *[float(x) for x in cf]) for i, (sc, cf) in enumerate(cases)]
    cols = ", ".join(f"{k}_score double" for k in CORES) + ", " + ", ".join(f"{k}_confidence double" for k in CORES)
    return spark.createDataFrame(data, f"item int, {cols}")


CASES = [
    ((0.15, 0.10, 0.12), (0.85, 0.80, 0.88)),
    ((0.78, 0.85, 0.72), (0.72, 0.82, 0.65)),
    ((0.50, 0.20, 0.70), (0.20, 0.90, 0.85)),
    ((0.90, 0.40, 0.10), (0.50, 0.50, 0.50)),
    ((0.45, 0.45, 0.45), (0.10, 0.20, 0.30)),
]


@pytest.fixture(scope="module")
def fused(spark):
    return rows(U.fuse_cores(wide(spark, CASES)), "item")


def test_weights_sum_to_one(fused):
    for r in fused:
        assert sum(r[f"w_{k}"] for k in CORES) == pytest.approx(1.0)


def test_authentic_and_manipulated(fused):
    a, m = fused[0], fused[1]
    assert (a["verdict"], a["consensus_type"], a["leading_core"]) == ("AUTHENTIC", "CONSENSUS_PASS", "alignment")
    assert (m["verdict"], m["consensus_type"]) == ("MANIPULATED", "CONSENSUS_FAIL")
    assert a["integrity_score"] > 80 and m["integrity_score"] < 30
    assert a["integrity_score"] == pytest.approx(100 * (1 - (0.15 * 0.33 + 0.10 * 0.33 + 0.12 * 0.34)), abs=0.006)


def test_low_confidence_core_loses_half_its_weight(fused):
    r = fused[2]
    assert r["w_biosignal"] == pytest.approx(0.165)
    assert r["w_artifact"] == pytest.approx(0.33 + 0.165 * 0.9 / 1.75)
    assert r["consensus_type"] == "DEFER_TO_ALIGNMENT"
    assert [f for f in r["factors"] if f.startswith("BIOSIGNAL CORE low confidence (0.20)")]


def test_conflict_and_all_weak(fused):
    assert (fused[3]["verdict"], fused[3]["conflicting"]) == ("INCONCLUSIVE", True)
    assert [fused[4][f"w_{k}"] for k in CORES] == pytest.approx([0.33, 0.33, 0.34])
    assert fused[4]["confidence"] >= 0.1


def test_confidence_product(spark):
    r = rows(U.fuse_cores(wide(spark, CASES[:1]), "confidence_product"), "item")[0]
    want = (0.15 * 0.85 + 0.10 * 0.80 + 0.12 * 0.88) / (0.85 + 0.80 + 0.88)
    assert r["fused"] == pytest.approx(want)
    with pytest.raises(ValueError):
        U.fused_score("other")


@pytest.mark.parametrize(
    "audio,factor",
    [((False, None, "NO_AUDIO", 0.3, False), 0.3), ((True, 3.0, "EXTREME", 0.3, True), 0.3),
     ((True, 12.0, "MEDIUM", 0.7, True), 0.7), ((True, 30.0, "LOW", 1.0, False), 0.5), ((True, 30.0, "LOW", 1.0, True), 1.0)],
)
def test_audio_rules(spark, audio, factor):
    a = spark.createDataFrame([(0, *audio)], "item int, has_audio boolean, snr_db double, noise_level string, av_weight double, is_speech boolean")
    r = rows(U.redistribute_weights(U.with_context(wide(spark, CASES[:1]), None, a, "item")), "item")[0]
    raw = 0.34 * factor
    assert r["w_alignment"] == pytest.approx(raw / (0.66 + raw))


def test_transparency_texts(spark):
    d = wide(spark, CASES[1:2])
    for k in CORES:
        d = d.withColumn(f"{k}_anomalies", F.array(F.lit("X")))
    r = rows(U.transparency(U.fuse_cores(d)), "item")[0]
    assert r["primary_concern"] == "Missing or inconsistent biological signals detected"
    assert r["summary"] == "Manipulation detected. " + r["primary_concern"]
    assert r["supporting_evidence"] == ["[BIOSIGNAL] X", "[ARTIFACT] X", "[ALIGNMENT] X"]
    assert "**ARTIFACT CORE** (Weight: 33.0%)" in r["artifact_explanation"]
    assert "- **Status:** Detected" in r["artifact_explanation"]


def test_attention(spark):
    data = [("a", "x", 0.9, 0.8), ("a", "y", 0.8, 0.6), ("a", "z", 0.1, 0.9), ("b", "x", 0.4, 0.5)]
    df = spark.createDataFrame(data, "item string, name string, score double, confidence double")
    att = rows(U.modality_attention(df, "item"), "item", "name")
    sc, cf = np.array([0.9, 0.8, 0.1]), np.array([0.8, 0.6, 0.9])
    e = np.exp(cf * (0.7 + 0.3 * (1 - np.abs(sc - np.median(sc)))))
    want = e / (e.sum() + 1e-10)
    assert [r["attention"] for r in att[:3]] == pytest.approx(list(want))
    assert att[3]["attention"] == 1.0
    f = rows(U.attention_fuse(df, "item"), "item")
    assert f[0]["fused_score"] == pytest.approx(float((sc * want).sum()))
    assert f[1]["agreement"] == 1.0 and f[1]["fused_confidence"] == pytest.approx(0.6)


def test_detector_fusion_skips_unusable_rows(spark):
    data = [(1, 0.9, 0.5, "FAIL"), (1, 0.1, 0.5, "ERROR"), (2, 0.5, 0.0, "SKIPPED"), (3, 0.4, 0.0, "PASS")]
    df = spark.createDataFrame(data, "item int, score double, confidence double, status string")
    got = rows(U.fuse_detectors(df, "item"), "item")
    assert [(r["aggregate_score"], r["verdict"]) for r in got] == [(0.9, "MANIPULATED"), (0.5, "UNCERTAIN"), (0.0, "AUTHENTIC")]
    items = spark.createDataFrame([(1,), (9,)], "item int")
    assert rows(U.no_detectors(items, U.fuse_detectors(df, "item"), "item"), "item")[1]["verdict"] == "NO_DETECTORS"


def test_bands_at_their_edges(spark):
    df = spark.createDataFrame([(0.3,), (0.5,), (0.6,), (0.65,), (0.66,)], "s double")
    r = df.select(B.verdict_band("s").alias("v"), B.status_band("s").alias("c")).collect()
    assert [x["v"] for x in r] == ["AUTHENTIC", "UNCERTAIN", "INCONCLUSIVE", "INCONCLUSIVE", "MANIPULATED"]
    assert [x["c"] for x in r] == ["PASS", "WARN", "WARN", "FAIL", "FAIL"]


def test_scan_runs_enabled_detectors_and_fills_gaps(spark):
    reg = Registry()
    reg.register(text_detector())
    failing = lambda d: d.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(0.9).alias("confidence"), F.lit("PASS").alias("status"), F.array(F.lit("a")).alias("anomalies"), F.lit("GOOD").alias("data_quality"))
    reg.register(Detector("Broken", "text", frozenset({"text_content"}), failing))
    reg.register(Detector("Off", "text", frozenset({"text_content"}), failing, enabled=False))
    df = spark.createDataFrame([(1, "word " * 60), (2, None), (3, "")], "doc_id bigint, text string")
    got, fused = scan(df, reg, "text_content", "doc_id")
    by = {(r["doc_id"], r["detector_name"]): r for r in got.collect()}
    assert len(by) == 6
    assert by[2, "Text Detector"]["status"] == "SKIPPED" and by[3, "Text Detector"]["confidence"] == 0.0
    assert by[1, "Broken"]["status"] == "ERROR" and by[1, "Broken"]["score"] == 0.5
    assert {r["doc_id"]: r["usable"] for r in fused.collect()} == {1: 1, 2: 0, 3: 0}
    assert len(reg) == 3 and reg.get("Off").name == "Off" and len(reg.by_kind("text")) == 3
    reg.unregister("Off")
    assert reg.names() == ["Text Detector", "Broken"]
    assert rows(reg.table(spark), "name")[0]["capabilities"] == ["text_content"]


def test_means_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1."""
    from provenir.plans import bindings as D

    values = [0.1, 0.2, 0.3]
    total = 0.0
    for v in values:
        total += v
    rows = [(k, datetime(2024, 1, 3, k), 10790, "view", v) for k, v in enumerate(values)]
    got = []
    for name, order in (("a", rows), ("b", rows[::-1]), ("c", [rows[1], rows[2], rows[0]])):
        df = spark.createDataFrame(order, "event_id long, ts timestamp, user_id long, event_type string, value double")
        df.coalesce(1).write.parquet(str(tmp_path / name / "events.parquet"))
        got.append(D.core_results(spark, str(tmp_path / name)).first().score)
        got.append(D.modalities(spark, str(tmp_path / name)).first().score)
    assert set(got) == {total / 3 / 40}
