"""Scans over items with different inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from provenir.catalog import features, series, unified
from provenir.plans import unified as V

LONG = "It was a plain day and nobody in the town thought much about the river. " * 6


@pytest.fixture(scope="module")
def inputs(spark):
    texts = spark.createDataFrame([(1, LONG), (2, ""), (3, None), (4, "too short"), (None, "no item")], "item bigint, text string")
    rng = [math.sin(k) for k in range(64)]
    vectors = spark.createDataFrame([(1, rng), (2, [0.0] * 64), (5, []), (6, None)], "item bigint, vec array<double>")
    patches = spark.createDataFrame([(1, [rng[k * 4 : k * 4 + 4] for k in range(16)])], "item bigint, patches array<array<double>>")
    frames = spark.createDataFrame([(7, t, [math.cos(k * (t + 1)) for k in range(64)]) for t in range(9)], "item bigint, t bigint, vec array<double>")
    return {"texts": texts, "vectors": vectors, "patches": patches, "frame_vectors": frames}


def by_item(df):
    out = {}
    for r in df.collect():
        assert (r.item, r.detector_name) not in out
        out[(r.item, r.detector_name)] = r
    return out


def test_every_item_has_every_detector(inputs):
    some = [V.text_adapter("item"), V.vector_adapter("item"), V.patch_adapter("item")]
    got = by_item(V.scan_results(inputs, some, "item"))
    assert {i for i, _ in got} == {1, 2, 3, 4, 5, 6, 7} and len(got) == 21
    ran = {k for k, r in got.items() if r.status != "SKIPPED"}
    assert ran == {(1, "Text Detector"), (4, "Text Detector"), (1, "CLIP Detector"), (2, "CLIP Detector"), (1, "ViT Detector")}
    lost = got[(3, "Text Detector")]
    assert (lost.score, lost.confidence, lost.data_quality, lost.anomalies) == (0.5, 0.0, "INSUFFICIENT", []) and "reason" in lost.details
    assert got[(2, "CLIP Detector")].details["feature_norm"] == "0.0" and got[(4, "Text Detector")].status == "WARN"


def test_fusion_weighs_by_confidence(inputs):
    some = [V.text_adapter("item"), V.vector_adapter("item"), V.patch_adapter("item")]
    rows = by_item(V.scan_results(inputs, some, "item"))
    got = {r.item: r for r in V.unified_scan(inputs, some, "item", None).collect()}
    mine = [r for (i, _), r in rows.items() if i == 1]
    want = sum(r.score * r.confidence for r in mine) / sum(r.confidence for r in mine)
    assert math.isclose(got[1].aggregate_score, want) and got[1].usable == 3 and got[1].detectors_run == 3
    assert got[7].usable == 0 and got[7].aggregate_score == 0.5 and got[7].verdict == "UNCERTAIN"


def test_clip_of_frames(inputs):
    got = by_item(V.scan_results({"frame_vectors": inputs["frame_vectors"]}, [V.frame_vector_adapter("item", "t")], "item"))
    r = got[(7, "CLIP Detector")]
    assert r.status == "PASS" and r.details["frames_analyzed"] == "8"


def test_table_that_is_not_there(inputs):
    got = by_item(V.scan_results({"texts": inputs["texts"]}, [V.text_adapter("item"), V.vector_adapter("item")], "item"))
    assert all(r.status == "SKIPPED" for (_, name), r in got.items() if name == "CLIP Detector") and (1, "CLIP Detector") in got


def test_failure_is_an_error(inputs):
    broken = V.TableDetector("Broken", "visual", frozenset({"single_image"}), ("vectors",), lambda i: i["vectors"].select(
        "item", F.lit(None).cast("double").alias("score"), F.lit(0.9).alias("confidence"), F.lit("PASS").alias("status"), F.lit(None).cast("array<string>").alias("anomalies"),
        F.lit("GOOD").alias("data_quality"), F.create_map().cast("map<string,string>").alias("details")))
    got = by_item(V.scan_results(inputs, [broken, V.patch_adapter("item")], "item"))
    assert got[(1, "Broken")].status == "ERROR" and got[(1, "Broken")].confidence == 0.0 and got[(7, "Broken")].status == "SKIPPED"
    fused = {r.item: r for r in V.unified_scan(inputs, [broken, V.patch_adapter("item")], "item").collect()}
    assert fused[1].usable == 1 and fused[2].usable == 0


def test_choice_by_capability():
    off = V.TableDetector("Off", "visual", frozenset({"single_image"}), ("x",), lambda i: i["x"], enabled=False)
    every = [V.text_adapter("item"), V.vector_adapter("item"), V.spectrogram_adapter("item", "t", "db", 8), off]
    assert [d.name for d in V.chosen(every, {"text_content"})] == ["Text Detector"]
    assert [d.name for d in V.chosen(every, {"single_image", "audio_track"})] == ["CLIP Detector", "CQT Audio Detector"]
    assert len(V.chosen(every)) == 3


def test_empty_inputs(inputs):
    none = {k: t.limit(0) for k, t in inputs.items()}
    assert V.scan_results(none, [V.text_adapter("item"), V.vector_adapter("item")], "item").collect() == []


def test_shared_tables_of_the_sql_have_different_names():
    parts = [features.EM, features.PT, series.SPG, features.SF, features.FP, series.SIG]
    assert len(unified.CTES) == sum(map(len, parts)) + 6
