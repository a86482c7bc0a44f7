"""The scan over items with different inputs: results of every detector, and their fusion.

An item is a number: the document, the vector, the label (sound track, spectra
and region signals) and the supplier (frame features) of that number are its
inputs, so items hold from one to seven of them.
"""

from __future__ import annotations

from ..operators.fusion import fuse_detectors
from ..plans import bindings as D
from ..plans import unified as V
from ..session import materialize
from .base import BAND, query
from .features import EM, FP, PT, SF
from .series import SIG, SPG, signal_profiles

CTES = {
    **EM, **PT, **SPG, **SF, **FP, **SIG,
    "u_bio": """SELECT *, channels % 2 = 0 AS low, least(CASE WHEN sync < 0.3 THEN 0.4 WHEN sync < 0.5 THEN 0.2 ELSE 0.0 END + CASE WHEN cov < 0.3 THEN 0.3 WHEN cov < 0.5 THEN 0.15 ELSE 0.0 END
        + CASE WHEN hc < 0.5 THEN 0.2 ELSE 0.0 END + CASE WHEN mb < 50 OR mb > 120 THEN 0.1 ELSE 0.0 END, 1.0) AS s FROM sy JOIN hr USING (item)""",
    "u_rows": """SELECT doc_id AS item, 'Text Detector' AS name, score, confidence, CASE WHEN NOT ok THEN 'WARN' WHEN raw > 0.65 THEN 'FAIL' WHEN raw > 0.35 THEN 'WARN' ELSE 'PASS' END AS status FROM ts
        UNION ALL SELECT item, 'CLIP Detector', score, least(0.5 + ((ent < 2)::INT + (norm > 50)::INT) * 0.15 + abs(score - 0.5) * 0.5, 1.0), 'PASS' FROM es
        UNION ALL SELECT item, 'ViT Detector', score, confidence, 'PASS' FROM pk2
        UNION ALL SELECT item, 'CQT Audio Detector', score, least(0.4 + abs(score - 0.5) * 0.6 + fl * 0.1, 1.0), 'PASS' FROM sr
        UNION ALL SELECT item, 'Frequency Analyzer', score, CASE WHEN sd < 0.05 THEN least(c + 0.1, 1.0) ELSE c END, CASE WHEN score > 0.65 THEN 'FAIL' WHEN score > 0.30 THEN 'WARN' ELSE 'PASS' END FROM sfi
        UNION ALL SELECT item, 'Artifact Detector', s, least(0.5 + s * 0.4, 0.9) * CASE WHEN n < 20 THEN 0.8 ELSE 1.0 END, CASE WHEN s > 0.6 THEN 'FAIL' WHEN s > 0.3 THEN 'WARN' ELSE 'PASS' END FROM fz
        UNION ALL SELECT item, 'BioSignal Detector', s, CASE WHEN low THEN least(sync * 0.8, 0.6) ELSE least(0.4 + sync * 0.4 + cov * 0.2, 1.0) END, CASE WHEN s > 0.6 THEN 'FAIL' WHEN s > 0.3 THEN 'WARN' ELSE 'PASS' END FROM u_bio""",
    "u_items": "SELECT doc_id AS item FROM documents UNION SELECT vec_id FROM embeddings UNION SELECT label FROM embeddings UNION SELECT l_suppkey FROM lineitem",
    "u_names": "SELECT DISTINCT name FROM u_rows",
    "u_full": """SELECT i.item, n.name, coalesce(r.status, 'SKIPPED') AS status, coalesce(r.score, 0.5) AS score, coalesce(r.confidence, 0.0) AS confidence
        FROM u_items i CROSS JOIN u_names n LEFT JOIN u_rows r ON r.item = i.item AND r.name = n.name""",
    "u_fused": """SELECT item, count(*) AS detectors_run, count(*) FILTER (status <> 'SKIPPED') AS usable, coalesce(sum(score * confidence) FILTER (status <> 'SKIPPED') / nullif(sum(confidence) FILTER (status <> 'SKIPPED'), 0), 0.5) AS a
        FROM u_full GROUP BY item""",
}


def detectors() -> list[V.TableDetector]:
    every = [
        V.text_adapter("item"), V.vector_adapter("item"), V.patch_adapter("item"), V.spectrogram_adapter("item", "t", "db", 64),
        V.spectrum_adapter("item", "t"), V.artifact_adapter("item"), V.biosignal_adapter("item", "channel", "sig"),
    ]
    return V.chosen(every)


def inputs(spark, sf) -> V.Inputs:
    # The profiles belong to the region signals alone; frame features of the same number are another clip.
    return {
        "texts": D.spread(D.table(spark, sf, "documents").selectExpr("doc_id AS item", "text")),
        "vectors": D.vectors(spark, sf),
        "patches": D.patches(spark, sf),
        "spectrogram": materialize(D.spectrogram(spark, sf), "spectrogram"),
        "spectra": materialize(D.spectral_frames(spark, sf), "spectra"),
        "frame_features": D.frame_features(spark, sf),
        "signals": D.signals(spark, sf),
    }


def results(spark, sf):
    bio = V.biosignal_adapter("item", "channel", "sig")
    profiles = signal_profiles(spark, sf)
    profiled = V.TableDetector(bio.name, bio.kind, bio.capabilities, bio.reads, lambda i: bio.run({**i, "profiles": profiles}))
    return V.scan_results(inputs(spark, sf), [profiled if d.name == bio.name else d for d in detectors()], "item")


@query("unified_results", "SELECT item, name AS detector_name, status, score, confidence FROM u_full", "score confidence", 4, extra=CTES)
def _(spark, sf):
    return results(spark, sf).select("item", "detector_name", "status", "score", "confidence")


@query("unified_inputs", f"SELECT item, detectors_run, usable, a AS aggregate_score, {BAND.format('a')} AS verdict FROM u_fused", "aggregate_score", 4, extra=CTES)
def _(spark, sf):
    return fuse_detectors(results(spark, sf), "item", None)
