"""Threshold bands and label rules over score and profile columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import clip, col, flags

# Resolution limits in pixels of height, with tier and label.
TIERS = (
    (360, "ultra_low", "Ultra-Low"),
    (480, "low", "Low"),
    (720, "medium", "Medium"),
    (1080, "high", "HD"),
)
TOP_TIER = ("ultra_hd", "Ultra-HD")

# Fixed values: (warn, fail) cut-offs of each scoring surface.
CORE_BANDS = (0.3, 0.6)
TEXT_BANDS = (0.35, 0.65)
SPECTRAL_BANDS = (0.30, 0.65)


def resolution_tier(height: str | Column) -> Column:
    """STRUCT(tier, label, is_low_res) of a frame height."""
    h = col(height)
    tier, word = F.lit(TOP_TIER[0]), F.lit(TOP_TIER[1])
    for limit, name, text in reversed(TIERS):
        tier = F.when(h <= limit, name).otherwise(tier)
        word = F.when(h <= limit, text).otherwise(word)
    label = F.concat(h.cast("string"), F.lit("p ("), word, F.lit(")"))
    return F.struct(tier.alias("tier"), label.alias("label"), (h <= 480).alias("is_low_res"))


def recommended_strategy(tier: str | Column) -> Column:
    t = col(tier)
    return (
        F.when(t.isin("ultra_low", "low"), "Deep-Pixel & Semantic (Low-res mode)")
        .when(t == "medium", "Hybrid Analysis (Balanced mode)")
        .otherwise("Full Forensic Suite (High-res mode)")
    )


def noise_level(snr_db: str | Column) -> Column:
    """STRUCT(level, weight) of a signal-to-noise ratio in dB."""
    s = col(snr_db)
    level = F.when(s >= 20, "LOW").when(s >= 10, "MEDIUM").when(s >= 5, "HIGH").otherwise("EXTREME")
    weight = F.when(s >= 20, 1.0).when(s >= 10, 0.7).when(s >= 5, 0.5).otherwise(0.3)
    return F.struct(level.alias("level"), weight.alias("weight"))


def status_band(score: str | Column, warn: float = 0.3, fail: float = 0.6) -> Column:
    s = col(score)
    return F.when(s > fail, "FAIL").when(s > warn, "WARN").otherwise("PASS")


def pass_fail(score: str | Column, cut: float = 0.5) -> Column:
    return F.when(col(score) > cut, "FAIL").otherwise("PASS")


def verdict_band(score: str | Column) -> Column:
    s = col(score)
    return (
        F.when(s <= 0.30, "AUTHENTIC")
        .when(s <= 0.50, "UNCERTAIN")
        .when(s <= 0.65, "INCONCLUSIVE")
        .otherwise("MANIPULATED")
    )


def text_verdict(score: str | Column) -> Column:
    s = col(score)
    return F.when(s > 0.65, "AI_GENERATED").when(s > 0.35, "UNCERTAIN").otherwise("HUMAN_WRITTEN")


def resolution_score(height: str | Column) -> Column:
    h = col(height)
    return (
        F.when(h >= 1080, 1.0).when(h >= 720, 0.75).when(h >= 480, 0.5).when(h >= 360, 0.3).otherwise(0.1)
    )


def noise_score(laplacian_var: str | Column) -> Column:
    v = col(laplacian_var)
    return F.when(v < 10, 0.3).when(v > 5000, 0.5).otherwise(clip(v / 2000.0))


def sharpness_score(mean_gradient: str | Column) -> Column:
    return clip(col(mean_gradient) / 50.0)


def quality_level(overall: str | Column) -> Column:
    o = col(overall)
    return F.when(o >= 0.7, "HIGH").when(o >= 0.5, "MEDIUM").when(o >= 0.3, "LOW").otherwise("DEGRADED")


def recommended_detectors(level: str | Column) -> Column:
    """ARRAY<STRING> of the detectors worth running at a quality level."""
    lv = col(level)
    usable = lv.isin("HIGH", "MEDIUM")
    return flags(
        (F.lit(True), "CLIP Detector"),
        (lv != "DEGRADED", "ViT Detector"),
        (F.lit(True), "Artifact Detector"),
        (usable, "BioSignal Detector"),
        (usable, "Alignment Detector"),
    )


def argmax_label(pairs: list[tuple[str, Column]]) -> Column:
    """Name of the largest column; the first listed wins a tie."""
    top = F.greatest(*[c for _, c in pairs])
    out = F.when(pairs[0][1] == top, pairs[0][0])
    for name, c in pairs[1:]:
        out = out.when(c == top, name)
    return out
