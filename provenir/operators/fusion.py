"""Fusion of core, detector and modality scores into verdicts.

Wide input has one row per item with ``<core>_score``, ``<core>_confidence``
and optional context columns; everything on it is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import argmax_label, noise_level, status_band, verdict_band
from ..functions.exprs import clip, flags, fmt, let

CORES = ("biosignal", "artifact", "alignment")

# Core weights, normal and for low-resolution footage.
BASE_WEIGHTS = {"biosignal": 0.33, "artifact": 0.33, "alignment": 0.34}
LOW_RES_WEIGHTS = {"biosignal": 0.20, "artifact": 0.45, "alignment": 0.35}

TRUST = 0.4
AUTHENTIC, UNCERTAIN, MANIPULATED = 0.30, 0.50, 0.65

CONTEXT_DEFAULTS = {
    "height": "int",
    "is_low_res": "boolean",
    "has_audio": "boolean",
    "snr_db": "double",
    "noise_level": "string",
    "av_weight": "double",
    "is_speech": "boolean",
}


def s(core: str) -> Column:
    return F.col(f"{core}_score")


def c(core: str) -> Column:
    return F.col(f"{core}_confidence")


def w(core: str) -> Column:
    return F.col(f"w_{core}")


def core_columns(long: DataFrame, item: str) -> DataFrame:
    """One row per item from (item, core, score, confidence, anomalies).

    A core without a row falls back to score 0.5 and confidence 0.
    """
    aggs = []
    for k in CORES:
        own = F.col("core") == k
        aggs += [
            F.coalesce(F.max(F.when(own, F.col("score"))), F.lit(0.5)).alias(f"{k}_score"),
            F.coalesce(F.max(F.when(own, F.col("confidence"))), F.lit(0.0)).alias(f"{k}_confidence"),
            F.coalesce(
                F.max_by("anomalies", F.when(own, F.col("confidence"))), F.array().cast("array<string>")
            ).alias(f"{k}_anomalies"),
        ]
    return long.groupBy(item).agg(*aggs)


def audio_profile(df: DataFrame) -> DataFrame:
    """Noise level and alignment weight of (has_audio, snr_db, is_speech) rows."""
    n = noise_level("snr_db")
    weight = F.when(F.col("is_speech"), n["weight"]).otherwise(F.greatest(n["weight"] * 0.8, F.lit(0.3)))
    return df.withColumns(
        {
            "noise_level": F.when(F.col("has_audio"), n["level"]).otherwise("NO_AUDIO"),
            "av_weight": F.when(F.col("has_audio"), weight).otherwise(0.3),
        }
    )


def with_context(df: DataFrame, media: DataFrame | None, audio: DataFrame | None, item: str) -> DataFrame:
    """Left-join the optional profiles; items without one keep base weights."""
    out = df
    if media is not None:
        out = out.join(media.select(item, "height", "is_low_res"), item, "left")
    if audio is not None:
        cols = ["has_audio", "snr_db", "noise_level", "av_weight", "is_speech"]
        out = out.join(audio.select(item, *cols), item, "left")
    return out


def redistribute_weights(df: DataFrame) -> DataFrame:
    """Add ``w_<core>`` and ``factors`` from confidence, resolution and audio."""
    missing = {k: F.lit(None).cast(t) for k, t in CONTEXT_DEFAULTS.items() if k not in df.columns}
    d = df.withColumns(missing) if missing else df
    low = F.coalesce("is_low_res", F.lit(False))
    heard = F.col("has_audio")
    loud = heard & F.col("noise_level").isin("HIGH", "EXTREME")
    mid = heard & (F.col("noise_level") == "MEDIUM")
    mute = heard & ~loud & ~mid & ~F.col("is_speech")
    audio = (
        F.when(~heard, 0.3).when(loud | mid, F.col("av_weight")).when(mute, 0.5).otherwise(1.0)
    )
    start = {
        f"_b_{k}": F.when(low, LOW_RES_WEIGHTS[k]).otherwise(BASE_WEIGHTS[k])
        * (audio if k == "alignment" else F.lit(1.0))
        for k in CORES
    }
    d = d.withColumns(start)
    weak = {k: c(k) < TRUST for k in CORES}
    some_weak = weak["biosignal"] | weak["artifact"] | weak["alignment"]
    some_strong = ~weak["biosignal"] | ~weak["artifact"] | ~weak["alignment"]

    def total(parts: list[Column]) -> Column:
        return parts[0] + parts[1] + parts[2]

    freed = total([F.when(weak[k], F.col(f"_b_{k}") * 0.5).otherwise(0.0) for k in CORES])
    trust = total([F.when(weak[k], 0.0).otherwise(c(k)) for k in CORES])
    d = d.withColumns({"_freed": freed, "_trust": trust, "_shift": some_weak & some_strong})
    moved = {
        f"_m_{k}": F.when(~F.col("_shift"), F.col(f"_b_{k}"))
        .when(weak[k], F.col(f"_b_{k}") * 0.5)
        .otherwise(F.col(f"_b_{k}") + F.col("_freed") * (c(k) / F.col("_trust")))
        for k in CORES
    }
    d = d.withColumns(moved).withColumn("_tot", total([F.col(f"_m_{k}") for k in CORES]))
    pct = F.col("av_weight") * 100
    notes = flags(
        (low, fmt("Low resolution (%sp): BIOSIGNAL weight reduced to 20%%, ARTIFACT boosted to 45%%", F.col("height"))),
        (~heard, "No audio track detected: ALIGNMENT (A/V Sync) weight reduced to 30%"),
        (loud, fmt("High audio noise (SNR: %.1fdB, %s): ALIGNMENT weight reduced to %.0f%%", F.col("snr_db"), F.col("noise_level"), pct)),
        (mid, fmt("Moderate audio noise (SNR: %.1fdB): ALIGNMENT weight at %.0f%%", F.col("snr_db"), pct)),
        (mute, "No speech detected in audio: ALIGNMENT weight reduced to 50%"),
        *[
            (F.col("_shift") & weak[k], fmt(f"{k.upper()} CORE low confidence (%.2f): weight reduced by 50%%", c(k)))
            for k in CORES
        ],
    )
    d = d.withColumns({f"w_{k}": F.col(f"_m_{k}") / F.col("_tot") for k in CORES} | {"factors": notes})
    return d.drop(*[x for x in d.columns if x.startswith("_")], *missing)


def weight_map() -> Column:
    pairs: list[Column] = []
    for k in CORES:
        pairs += [F.lit(k), w(k)]
    return F.create_map(*pairs)


def fused_score(mode: str = "weighted_average") -> Column:
    """Manipulation score of a wide row under one of the two fusion modes."""
    if mode == "weighted_average":
        return s(CORES[0]) * w(CORES[0]) + s(CORES[1]) * w(CORES[1]) + s(CORES[2]) * w(CORES[2])
    if mode == "confidence_product":
        total = c(CORES[0]) + c(CORES[1]) + c(CORES[2])
        mix = s(CORES[0]) * c(CORES[0]) + s(CORES[1]) * c(CORES[1]) + s(CORES[2]) * c(CORES[2])
        return mix / F.greatest(total, F.lit(0.1))
    raise ValueError(f"unknown fusion mode: {mode}")


def consensus() -> dict[str, Column]:
    """Consensus type and leading core of a wide row."""
    lead = argmax_label([(k, c(k)) for k in CORES])
    fails = sum((F.when(s(k) > 0.6, 1).otherwise(0) for k in CORES), F.lit(0))
    passes = sum((F.when(s(k) <= 0.3, 1).otherwise(0) for k in CORES), F.lit(0))
    kind = F.when(fails >= 2, "CONSENSUS_FAIL").when(passes >= 2, "CONSENSUS_PASS")
    leader = F.when((fails >= 2) | (passes >= 2), lead)
    for k in CORES:
        alone = (c(k) > 0.8) & (s(k) > 0.6)
        kind = kind.when(alone, f"DEFER_TO_{k.upper()}")
        leader = leader.when(alone, k)
    return {"consensus_type": kind.otherwise("INCONCLUSIVE"), "leading_core": leader.otherwise(lead)}


def core_verdict(score: str = "fused") -> dict[str, Column]:
    """Verdict, reason and conflict flag from score and consensus."""
    x, kind = F.col(score), F.col("consensus_type")
    scores = [s(k) for k in CORES]
    split = (F.greatest(*scores) > 0.6) & (F.least(*scores) < 0.3)
    deferred = kind.startswith("DEFER_TO_")
    who = F.regexp_replace(kind, "^DEFER_TO_", "")
    # (condition, verdict, reason), first match wins.
    rules = [
        ((kind == "CONSENSUS_FAIL") & (x >= MANIPULATED), "MANIPULATED", F.lit("Multiple cores detected manipulation patterns")),
        ((kind == "CONSENSUS_FAIL") & (x >= UNCERTAIN), "MANIPULATED", F.lit("Consensus indicates manipulation with moderate confidence")),
        (kind == "CONSENSUS_FAIL", "UNCERTAIN", F.lit("Conflicting signals despite consensus")),
        ((kind == "CONSENSUS_PASS") & (x < AUTHENTIC), "AUTHENTIC", F.lit("Multiple cores verified authenticity")),
        ((kind == "CONSENSUS_PASS") & (x < UNCERTAIN), "AUTHENTIC", F.lit("Consensus indicates authentic with moderate confidence")),
        (kind == "CONSENSUS_PASS", "UNCERTAIN", F.lit("Score elevated despite positive consensus")),
        (deferred & (x >= MANIPULATED), "MANIPULATED", fmt("High confidence signal from %s core", who)),
        (deferred, "UNCERTAIN", fmt("Deferring to %s core with elevated concern", who)),
        (split, "INCONCLUSIVE", F.lit("Conflicting signals between cores")),
        (x >= MANIPULATED, "MANIPULATED", F.lit("Score indicates manipulation despite uncertain consensus")),
        (x < AUTHENTIC, "AUTHENTIC", F.lit("Score indicates authenticity despite uncertain consensus")),
    ]
    verdict = F.when(rules[0][0], rules[0][1])
    reason = F.when(rules[0][0], rules[0][2])
    for cond, v, text in rules[1:]:
        verdict, reason = verdict.when(cond, v), reason.when(cond, text)
    odd = ((kind == "CONSENSUS_FAIL") & (x < UNCERTAIN)) | ((kind == "CONSENSUS_PASS") & (x >= UNCERTAIN))
    return {
        "verdict": verdict.otherwise("UNCERTAIN"),
        "reason": reason.otherwise("Ambiguous signals require manual review"),
        "conflicting": split | odd,
    }


def core_confidence() -> Column:
    kind = F.col("consensus_type")
    base = c(CORES[0]) * w(CORES[0]) + c(CORES[1]) * w(CORES[1]) + c(CORES[2]) * w(CORES[2])
    bonus = (
        F.when(kind.isin("CONSENSUS_FAIL", "CONSENSUS_PASS"), 0.15)
        .when(kind.startswith("DEFER_TO_"), 0.05)
        .otherwise(-0.1)
    )
    balance = 1.0 - (F.greatest(*[w(k) for k in CORES]) - 0.33) * 0.5
    return clip(base * balance + bonus, 0.1, 1.0)


def integrity_score(score: str = "fused", digits: int | None = 2) -> Column:
    """0 to 100, where 100 is authentic; ``digits`` None keeps it unrounded."""
    raw = clip(100 * (1 - F.col(score)), 0.0, 100.0)
    return raw if digits is None else F.round(raw, digits)


def fuse_cores(df: DataFrame, mode: str = "weighted_average") -> DataFrame:
    """Full fusion row of each item: projections only on wide input."""
    d = redistribute_weights(df)
    d = d.withColumn("fused", fused_score(mode)).withColumns(consensus())
    d = d.withColumns(core_verdict("fused") | {"confidence": core_confidence()})
    return d.withColumns({"integrity_score": integrity_score("fused"), "fusion_method": F.lit(mode)})


# Wording of the explanation of each core.
EXPLAIN = {
    "biosignal": (
        ("Normal", "Anomalous", "Critical"),
        (("Biological Sync", "sync"), ("Pulse Coverage", "pulse_coverage"), ("HR Consistency", "hr_consistency")),
        ("Biological signals appear natural.", "Some biological irregularities detected.", "Biological signals are inconsistent or missing."),
        "Biological signal analysis (rPPG)",
        "Missing or inconsistent biological signals detected",
    ),
    "artifact": (
        ("Clean", "Suspicious", "Detected"),
        (("GAN Score", "gan_score"), ("Diffusion Score", "diffusion_score"), ("VAE Score", "vae_score")),
        ("No generative model fingerprints found.", "Some generative patterns detected.", "Generative model artifacts strongly present."),
        "Generative fingerprint detection",
        "Generative model fingerprints detected",
    ),
    "alignment": (
        ("Aligned", "Minor Issues", "Misaligned"),
        (("A/V Alignment", "av_alignment"), ("Phoneme-Viseme Match", "pv_match"), ("Speech Rhythm", "speech_rhythm")),
        ("Audio and video are well synchronized.", "Minor synchronization anomalies present.", "Significant audio-visual sync issues detected."),
        "Audio-visual alignment check",
        "Audio-visual synchronization anomalies detected",
    ),
}


def pct(x: Column, digits: int) -> Column:
    return fmt(f"%.{digits}f%%", x * 100)


def explanation(core: str, columns: list[str]) -> Column:
    """Explanation text of one core; extra metric lines where columns exist."""
    words, lines, tails, _, _ = EXPLAIN[core]
    band = status_band(s(core))
    word = F.when(band == "PASS", words[0]).when(band == "WARN", words[1]).otherwise(words[2])
    parts = [
        F.concat(F.lit(f"**{core.upper()} CORE** (Weight: "), pct(w(core), 1), F.lit(")\n\n")),
        F.concat(F.lit("- **Status:** "), word, F.lit("\n")),
        F.concat(F.lit("- **Score:** "), pct(s(core), 2), F.lit(" manipulation likelihood\n")),
        F.concat(F.lit("- **Confidence:** "), pct(c(core), 2), F.lit("\n")),
    ]
    for label, name in lines:
        if name in columns:
            parts.append(F.concat(F.lit(f"- **{label}:** "), pct(F.col(name), 2), F.lit("\n")))
    tail = F.when(s(core) > 0.6, tails[2]).when(s(core) > 0.3, tails[1]).otherwise(tails[0])
    return F.concat(*parts, F.lit("\n*"), tail, F.lit("*"))


def transparency(df: DataFrame) -> DataFrame:
    """Add the explanation columns of a fused row."""
    concern = F.when(F.lit(False), F.lit(None).cast("string"))
    for k in CORES:
        concern = concern.when((s(k) > 0.6) & (c(k) > 0.5), EXPLAIN[k][4])
    concern = F.when(
        F.col("verdict") == "MANIPULATED",
        concern.otherwise("Multiple weak signals indicate potential manipulation"),
    )

    def tagged(core: str) -> Column:
        return F.transform(f"{core}_anomalies", lambda a: F.concat(F.lit(f"[{core.upper()}] "), a))

    evidence = [tagged(k) for k in CORES if f"{k}_anomalies" in df.columns]
    d = df.withColumn("primary_concern", concern)
    summary = (
        F.when(F.col("verdict") == "AUTHENTIC", "All forensic checks passed. No manipulation indicators detected.")
        .when(F.col("verdict") == "MANIPULATED", F.concat(F.lit("Manipulation detected. "), F.col("primary_concern")))
        .when(F.col("verdict") == "INCONCLUSIVE", "Analysis inconclusive due to conflicting or insufficient signals.")
        .otherwise("Some anomalies detected but not conclusive. Manual review recommended.")
    )
    cols = {
        "summary": summary,
        "supporting_evidence": F.concat(*evidence) if evidence else F.array().cast("array<string>"),
    }
    for k in CORES:
        cols[f"{k}_explanation"] = explanation(k, df.columns)
        cols[f"{k}_weight_note"] = F.concat(F.lit("Weight "), pct(w(k), 1), F.lit(f": {EXPLAIN[k][3]}"))
    if "has_audio" in df.columns:
        cols["audio_note"] = (
            F.when(~F.col("has_audio"), "No audio track present. A/V sync analysis limited.")
            .when(
                F.col("noise_level").isin("HIGH", "EXTREME"),
                fmt("High audio noise (SNR: %.1fdB). A/V sync confidence reduced.", F.col("snr_db")),
            )
            .when(~F.col("is_speech"), "No speech detected in audio. A/V sync analysis limited.")
        )
    return d.withColumns(cols)


# --- modality attention ----------------------------------------------------------


def _modalities(df: DataFrame, item: str, temperature: float) -> DataFrame:
    """Collapse an item's modalities (one row per named modality) to an array."""
    m = df.groupBy(item).agg(
        F.sort_array(F.collect_list(F.struct("name", "score", "confidence"))).alias("_m"),
        F.percentile("score", 0.5).alias("_med"),
        F.stddev_pop("score").alias("_std"),
    )
    raw = let(
        F.col("_med"),
        lambda med: F.transform(
            "_m", lambda x: x["confidence"] * (0.7 + 0.3 * (1.0 - F.abs(x["score"] - med)))
        ),
    )
    m = m.withColumn("_e", F.transform(raw, lambda r: F.exp(r / temperature)))
    tot = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x) + 1e-10
    m = m.withColumn("_tot", tot)
    att = F.when(F.array_size("_m") == 1, F.array(F.lit(1.0))).otherwise(
        let(F.col("_tot"), lambda t: F.transform("_e", lambda e: e / t))
    )
    return m.withColumn("_a", att)


def modality_attention(df: DataFrame, item: str, temperature: float = 1.0) -> DataFrame:
    """Attention weight of every modality of an item."""
    z = F.arrays_zip(F.col("_m").alias("m"), F.col("_a").alias("a"))
    rows = _modalities(df, item, temperature).select(item, F.explode(z).alias("_z"))
    return rows.select(item, F.col("_z.m.name").alias("name"), F.col("_z.a").alias("attention"))


def attention_fuse(df: DataFrame, item: str, temperature: float = 1.0) -> DataFrame:
    m = _modalities(df, item, temperature)

    def mix(field: str) -> Column:
        parts = F.zip_with("_m", "_a", lambda x, a: x[field] * a)
        return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)

    n = F.array_size("_m")
    d = m.select(
        item,
        n.alias("num_modalities"),
        clip(mix("score")).alias("fused_score"),
        mix("confidence").alias("_c"),
        F.when(n > 1, clip(1.0 - F.col("_std") * 2)).otherwise(1.0).alias("agreement"),
    )
    conf = (
        F.when(F.col("agreement") > 0.8, F.least(F.col("_c") * 1.2, F.lit(1.0)))
        .when(F.col("agreement") < 0.3, F.col("_c") * 0.7)
        .otherwise(F.col("_c"))
    )
    return d.withColumn("fused_confidence", clip(conf)).drop("_c")


# --- detectors ---------------------------------------------------------------------


def with_fallback(df: DataFrame, name: str, kind: str, required: Column) -> DataFrame:
    """Neutral SKIPPED or ERROR values where input is missing or failed.

    ``required`` is true where the input is present. A present input whose
    score is NULL counts as a failure.
    """
    status = F.when(~required, "SKIPPED").when(F.col("score").isNull(), "ERROR").otherwise(F.col("status"))
    bad = ~required | F.col("score").isNull()
    return df.withColumns(
        {
            "detector_name": F.lit(name),
            "detector_type": F.lit(kind),
            "status": status,
            "score": F.when(bad, 0.5).otherwise(F.col("score")),
            "confidence": F.when(bad, 0.0).otherwise(F.col("confidence")),
            "data_quality": F.when(bad, "INSUFFICIENT").otherwise(F.col("data_quality")),
        }
    )


def fuse_detectors(df: DataFrame, item: str, digits: int | None = 4) -> DataFrame:
    """Confidence-weighted mean of the usable detector rows of each item.

    ``digits`` rounds the reported score; None keeps it as computed.
    """
    used = ~F.col("status").isin("SKIPPED", "ERROR")
    sc, cf = F.col("score"), F.col("confidence")
    g = df.groupBy(item).agg(
        F.count(F.lit(1)).alias("detectors_run"),
        F.sum(used.cast("bigint")).alias("usable"),
        F.sum(F.when(used, sc * cf)).alias("_sc"),
        F.sum(F.when(used, cf)).alias("_c"),
    )
    total = F.when(F.col("_c") == 0, 1.0).otherwise(F.col("_c"))
    agg = F.when(F.col("usable") == 0, 0.5).otherwise(F.col("_sc") / total)
    return g.withColumn("_agg", agg).select(
        item, "detectors_run", "usable",
        (F.col("_agg") if digits is None else F.round("_agg", digits)).alias("aggregate_score"),
        verdict_band("_agg").alias("verdict"),
    )


def no_detectors(items: DataFrame, fused: DataFrame, item: str) -> DataFrame:
    """Give items on which nothing ran the NO_DETECTORS verdict."""
    j = items.select(item).distinct().join(fused, item, "left")
    return j.withColumns(
        {
            "detectors_run": F.coalesce("detectors_run", F.lit(0)),
            "usable": F.coalesce("usable", F.lit(0)),
            "verdict": F.coalesce("verdict", F.lit("NO_DETECTORS")),
        }
    )


def clip_verdict(df: DataFrame, item: str, prob: str) -> DataFrame:
    """Clip verdict from frame probabilities; a frame is fake above one half."""
    g = df.groupBy(item).agg(
        F.count(F.lit(1)).alias("frames_analyzed"),
        F.avg(prob).alias("avg_prob"),
        F.avg((F.col(prob) > 0.5).cast("double")).alias("fake_ratio"),
    )
    p = F.col("avg_prob")
    return g.withColumns(
        {
            "verdict": F.when(p > 0.7, "FAKE").when(p < 0.3, "REAL").otherwise("UNCERTAIN"),
            "confidence": F.when(p > 0.7, p).when(p < 0.3, 1 - p).otherwise(1 - F.abs(0.5 - p) * 2),
        }
    )


def frame_details(df: DataFrame, item: str, idx: str, prob: str) -> DataFrame:
    """The ordered frame list of a clip, one row per frame."""
    label = F.when(F.col(prob) > 0.5, "FAKE").otherwise("REAL")
    return df.select(item, idx, F.col(prob).alias("fake_probability"), label.alias("label"))


def quality_profile(df: DataFrame) -> DataFrame:
    """Overall quality and level from height, blockiness, noise and gradient."""
    from ..functions import bands as B

    d = df.withColumns(
        {
            "resolution_score": B.resolution_score("height"),
            "noise_score": B.noise_score("laplacian_var"),
            "sharpness_score": B.sharpness_score("mean_gradient"),
        }
    )
    overall = (
        F.col("resolution_score") * 0.3
        + F.col("compression_score") * 0.25
        + F.col("noise_score") * 0.2
        + F.col("sharpness_score") * 0.25
    )
    d = d.withColumn("overall_score", overall)
    d = d.withColumn("level", B.quality_level("overall_score"))
    return d.withColumn("recommended", B.recommended_detectors("level"))


def media_profile(df: DataFrame) -> DataFrame:
    """Profile columns from width, height, fps and frame_count."""
    from ..functions.bands import recommended_strategy, resolution_tier

    fps = F.when(F.col("fps") == 0, 30.0).otherwise(F.col("fps"))
    d = df.withColumns({"fps": fps, "_t": resolution_tier("height")})
    return d.withColumns(
        {
            "duration_sec": F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps")).otherwise(0.0),
            "pixel_count": F.col("width").cast("bigint") * F.col("height"),
            "aspect_ratio": F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(1.0),
            "tier": F.col("_t.tier"),
            "resolution_label": F.col("_t.label"),
            "is_low_res": F.col("_t.is_low_res"),
            "rppg_viable": (F.col("height") >= 480) & (F.col("fps") >= 24),
            "mesh_viable": F.col("height") >= 720,
            "strategy": recommended_strategy(F.col("_t.tier")),
        }
    ).drop("_t")


def alignment_result(
    rhythm: DataFrame, closures: DataFrame, metadata: DataFrame, item: str, profiles: DataFrame | None = None
) -> DataFrame:
    """Alignment core verdict from lip rhythm, closures and metadata checks."""
    return alignment_verdict(metadata.join(rhythm, item, "left").join(closures.drop("n_frames"), item, "left"), item, profiles)


def alignment_verdict(j: DataFrame, item: str, profiles: DataFrame | None = None) -> DataFrame:
    """Alignment core verdict of rows that hold the columns of all three checks."""
    if profiles is not None:
        j = j.join(profiles.select(item, "is_low_res"), item, "left")
    else:
        j = j.withColumn("is_low_res", F.lit(False))
    av = F.coalesce("av_score", F.lit(0.5))
    pv = F.coalesce("pv_score", F.lit(0.5))
    md = F.col("metadata_score")
    few = F.col("n_frames") < 10
    notes = flags(
        ((av > 0.5) & (F.col("speech_ratio") < 0.2), "MISSING_SPEECH_RHYTHM"),
        ((av > 0.5) & (F.col("movement_variance") < 10), "STATIC_LIP_MOVEMENT"),
        ((av > 0.5) & (F.col("peak_ratio") > 10), "ROBOTIC_LIP_SYNC"),
        (pv > 0.5, "PHONEME_VISEME_MISMATCH"),
        ((md > 0.4) & (F.col("jumps") > F.col("n_frames") * 0.1), "BRIGHTNESS_DISCONTINUITY"),
        (md > 0.4, "ENCODING_ANOMALY"),
    )
    score = F.when(few, 0.5).otherwise(F.least(av * 0.4 + pv * 0.35 + md * 0.25, F.lit(1.0)))
    conf = F.when(F.col("n_frames") >= 30, 0.6).otherwise(0.4)
    conf = conf * F.when(F.coalesce("is_low_res", F.lit(False)), 0.8).otherwise(1.0)
    d = j.withColumn("score", score)
    return d.select(
        item,
        "n_frames",
        av.alias("av_score"),
        pv.alias("pv_score"),
        md.alias("metadata_score"),
        "score",
        F.when(few, 0.3).otherwise(conf).alias("confidence"),
        F.when(few, "WARN").otherwise(status_band("score")).alias("status"),
        F.when(few, F.array(F.lit("LOW_FRAME_COUNT"))).otherwise(notes).alias("anomalies"),
        F.when(few, "INSUFFICIENT").when(F.col("n_frames") >= 30, "GOOD").otherwise("LIMITED").alias("data_quality"),
    )
