"""Bands, profiles, core fusion, attention and detector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions.exprs import clip, logit, sigmoid
from ..operators import fusion as U
from ..operators import stores as S
from ..plans import bindings as D
from ..plans.registry import Detector, Registry, result_struct, scan, text_detector
from ..sources.manifest import route_media
from .base import BAND, query

# --- bands and profiles ---------------------------------------------------------


@query("numeric_kit", """SELECT event_id, least(greatest(value / 100, 0.0), 1.0) AS clipped, 1.0 / (1.0 + exp(-value / 100)) AS squashed,
    ln((value / 5000) / (1.0 - value / 5000 + 1e-10) + 1e-10) AS log_odds, round(value / 7, 4) AS short FROM events""",
    "clipped squashed log_odds short")
def _(spark, sf):
    v = F.col("value")
    return D.events(spark, sf).select(
        "event_id", clip(v / 100).alias("clipped"), sigmoid(v / 100).alias("squashed"),
        logit(v / 5000).alias("log_odds"), F.round(v / 7, 4).alias("short"),
    )


@query("resolution_tier", """SELECT item, tier, height || 'p (' || CASE tier WHEN 'ultra_low' THEN 'Ultra-Low' WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium' WHEN 'high' THEN 'HD' ELSE 'Ultra-HD' END || ')' AS label, is_low_res FROM media""")
def _(spark, sf):
    m = D.media_rows(spark, sf)
    return m.select("item", B.resolution_tier("height").alias("t")).select("item", "t.tier", "t.label", "t.is_low_res")


@query("media_profile", """SELECT item, width::BIGINT AS width, height::BIGINT AS height, fps, frame_count / fps AS duration_sec, (width * height)::BIGINT AS pixel_count,
    width / height AS aspect_ratio, height >= 480 AND fps >= 24 AS rppg_viable, height >= 720 AS mesh_viable FROM media""", "fps duration_sec aspect_ratio")
def _(spark, sf):
    return D.media_profiles(spark, sf).select(
        "item", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"), "fps",
        "duration_sec", "pixel_count", "aspect_ratio", "rppg_viable", "mesh_viable",
    )


@query("recommended_strategy", """SELECT CASE WHEN tier IN ('ultra_low', 'low') THEN 'Deep-Pixel & Semantic (Low-res mode)' WHEN tier = 'medium' THEN 'Hybrid Analysis (Balanced mode)' ELSE 'Full Forensic Suite (High-res mode)' END AS strategy, count(*) AS items FROM media GROUP BY 1""")
def _(spark, sf):
    return D.media_profiles(spark, sf).groupBy("strategy").agg(F.count(F.lit(1)).alias("items"))


@query("tier_weights", """SELECT item, tier, CASE tier WHEN 'ultra_low' THEN 0.05 WHEN 'low' THEN 0.10 WHEN 'medium' THEN 0.20 ELSE 0.30 END AS rppg,
    CASE tier WHEN 'ultra_low' THEN 0.35 WHEN 'low' THEN 0.30 WHEN 'medium' THEN 0.20 ELSE 0.18 END AS fingerprint FROM media""", "rppg fingerprint")
def _(spark, sf):
    j = D.media_profiles(spark, sf).join(F.broadcast(S.tier_weights(spark)), "tier")
    return j.select("item", "tier", F.col("weights")["Biometric rPPG"].alias("rppg"), F.col("weights")["Neural Fingerprint"].alias("fingerprint"))


@query("noise_level", "SELECT item, snr_db, lv AS level, wt AS weight FROM audio1", "snr_db weight")
def _(spark, sf):
    a = D.audio_rows(spark, sf).withColumn("_n", B.noise_level("snr_db"))
    return a.select("item", "snr_db", F.col("_n.level").alias("level"), F.col("_n.weight").alias("weight"))


@query("audio_profile", """SELECT media.item, coalesce(has_audio, false) AS has_audio, coalesce(noise_level, 'NO_AUDIO') AS noise_level,
    coalesce(av_weight, 0.3) AS av_weight FROM media LEFT JOIN audio USING (item)""", "av_weight")
def _(spark, sf):
    m = D.media_rows(spark, sf).select("item").join(D.audio_profiles(spark, sf), "item", "left")
    return m.select(
        "item", F.coalesce("has_audio", F.lit(False)).alias("has_audio"),
        F.coalesce("noise_level", F.lit("NO_AUDIO")).alias("noise_level"), F.coalesce("av_weight", F.lit(0.3)).alias("av_weight"),
    )


Q_EXTRA = {
    "qp": """SELECT item, frame, CASE WHEN height >= 1080 THEN 1.0 WHEN height >= 720 THEN 0.75 ELSE 0.5 END AS rs, least(compression / 8, 1.0) AS cs,
        CASE WHEN blur_var < 10 THEN 0.3 WHEN blur_var > 5000 THEN 0.5 ELSE least(greatest(blur_var / 2000, 0.0), 1.0) END AS nz, least(greatest(gradient / 4 / 50, 0.0), 1.0) AS sh FROM ff""",
    "ql": """SELECT *, CASE WHEN o >= 0.7 THEN 'HIGH' WHEN o >= 0.5 THEN 'MEDIUM' WHEN o >= 0.3 THEN 'LOW' ELSE 'DEGRADED' END AS level
        FROM (SELECT *, rs * 0.3 + cs * 0.25 + nz * 0.2 + sh * 0.25 AS o FROM qp)""",
}


def quality(spark, sf):
    # A frame without item or day has no height; SQL gives it the score of 480 lines.
    f = D.frame_features(spark, sf).select(
        "item", "frame", F.coalesce("height", F.lit(480)).alias("height"), F.least(F.col("compression") / 8, F.lit(1.0)).alias("compression_score"),
        F.col("blur_var").alias("laplacian_var"), (F.col("gradient") / 4).alias("mean_gradient"),
    )
    return U.quality_profile(f)


@query("quality_profile", "SELECT item, frame, o AS overall_score, level FROM ql", "overall_score", extra=Q_EXTRA)
def _(spark, sf):
    return quality(spark, sf).select("item", "frame", "overall_score", "level")


@query("recommended_detectors", """SELECT item, d AS detector, count(*) AS frames FROM (SELECT item, unnest(CASE WHEN level IN ('HIGH', 'MEDIUM')
    THEN ['CLIP Detector', 'ViT Detector', 'Artifact Detector', 'BioSignal Detector', 'Alignment Detector'] WHEN level = 'LOW'
    THEN ['CLIP Detector', 'ViT Detector', 'Artifact Detector'] ELSE ['CLIP Detector', 'Artifact Detector'] END) AS d FROM ql) GROUP BY 1, 2""", extra=Q_EXTRA)
def _(spark, sf):
    return quality(spark, sf).select("item", F.explode("recommended").alias("detector")).groupBy("item", "detector").agg(F.count(F.lit(1)).alias("frames"))


@query("status_bands", """SELECT item, idx, CASE WHEN score > 0.6 THEN 'FAIL' WHEN score > 0.3 THEN 'WARN' ELSE 'PASS' END AS core_status,
    CASE WHEN score > 0.65 THEN 'FAIL' WHEN score > 0.35 THEN 'WARN' ELSE 'PASS' END AS text_status,
    CASE WHEN score > 0.65 THEN 'FAIL' WHEN score > 0.3 THEN 'WARN' ELSE 'PASS' END AS spectral_status,
    CASE WHEN score > 0.5 THEN 'FAIL' ELSE 'PASS' END AS classifier_status FROM fs""")
def _(spark, sf):
    return D.frame_scores(spark, sf).select(
        "item", "idx", B.status_band("score", *B.CORE_BANDS).alias("core_status"), B.status_band("score", *B.TEXT_BANDS).alias("text_status"),
        B.status_band("score", *B.SPECTRAL_BANDS).alias("spectral_status"), B.pass_fail("score").alias("classifier_status"),
    )


@query("verdict_bands", f"SELECT {BAND.format('least(value / 60, 1.0)')} AS verdict, count(*) AS n, sum(value) AS total FROM events GROUP BY 1", "total", 4)
def _(spark, sf):
    s = F.least(F.col("value") / 60, F.lit(1.0))
    return D.events(spark, sf).groupBy(B.verdict_band(s).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("route_media", """SELECT media_type, count(*) AS n FROM (SELECT CASE WHEN nm IS NULL THEN 'text' WHEN e IN ('.mp4', '.avi', '.mov', '.mkv', '.webm') THEN 'video'
    WHEN e IN ('.jpg', '.jpeg', '.png', '.bmp', '.webp') THEN 'image' ELSE 'reject' END AS media_type FROM (SELECT nm, lower(regexp_extract(nm, '(\\.[^./]*)$', 1)) AS e
    FROM (SELECT CASE event_type WHEN 'signup' THEN NULL WHEN 'click' THEN 'a' || event_id || '.MP4' WHEN 'view' THEN 'b.' || event_id || '.jpeg' WHEN 'purchase' THEN 'c' || event_id || '.webm' ELSE 'd' || event_id || '.exe' END AS nm FROM events))) GROUP BY 1""")
def _(spark, sf):
    e, i = F.col("event_type"), F.col("event_id").cast("string")
    name = (
        F.when(e == "signup", F.lit(None).cast("string")).when(e == "click", F.concat(F.lit("a"), i, F.lit(".MP4")))
        .when(e == "view", F.concat(F.lit("b."), i, F.lit(".jpeg"))).when(e == "purchase", F.concat(F.lit("c"), i, F.lit(".webm")))
        .otherwise(F.concat(F.lit("d"), i, F.lit(".exe")))
    )
    r = route_media(D.events(spark, sf).select(name.alias("nm")), "nm")
    return r.groupBy("media_type").agg(F.count(F.lit(1)).alias("n"))


# --- core fusion -------------------------------------------------------------------


def wide(spark, sf):
    return U.with_context(D.wide_cores(spark, sf), D.media_profiles(spark, sf), D.audio_profiles(spark, sf), "item")


def fused(spark, sf, mode="weighted_average"):
    return U.fuse_cores(wide(spark, sf), mode)


def _w(core: str, weak: str) -> str:
    return f"CASE WHEN NOT sh THEN b_{core} WHEN {core}_confidence < 0.4 THEN b_{core} * 0.5 ELSE b_{core} + freed * ({core}_confidence / trust) END AS m_{core}"


CORES = ("biosignal", "artifact", "alignment")
FUSE = {
    "fw0": """SELECT wide.*, height, coalesce(is_low_res, false) AS low, has_audio, snr_db, noise_level, av_weight, is_speech,
        has_audio AND noise_level IN ('HIGH', 'EXTREME') AS loud, has_audio AND noise_level = 'MEDIUM' AS mid,
        CASE WHEN low THEN 0.20 ELSE 0.33 END AS b_biosignal, CASE WHEN low THEN 0.45 ELSE 0.33 END AS b_artifact,
        CASE WHEN low THEN 0.35 ELSE 0.34 END * CASE WHEN NOT has_audio THEN 0.3 WHEN loud OR mid THEN av_weight WHEN has_audio AND NOT is_speech THEN 0.5 ELSE 1.0 END AS b_alignment
        FROM wide LEFT JOIN media USING (item) LEFT JOIN audio USING (item)""",
    "fw1": "SELECT *, " + " + ".join(f"CASE WHEN {k}_confidence < 0.4 THEN b_{k} * 0.5 ELSE 0.0 END" for k in CORES) + " AS freed, "
        + " + ".join(f"CASE WHEN {k}_confidence < 0.4 THEN 0.0 ELSE {k}_confidence END" for k in CORES) + " AS trust, "
        + "least(biosignal_confidence, artifact_confidence, alignment_confidence) < 0.4 AND greatest(biosignal_confidence, artifact_confidence, alignment_confidence) >= 0.4 AS sh FROM fw0",
    "fw2": "SELECT *, " + ", ".join(_w(k, "") for k in CORES) + " FROM fw1",
    "fw": "SELECT *, " + ", ".join(f"m_{k} / (m_biosignal + m_artifact + m_alignment) AS w_{k}" for k in CORES) + " FROM fw2",
    "fc": """SELECT *, (biosignal_score > 0.6)::INT + (artifact_score > 0.6)::INT + (alignment_score > 0.6)::INT AS fails,
        (biosignal_score <= 0.3)::INT + (artifact_score <= 0.3)::INT + (alignment_score <= 0.3)::INT AS passes,
        CASE WHEN biosignal_confidence >= greatest(artifact_confidence, alignment_confidence) THEN 'biosignal' WHEN artifact_confidence >= alignment_confidence THEN 'artifact' ELSE 'alignment' END AS lead,
        biosignal_score * w_biosignal + artifact_score * w_artifact + alignment_score * w_alignment AS wavg,
        (biosignal_score * biosignal_confidence + artifact_score * artifact_confidence + alignment_score * alignment_confidence) / greatest(biosignal_confidence + artifact_confidence + alignment_confidence, 0.1) AS cprod,
        greatest(biosignal_score, artifact_score, alignment_score) > 0.6 AND least(biosignal_score, artifact_score, alignment_score) < 0.3 AS split FROM fw""",
    "fk": """SELECT *, CASE WHEN fails >= 2 THEN 'CONSENSUS_FAIL' WHEN passes >= 2 THEN 'CONSENSUS_PASS'
        WHEN biosignal_confidence > 0.8 AND biosignal_score > 0.6 THEN 'DEFER_TO_BIOSIGNAL' WHEN artifact_confidence > 0.8 AND artifact_score > 0.6 THEN 'DEFER_TO_ARTIFACT'
        WHEN alignment_confidence > 0.8 AND alignment_score > 0.6 THEN 'DEFER_TO_ALIGNMENT' ELSE 'INCONCLUSIVE' END AS kind FROM fc""",
    "fkl": "SELECT *, CASE WHEN kind LIKE 'DEFER%' THEN lower(replace(kind, 'DEFER_TO_', '')) ELSE lead END AS leading_core FROM fk",
}


def _verdict(x: str) -> str:
    return f"""CASE WHEN kind = 'CONSENSUS_FAIL' THEN CASE WHEN {x} >= 0.50 THEN 'MANIPULATED' ELSE 'UNCERTAIN' END
        WHEN kind = 'CONSENSUS_PASS' THEN CASE WHEN {x} < 0.50 THEN 'AUTHENTIC' ELSE 'UNCERTAIN' END
        WHEN kind LIKE 'DEFER%' THEN CASE WHEN {x} >= 0.65 THEN 'MANIPULATED' ELSE 'UNCERTAIN' END
        WHEN split THEN 'INCONCLUSIVE' WHEN {x} >= 0.65 THEN 'MANIPULATED' WHEN {x} < 0.30 THEN 'AUTHENTIC' ELSE 'UNCERTAIN' END"""


REASON = """CASE WHEN kind = 'CONSENSUS_FAIL' THEN CASE WHEN wavg >= 0.65 THEN 'Multiple cores detected manipulation patterns' WHEN wavg >= 0.50 THEN 'Consensus indicates manipulation with moderate confidence' ELSE 'Conflicting signals despite consensus' END
    WHEN kind = 'CONSENSUS_PASS' THEN CASE WHEN wavg < 0.30 THEN 'Multiple cores verified authenticity' WHEN wavg < 0.50 THEN 'Consensus indicates authentic with moderate confidence' ELSE 'Score elevated despite positive consensus' END
    WHEN kind LIKE 'DEFER%' THEN CASE WHEN wavg >= 0.65 THEN 'High confidence signal from ' || replace(kind, 'DEFER_TO_', '') || ' core' ELSE 'Deferring to ' || replace(kind, 'DEFER_TO_', '') || ' core with elevated concern' END
    WHEN split THEN 'Conflicting signals between cores' WHEN wavg >= 0.65 THEN 'Score indicates manipulation despite uncertain consensus' WHEN wavg < 0.30 THEN 'Score indicates authenticity despite uncertain consensus' ELSE 'Ambiguous signals require manual review' END"""
CONFLICT = "(split OR (kind = 'CONSENSUS_FAIL' AND wavg < 0.5) OR (kind = 'CONSENSUS_PASS' AND wavg >= 0.5))"
CONF = """least(greatest((biosignal_confidence * w_biosignal + artifact_confidence * w_artifact + alignment_confidence * w_alignment)
    * (1.0 - (greatest(w_biosignal, w_artifact, w_alignment) - 0.33) * 0.5) + CASE WHEN kind LIKE 'CONSENSUS%' THEN 0.15 WHEN kind LIKE 'DEFER%' THEN 0.05 ELSE -0.1 END, 0.1), 1.0)"""


@query("redistribute_weights", "SELECT item, w_biosignal, w_artifact, w_alignment, (low::INT + (NOT coalesce(has_audio, true))::INT + coalesce(loud, false)::INT + coalesce(mid, false)::INT + coalesce(has_audio AND NOT loud AND NOT mid AND NOT is_speech, false)::INT + CASE WHEN sh THEN (biosignal_confidence < 0.4)::INT + (artifact_confidence < 0.4)::INT + (alignment_confidence < 0.4)::INT ELSE 0 END)::BIGINT AS factors FROM fw",
    "w_biosignal w_artifact w_alignment", extra=FUSE)
def _(spark, sf):
    r = U.redistribute_weights(wide(spark, sf))
    return r.select("item", "w_biosignal", "w_artifact", "w_alignment", F.array_size("factors").cast("bigint").alias("factors"))


@query("fused_score_weighted", "SELECT item, wavg AS fused FROM fc", "fused", extra=FUSE)
def _(spark, sf):
    return U.redistribute_weights(wide(spark, sf)).select("item", U.fused_score("weighted_average").alias("fused"))


@query("fused_score_confidence", "SELECT item, cprod AS fused FROM fc", "fused", extra=FUSE)
def _(spark, sf):
    return D.wide_cores(spark, sf).select("item", U.fused_score("confidence_product").alias("fused"))


@query("consensus", "SELECT item, kind AS consensus_type, leading_core FROM fkl", extra=FUSE)
def _(spark, sf):
    c = U.consensus()
    return D.wide_cores(spark, sf).select("item", *[v.alias(k) for k, v in c.items()])


@query("core_verdict", f"SELECT item, {_verdict('wavg')} AS verdict, {REASON} AS reason, {CONFLICT} AS conflicting FROM fkl", extra=FUSE)
def _(spark, sf):
    return fused(spark, sf).select("item", "verdict", "reason", "conflicting")


@query("core_confidence", f"SELECT item, {CONF} AS confidence, least(greatest(100 * (1 - wavg), 0.0), 100.0) AS integrity_score FROM fkl", "confidence integrity_score", 6, extra=FUSE)
def _(spark, sf):
    return fused(spark, sf).select("item", "confidence", U.integrity_score("fused", None).alias("integrity_score"))


@query("fuse_cores", f"SELECT item, {_verdict('wavg')} AS verdict, wavg AS fused, {CONF} AS confidence, kind AS consensus_type, leading_core, w_biosignal, w_artifact, w_alignment FROM fkl",
    "fused confidence w_biosignal w_artifact w_alignment", extra=FUSE)
def _(spark, sf):
    return fused(spark, sf).select("item", "verdict", "fused", "confidence", "consensus_type", "leading_core", "w_biosignal", "w_artifact", "w_alignment")


@query("fuse_cores_confidence_product", f"SELECT {_verdict('cprod')} AS verdict, count(*) AS items, avg(cprod) AS avg_score FROM fkl GROUP BY 1", "avg_score", extra=FUSE)
def _(spark, sf):
    return fused(spark, sf, "confidence_product").groupBy("verdict").agg(F.count(F.lit(1)).alias("items"), F.avg("fused").alias("avg_score"))


@query("transparency", f"""SELECT item, CASE v WHEN 'AUTHENTIC' THEN 'All forensic checks passed. No manipulation indicators detected.' WHEN 'MANIPULATED' THEN 'Manipulation detected. ' || pc
    WHEN 'INCONCLUSIVE' THEN 'Analysis inconclusive due to conflicting or insufficient signals.' ELSE 'Some anomalies detected but not conclusive. Manual review recommended.' END AS summary,
    concat_ws('|', CASE WHEN biosignal_notes <> '' THEN '[BIOSIGNAL] ' || replace(biosignal_notes, ',', '|[BIOSIGNAL] ') END, CASE WHEN artifact_notes <> '' THEN '[ARTIFACT] ' || replace(artifact_notes, ',', '|[ARTIFACT] ') END,
    CASE WHEN alignment_notes <> '' THEN '[ALIGNMENT] ' || replace(alignment_notes, ',', '|[ALIGNMENT] ') END) AS evidence,
    CASE WHEN NOT has_audio THEN 'No audio track present. A/V sync analysis limited.' WHEN noise_level IN ('HIGH', 'EXTREME') THEN 'High audio noise' WHEN NOT is_speech THEN 'No speech detected in audio. A/V sync analysis limited.' END AS audio_note
    FROM (SELECT *, {_verdict('wavg')} AS v, CASE WHEN biosignal_score > 0.6 AND biosignal_confidence > 0.5 THEN 'Missing or inconsistent biological signals detected'
    WHEN artifact_score > 0.6 AND artifact_confidence > 0.5 THEN 'Generative model fingerprints detected' WHEN alignment_score > 0.6 AND alignment_confidence > 0.5 THEN 'Audio-visual synchronization anomalies detected'
    ELSE 'Multiple weak signals indicate potential manipulation' END AS pc FROM fkl)""", extra=FUSE)
def _(spark, sf):
    t = U.transparency(fused(spark, sf))
    note = F.when(F.col("audio_note").startswith("High audio noise"), "High audio noise").otherwise(F.col("audio_note"))
    return t.select("item", "summary", F.concat_ws("|", "supporting_evidence").alias("evidence"), note.alias("audio_note"))


@query("core_explanations")
def _(spark, sf):
    t = U.transparency(fused(spark, sf))
    return t.select("item", "biosignal_explanation", "artifact_explanation", "alignment_explanation", "biosignal_weight_note", "artifact_weight_note", "alignment_weight_note", F.concat_ws("|", "factors").alias("factors"))


@query("anomaly_union", "SELECT core, a AS anomaly, count(*) AS n FROM (SELECT core, unnest(string_split(notes, ',')) AS a FROM cr WHERE notes <> '') GROUP BY 1, 2")
def _(spark, sf):
    r = D.core_results(spark, sf).select("core", F.explode("anomalies").alias("anomaly"))
    return r.groupBy("core", "anomaly").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_flags", "SELECT item, array_to_string(list_sort(list_distinct(flatten(list(string_split(notes, ','))))), ',') AS flags FROM cr WHERE notes <> '' GROUP BY item")
def _(spark, sf):
    r = D.core_results(spark, sf).filter("array_size(anomalies) > 0")
    # At most three cores per item.
    g = r.groupBy("item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("anomalies")))).alias("a"))
    return g.select("item", F.concat_ws(",", "a").alias("flags"))


@query("leading_core", "SELECT lead AS leading, count(*) AS items FROM fc GROUP BY 1", extra=FUSE)
def _(spark, sf):
    lead = B.argmax_label([(k, F.col(f"{k}_confidence")) for k in U.CORES])
    return D.wide_cores(spark, sf).groupBy(lead.alias("leading")).agg(F.count(F.lit(1)).alias("items"))


@query("optional_profiles", "SELECT has_audio IS NULL AS no_profile, count(*) AS items, avg(w_alignment) AS avg_alignment FROM fw GROUP BY 1", "avg_alignment", extra=FUSE)
def _(spark, sf):
    r = U.redistribute_weights(wide(spark, sf))
    return r.groupBy(F.col("has_audio").isNull().alias("no_profile")).agg(F.count(F.lit(1)).alias("items"), F.avg("w_alignment").alias("avg_alignment"))


# --- attention -------------------------------------------------------------------

ATT = {
    "am": "SELECT item, count(*) AS n, quantile_cont(score, 0.5) AS med, stddev_pop(score) AS sd FROM mods GROUP BY item",
    "ae": "SELECT mods.*, n, sd, exp(confidence * (0.7 + 0.3 * (1.0 - abs(score - med)))) AS e FROM mods JOIN am USING (item)",
    "aa": "SELECT *, CASE WHEN n = 1 THEN 1.0 ELSE e / (sum(e) OVER (PARTITION BY item) + 1e-10) END AS attention FROM ae",
}


@query("modality_attention", "SELECT item, name, attention FROM aa", "attention", extra=ATT)
def _(spark, sf):
    return U.modality_attention(D.modalities(spark, sf), "item")


@query("attention_fuse", """SELECT item, n::BIGINT AS num_modalities, fs0 AS fused_score, ag AS agreement, least(greatest(CASE WHEN ag > 0.8 THEN least(fc0 * 1.2, 1.0) WHEN ag < 0.3 THEN fc0 * 0.7 ELSE fc0 END, 0.0), 1.0) AS fused_confidence
    FROM (SELECT item, max(n) AS n, sum(score * attention) AS fs0, sum(confidence * attention) AS fc0, CASE WHEN max(n) > 1 THEN least(greatest(1.0 - max(sd) * 2, 0.0), 1.0) ELSE 1.0 END AS ag FROM aa GROUP BY item)""",
    "fused_score agreement fused_confidence", extra=ATT)
def _(spark, sf):
    r = U.attention_fuse(D.modalities(spark, sf), "item")
    return r.withColumn("num_modalities", F.col("num_modalities").cast("bigint"))


# --- detectors ----------------------------------------------------------------------


@query("fuse_detectors", f"""SELECT item, count(*) AS detectors_run, sum((confidence > 0.2)::INT)::BIGINT AS usable, a AS aggregate_score, {BAND.format('a')} AS verdict FROM
    (SELECT *, coalesce(sum(CASE WHEN confidence > 0.2 THEN score * confidence END) OVER w / sum(CASE WHEN confidence > 0.2 THEN confidence END) OVER w, 0.5) AS a FROM cr WINDOW w AS (PARTITION BY item)) GROUP BY item, a""", "aggregate_score")
def _(spark, sf):
    c = D.core_results(spark, sf).withColumn("status", F.when(F.col("confidence") > 0.2, "PASS").otherwise("SKIPPED"))
    return U.fuse_detectors(c, "item", None)


@query("detector_fallback", """SELECT core, CASE WHEN confidence <= 0.2 THEN 'SKIPPED' WHEN score < 0.1 THEN 'ERROR' ELSE 'PASS' END AS status, count(*) AS n,
    avg(CASE WHEN confidence <= 0.2 OR score < 0.1 THEN 0.5 ELSE score END) AS avg_score FROM cr GROUP BY 1, 2""", "avg_score")
def _(spark, sf):
    c = D.core_results(spark, sf).withColumns(
        {"_has": F.col("confidence") > 0.2, "status": F.lit("PASS"), "data_quality": F.lit("GOOD"),
         "score": F.when(F.col("score") >= 0.1, F.col("score"))}
    )
    r = U.with_fallback(c, "Core", "visual", F.col("_has"))
    return r.groupBy("core", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"))


def registry() -> Registry:
    def weekly(core: str):
        def run(df):
            return df.filter(F.col("core") == core).withColumns({"status": B.status_band("score"), "data_quality": F.lit("GOOD")})
        return run

    r = Registry()
    kinds = {
        "BioSignal Detector": ("biological", {"video_frames", "biological_signal"}, "biosignal"),
        "Artifact Detector": ("visual", {"video_frames", "single_image"}, "artifact"),
        "Alignment Detector": ("multimodal", {"video_frames", "av_sync"}, "alignment"),
    }
    for name, (kind, caps, core) in kinds.items():
        r.register(Detector(name, kind, frozenset(caps), weekly(core)))
    r.register(text_detector())
    r.register(Detector("CLIP Detector", "visual", frozenset({"single_image", "video_frames"}), lambda d: d, enabled=False))
    return r


@query("detectors_for", """SELECT d.name AS detector, media_type, count(*) AS items FROM (SELECT CASE event_type WHEN 'view' THEN 'single_image' ELSE 'video_frames' END AS media_type FROM events) e
    JOIN (VALUES ('BioSignal Detector', 'video_frames'), ('Artifact Detector', 'video_frames'), ('Artifact Detector', 'single_image'), ('Alignment Detector', 'video_frames')) d(name, cap) ON cap = media_type GROUP BY 1, 2""")
def _(spark, sf):
    kind = F.when(F.col("event_type") == "view", "single_image").otherwise("video_frames")
    e = D.events(spark, sf).groupBy(kind.alias("media_type")).agg(F.count(F.lit(1)).alias("items"))
    # The registry table has one row per registered plug-in.
    table = registry().table(spark)
    parts = [S.detectors_for(table, c).select(F.col("name").alias("detector"), F.lit(c).alias("media_type")) for c in ("single_image", "video_frames")]
    return e.join(parts[0].unionByName(parts[1]), "media_type").select("detector", "media_type", "items")


@query("registry_results", """SELECT core || '/' || status AS detector_status, count(*) AS n FROM (SELECT core, CASE WHEN score > 0.6 THEN 'FAIL' WHEN score > 0.3 THEN 'WARN' ELSE 'PASS' END AS status FROM cr) GROUP BY 1""")
def _(spark, sf):
    names = {d: n for d, n in (("BioSignal Detector", "biosignal"), ("Artifact Detector", "artifact"), ("Alignment Detector", "alignment"))}
    core = D.core_results(spark, sf)
    reg = registry()
    out = None
    for d, c in names.items():
        r = reg.get(d).detect(core.filter(F.col("core") == c), "item").withColumn("core", F.lit(c))
        out = r if out is None else out.unionByName(r)
    return out.groupBy(F.concat("core", F.lit("/"), "status").alias("detector_status")).agg(F.count(F.lit(1)).alias("n"))


@query("unified_scan", f"SELECT doc_id, 1::BIGINT AS detectors_run, score AS aggregate_score, {BAND.format('score')} AS verdict FROM ts", "aggregate_score", 4)
def _(spark, sf):
    docs = D.spread(D.table(spark, sf, "documents").select("doc_id", "text"))
    _, f = scan(docs, registry(), "text_content", "doc_id")
    return f.select("doc_id", "detectors_run", "aggregate_score", "verdict")


@query("result_rows", "SELECT doc_id, 'Text Detector' AS detector_name, score, confidence, CASE WHEN NOT ok THEN 'WARN' WHEN raw > 0.65 THEN 'FAIL' WHEN raw > 0.35 THEN 'WARN' ELSE 'PASS' END AS status, n_words::VARCHAR AS words FROM ts", "score confidence", 4)
def _(spark, sf):
    r = text_detector().detect(D.spread(D.table(spark, sf, "documents").select("doc_id", "text")), "doc_id")
    s = r.select("doc_id", result_struct().alias("r"))
    return s.select("doc_id", "r.detector_name", "r.score", "r.confidence", "r.status", F.col("r.details")["word_count"].alias("words"))


@query("clip_verdict", """SELECT item, n AS frames_analyzed, p AS avg_prob, r AS fake_ratio, CASE WHEN p > 0.7 THEN 'FAKE' WHEN p < 0.3 THEN 'REAL' ELSE 'UNCERTAIN' END AS verdict,
    CASE WHEN p > 0.7 THEN p WHEN p < 0.3 THEN 1 - p ELSE 1 - abs(0.5 - p) * 2 END AS confidence FROM (SELECT item, count(*) AS n, avg(score) AS p, avg((score > 0.5)::INT) AS r FROM fs GROUP BY item)""", "avg_prob fake_ratio confidence")
def _(spark, sf):
    return U.clip_verdict(D.frame_scores(spark, sf), "item", "score")


@query("frame_details", "SELECT item, idx, score AS fake_probability, CASE WHEN score > 0.5 THEN 'FAKE' ELSE 'REAL' END AS label FROM fs", "fake_probability")
def _(spark, sf):
    return U.frame_details(D.frame_scores(spark, sf), "item", "idx", "score")
