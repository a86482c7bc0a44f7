"""Fingerprint, heatmap, spectrum, embedding, grid and audio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..plans import bindings as D
from ..plans.registry import spectral_adapter
from .base import query

FP = {
    "ft": """SELECT item, count(*) AS n, avg(grid_score) AS gm, stddev_pop(grid_score) AS gs, avg(1.0 / (1.0 + abs(kurtosis - 3))) AS u, avg(noise_std) AS nm, avg(blur_var) AS bm, avg(detail_ratio) AS dm,
        avg(CASE WHEN flow_dir_var > 1.5 AND flow_mag > 1 THEN flow_dir_var END) AS wm, sum((flow_dir_var > 1.5 AND flow_mag > 1)::INT)::BIGINT AS wc FROM ff GROUP BY item""",
    "fq": """SELECT *, 1.0 - least(gs / (gm + 1e-6), 1.0) AS gc, coalesce(least(wm / 3, 1.0), 0.0) AS warp FROM ft""",
    "fr": """SELECT *, least(CASE WHEN gm > 0.15 THEN 0.7 WHEN gm > 0.08 THEN 0.4 ELSE 0.0 END + CASE WHEN gc > 0.8 AND gm > 0.05 THEN 0.2 ELSE 0.0 END, 1.0) AS gan,
        least(CASE WHEN u > 0.7 THEN 0.6 WHEN u > 0.5 THEN 0.3 ELSE 0.0 END + CASE WHEN nm < 2 THEN 0.2 ELSE 0.0 END, 1.0) AS dif,
        least(CASE WHEN bm < 100 THEN 0.5 WHEN bm < 300 THEN 0.25 ELSE 0.0 END + CASE WHEN dm < 0.3 THEN 0.3 ELSE 0.0 END, 1.0) AS vae FROM fq""",
    "fz": "SELECT *, least(greatest(gan, dif, vae) + warp * 0.3, 1.0) AS s FROM fr",
}


@query("gan_fingerprint", """SELECT item, gm AS grid_mean, gc AS grid_consistency, gan AS gan_score, concat_ws(',', CASE WHEN gm > 0.15 THEN 'GAN_GRID_ARTIFACT_DETECTED' WHEN gm > 0.08 THEN 'POSSIBLE_GAN_ARTIFACT' END,
    CASE WHEN gc > 0.8 AND gm > 0.05 AND gm <= 0.15 THEN 'CONSISTENT_FREQUENCY_PATTERN' END) AS gan_flags FROM fr""", "grid_mean grid_consistency gan_score", extra=FP)
def _(spark, sf):
    return X.gan_fingerprint(D.frame_features(spark, sf), "item").withColumn("gan_flags", F.concat_ws(",", "gan_flags"))


@query("diffusion_fingerprint", "SELECT item, u AS uniformity, nm AS noise_mean, dif AS diffusion_score FROM fr", "uniformity noise_mean diffusion_score", extra=FP)
def _(spark, sf):
    return X.diffusion_fingerprint(D.frame_features(spark, sf), "item").drop("diffusion_flags")


@query("vae_fingerprint", "SELECT item, bm AS blur_mean, dm AS detail_mean, vae AS vae_score FROM fr", "blur_mean detail_mean vae_score", 6, extra=FP)
def _(spark, sf):
    return X.vae_fingerprint(D.frame_features(spark, sf), "item").drop("vae_flags")


@query("warp_score", "SELECT item, wc AS warp_count, warp AS warp_score FROM fr", "warp_score", extra=FP)
def _(spark, sf):
    return X.warp_score(D.frame_features(spark, sf), "item")


@query("warp_events", "SELECT item, frame, flow_dir_var, flow_mag FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY frame) AS r FROM ff WHERE flow_dir_var > 1.5 AND flow_mag > 1) WHERE r <= 5", "flow_dir_var flow_mag")
def _(spark, sf):
    return X.warp_events(D.frame_features(spark, sf), "item", "frame")


@query("artifact_result", """SELECT item, n AS n_frames, gan AS gan_score, dif AS diffusion_score, vae AS vae_score, s AS score, least(0.5 + s * 0.4, 0.9) * CASE WHEN n < 20 THEN 0.8 ELSE 1.0 END AS confidence,
    CASE WHEN s > 0.6 THEN 'FAIL' WHEN s > 0.3 THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN greatest(gan, dif, vae) < 0.3 THEN 'NONE_DETECTED' WHEN gan >= greatest(dif, vae) THEN 'GAN' WHEN dif >= vae THEN 'DIFFUSION' ELSE 'VAE' END AS model_type,
    ((gan > 0.3)::INT + (dif > 0.3)::INT + (vae > 0.3)::INT)::BIGINT AS fingerprints FROM fz""", "gan_score diffusion_score vae_score score confidence", extra=FP)
def _(spark, sf):
    r = X.artifact_result(D.frame_features(spark, sf), "item")
    return r.select("item", "n_frames", "gan_score", "diffusion_score", "vae_score", "score", "confidence", "status", "model_type", F.array_size("fingerprints").cast("bigint").alias("fingerprints"))


HM = {
    "hc0": "SELECT vec_id AS item, p, least(abs(embedding[p + 1]::DOUBLE) * 4, 1.0) AS g, least(abs(embedding[(p + 21) % 64 + 1]::DOUBLE) * 4, 1.0) AS d, least(abs(embedding[(p + 42) % 64 + 1]::DOUBLE) * 4, 1.0) AS v FROM (SELECT *, unnest(range(64)) AS p FROM embeddings)",
    "hc": "SELECT *, greatest(g, d, v) AS s, CASE WHEN greatest(g, d, v) < 0.3 THEN 'NONE' WHEN g >= greatest(d, v) THEN 'GAN' WHEN d >= v THEN 'DIFFUSION' ELSE 'VAE' END AS k FROM hc0",
    "hn": "SELECT item, avg(s) AS overall, sum((s > 0.5)::INT)::BIGINT AS hotspots, sum((k = 'GAN')::INT) AS a, sum((k = 'DIFFUSION')::INT) AS b, sum((k = 'VAE')::INT) AS c, sum((k = 'NONE')::INT) AS n FROM hc GROUP BY item",
}


@query("heatmap_cells", "SELECT item, p % 8 AS x, p // 8 AS y, s AS anomaly_score, k AS anomaly_type, least(s * 1.5, 1.0) AS confidence, s > 0.5 AS is_hotspot FROM hc", "anomaly_score confidence", extra=HM)
def _(spark, sf):
    return X.heatmap_cells(D.heat_cells(spark, sf)).drop("gan", "diffusion", "vae")


@query("heatmap", "SELECT item, overall, hotspots, CASE WHEN n = greatest(a, b, c, n) THEN 'NONE' WHEN a = greatest(a, b, c, n) THEN 'GAN' WHEN b = greatest(a, b, c, n) THEN 'DIFFUSION' ELSE 'VAE' END AS dominant_type FROM hn", "overall", extra=HM)
def _(spark, sf):
    return X.heatmap(D.heat_cells(spark, sf), "item")


@query("heatmap_grid", "SELECT item, p // 8 AS y, " + ", ".join(f"max(s) FILTER (p % 8 = {i}) AS x{i}" for i in range(8)) + " FROM hc GROUP BY 1, 2", "x0 x1 x2 x3 x4 x5 x6 x7", extra=HM)
def _(spark, sf):
    return X.heatmap_grid(D.heat_cells(spark, sf), "item")


@query("shape_stats", """SELECT item, n, kurt + 3 AS kurtosis, kurt AS excess_kurtosis, skew AS skewness, ent / ln(n) AS entropy FROM
    (SELECT vec_id AS item, count(*) AS n, kurtosis_pop(a) AS kurt, avg(pow((a - m) / s, 3)) AS skew, -sum((a / (t + 1e-10)) * ln(a / (t + 1e-10))) AS ent
    FROM (SELECT vec_id, abs(v) AS a, avg(abs(v)) OVER w AS m, stddev_pop(abs(v)) OVER w AS s, sum(abs(v)) OVER w AS t FROM vals WINDOW w AS (PARTITION BY vec_id)) GROUP BY vec_id)""", "kurtosis excess_kurtosis skewness entropy", 7)
def _(spark, sf):
    v = D.vectors(spark, sf).select("item", F.explode("vec").alias("v"))
    return X.shape_stats(v, ["item"], "v")


SF = {
    "pf": "SELECT item, t, pos, abs(v) AS p, v FROM fv",
    "fl": """SELECT item, t, least(exp(avg(ln(p + 1e-10)) FILTER (p > 0)) / avg(p) FILTER (p > 0), 1.0) AS flatness, sum(p * p) FILTER (pos < 12) / sum(p * p) AS low, sum(p * p) FILTER (pos >= 12 AND pos < 32) / sum(p * p) AS mid,
        sum(p * p) FILTER (pos >= 32) / sum(p * p) AS high, stddev_pop(p) AS az, kurtosis_pop(v) AS ku FROM pf GROUP BY 1, 2""",
    "sfr": """SELECT *, CASE WHEN flatness > 0.35 THEN least((flatness - 0.35) / 0.3, 1.0) END AS c1, CASE WHEN high > 0.25 THEN least((high - 0.25) / 0.3, 1.0) END AS c2,
        CASE WHEN ku < 1.5 THEN least((1.5 - ku) / 3, 1.0) WHEN ku > 20 THEN least((ku - 20) / 30, 1.0) END AS c3 FROM fl""",
    "sf1": "SELECT *, (c1 IS NOT NULL)::INT + (c2 IS NOT NULL)::INT + (c3 IS NOT NULL)::INT AS k FROM sfr",
    "sf2": """SELECT *, least(greatest(CASE WHEN k > 0 THEN least((coalesce(c1, 0.0) + coalesce(c2, 0.0) + coalesce(c3, 0.0)) / k * 0.8 + 0.2, 1.0) ELSE flatness * 0.3 + high * 0.3 END, 0.0), 1.0) AS score,
        least(0.5 + k * 0.15 + az * 0.1, 1.0) AS confidence FROM sf1""",
    "sfn": "SELECT item, n, unnest(CASE WHEN n > 10 THEN range(10) ELSE range(n) END) AS j FROM (SELECT item, count(*) AS n FROM sf2 GROUP BY item)",
    "sfp": "SELECT DISTINCT item, CASE WHEN n > 10 THEN CASE WHEN j = 9 THEN n - 1 ELSE floor(j * ((n - 1) / 9)) END ELSE j END AS t FROM sfn",
    "sfi": "SELECT item, count(*) AS n, avg(score) AS score, avg(confidence) AS c, stddev_pop(score) AS sd FROM sf2 JOIN sfp USING (item, t) GROUP BY item",
}


@query("spectral_flatness", "SELECT item, t, flatness FROM fl", "flatness", extra=SF)
def _(spark, sf):
    return D.spectral_frames(spark, sf).select("item", "t", "flatness")


@query("band_ratios", "SELECT vec_id AS item, low AS low_ratio, mid AS mid_ratio, high AS high_ratio FROM fl JOIN (SELECT vec_id, label AS item, t FROM frm JOIN embeddings USING (vec_id)) USING (item, t)", "low_ratio mid_ratio high_ratio", extra=SF)
def _(spark, sf):
    g = D.grids(spark, sf).select("item", X.band_ratios("grid").alias("b"))
    return g.select("item", F.col("b.low").alias("low_ratio"), F.col("b.mid").alias("mid_ratio"), F.col("b.high").alias("high_ratio"))


@query("radial_profile", "SELECT vec_id AS item, r AS radius, avg(p) AS power FROM (SELECT vec_id, abs(v) AS p, floor(sqrt(pow(pos // 8 - 4, 2) + pow(pos % 8 - 4, 2)))::BIGINT AS r FROM vals) WHERE r < 4 GROUP BY 1, 2", "power")
def _(spark, sf):
    return X.radial_profile(D.grid_cells(spark, sf), "item", "r", "c", "v", 8, 8)


@query("spectral_frame", "SELECT item, t, score, confidence, k::BIGINT AS flags FROM sf2", "score confidence", extra=SF)
def _(spark, sf):
    s = X.spectral_frame(D.spectral_frames(spark, sf))
    return s.select("item", "t", "score", "confidence", F.array_size("anomalies").cast("bigint").alias("flags"))


def spectral_items(spark, sf):
    return X.spectral_item(X.spectral_frame(D.spectral_frames(spark, sf)), "item", "t")


@query("spectral_item", "SELECT item, n AS frames_analyzed, score, sd AS score_std, CASE WHEN sd < 0.05 THEN least(c + 0.1, 1.0) ELSE c END AS confidence FROM sfi", "score score_std confidence", extra=SF)
def _(spark, sf):
    return spectral_items(spark, sf).select("item", "frames_analyzed", "score", "score_std", "confidence")


@query("spectral_anomalies")
def _(spark, sf):
    return spectral_items(spark, sf).select("item", F.concat_ws("|", "anomalies").alias("anomalies"))


@query("spectral_detector", """SELECT item, score, CASE WHEN score > 0.65 THEN 'FAIL' WHEN score > 0.30 THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN CASE WHEN sd < 0.05 THEN least(c + 0.1, 1.0) ELSE c END > 0.5 THEN 'GOOD' ELSE 'LIMITED' END AS data_quality FROM sfi""", "score", extra=SF)
def _(spark, sf):
    frames = X.spectral_frame(D.spectral_frames(spark, sf))
    det = spectral_adapter(lambda df: X.spectral_item(frames.join(df, "item", "left_semi"), "item", "t"))
    items = frames.select("item").distinct()
    return det.detect(items, "item").select("item", "score", "status", "data_quality")


EM = {
    "es": """SELECT vec_id AS item, label::BIGINT AS grp, sqrt(sum(v * v)) AS norm, -sum((abs(v) / (t + 1e-10)) * ln(abs(v) / (t + 1e-10) + 1e-10)) AS ent, least(greatest(0.5 + (stddev_pop(v) - 0.3) * 0.5, 0.0), 1.0) AS score
        FROM (SELECT *, sum(abs(v)) OVER (PARTITION BY vec_id) AS t FROM vals) GROUP BY 1, 2""",
    "ei0": "SELECT grp, item, score, row_number() OVER (PARTITION BY grp ORDER BY item) - 1 AS t, count(*) OVER (PARTITION BY grp) AS n FROM es",
    "ei": "SELECT *, EXISTS (SELECT 1 FROM (SELECT unnest(range(8)) AS j) WHERE n <= 8 OR ei0.t = CASE WHEN j = 7 THEN n - 1 ELSE floor(j * ((n - 1) / 7)) END) AS hit FROM ei0",
}


@query("embedding_stats", "SELECT item, norm AS feature_norm, ent AS feature_entropy, score, least(0.5 + ((ent < 2)::INT + (norm > 50)::INT) * 0.15 + abs(score - 0.5) * 0.5, 1.0) AS confidence FROM es", "feature_norm feature_entropy score confidence", 7, extra=EM)
def _(spark, sf):
    return X.embedding_stats(D.vectors(spark, sf), "vec").select("item", "feature_norm", "feature_entropy", "score", "confidence")


def ordered_scores(spark, sf, scored):
    """Scored vectors of a group in id order, as frames."""
    from ..operators.ordered import dense_index

    s = scored.withColumnRenamed("item", "vec_id").withColumnRenamed("grp", "item")
    return dense_index(s, ["item"], F.col("vec_id"), [F.col("vec_id")], "t")


@query("embedding_item", "SELECT grp AS item, count(*) AS frames_analyzed, stddev_pop(score) AS score_std, avg(score) AS score, least(0.6 + abs(avg(score) - 0.5) * 0.4 + (1.0 - stddev_pop(score)) * 0.1, 1.0) AS confidence, CASE WHEN stddev_pop(score) < 0.02 THEN 1 ELSE 0 END::BIGINT AS flags FROM ei WHERE hit GROUP BY grp",
    "score_std score confidence", extra=EM)
def _(spark, sf):
    s = X.embedding_stats(D.vectors(spark, sf), "vec").select("item", "grp", "score")
    r = X.embedding_item(ordered_scores(spark, sf, s), "item", "t")
    return r.withColumn("flags", F.array_size("anomalies").cast("bigint")).drop("anomalies")


PT = {
    "pq": "SELECT vec_id AS item, pos // 4 AS q, pos % 4 AS d, v FROM vals",
    "pn": "SELECT *, v / (sqrt(sum(v * v) OVER (PARTITION BY item, q)) + 1e-8) AS u FROM pq",
    "pd": "SELECT a.item, a.q AS i, b.q AS j, sum(a.u * b.u) / 2 AS s FROM pn a JOIN pn b ON a.item = b.item AND a.d = b.d GROUP BY 1, 2, 3",
    "pe": "SELECT *, exp(s - max(s) OVER (PARTITION BY item, i)) AS e FROM pd",
    "pa": "SELECT item, i, j, e / (sum(e) OVER (PARTITION BY item, i) + 1e-10) AS a FROM pe",
    "pu": "SELECT item, -sum(a * ln(a + 1e-10)) AS ent, 1.0 - avg(abs(a - 1.0 / 16)) * 16 AS uni FROM pa GROUP BY item",
    "pm": "SELECT item, var_pop(m) AS pv FROM (SELECT item, q, avg(v) AS m FROM pq GROUP BY 1, 2) GROUP BY item",
    "pg": "SELECT a.item, a.q, avg(abs(a.v - b.v)) AS g FROM pq a JOIN pq b ON a.item = b.item AND b.q = a.q + 1 AND a.d = b.d WHERE a.q % 4 <> 3 GROUP BY 1, 2",
    "pb": "SELECT item, CASE WHEN avg(g) < 1e-8 THEN 0.0 ELSE least(greatest(stddev_pop(g) / (avg(g) + 1e-8) - 0.5, 0.0), 1.0) END AS b FROM pg GROUP BY item",
    "pk0": "SELECT item, ent, uni, pv, b, (uni > 0.85)::INT + (pv < 0.01)::INT + (b > 0.3)::INT AS k, CASE WHEN uni > 0.85 THEN 0.7 ELSE 0.0 END + CASE WHEN pv < 0.01 THEN 0.6 ELSE 0.0 END + CASE WHEN b > 0.3 THEN b ELSE 0.0 END AS tot FROM pu JOIN pm USING (item) JOIN pb USING (item)",
    "pk1": "SELECT *, least(greatest(CASE WHEN k > 0 THEN tot / k ELSE 0.3 * (1 - ent / 5) + 0.2 * b END, 0.0), 1.0) AS score FROM pk0",
    "pk2": "SELECT *, least(0.5 + k * 0.15 + abs(score - 0.5) * 0.3, 1.0) AS confidence FROM pk1",
}


@query("self_attention", "SELECT item, i AS row, j AS col, a AS attention FROM pa", "attention", extra=PT)
def _(spark, sf):
    a = D.patches(spark, sf).select("item", F.posexplode(X.self_attention("patches")).alias("row", "r"))
    m = a.select("item", F.col("row").cast("bigint").alias("row"), F.posexplode("r").alias("col", "attention"))
    return m.withColumn("col", F.col("col").cast("bigint"))


@query("patch_stats", "SELECT item, ent AS attention_entropy, uni AS attention_uniformity, pv AS patch_variance, b AS boundary_score, score, confidence FROM pk2",
    "attention_entropy attention_uniformity patch_variance boundary_score score confidence", 7, extra=PT)
def _(spark, sf):
    return X.patch_stats(D.patches(spark, sf), "patches").drop("grp", "patches", "anomalies")


@query("patch_item", """SELECT grp AS item, count(*) AS frames_analyzed, avg(score) AS score, avg(confidence) AS confidence FROM (SELECT grp, score, confidence, EXISTS (SELECT 1 FROM (SELECT unnest(range(6)) AS j) WHERE n <= 6 OR z.t = CASE WHEN j = 5 THEN n - 1 ELSE floor(j * ((n - 1) / 5)) END) AS hit
    FROM (SELECT label::BIGINT AS grp, score, confidence, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, count(*) OVER (PARTITION BY label) AS n FROM pk2 JOIN embeddings ON vec_id = item) z) WHERE hit GROUP BY grp""", "score confidence", 7, extra=PT)
def _(spark, sf):
    s = X.patch_stats(D.patches(spark, sf), "patches").select("item", "grp", "score", "confidence", "anomalies")
    return X.patch_item(ordered_scores(spark, sf, s), "item", "t").drop("anomalies")


@query("grid_coherence", """SELECT item, p, CASE WHEN max(own) > 0 THEN 1.0 - least(stddev_pop(v) / (avg(v) + 1e-10), 1.0) ELSE 0.0 END AS coherence FROM (SELECT a.vec_id AS item, a.pos AS p, abs(a.v) AS own, abs(b.v) AS v FROM vals a JOIN vals b
    ON a.vec_id = b.vec_id AND abs(a.pos // 8 - b.pos // 8) + abs(a.pos % 8 - b.pos % 8) <= 1) GROUP BY 1, 2""", "coherence", 7)
def _(spark, sf):
    g = D.grids(spark, sf).select("item", F.posexplode(X.grid_coherence("grid", 8, 8)).alias("p", "coherence"))
    return g.withColumn("p", F.col("p").cast("bigint"))


@query("block_median", "SELECT item, quantile_cont(m, 0.5) AS block_median FROM (SELECT vec_id AS item, (pos // 8) // 2 AS a, (pos % 8) // 2 AS b, avg(abs(v)) AS m FROM vals GROUP BY 1, 2, 3) GROUP BY item", "block_median")
def _(spark, sf):
    return X.block_median(D.grid_cells(spark, sf), "item", "r", "c", 2, "v")


@query("roi_grid", """SELECT item, 'ROI_' || r || '_' || c AS roi_name, tp + r * chh AS y1, lf + c * cww AS x1, tp + (r + 1) * chh AS y2, lf + (c + 1) * cww AS x2 FROM (SELECT item, tp, lf, ((height * 5) // 6 - tp) // 8 AS chh, ((width * 3) // 4 - lf) // 4 AS cww
    FROM (SELECT item, width, height, height // 6 AS tp, width // 4 AS lf FROM media)) CROSS JOIN (SELECT unnest(range(8)) AS r) CROSS JOIN (SELECT unnest(range(4)) AS c)""")
def _(spark, sf):
    m = D.media_rows(spark, sf).select("item", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"))
    return X.roi_grid(m, "width", "height").select("item", "roi_name", "y1", "x1", "y2", "x2")


@query("roi_weights", "SELECT row, count(*) AS boxes, avg(height) AS avg_height FROM (SELECT item, height, unnest(range(8)) AS row FROM media) CROSS JOIN (SELECT unnest(range(4)) AS c) GROUP BY row", "avg_height")
def _(spark, sf):
    g = X.roi_grid(D.media_rows(spark, sf), "width", "height")
    return g.groupBy(F.col("row").cast("bigint").alias("row")).agg(F.count("weight").alias("boxes"), F.avg("height").alias("avg_height"))


AU = {
    "sm": "SELECT item, t * 64 + pos AS i, v FROM fv",
    "nfr": "SELECT item, (max(i) + 1 - 25) // 10 + 1 AS nf FROM sm GROUP BY item",
    "fe": "SELECT item, f, sum(v * v) AS e FROM (SELECT item, v, unnest(range(greatest(0, ceil((i - 24) / 10)::BIGINT), i // 10 + 1)) AS f FROM sm) JOIN nfr USING (item) WHERE f < nf GROUP BY 1, 2",
    "er": "SELECT item, e, row_number() OVER (PARTITION BY item ORDER BY e) - 1 AS r, count(*) OVER (PARTITION BY item) AS n FROM fe WHERE e > 0",
    "el": "SELECT item, avg(e) FILTER (r < greatest(floor(n * 0.1), 1)) AS noise, avg(e) FILTER (r >= floor(n * 0.7)) AS sig FROM er GROUP BY item",
}


@query("estimate_snr", "SELECT item, CASE WHEN sig > noise THEN least(greatest(10 * log10(sig / noise), 0.0), 40.0) ELSE 30.0 END AS snr_db FROM el", "snr_db", 7, extra=AU)
def _(spark, sf):
    return X.estimate_snr(D.samples(spark, sf), "item", "i", "v", D.SR)


@query("speech_present", "SELECT item, sqrt(avg(v * v)) AS rms, avg(z) AS zcr, sqrt(avg(v * v)) >= 0.01 AND ((avg(z) > 0.02 AND avg(z) < 0.20) OR sqrt(avg(v * v)) > 0.02) AS is_speech FROM (SELECT item, v, coalesce(((v < 0) <> (lag(v) OVER (PARTITION BY item ORDER BY i) < 0))::INT, 0) AS z FROM sm) GROUP BY item", "rms zcr", extra=AU)
def _(spark, sf):
    return X.speech_present(D.samples(spark, sf), "item", "i", "v")
