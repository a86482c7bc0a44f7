"""Aggregates over frame features, grids, vectors, profiles and samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import argmax_label, status_band
from ..functions.exprs import (
    array_mean,
    array_std,
    array_sum,
    array_var,
    clip,
    col,
    flags,
    fmt,
    let,
    mean_of_present,
    safe_div,
)
from .ordered import histogram_ranks, log_cell, own_rows, with_halo
from .sampling import sample_even, top_rows

LOW_END, MID_END = 0.2, 0.5

# --- generative-model fingerprints ------------------------------------------

FINGERPRINT_TERMS = {
    "n_frames": lambda: F.count(F.lit(1)),
    "grid_mean": lambda: F.avg("grid_score"),
    "grid_std": lambda: F.stddev_pop("grid_score"),
    "uniformity": lambda: F.avg(1.0 / (1.0 + F.abs(F.col("kurtosis") - 3.0))),
    "noise_mean": lambda: F.avg("noise_std"),
    "blur_mean": lambda: F.avg("blur_var"),
    "detail_mean": lambda: F.avg("detail_ratio"),
    "warp_mean": lambda: F.avg(F.when(_warped(), F.col("flow_dir_var"))),
    "warp_count": lambda: F.sum(_warped().cast("bigint")),
}


def _warped() -> Column:
    return (F.col("flow_dir_var") > 1.5) & (F.col("flow_mag") > 1.0)


def frame_terms(df: DataFrame, item: str) -> DataFrame:
    """Every mean the fingerprint rules need, in one aggregation."""
    return df.groupBy(item).agg(*[f().alias(k) for k, f in FINGERPRINT_TERMS.items()])


def gan_columns() -> dict[str, Column]:
    m = F.col("grid_mean")
    even = 1.0 - F.least(F.col("grid_std") / (m + 1e-6), F.lit(1.0))
    steady = (even > 0.8) & (m > 0.05)
    base = F.when(m > 0.15, 0.7).when(m > 0.08, 0.4).otherwise(0.0)
    return {
        "grid_consistency": even,
        "gan_score": F.least(base + F.when(steady, 0.2).otherwise(0.0), F.lit(1.0)),
        "gan_flags": flags(
            (m > 0.15, "GAN_GRID_ARTIFACT_DETECTED"),
            ((m > 0.08) & (m <= 0.15), "POSSIBLE_GAN_ARTIFACT"),
            (steady & (m <= 0.15), "CONSISTENT_FREQUENCY_PATTERN"),
        ),
    }


def diffusion_columns() -> dict[str, Column]:
    u, n = F.col("uniformity"), F.col("noise_mean")
    base = F.when(u > 0.7, 0.6).when(u > 0.5, 0.3).otherwise(0.0)
    return {
        "diffusion_score": F.least(base + F.when(n < 2.0, 0.2).otherwise(0.0), F.lit(1.0)),
        "diffusion_flags": flags(
            (u > 0.7, "DIFFUSION_NOISE_SIGNATURE"),
            ((u > 0.5) & (u <= 0.7), "POSSIBLE_DIFFUSION_PATTERN"),
            (n < 2.0, "UNNATURALLY_SMOOTH_REGIONS"),
        ),
    }


def vae_columns() -> dict[str, Column]:
    b, d = F.col("blur_mean"), F.col("detail_mean")
    base = F.when(b < 100, 0.5).when(b < 300, 0.25).otherwise(0.0)
    return {
        "vae_score": F.least(base + F.when(d < 0.3, 0.3).otherwise(0.0), F.lit(1.0)),
        "vae_flags": flags(
            (b < 100, "VAE_BLUR_SIGNATURE"),
            ((b >= 100) & (b < 300), "POSSIBLE_VAE_BLUR"),
            (d < 0.3, "HIGH_FREQUENCY_LOSS"),
        ),
    }


def gan_fingerprint(df: DataFrame, item: str) -> DataFrame:
    cols = gan_columns()
    return frame_terms(df, item).withColumns(cols).select(item, "grid_mean", *cols)


def diffusion_fingerprint(df: DataFrame, item: str) -> DataFrame:
    cols = diffusion_columns()
    return frame_terms(df, item).withColumns(cols).select(item, "uniformity", "noise_mean", *cols)


def vae_fingerprint(df: DataFrame, item: str) -> DataFrame:
    cols = vae_columns()
    return frame_terms(df, item).withColumns(cols).select(item, "blur_mean", "detail_mean", *cols)


def warp_score(df: DataFrame, item: str) -> DataFrame:
    score = F.coalesce(F.least(F.col("warp_mean") / 3.0, F.lit(1.0)), F.lit(0.0))
    return frame_terms(df, item).select(item, "warp_count", score.alias("warp_score"))


def warp_events(df: DataFrame, item: str, frame: str, keep: int = 5) -> DataFrame:
    """The first warp events of each item."""
    ev = df.filter(_warped()).select(item, frame, "flow_dir_var", "flow_mag")
    return top_rows(ev, [item], [F.col(frame)], keep)


def artifact_result(df: DataFrame, item: str, profiles: DataFrame | None = None) -> DataFrame:
    """Artifact core verdict per item from one aggregation of frame features."""
    t = frame_terms(df, item)
    if profiles is None:
        t = t.withColumn("is_low_res", F.lit(False))
    else:
        t = t.join(profiles.select(item, "is_low_res"), item, "left")
    warp = F.coalesce(F.least(F.col("warp_mean") / 3.0, F.lit(1.0)), F.lit(0.0))
    s = t.withColumns(gan_columns() | diffusion_columns() | vae_columns() | {"warp_score": warp})
    g, d, v = F.col("gan_score"), F.col("diffusion_score"), F.col("vae_score")
    top = F.greatest(g, d, v)
    few = F.col("n_frames") < 5
    raw = F.least(top + F.col("warp_score") * 0.3, F.lit(1.0))
    s = s.withColumn("score", F.when(few, 0.5).otherwise(raw))
    conf = F.least(0.5 + F.col("score") * 0.4, F.lit(0.9)) * F.when(F.col("n_frames") < 20, 0.8).otherwise(1.0)
    conf = F.when(F.coalesce("is_low_res", F.lit(False)), F.least(conf * 1.1, F.lit(0.95))).otherwise(conf)
    model = F.when(top < 0.3, "NONE_DETECTED").otherwise(
        argmax_label([("GAN", g), ("DIFFUSION", d), ("VAE", v)])
    )

    def mark(name: str, c: Column, fl: str) -> Column:
        entry = F.struct(F.lit(name).alias("type"), F.round(c, 4).alias("score"), F.col(fl).alias("anomalies"))
        return F.when(c > 0.3, entry)

    prints = F.filter(
        F.array(mark("GAN", g, "gan_flags"), mark("DIFFUSION", d, "diffusion_flags"), mark("VAE", v, "vae_flags")),
        lambda x: x.isNotNull(),
    )
    notes = F.concat(
        "gan_flags", "diffusion_flags", "vae_flags",
        flags((F.col("warp_score") > 0.4, "TEMPORAL_WARPING_DETECTED")),
    )
    return s.select(
        item,
        "n_frames",
        "gan_score",
        "diffusion_score",
        "vae_score",
        "warp_score",
        "warp_count",
        "score",
        F.when(few, 0.3).otherwise(conf).alias("confidence"),
        F.when(few, "WARN").otherwise(status_band("score")).alias("status"),
        model.alias("model_type"),
        F.when(few, F.array(F.lit("LOW_FRAME_COUNT"))).otherwise(notes).alias("anomalies"),
        prints.alias("fingerprints"),
        F.when(few, "INSUFFICIENT").otherwise("GOOD").alias("data_quality"),
    )


# --- heatmap -----------------------------------------------------------------


def heatmap_cells(df: DataFrame) -> DataFrame:
    """Type and confidence of each grid cell from its three scores."""
    g, d, v = F.col("gan"), F.col("diffusion"), F.col("vae")
    top = F.greatest(g, d, v)
    kind = F.when(top < 0.3, "NONE").otherwise(argmax_label([("GAN", g), ("DIFFUSION", d), ("VAE", v)]))
    return df.withColumns(
        {
            "anomaly_score": top,
            "anomaly_type": kind,
            "confidence": F.least(top * 1.5, F.lit(1.0)),
            "is_hotspot": top > 0.5,
        }
    )


def heatmap(df: DataFrame, item: str) -> DataFrame:
    """Overall score, hotspot count and dominant type of each item's grid."""
    cells = heatmap_cells(df)

    def n(kind: str) -> Column:
        return F.sum((F.col("anomaly_type") == kind).cast("bigint"))

    g = cells.groupBy(item).agg(
        F.avg("anomaly_score").alias("overall"),
        F.sum(F.col("is_hotspot").cast("bigint")).alias("hotspots"),
        n("GAN").alias("_g"), n("DIFFUSION").alias("_d"), n("VAE").alias("_v"), n("NONE").alias("_n"),
    )
    best = argmax_label(
        [("GAN", F.col("_g")), ("DIFFUSION", F.col("_d")), ("VAE", F.col("_v")), ("NONE", F.col("_n"))]
    )
    top = F.greatest("_g", "_d", "_v", "_n")
    return g.select(
        item, "overall", "hotspots",
        F.when(top == F.col("_n"), "NONE").otherwise(best).alias("dominant_type"),
    )


def heatmap_grid(df: DataFrame, item: str, size: int = 8) -> DataFrame:
    """Dense form: one row per grid line, one column per cell."""
    cells = heatmap_cells(df)
    return cells.groupBy(item, "y").agg(
        *[F.max(F.when(F.col("x") == x, F.col("anomaly_score"))).alias(f"x{x}") for x in range(size)]
    )


# --- distribution shape and spectra -------------------------------------------


def shape_stats(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Kurtosis, skewness and normalised entropy of the values of each key."""
    a = F.abs(F.col(v))
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_pop(a).alias("_s"),
        F.kurtosis(a).alias("_k"),
        F.skewness(a).alias("_w"),
        (F.sum(a) + 1e-10).alias("_t"),
        F.sum(a).alias("_sum"),
        F.sum(F.when(a > 0, a * F.ln(a))).alias("_vlnv"),
        F.sum(F.when(a > 0, 1).otherwise(0)).alias("_pos"),
    )
    flat = (F.col("n") < 4) | (F.col("_s") < 1e-6)
    still = F.col("_s") < 1e-10
    ent = -(F.coalesce("_vlnv", F.lit(0.0)) - F.ln("_t") * F.col("_sum")) / F.col("_t")
    top = F.when(F.col("_pos") > 0, F.ln("_pos")).otherwise(1.0)
    return g.select(
        *keys,
        "n",
        F.when(flat, 3.0).otherwise(F.col("_k") + 3).alias("kurtosis"),
        F.when(still, 3.0).otherwise(F.col("_k")).alias("excess_kurtosis"),
        F.when(still, 0.0).otherwise(F.col("_w")).alias("skewness"),
        F.when(still, 0.0).otherwise(ent / F.greatest(top, F.lit(1e-10))).alias("entropy"),
    )


def spectral_flatness(profile: str | Column) -> Column:
    """Geometric over arithmetic mean of the positive profile values."""

    def of(p: Column) -> Column:
        geo = F.exp(array_mean(F.transform(p, lambda x: F.ln(x + 1e-10))))
        mean = array_mean(p)
        ok = (F.array_size(p) > 0) & (mean >= 1e-10)
        return F.when(ok, F.least(geo / mean, F.lit(1.0))).otherwise(0.0)

    return let(F.filter(col(profile), lambda x: x > 0), of)


def band_ratios(profile: str | Column) -> Column:
    """STRUCT(low, mid, high) energy shares of a radial profile."""
    p = col(profile)
    n = F.array_size(p)
    a, b = F.floor(n * LOW_END).cast("int"), F.floor(n * MID_END).cast("int")

    def energy(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x)

    def shares(total: Column) -> Column:
        ok = (n > 0) & (total >= 1e-10)
        low = energy(F.slice(p, F.lit(1), a))
        mid = energy(F.slice(p, a + 1, b - a))
        high = energy(F.slice(p, b + 1, n - b))
        return F.struct(
            F.when(ok, low / total).otherwise(0.33).alias("low"),
            F.when(ok, mid / total).otherwise(0.33).alias("mid"),
            F.when(ok, high / total).otherwise(0.34).alias("high"),
        )

    return let(energy(p), shares)


def radial_profile(df: DataFrame, item: str, y: str, x: str, v: str, h: int, w: int) -> DataFrame:
    """Mean value per whole radius around the grid centre."""
    dy, dx = F.col(y) - h // 2, F.col(x) - w // 2
    r = F.floor(F.sqrt((dy * dy + dx * dx).cast("double")))
    return (
        df.withColumn("radius", r)
        .filter(F.col("radius") < min(h // 2, w // 2))
        .groupBy(item, "radius")
        .agg(F.avg(v).alias("power"))
    )


def spectral_frame(df: DataFrame) -> DataFrame:
    """Score one frame from flatness, high share, kurtosis and profile spread."""
    fl, hi, ku = F.col("flatness"), F.col("high_ratio"), F.col("kurtosis")
    one = F.lit(1.0)
    parts = [
        F.when(fl > 0.35, F.least((fl - 0.35) / 0.3, one)),
        F.when(hi > 0.25, F.least((hi - 0.25) / 0.3, one)),
        F.when(ku < 1.5, F.least((1.5 - ku) / 3.0, one)).when(
            ku > 20.0, F.least((ku - 20.0) / 30.0, one)
        ),
    ]
    notes = flags(
        (fl > 0.35, fmt("High spectral flatness (%.3f) - uniform spectrum suggests generation", fl)),
        (hi > 0.25, fmt("Elevated high-frequency energy (%.3f) - possible upsampling artifacts", hi)),
        (ku < 1.5, fmt("Low DCT kurtosis (%.2f) - unnaturally uniform coefficient distribution", ku)),
        (ku > 20.0, fmt("High DCT kurtosis (%.2f) - spectral spikes detected", ku)),
    )
    d = df.withColumns({"_mean": mean_of_present(*parts), "anomalies": notes})
    quiet = F.greatest(fl * 0.3 + hi * 0.3, F.lit(0.0))
    score = F.when(F.col("_mean").isNotNull(), F.least(F.col("_mean") * 0.8 + 0.2, one)).otherwise(quiet)
    conf = F.least(0.5 + F.array_size("anomalies") * 0.15 + F.col("azimuthal_std") * 0.1, one)
    return d.withColumns({"score": clip(score), "confidence": conf}).drop("_mean")


def spectral_item(df: DataFrame, item: str, idx: str, max_frames: int = 10) -> DataFrame:
    """Combine up to ten evenly spaced frame results into one item result."""
    s = sample_even(df, item, idx, max_frames)
    g = s.groupBy(item).agg(
        F.count(F.lit(1)).alias("frames_analyzed"),
        F.avg("score").alias("score"),
        F.avg("confidence").alias("_c"),
        F.stddev_pop("score").alias("score_std"),
        F.avg("flatness").alias("flatness"),
        F.avg("high_ratio").alias("high_ratio"),
        F.avg("kurtosis").alias("kurtosis"),
    )
    conf = F.when(F.col("score_std") < 0.05, F.least(F.col("_c") + 0.1, F.lit(1.0))).otherwise(F.col("_c"))
    rows = s.select(item, idx, F.posexplode("anomalies").alias("_p", "_a"))
    place = F.struct(F.col(idx), F.col("_p"))
    first = rows.groupBy(item, F.split("_a", " - ")[0].alias("_k")).agg(
        F.min(place).alias("_at"), F.min_by("_a", place).alias("_a")
    )
    # At most ten frames of three notes each per item.
    notes = first.groupBy(item).agg(
        F.sort_array(F.collect_list(F.struct("_at", "_a"))).getField("_a").alias("anomalies")
    )
    return (
        g.join(notes, item, "left")
        .withColumns(
            {
                "confidence": conf,
                "anomalies": F.coalesce("anomalies", F.array().cast("array<string>")),
            }
        )
        .drop("_c")
    )


# --- embeddings and patches ----------------------------------------------------


def embedding_stats(df: DataFrame, vec: str) -> DataFrame:
    """Norm, entropy, score and flags of one feature vector per row."""
    v = col(vec)
    size = F.transform(v, lambda x: F.abs(x))
    d = df.withColumns(
        {
            "feature_norm": F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)),
            "_t": array_sum(size) + 1e-10,
            "_std": array_std(v),
        }
    )
    ent = -let(
        F.col("_t"),
        lambda t: F.aggregate(
            F.filter(size, lambda x: x > 0), F.lit(0.0), lambda a, x: a + (x / t) * F.ln(x / t + 1e-10)
        ),
    )
    d = d.withColumns({"feature_entropy": ent, "score": clip(0.5 + (F.col("_std") - 0.3) * 0.5)})
    notes = flags(
        (F.col("feature_entropy") < 2.0, "Low feature entropy - possible synthetic uniformity"),
        (F.col("feature_norm") > 50.0, "Abnormal feature magnitude - potential manipulation"),
    )
    d = d.withColumn("anomalies", notes)
    conf = F.least(0.5 + F.array_size("anomalies") * 0.15 + F.abs(F.col("score") - 0.5) * 0.5, F.lit(1.0))
    return d.withColumn("confidence", conf).drop("_t", "_std")


def embedding_item(df: DataFrame, item: str, idx: str, score: str = "score", k: int = 8) -> DataFrame:
    g = sample_even(df, item, idx, k).groupBy(item).agg(
        F.count(F.lit(1)).alias("frames_analyzed"),
        F.avg(score).alias("_m"),
        F.stddev_pop(score).alias("score_std"),
    )
    conf = F.least(
        0.6 + F.abs(F.col("_m") - 0.5) * 0.4 + (1.0 - F.col("score_std")) * 0.1, F.lit(1.0)
    )
    notes = flags((F.col("score_std") < 0.02, "Temporally uniform CLIP scores - synthetic consistency"))
    return g.select(
        item, "frames_analyzed", "score_std",
        clip(F.col("_m")).alias("score"), conf.alias("confidence"), notes.alias("anomalies"),
    )


def split_patches(vec: str | Column, width: int) -> Column:
    """Cut one vector into equal patches: ARRAY<ARRAY<DOUBLE>>."""

    def cut(v: Column) -> Column:
        count = F.floor(F.array_size(v) / width).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda p: F.slice(v, p * width + 1, F.lit(width)))

    return let(col(vec), cut)


def self_attention(patches: str | Column) -> Column:
    """Row-softmax attention between the patches of one item.

    The patch count is fixed by the vector layout, so the matrix is a bounded
    array inside the row and no pairing between rows takes place.
    """
    p = col(patches)

    def unit(x: Column) -> Column:
        return let(
            F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e)) + 1e-8,
            lambda n: F.transform(x, lambda e: e / n),
        )

    def rows(u: Column) -> Column:
        scale = F.sqrt(F.array_size(F.get(u, F.lit(0))).cast("double"))

        def row(a: Column) -> Column:
            sims = F.transform(
                u, lambda b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e) / scale
            )
            exps = let(sims, lambda s: let(F.array_max(s), lambda m: F.transform(s, lambda e: F.exp(e - m))))
            return let(exps, lambda e: let(array_sum(e) + 1e-10, lambda t: F.transform(e, lambda x: x / t)))

        return F.transform(u, row)

    return let(F.transform(p, unit), rows)


def patch_stats(df: DataFrame, patches: str) -> DataFrame:
    """Attention entropy and uniformity, patch variance, boundary score."""
    p = col(patches)
    side = F.floor(F.sqrt(F.array_size(p).cast("double"))).cast("int")

    def gaps(q: Column) -> Column:
        def inner(sd: Column) -> Column:
            at = F.sequence(F.lit(0), F.array_size(q) - 2)
            return F.filter(at, lambda i: (i < sd * sd) & (i % sd != sd - 1))

        def gap(i: Column) -> Column:
            return array_mean(F.zip_with(F.get(q, i), F.get(q, i + 1), lambda a, b: F.abs(a - b)))

        return F.transform(let(side, inner), gap)

    flat = F.flatten("_att")
    ent = -F.aggregate(
        F.filter(flat, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x * F.ln(x + 1e-10)
    )
    uni = let(
        F.array_size("_att"),
        lambda n: 1.0 - array_mean(F.transform(flat, lambda x: F.abs(x - F.lit(1.0) / n))) * n,
    )
    d = df.withColumn("_att", self_attention(patches)).withColumn("_gaps", let(p, gaps))
    mean, std = array_mean(F.col("_gaps")), array_std(F.col("_gaps"))
    bound = F.when((side < 2) | (mean < 1e-8), 0.0).otherwise(clip(std / (mean + 1e-8) - 0.5))
    d = d.withColumns(
        {
            "attention_entropy": ent,
            "attention_uniformity": uni,
            "patch_variance": array_var(F.transform(p, array_mean)),
            "boundary_score": bound,
        }
    )
    u, pv, b = F.col("attention_uniformity"), F.col("patch_variance"), F.col("boundary_score")
    notes = flags(
        (u > 0.85, "Overly uniform attention pattern - synthetic indicator"),
        (pv < 0.01, "Low inter-patch variance - possible generated content"),
        (b > 0.3, "Patch boundary discontinuities detected"),
    )
    parts = mean_of_present(F.when(u > 0.85, 0.7), F.when(pv < 0.01, 0.6), F.when(b > 0.3, b))
    quiet = clip(0.3 * (1 - F.col("attention_entropy") / 5.0) + 0.2 * b)
    d = d.withColumns({"anomalies": notes, "score": clip(F.coalesce(parts, quiet))})
    conf = F.least(0.5 + F.array_size("anomalies") * 0.15 + F.abs(F.col("score") - 0.5) * 0.3, F.lit(1.0))
    return d.withColumn("confidence", conf).drop("_att", "_gaps")


def patch_item(df: DataFrame, item: str, idx: str, k: int = 6) -> DataFrame:
    """Mean patch score of up to six frames, with the distinct flags."""
    s = sample_even(df, item, idx, k)
    # collect_set sees at most six frames of three fixed texts per item.
    return s.groupBy(item).agg(
        F.count(F.lit(1)).alias("frames_analyzed"),
        clip(F.avg("score")).alias("score"),
        F.avg("confidence").alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("anomalies")))).alias("anomalies"),
    )


# --- grids -----------------------------------------------------------------------


def grid_coherence(grid: str | Column, rows: int, cols: int) -> Column:
    """ARRAY<DOUBLE>: agreement of each cell with its direct neighbours.

    The grid is one row-major array, so neighbours are positions in the row.
    """

    def cells(g: Column) -> Column:
        def at(p: Column) -> Column:
            r, c = F.floor(p / cols), p % cols
            around = [
                F.get(g, p),
                F.when(r > 0, F.get(g, p - cols)),
                F.when(r < rows - 1, F.get(g, p + cols)),
                F.when(c > 0, F.get(g, p - 1)),
                F.when(c < cols - 1, F.get(g, p + 1)),
            ]
            vals = F.filter(F.array(*around), lambda x: x.isNotNull())
            coh = let(vals, lambda v: 1.0 - F.least(array_std(v) / (array_mean(v) + 1e-10), F.lit(1.0)))
            return F.when(F.get(g, p) > 0, coh).otherwise(0.0)

        return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), at)

    return let(col(grid), cells)


def grid_summary(df: DataFrame, item: str, strength: str, quality: str) -> DataFrame:
    return df.groupBy(item).agg(
        F.avg(strength).alias("mean_strength"),
        F.avg(quality).alias("mean_quality"),
        F.avg((F.col(strength) > 0.1).cast("double")).alias("coverage"),
    )


def block_median(df: DataFrame, item: str, r: str, c: str, block: int, v: str) -> DataFrame:
    """Median over blocks of the mean inside each block.

    A grid has a fixed number of blocks, which bounds the median's input.
    """
    b = df.groupBy(
        item, F.floor(F.col(r) / block).alias("_br"), F.floor(F.col(c) / block).alias("_bc")
    ).agg(F.avg(v).alias("_m"))
    return b.groupBy(item).agg(F.percentile("_m", 0.5).alias("block_median"))


ROI_WEIGHTS = (
    # Weight of each region by row (top to bottom) and column.
    (0.8, 0.9, 0.9, 0.8),
    (0.9, 1.0, 1.0, 0.9),
    (1.0, 1.2, 1.2, 1.0),
    (1.0, 1.2, 1.2, 1.0),
    (0.9, 1.0, 1.0, 0.9),
    (0.8, 0.9, 0.9, 0.8),
    (0.5, 0.6, 0.6, 0.5),
    (0.3, 0.4, 0.4, 0.3),
)


def roi_grid(df: DataFrame, width: str, height: str) -> DataFrame:
    """The 8 x 4 region boxes inside the central face box of each frame size."""
    rows, cols = len(ROI_WEIGHTS), len(ROI_WEIGHTS[0])
    w, h = F.col(width), F.col(height)
    top, left = F.floor(h / 6), F.floor(w / 4)
    ch = F.floor((F.floor(h * 5 / 6) - top) / rows)
    cw = F.floor((F.floor(w * 3 / 4) - left) / cols)
    weights = F.array(*[F.array(*[F.lit(x) for x in line]) for line in ROI_WEIGHTS])
    cells = df.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))
    )
    return cells.withColumns(
        {
            "roi_name": F.concat(F.lit("ROI_"), F.col("row"), F.lit("_"), F.col("col")),
            "y1": top + F.col("row") * ch,
            "y2": top + (F.col("row") + 1) * ch,
            "x1": left + F.col("col") * cw,
            "x2": left + (F.col("col") + 1) * cw,
            "weight": F.get(F.get(weights, F.col("row")), F.col("col")),
        }
    )


# --- audio samples ---------------------------------------------------------------


def frame_energies(df: DataFrame, item: str, i: str, v: str, sr: int) -> DataFrame:
    """Energy of 25 ms frames every 10 ms.

    Samples first fold into blocks of the greatest common divisor of frame and
    hop, so the overlap copies blocks and not samples.
    """
    frame, hop = int(sr * 0.025), int(sr * 0.010)
    g = math.gcd(frame, hop)
    length = df.groupBy(item).agg((F.max(i) + 1).alias("n_samples"))
    blocks = df.groupBy(item, F.floor(F.col(i) / g).alias("_b")).agg(
        F.sum(F.col(v) * F.col(v)).alias("_e")
    )
    lo = F.greatest(F.ceil((F.col("_b") * g - frame + g) / hop), F.lit(0))
    hi = F.floor(F.col("_b") * g / hop)
    spread = blocks.withColumn("frame", F.explode(F.sequence(lo, hi)))
    count = F.floor((F.col("n_samples") - frame) / hop) + 1
    return (
        spread.groupBy(item, "frame")
        .agg(F.sum("_e").alias("energy"))
        .join(length, item)
        .withColumn("n_frames", count)
        .filter(F.col("frame") < F.col("n_frames"))
    )


def estimate_snr(df: DataFrame, item: str, i: str, v: str, sr: int) -> DataFrame:
    """Signal-to-noise ratio: loudest 30 % against quietest 10 % of the frames."""
    en = frame_energies(df, item, i, v, sr)
    usable = (F.col("n_samples") >= sr // 2) & (F.col("n_frames") >= 2) & (F.col("energy") > 0)
    ranks = histogram_ranks(en.filter(usable), [item], "energy", log_cell(F.col("energy")), 2)
    k = F.greatest(F.floor(F.col("total") * 0.1), F.lit(1))
    s = F.floor(F.col("total") * 0.7)
    low = F.greatest(F.least(F.col("hi"), k) - F.col("lo"), F.lit(0))
    high = F.greatest(F.col("hi") - F.greatest(F.col("lo"), s), F.lit(0))
    g = ranks.groupBy(item).agg(
        F.max("total").alias("_n"),
        (F.sum(F.col("energy") * low) / F.sum(low)).alias("_noise"),
        (F.sum(F.col("energy") * high) / F.sum(high)).alias("_signal"),
    )
    louder = (F.col("_noise") > 0) & (F.col("_signal") > F.col("_noise"))
    db = F.when(louder, 10 * F.log10(F.col("_signal") / F.col("_noise"))).otherwise(30.0)
    snr = F.when(F.col("_n") >= 2, clip(db, 0.0, 40.0)).otherwise(0.0)
    items = df.select(item).distinct()
    return items.join(g.select(item, snr.alias("_snr")), item, "left").select(
        item, F.coalesce("_snr", F.lit(0.0)).alias("snr_db")
    )


def speech_present(df: DataFrame, item: str, i: str, v: str) -> DataFrame:
    """Speech by level and zero-crossing rate; louder signals by level alone."""
    cut, w = with_halo(df.select(item, i, v), [item], i, 1, 0)
    flip = (F.col(v) < 0) != (F.lag(v).over(w) < 0)
    g = own_rows(cut.withColumn("_z", F.coalesce(flip.cast("int"), F.lit(0)))).groupBy(item).agg(
        F.sqrt(F.avg(F.col(v) * F.col(v))).alias("rms"), F.avg("_z").alias("zcr")
    )
    voiced = (F.col("zcr") > 0.02) & (F.col("zcr") < 0.20)
    speech = (F.col("rms") >= 0.01) & (voiced | (F.col("rms") > 0.02))
    return g.withColumn("is_speech", speech)


# --- landmarks ----------------------------------------------------------------


def _dist(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def eye_aspect_ratio(points: str | Column) -> Column:
    """Eye openness from six landmarks in order: two corners, four lids."""

    def openness(p: Column) -> Column:
        pt = [F.get(p, F.lit(j)) for j in range(6)]
        h = _dist(pt[0], pt[3])
        v = _dist(pt[1], pt[5]) + _dist(pt[2], pt[4])
        return F.when(h < 1e-6, 0.0).otherwise(safe_div(v, 2.0 * h))

    return let(col(points), openness)


def ear_rows(df: DataFrame, keys: list[str], place: str, x: str, y: str) -> DataFrame:
    """Eye aspect ratio from a long landmark table, six points per eye."""
    pts = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(place), F.col(x).alias("x"), F.col(y).alias("y")))).alias("_p")
    )
    return pts.select(*keys, eye_aspect_ratio("_p").alias("ear"))


def gaze_ratio(df: DataFrame) -> DataFrame:
    """Horizontal and vertical gaze from iris points, corners and lids.

    Input columns: left_iris, right_iris ARRAY<STRUCT(x, y)> and the points
    left_outer, left_inner, right_inner, right_outer, upper, lower.
    """

    def centre(name: str) -> Column:
        a = F.col(name)
        return F.struct(
            array_mean(F.transform(a, lambda p: p["x"])).alias("x"),
            array_mean(F.transform(a, lambda p: p["y"])).alias("y"),
        )

    d = df.withColumns({"_l": centre("left_iris"), "_r": centre("right_iris")})
    wl = _dist(F.col("left_inner"), F.col("left_outer"))
    wr = _dist(F.col("right_outer"), F.col("right_inner"))
    ht = _dist(F.col("upper"), F.col("lower"))
    ok = (wl >= 1e-6) & (wr >= 1e-6) & (ht >= 1e-6)
    h = (_dist(F.col("_l"), F.col("left_outer")) / wl + _dist(F.col("_r"), F.col("right_inner")) / wr) / 2.0
    v = _dist(F.col("_l"), F.col("upper")) / ht
    return d.withColumns({"gaze_h": F.when(ok, clip(h)), "gaze_v": F.when(ok, clip(v))}).drop("_l", "_r")


def gaze_result(blinks: DataFrame, gaze: DataFrame, item: str, faces: DataFrame) -> DataFrame:
    """Gaze verdict from blink and movement results; ``faces`` gives frame counts.

    ``faces`` has (item, total_frames, frames_with_face).
    """
    j = faces.join(blinks, item, "left").join(gaze, item, "left")
    rate, sym = F.col("blink_rate"), F.col("blink_symmetry")
    stab, sacc = F.coalesce("gaze_stability", F.lit(1.0)), F.coalesce("saccade_score", F.lit(1.0))
    few, blind = F.col("total_frames") < 15, F.col("frames_with_face") < 15
    long = F.col("duration_sec") > 3
    parts = mean_of_present(
        F.when((rate < 10) & long, F.least((10 - rate) / 10, F.lit(1.0))).when(rate > 50, 0.6),
        F.when(sym < 0.6, (1.0 - sym) * 0.8),
        F.when(stab < 0.4, (1.0 - stab) * 0.6),
        F.when(sacc < 0.5, (1.0 - sacc) * 0.7),
    )
    notes = flags(
        ((rate < 10) & long, fmt("Low blink rate (%.1f/min, normal: 10-25)", rate)),
        (rate > 50, fmt("Abnormally high blink rate (%.1f/min)", rate)),
        (sym < 0.6, fmt("Asymmetric blinking (symmetry: %.2f)", sym)),
        (stab < 0.4, fmt("Unstable gaze pattern (stability: %.2f)", stab)),
        (sacc < 0.5, fmt("Unnatural eye movement velocity (score: %.2f)", sacc)),
    )
    ratio = F.col("frames_with_face") / F.col("total_frames")
    return j.select(
        item,
        F.when(few | blind, 0.5).otherwise(F.coalesce(clip(parts), F.lit(0.1))).alias("score"),
        F.when(few, 0.0).when(blind, 0.2).otherwise(F.least(ratio * 0.7 + 0.3, F.lit(1.0))).alias("confidence"),
        F.when(few | blind, 0.0).otherwise(rate).alias("blink_rate"),
        F.when(few | blind, 1.0).otherwise(sym).alias("blink_symmetry"),
        F.when(few | blind, 1.0).otherwise(stab).alias("gaze_stability"),
        F.when(few | blind, 1.0).otherwise(sacc).alias("saccade_score"),
        F.when(few, F.array(F.lit("Insufficient frames for gaze analysis")))
        .when(blind, F.array(F.lit("Insufficient face detections for gaze analysis")))
        .otherwise(notes)
        .alias("anomalies"),
    )


# --- input checks ---------------------------------------------------------------


def uniform_shape(df: DataFrame, item: str, h: str, w: str) -> DataFrame:
    """Whether all frames share one shape, from extremes alone."""
    same = (F.min(h) == F.max(h)) & (F.min(w) == F.max(w))
    return df.groupBy(item).agg(same.alias("same_shape"))


def content_checks(df: DataFrame, item: str, idx: str) -> DataFrame:
    """Gradient share of the first ten frames, value checks of the first five.

    Columns read: gradient, mean_val, min_val, max_val, high_freq_share.
    """
    ten, five = F.col(idx) < 10, F.col(idx) < 5
    bad = F.isnan("mean_val") | (F.abs("mean_val") == float("inf"))
    g = df.filter(ten).groupBy(item).agg(
        F.sum((F.col("gradient") > 200).cast("bigint")).alias("steep"),
        F.count(F.lit(1)).alias("checked"),
        F.sum((F.col("high_freq_share") > 0.9).cast("bigint")).alias("odd_spectrum"),
        F.min(F.when(five & bad, F.col(idx))).alias("first_bad"),
        F.sum((five & ((F.col("max_val") > 255) | (F.col("min_val") < 0))).cast("bigint")).alias("out_of_range"),
        F.sum((five & ((F.col("mean_val") < 5) | (F.col("mean_val") > 250))).cast("bigint")).alias("flat_frames"),
        F.min(F.when((F.col(idx) < 3) & bad, F.col(idx))).alias("quick_bad"),
    )
    score = clip(1.0 - F.col("steep") / F.greatest(F.col("checked"), F.lit(1)) * 0.5)
    return g.withColumns({"integrity_score": score, "content_ok": F.col("first_bad").isNull()})


CRITICAL = ("FRAME_SEQUENCE_INVALID", "ADVERSARIAL_PATTERN_DETECTED")


def sanity_result(counts: DataFrame, seq: DataFrame, shape: DataFrame, content: DataFrame, item: str) -> DataFrame:
    """Accept or reject each item from the four input checks.

    ``counts`` has (item, n_frames).
    """
    j = counts.join(seq, item, "left").join(shape, item, "left").join(content, item, "left")
    few = F.col("n_frames") < 2
    c = F.coalesce("consistency_score", F.lit(0.0))
    ok_seq, ok_res = c > 0.5, F.col("same_shape")
    ok_adv, ok_con = F.col("integrity_score") > 0.6, F.col("content_ok")
    passed = flags(
        (ok_seq, "FRAME_SEQUENCE_VALID"), (ok_res, "RESOLUTION_CONSISTENT"),
        (ok_adv, "NO_ADVERSARIAL_PATTERNS"), (ok_con, "CONTENT_INTEGRITY_OK"),
    )
    failed = flags(
        (~ok_seq, "FRAME_SEQUENCE_INVALID"), (~ok_res, "RESOLUTION_MISMATCH"),
        (~ok_adv, "ADVERSARIAL_PATTERN_DETECTED"), (~ok_con, "CONTENT_INTEGRITY_FAILED"),
    )
    none = F.array().cast("array<string>")
    d = j.withColumns(
        {
            "checks_passed": F.when(few, none).otherwise(passed),
            "checks_failed": F.when(few, F.array(F.lit("INSUFFICIENT_FRAMES"))).otherwise(failed),
        }
    )
    crit = F.array_intersect("checks_failed", F.array(*[F.lit(x) for x in CRITICAL]))
    valid = ~few & (F.array_size(crit) == 0)
    reason = (
        F.when(few, "Need at least 2 frames for validation")
        .when(F.array_contains(crit, "ADVERSARIAL_PATTERN_DETECTED"), "Potential adversarial attack detected")
        .when(F.array_contains(crit, "FRAME_SEQUENCE_INVALID"), "Frame sequence appears corrupted or manipulated")
    )
    warn = F.concat(
        F.coalesce("warnings", F.array(F.lit("Could not compute frame differences"))),
        flags(
            (~ok_res, "Frame resolutions vary - possible splicing"),
            (F.col("odd_spectrum") > 0, "Unusual frequency distribution detected"),
            (F.col("steep") > F.col("checked") * 0.3, "Multiple frames show adversarial gradient patterns"),
            (F.col("out_of_range") > 0, "Frames have out-of-range pixel values"),
            (F.col("flat_frames") > 0, "Frames appear nearly black/white"),
        ),
    )
    quick = ~few & F.coalesce(ok_res, F.lit(False)) & F.col("quick_bad").isNull()
    return d.select(
        item, "n_frames", valid.alias("is_valid"), "checks_passed", "checks_failed",
        F.when(few, none).otherwise(warn).alias("warnings"),
        F.when(few, 0.0).otherwise(c).alias("consistency_score"),
        F.when(few, 0.0).otherwise(F.col("integrity_score")).alias("integrity_score"),
        reason.alias("rejection_reason"), quick.alias("quick_ok"),
    )
