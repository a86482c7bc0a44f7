"""Region signals and spectra. A signal is one row holding its samples.

Row-local array work needs no shuffle; only per-item results aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import status_band
from ..functions.exprs import array_mean, array_std, array_sum, array_var, clip, col, flags, let

MIN_SAMPLES = 30
HR_BAND = (0.7, 4.0)
SPEECH_BAND = (2.0, 8.0)
HR_NORMAL = (50, 120)


def znorm_array(sig: str | Column) -> Column:
    """Zero mean and unit variance, NULL for a flat or short signal."""

    def norm(s: Column) -> Column:
        return let(
            F.struct(array_mean(s).alias("m"), array_std(s).alias("d")),
            lambda st: F.when(
                (F.array_size(s) >= MIN_SAMPLES) & (st["d"] >= 1e-6),
                F.transform(s, lambda x: (x - st["m"]) / st["d"]),
            ),
        )

    return let(col(sig), norm)


def unit_array(sig: str | Column, floor: float = 0.01) -> Column:
    """Standardised samples, NULL where the spread is at most ``floor``."""

    def norm(s: Column) -> Column:
        return let(
            F.struct(array_mean(s).alias("m"), array_std(s).alias("d")),
            lambda st: F.when(st["d"] > floor, F.transform(s, lambda x: (x - st["m"]) / st["d"])),
        )

    return let(col(sig), norm)


def smooth_array(sig: str | Column, width: int) -> Column:
    """Centred moving average of the samples, zero padded at both ends."""
    d = (width - 1) // 2
    back = width - 1 - d

    def smooth(s: Column) -> Column:
        def at(i: Column) -> Column:
            lo = F.greatest(i - back, F.lit(0))
            hi = F.least(i + d, F.array_size(s) - 1)
            return array_sum(F.slice(s, lo + 1, hi - lo + 1)) / width

        return F.transform(F.sequence(F.lit(0), F.array_size(s) - 1), at)

    return let(col(sig), lambda s: F.when(F.array_size(s) > 0, smooth(s)))


def centred(sig: str | Column) -> Column:
    """Samples minus their mean."""
    return let(col(sig), lambda s: let(array_mean(s), lambda m: F.transform(s, lambda x: x - m)))


def filter_width(fps: float) -> int:
    return max(3, int(fps / 4))


def _rfft_magnitude(signals: pd.Series) -> pd.Series:
    return signals.map(lambda a: np.abs(np.fft.rfft(np.asarray(a, dtype=np.float64))))


def spectrum(sig: str | Column) -> Column:
    """ARRAY<DOUBLE> of the magnitudes of frequencies 0 .. n/2."""
    return F.pandas_udf(_rfft_magnitude, "array<double>")(col(sig))


def with_spectrum(df: DataFrame, sig: Column, out: str = "mag") -> DataFrame:
    """Add the spectrum; rows whose signal is NULL get NULL."""
    ready = df.withColumn("_sig", F.coalesce(sig, F.array(F.lit(0.0))))
    return (
        ready.withColumn("_m", spectrum("_sig"))
        .withColumn("_has", sig.isNotNull())
        .withColumn(out, F.when(F.col("_has"), F.col("_m")))
        .drop("_sig", "_m", "_has")
    )


def _bins(mag: Column, n: Column, fps: float, lo: float, hi: float, closed: bool) -> Column:
    """ARRAY<STRUCT(m, k)> of the bins inside a band; open bands skip Nyquist."""

    def inside(x: Column) -> Column:
        f = x["k"] * F.lit(float(fps)) / x["n"]
        if closed:
            return (f >= lo) & (f <= hi)
        return (f > lo) & (f < hi) & (x["k"] * 2 < x["n"])

    pairs = let(
        n, lambda t: F.transform(mag, lambda m, k: F.struct(m.alias("m"), k.alias("k"), t.alias("n")))
    )
    return F.filter(pairs, inside)


def _peak(bins: Column) -> Column:
    """STRUCT(m, k) of the strongest bin, the lowest one on a tie."""
    best = F.array_max(F.transform(bins, lambda x: F.struct(x["m"].alias("m"), (-x["k"]).alias("k"))))
    return let(best, lambda b: F.struct(b["m"].alias("m"), (-b["k"]).alias("k")))


def pairwise_sync(df: DataFrame, item: str, sig: str, fps: float = 30.0) -> DataFrame:
    """Mean correlation over all channel pairs of an item, and channel counts.

    With z_i the standardised channels, the sum of all pair correlations is
    (sum_t (sum_i z_i)^2 / T - live) / 2, so no pair is ever built. Channels
    with spread at most 0.01 count as zero correlation.
    """
    z = df.select(item, znorm_array(sig).alias("_z"))
    live = z.filter("_z IS NOT NULL").select(item, smooth_array("_z", filter_width(fps)).alias("_f"))
    length = live.groupBy(item).agg(F.min(F.array_size("_f")).alias("_t"), F.count(F.lit(1)).alias("valid"))
    cut = live.join(length, item).withColumn("_f", F.slice("_f", F.lit(1), F.col("_t")))
    samples = cut.select(item, F.posexplode(unit_array("_f")).alias("_p", "_v"))
    at_t = samples.groupBy(item, "_p").agg(F.sum("_v").alias("_s"), F.count(F.lit(1)).alias("_c"))
    total = at_t.groupBy(item).agg(
        (F.sum(F.col("_s") * F.col("_s")) / F.count(F.lit(1))).alias("_q"), F.max("_c").alias("_live")
    )
    n = F.col("valid")
    sync = F.when(n < 2, 0.0).otherwise(
        (F.coalesce("_q", F.lit(0.0)) - F.coalesce("_live", F.lit(0))) / (n * (n - 1))
    )
    items = df.groupBy(item).agg(F.count(F.lit(1)).alias("channels"))
    return (
        items.join(length, item, "left")
        .join(total, item, "left")
        .select(item, "channels", F.coalesce("valid", F.lit(0)).alias("valid"), F.coalesce(sync, F.lit(0.0)).alias("sync"))
    )


def channel_sync(df: DataFrame, item: str, channel: str, sig: str, fps: float = 30.0) -> DataFrame:
    """Mean correlation of each valid channel with the other channels.

    The row means of the correlation matrix, again without building pairs.
    Channels are expected to have one common length per item.
    """
    z = df.select(item, channel, znorm_array(sig).alias("_z")).filter("_z IS NOT NULL")
    f = z.select(item, channel, smooth_array("_z", filter_width(fps)).alias("_f"))
    rows = f.select(item, channel, unit_array("_f").alias("_u"))
    count = rows.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    sums = (
        rows.select(item, F.posexplode("_u").alias("_p", "_v"))
        .groupBy(item, "_p")
        .agg(F.sum("_v").alias("_s"))
        .groupBy(item)
        .agg(F.sort_array(F.collect_list(F.struct("_p", "_s"))).getField("_s").alias("_tot"))
    )
    dot = array_sum(F.zip_with("_u", "_tot", lambda a, b: a * b)) / F.array_size("_u")
    mean = F.when(F.col("_n") < 2, 0.0).otherwise((dot - 1) / (F.col("_n") - 1))
    joined = rows.join(count, item).join(sums, item, "left")
    return joined.select(item, channel, F.coalesce(mean, F.lit(0.0)).alias("mean_corr"))


def band_peak(df: DataFrame, item: str, channel: str, sig: str, fps: float = 30.0) -> DataFrame:
    """Dominant pulse frequency of each channel; NULL where it is too weak."""
    z = df.select(item, channel, znorm_array(sig).alias("_z"))
    f = z.withColumn("_f", F.when(F.col("_z").isNotNull(), smooth_array("_z", filter_width(fps))))
    m = with_spectrum(f, F.col("_f")).withColumn(
        "_b", _bins(F.col("mag"), F.array_size("_f"), fps, *HR_BAND, closed=False)
    )
    has = F.array_size("_b") > 0
    p = m.withColumn("_pk", F.when(has, _peak(F.col("_b"))))
    mean = array_mean(F.transform("_b", lambda x: x["m"]))
    strength = F.when(has, F.col("_pk.m") / (mean + 1e-6))
    bpm = F.col("_pk.k") * F.lit(float(fps)) / F.array_size("_f") * 60
    return p.withColumn("strength", strength).select(
        item, channel, "strength", F.when(F.col("strength") > 1.5, bpm).alias("bpm")
    )


def heart_rates(df: DataFrame, item: str, channel: str, sig: str, fps: float = 30.0) -> DataFrame:
    """Heart-rate consistency and pulse coverage per item."""
    g = band_peak(df, item, channel, sig, fps).groupBy(item).agg(
        F.count(F.lit(1)).alias("channels"),
        F.count("bpm").alias("pulses"),
        F.avg("bpm").alias("mean_bpm"),
        F.stddev_pop("bpm").alias("std_bpm"),
    )
    cons = 1.0 - F.least(F.col("std_bpm") / (F.col("mean_bpm") + 1e-6), F.lit(1.0))
    none = F.col("pulses") == 0
    return g.withColumns(
        {
            "hr_consistency": F.when(none, 0.0).otherwise(cons),
            "pulse_coverage": F.col("pulses") / F.col("channels"),
        }
    )


def band_strength(df: DataFrame, keys: list[str], sig: str, fps: float = 30.0) -> DataFrame:
    """Peak strength, quality and rate of the pulse band of each signal."""
    d = df.withColumn("_d", F.when(F.array_size(sig) >= MIN_SAMPLES, centred(sig)))
    m = with_spectrum(d, F.col("_d")).withColumn(
        "_b", _bins(F.col("mag"), F.array_size("_d"), fps, *HR_BAND, closed=True)
    )
    has = F.array_size("_b") > 0
    p = m.withColumns(
        {
            "_pk": F.when(has, _peak(F.col("_b"))),
            "_top": F.array_max("mag"),
            "_e": F.aggregate("mag", F.lit(0.0), lambda a, x: a + x * x),
        }
    )
    peak = F.col("_pk.m")
    return p.select(
        *keys,
        F.coalesce(peak / (F.col("_top") + 1e-10), F.lit(0.0)).alias("strength"),
        F.coalesce(F.when(peak.isNotNull(), F.least(peak * peak / (F.col("_e") + 1e-10) * 5, F.lit(1.0))), F.lit(0.0)).alias("quality"),
        F.coalesce(F.col("_pk.k") * F.lit(float(fps)) / F.array_size("_d") * 60, F.lit(0.0)).alias("bpm"),
    )


def _speech_terms(fps: float) -> Column:
    """UDF of a signal: means of its speech band, of all bins and of those below the half, the highest of these."""

    def one(values: np.ndarray) -> tuple[int, float, float, float, float]:
        x = np.asarray(values, dtype=np.float64)
        n = len(x)
        mag = np.abs(np.fft.rfft(x))[: (n + 1) // 2]  # without Nyquist
        f = np.arange(len(mag)) * fps / n
        band, every, half = mag[(f > SPEECH_BAND[0]) & (f < SPEECH_BAND[1])], mag[1:], mag[1 : n // 2]
        means = [float(m.mean()) if len(m) else np.nan for m in (band, every, half)]
        return len(band), *means, float(half.max()) if len(half) else np.nan

    def terms(signals: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(a) for a in signals], columns=["bins", "band", "every", "half", "top"])

    return F.pandas_udf(terms, "bins bigint, band double, every double, half double, top double")


def speech_rhythm(df: DataFrame, keys: list[str], sig: str, fps: float = 30.0) -> DataFrame:
    """Speech-band share, variance and peak ratio of a lip movement signal."""
    d = df.withColumn("_d", centred(sig))
    n = F.array_size("_d")
    ready = F.coalesce(F.when(n > 0, F.col("_d")), F.array(F.lit(0.0)))
    p = d.withColumn("_t", _speech_terms(float(fps))(ready)).withColumns(
        {"n_samples": n, "movement_variance": array_var(F.col("_d"))}
    )
    ratio = F.when(F.col("_t.bins") > 0, F.col("_t.band") / (F.col("_t.every") + 1e-6)).otherwise(0.0)
    peak = F.when(F.col("n_samples") > 5, F.col("_t.top") / (F.col("_t.half") + 1e-6)).otherwise(1.0)
    r = p.withColumns({"speech_ratio": ratio, "peak_ratio": peak})
    score = (
        F.when(F.col("speech_ratio") < 0.2, 0.4).otherwise(0.0)
        + F.when(F.col("movement_variance") < 10, 0.3).otherwise(0.0)
        + F.when(F.col("peak_ratio") > 10, 0.3).otherwise(0.0)
    )
    return r.select(
        *keys,
        "n_samples",
        "speech_ratio",
        "movement_variance",
        "peak_ratio",
        F.when(F.col("n_samples") < 10, 0.5).otherwise(F.least(score, F.lit(1.0))).alias("av_score"),
    )


def biosignal_result(
    signals: DataFrame, item: str, channel: str, sig: str, profiles: DataFrame, fps: float = 30.0
) -> DataFrame:
    """Biosignal core verdict per item.

    ``profiles`` has (item, is_low_res, rppg_viable); items without a profile
    count as full resolution.
    """
    n = signals.groupBy(item).agg(F.max(F.array_size(sig)).alias("_n"))
    j = (
        pairwise_sync(signals, item, sig, fps)
        .join(heart_rates(signals, item, channel, sig, fps).drop("channels"), item)
        .join(n, item)
        .join(profiles.select(item, "is_low_res", "rppg_viable"), item, "left")
    )
    sync, cov, hr = F.col("sync"), F.col("pulse_coverage"), F.col("hr_consistency")
    odd = (F.col("mean_bpm") < HR_NORMAL[0]) | (F.col("mean_bpm") > HR_NORMAL[1])
    score = (
        F.when(sync < 0.3, 0.4).when(sync < 0.5, 0.2).otherwise(0.0)
        + F.when(cov < 0.3, 0.3).when(cov < 0.5, 0.15).otherwise(0.0)
        + F.when(hr < 0.5, 0.2).otherwise(0.0)
        + F.when(odd, 0.1).otherwise(0.0)
    )
    low = F.coalesce("is_low_res", F.lit(False))
    short = F.col("_n") < MIN_SAMPLES
    conf = F.when(low, F.least(sync * 0.8, F.lit(0.6))).otherwise(
        F.least(0.4 + sync * 0.4 + cov * 0.2, F.lit(1.0))
    )
    notes = flags(
        (sync < 0.3, "LOW_BIOLOGICAL_SYNC"),
        (cov < 0.3, "WEAK_PULSE_COVERAGE"),
        (hr < 0.5, "INCONSISTENT_HR_ACROSS_ROIS"),
        (odd, "ABNORMAL_HR_RANGE"),
    )
    quality = (
        F.when(short | ~F.coalesce("rppg_viable", F.lit(True)), "INSUFFICIENT")
        .when(low, "LIMITED")
        .otherwise("GOOD")
    )
    s = j.withColumn("score", F.when(short, 0.5).otherwise(F.least(score, F.lit(1.0))))
    return s.select(
        item,
        "channels",
        "valid",
        "sync",
        "pulse_coverage",
        "hr_consistency",
        "mean_bpm",
        "score",
        F.when(short, 0.2).otherwise(conf).alias("confidence"),
        F.when(short, "WARN").otherwise(status_band("score")).alias("status"),
        F.when(short, F.array(F.lit("LOW_FRAME_COUNT"))).otherwise(notes).alias("anomalies"),
        quality.alias("data_quality"),
    )


# --- spectrogram frames: (item, t, db ARRAY<DOUBLE>) ------------------------


def harmonic_regularity(df: DataFrame, item: str, t: str, db: str) -> DataFrame:
    """Evenness of the peak spacing in the mean spectrum of an item."""
    frames = df.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    mean = (
        df.select(item, F.posexplode(db).alias("_b", "_v"))
        .groupBy(item, "_b")
        .agg(F.avg("_v").alias("_m"))
    )
    # One array of N bins per item: bounded by the spectrogram's height.
    avg = mean.groupBy(item).agg(F.sort_array(F.collect_list(F.struct("_b", "_m"))).getField("_m").alias("_a"))

    def peaks(a: Column) -> Column:
        at = F.filter(
            F.sequence(F.lit(1), F.array_size(a) - 2),
            lambda i: (F.get(a, i) > F.get(a, i - 1)) & (F.get(a, i) > F.get(a, i + 1)),
        )
        return F.when(F.array_size(a) > 2, at).otherwise(F.array().cast("array<int>"))

    def gaps(p: Column) -> Column:
        later = F.slice(p, F.lit(2), F.greatest(F.array_size(p) - 1, F.lit(0)))
        return F.transform(later, lambda x, i: (x - F.get(p, i)).cast("double"))

    p = avg.withColumn("_p", let(F.col("_a"), peaks))
    g = p.withColumn("_g", let(F.col("_p"), gaps)).join(frames, item)
    reg = clip(1.0 - array_std(F.col("_g")) / (array_mean(F.col("_g")) + 1e-8))
    out = F.when((F.col("_n") < 2) | (F.array_size("_p") < 3), 0.5).otherwise(reg)
    return g.select(item, F.array_size("_p").alias("peaks"), out.alias("harmonic"))


def _step_terms(df: DataFrame, item: str, t: str, db: str, chunk: int) -> DataFrame:
    from .ordered import own_rows, with_halo

    tops = F.slice(
        F.sort_array(F.transform(db, lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        F.lit(-3),
        F.lit(3),
    ).getField("i")
    rows = df.select(item, t, F.col(db).alias("_db"), F.sort_array(tops).alias("_top"))
    cut, w = with_halo(rows, [item], t, 1, 0, chunk)
    both = cut.withColumns({"_pdb": F.lag("_db").over(w), "_ptop": F.lag("_top").over(w)})
    return own_rows(both)


def spectral_steps(df: DataFrame, item: str, t: str, db: str, n_bins: int, chunk: int = 4096) -> DataFrame:
    """Spectral continuity and formant stability from one pass over frames."""
    s = _step_terms(df, item, t, db, chunk)
    diff = F.zip_with("_db", "_pdb", lambda a, b: F.abs(a - b))
    track = F.zip_with("_top", "_ptop", lambda a, b: F.abs(a - b).cast("double"))
    r = s.select(item, diff.alias("_d"), track.alias("_k"))
    g = r.groupBy(item).agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum(array_sum(F.col("_d"))).alias("_sum"),
        F.sum(F.array_size("_d")).alias("_cnt"),
        F.max(F.array_max("_d")).alias("_max"),
        *[F.avg(F.get("_k", F.lit(j))).alias(f"_f{j}") for j in range(3)],
    )
    mean = F.col("_sum") / F.col("_cnt")
    cont = (
        F.when(F.col("frames") < 3, 0.5)
        .when(mean < 1e-8, 0.5)
        .otherwise(clip(1.0 - F.col("_max") / (mean + 1e-8) / 20.0))
    )
    tracks = [F.greatest(1.0 - F.col(f"_f{j}") / (n_bins / 2), F.lit(0.0)) for j in range(3)]
    form = F.when(F.col("frames") < 5, 0.5).otherwise((tracks[0] + tracks[1] + tracks[2]) / 3)
    return g.select(item, "frames", cont.alias("continuity"), form.alias("formants"))


def spectrogram_result(df: DataFrame, item: str, t: str, db: str, n_bins: int) -> DataFrame:
    j = harmonic_regularity(df, item, t, db).join(spectral_steps(df, item, t, db, n_bins), item)
    h, c, f = F.col("harmonic"), F.col("continuity"), F.col("formants")
    notes = flags(
        (h < 0.4, "Irregular harmonic structure"),
        (c < 0.3, "Spectral discontinuities detected"),
        (f < 0.5, "Unstable formant tracks"),
    )
    s = j.withColumns({"score": clip(1.0 - (h * 0.35 + c * 0.35 + f * 0.3)), "anomalies": notes})
    conf = F.least(0.4 + F.abs(F.col("score") - 0.5) * 0.6 + F.array_size("anomalies") * 0.1, F.lit(1.0))
    return s.withColumn("confidence", conf)
