"""Region signals of any length, as rows (item, channel, t, v) with t = 0, 1, ...

No task holds a signal: it is cut into chunks of ``CHUNK`` samples. Filtering
copies the few samples around a chunk's edges. A spectrum is the sum of the
chunks' shares: for a chunk that starts at s,

    X(k) = sum over chunks of exp(-2 pi i k s / n) * sum over j of v(s + j) exp(-2 pi i k j / n)

where the inner sum, at frequencies between those of the chunk itself, is a
chirp transform of three short FFTs. The shares are added by a plain aggregate.
Correlations come from the sums of all channels at a moment, so pairs of
channels are never built. Results equal those of ``signals`` on whole arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import own_rows, with_halo
from .signals import HR_BAND, MIN_SAMPLES, filter_width

CHUNK = 1 << 16

SHARE = "k0 bigint, re array<double>, im array<double>"


def chirp_share(values: np.ndarray, start: int, n: int, low: int, high: int) -> np.ndarray:
    """``sum_j values[j] exp(-2 pi i k (start + j) / n)`` for k = low .. high - 1.

    With 2jk = j*j + k*k - (k - j)*(k - j) the sums are a convolution. Exponents
    are reduced as whole numbers modulo 2n, so long signals lose no precision.
    """
    m, count = len(values), high - low
    if not count:
        return np.empty(0, complex)

    def half_turns(square: np.ndarray) -> np.ndarray:  # exp(-pi i x / n)
        return np.exp(-1j * np.pi * (square % (2 * n)) / n)

    j, k = np.arange(m, dtype=np.int64), np.arange(count, dtype=np.int64)
    size = 1 << int(m + count - 1).bit_length()
    a = np.zeros(size, complex)
    a[:m] = values * half_turns(j * j) * half_turns(2 * (low * j % n))
    b = np.zeros(size, complex)
    b[:count] = half_turns(k * k).conj()
    b[size - m + 1 :] = half_turns(j[1:] * j[1:])[::-1].conj()
    inner = np.fft.ifft(np.fft.fft(a) * np.fft.fft(b))[:count] * half_turns(k * k)
    return inner * half_turns(2 * ((low + k) * (start % n) % n))


def _shares(values: pd.Series, start: pd.Series, n: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
    got = [chirp_share(np.asarray(v, float), s, m, a, b) for v, s, m, a, b in zip(values, start, n, low, high)]
    return pd.DataFrame({"k0": low, "re": [g.real for g in got], "im": [g.imag for g in got]})


def spectrum_rows(df: DataFrame, keys: list[str], t: str, v: str, n: str, low: Column, high: Column, chunk: int = CHUNK) -> DataFrame:
    """Magnitudes (keys, n, k, mag) of the frequencies ``low`` .. ``high`` - 1 of each signal of length ``n``."""
    cut = df.select(*keys, n, F.col(t).cast("bigint").alias("_t"), F.col(v).alias("_v"), F.floor(F.col(t) / chunk).alias("_c"))
    # A group is one chunk: at most ``chunk`` samples.
    packs = cut.groupBy(*keys, n, "_c").agg(F.sort_array(F.collect_list(F.struct("_t", "_v"))).getField("_v").alias("_a"))
    share = F.pandas_udf(_shares, SHARE)("_a", F.col("_c") * chunk, F.col(n), low.cast("bigint"), high.cast("bigint"))
    rows = packs.select(*keys, n, share.alias("_s"))
    rows = rows.select(*keys, n, "_s.k0", F.posexplode(F.arrays_zip(F.col("_s.re").alias("re"), F.col("_s.im").alias("im"))).alias("_p", "_x"))
    total = rows.groupBy(*keys, n, (F.col("k0") + F.col("_p")).alias("k")).agg(F.sum("_x.re").alias("_re"), F.sum("_x.im").alias("_im"))
    return total.select(*keys, n, "k", F.hypot("_re", "_im").alias("mag"))


def signal_stats(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Length, mean and spread (_n, _m, _s) of each signal."""
    return df.groupBy(*keys).agg(F.count(v).alias("_n"), F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))


def filtered_rows(df: DataFrame, keys: list[str], t: str, v: str, fps: float, chunk: int = CHUNK) -> DataFrame:
    """Rows (keys, t, _n, _f) of the valid signals, standardised and smoothed by the centred moving average."""
    stats = signal_stats(df, keys, v).filter((F.col("_n") >= MIN_SAMPLES) & (F.col("_s") >= 1e-6))
    z = df.join(stats, keys).select(*keys, t, "_n", ((F.col(v) - F.col("_m")) / F.col("_s")).alias("_z"))
    width = filter_width(fps)
    d = (width - 1) // 2
    cut, w = with_halo(z, keys, t, width - 1 - d, d, chunk)
    return own_rows(cut.withColumn("_f", F.sum("_z").over(w.rowsBetween(-(width - 1 - d), d)) / width)).drop("_z")


def _band(n: str, fps: float, lo: float, hi: float, closed: bool) -> tuple[Column, Column]:
    """First bin of a band and the bin after its last; an open band leaves out its ends and the highest frequency."""
    per = F.col(n) / F.lit(float(fps))
    if closed:
        return F.ceil(lo * per - 1e-9), F.least(F.floor(hi * per + 1e-9), F.floor(F.col(n) / 2)) + 1
    return F.floor(lo * per + 1e-9) + 1, F.least(F.ceil(hi * per - 1e-9), F.ceil(F.col(n) / 2))


def band_peak_rows(df: DataFrame, item: str, channel: str, t: str, v: str, fps: float = 30.0, chunk: int = CHUNK) -> DataFrame:
    """Dominant pulse frequency of each channel; NULL where it is too weak."""
    keys = [item, channel]
    f = filtered_rows(df, keys, t, v, fps, chunk)
    low, high = _band("_n", fps, *HR_BAND, closed=False)
    bins = spectrum_rows(f, keys, t, "_f", "_n", low, F.greatest(low, high), chunk)
    g = bins.groupBy(*keys, "_n").agg(F.max(F.struct("mag", (-F.col("k")).alias("k"))).alias("_b"), F.avg("mag").alias("_a"))
    strength = F.col("_b.mag") / (F.col("_a") + 1e-6)
    bpm = -F.col("_b.k") * F.lit(float(fps)) / F.col("_n") * 60
    found = g.withColumn("strength", strength).select(*keys, "strength", F.when(F.col("strength") > 1.5, bpm).alias("bpm"))
    return df.select(*keys).distinct().join(found, keys, "left")


def heart_rates_rows(df: DataFrame, item: str, channel: str, t: str, v: str, fps: float = 30.0, chunk: int = CHUNK) -> DataFrame:
    """Heart-rate consistency and pulse coverage per item."""
    g = band_peak_rows(df, item, channel, t, v, fps, chunk).groupBy(item).agg(
        F.count(F.lit(1)).alias("channels"), F.count("bpm").alias("pulses"), F.avg("bpm").alias("mean_bpm"), F.stddev_pop("bpm").alias("std_bpm")
    )
    even = 1.0 - F.least(F.col("std_bpm") / (F.col("mean_bpm") + 1e-6), F.lit(1.0))
    return g.withColumns({"hr_consistency": F.when(F.col("pulses") == 0, 0.0).otherwise(even), "pulse_coverage": F.col("pulses") / F.col("channels")})


def band_strength_rows(df: DataFrame, keys: list[str], t: str, v: str, fps: float = 30.0, chunk: int = CHUNK) -> DataFrame:
    """Peak strength, quality and rate of the pulse band of each signal; zeros for a short one."""
    stats = signal_stats(df, keys, v)
    live = df.join(stats.filter(F.col("_n") >= MIN_SAMPLES), keys).select(*keys, t, "_n", (F.col(v) - F.col("_m")).alias("_d"))
    half = F.floor(F.col("_n") / 2) + 1
    bins = spectrum_rows(live, keys, t, "_d", "_n", F.lit(0), half, chunk)
    low, high = _band("_n", fps, *HR_BAND, closed=True)
    inside = (F.col("k") >= low) & (F.col("k") < high)
    g = bins.groupBy(*keys, "_n").agg(
        F.max(F.when(inside, F.struct("mag", (-F.col("k")).alias("k")))).alias("_b"), F.max("mag").alias("_top"), F.sum(F.col("mag") * F.col("mag")).alias("_e")
    )
    peak = F.col("_b.mag")
    found = g.select(
        *keys, (peak / (F.col("_top") + 1e-10)).alias("strength"), F.when(peak.isNotNull(), F.least(peak * peak / (F.col("_e") + 1e-10) * 5, F.lit(1.0))).alias("quality"),
        (-F.col("_b.k") * F.lit(float(fps)) / F.col("_n") * 60).alias("bpm"),
    )
    return stats.select(*keys).join(found, keys, "left").select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("strength", "quality", "bpm")])


def _unit_rows(df: DataFrame, item: str, channel: str, t: str, v: str, fps: float, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Standardised filtered rows (item, channel, t, _u) up to the shortest valid signal of an item, and (item, valid, _t)."""
    f = filtered_rows(df, [item, channel], t, v, fps, chunk)
    length = f.filter(F.col(t) == 0).groupBy(item).agg(F.min("_n").alias("_t"), F.count(F.lit(1)).alias("valid"))
    cut = f.join(length, item).filter(F.col(t) < F.col("_t")).select(item, channel, t, "_f")
    s = cut.groupBy(item, channel).agg(F.avg("_f").alias("_m"), F.stddev_pop("_f").alias("_s")).filter(F.col("_s") > 0.01)
    return cut.join(s, [item, channel]).select(item, channel, t, ((F.col("_f") - F.col("_m")) / F.col("_s")).alias("_u")), length


def pairwise_sync_rows(df: DataFrame, item: str, channel: str, t: str, v: str, fps: float = 30.0, chunk: int = CHUNK) -> DataFrame:
    """Mean correlation over all channel pairs of an item, and channel counts."""
    u, length = _unit_rows(df, item, channel, t, v, fps, chunk)
    at_t = u.groupBy(item, t).agg(F.sum("_u").alias("_s"), F.count(F.lit(1)).alias("_c"))
    total = at_t.groupBy(item).agg((F.sum(F.col("_s") * F.col("_s")) / F.count(F.lit(1))).alias("_q"), F.max("_c").alias("_live"))
    n = F.col("valid")
    sync = F.when(n < 2, 0.0).otherwise((F.coalesce("_q", F.lit(0.0)) - F.coalesce("_live", F.lit(0))) / (n * (n - 1)))
    items = df.select(item, channel).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("channels"))
    j = items.join(length, item, "left").join(total, item, "left")
    return j.select(item, "channels", F.coalesce("valid", F.lit(0)).alias("valid"), F.coalesce(sync, F.lit(0.0)).alias("sync"))


def channel_sync_rows(df: DataFrame, item: str, channel: str, t: str, v: str, fps: float = 30.0, chunk: int = CHUNK) -> DataFrame:
    """Mean correlation of each valid channel with the other channels of its item."""
    u, length = _unit_rows(df, item, channel, t, v, fps, chunk)
    at_t = u.groupBy(item, t).agg(F.sum("_u").alias("_s"))
    dot = u.join(at_t, [item, t]).groupBy(item, channel).agg((F.sum(F.col("_u") * F.col("_s")) / F.count(F.lit(1))).alias("_d"))
    valid = signal_stats(df, [item, channel], v).filter((F.col("_n") >= MIN_SAMPLES) & (F.col("_s") >= 1e-6)).select(item, channel)
    mean = F.when(F.col("valid") < 2, 0.0).otherwise((F.col("_d") - 1) / (F.col("valid") - 1))
    return valid.join(length, item).join(dot, [item, channel], "left").select(item, channel, F.coalesce(mean, F.lit(0.0)).alias("mean_corr"))
