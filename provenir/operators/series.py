"""Per-frame score series: smoothness, flicker, trend, periodicity, closures.

Inputs are long tables (key, dense position, value). All row-to-row terms come
from chunked windows; per-key results are plain partial aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import array_mean, array_std, clip, flags, fmt, let, safe_div
from ..session import materialize
from .ordered import CHUNK, dense_index, own_rows, with_halo

WINDOW = 5
# Series up to this length go to one vectorised call; longer ones use the
# distributed transform.
DIRECT_LIMIT = 1 << 15


def series_terms(df: DataFrame, key: str, idx: str, v: str, chunk: int = CHUNK) -> DataFrame:
    """Row terms shared by smoothness, flicker and trend stability."""
    cut, w = with_halo(df.select(key, idx, v), [key], idx, WINDOW, 0, chunk)
    x = F.col(v)
    step = cut.withColumns(
        {
            "_d": x - F.lag(v).over(w),
            "_ma": F.when(F.col(idx) >= WINDOW - 1, F.avg(v).over(w.rowsBetween(-(WINDOW - 1), 0))),
        }
    )
    turn = step.withColumns(
        {
            "_turn": F.signum("_d") != F.signum(F.lag("_d").over(w)),
            "_dma": F.abs(F.col("_ma") - F.lag("_ma").over(w)),
        }
    )
    return own_rows(turn)


def smoothness_expr() -> Column:
    """1 - clip(3 * mean |step|), times 0.7 after a step above 0.3."""
    base = 1.0 - clip(F.avg(F.abs("_d")) * 3.0)
    jumped = F.when(F.max(F.abs("_d")) > 0.3, 0.7).otherwise(1.0)
    return F.when(F.count("_d") == 0, 1.0).otherwise(clip(base * jumped))


def flicker_expr() -> Column:
    """Share of direction changes times the spread of steps times 4."""
    changes = F.sum(F.col("_turn").cast("int"))
    possible = F.count("_d") - 1
    ratio = F.when(possible > 0, changes / possible)
    return F.when(possible <= 0, 0.0).otherwise(clip(ratio * F.stddev_pop("_d") * 4))


def trend_expr() -> Column:
    """Mean step of the 5-point moving average against 0.3."""
    return F.when(F.count("_dma") == 0, 0.5).otherwise(1.0 - clip(F.avg("_dma") / 0.3))


def smoothness(df: DataFrame, key: str, idx: str, v: str) -> DataFrame:
    return series_terms(df, key, idx, v).groupBy(key).agg(smoothness_expr().alias("smoothness"))


def flicker(df: DataFrame, key: str, idx: str, v: str) -> DataFrame:
    return series_terms(df, key, idx, v).groupBy(key).agg(flicker_expr().alias("flicker"))


def trend_stability(df: DataFrame, key: str, idx: str, v: str) -> DataFrame:
    return series_terms(df, key, idx, v).groupBy(key).agg(trend_expr().alias("trend_stability"))


# --- periodicity ----------------------------------------------------------


def _peak_strength(series: pd.Series) -> pd.Series:
    """Largest local autocorrelation peak above 0.3 from lag 2 on."""

    def one(values: np.ndarray) -> float:
        x = np.asarray(values, dtype=np.float64)
        if len(x) < 10:
            return 0.0
        x = x - x.mean()
        if x.std() < 1e-8:
            return 0.0
        size = 1 << int(2 * len(x) - 1).bit_length()
        power = np.abs(np.fft.rfft(x, size)) ** 2
        r = np.fft.irfft(power, size)[: len(x)]
        r = r / (r[0] + 1e-10)
        mid = r[2:-1]
        peaks = mid[(mid > r[1:-2]) & (mid > r[3:]) & (mid > 0.3)]
        return float(peaks.max()) if len(peaks) else 0.0

    return series.map(one).astype("float64")


def _fft_pass(
    df: DataFrame, key: str, group: str, place: str, size: str, twiddle: bool
) -> DataFrame:
    """FFT of length ``size`` over ``place`` for every (key, group) column."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n bigint, m1 bigint, m2 bigint, g bigint, k bigint, re double, im double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, part in pdf.groupby(group, sort=False):
            length = int(part[size].iloc[0])
            z = np.zeros(length, dtype=np.complex128)
            z[part[place].to_numpy()] = part["re"].to_numpy() + 1j * part["im"].to_numpy()
            f = np.fft.fft(z)
            k = np.arange(length)
            if twiddle:
                total = float(part["m1"].iloc[0]) * float(part["m2"].iloc[0])
                f = f * np.exp(-2j * np.pi * ((k * int(g)) % int(total)) / total)
            out.append(
                pd.DataFrame(
                    {
                        key: part[key].iloc[0],
                        "n": part["n"].iloc[0],
                        "m1": part["m1"].iloc[0],
                        "m2": part["m2"].iloc[0],
                        "g": int(g),
                        "k": k,
                        "re": f.real,
                        "im": f.imag,
                    }
                )
            )
        return pd.concat(out, ignore_index=True)

    return df.groupBy(key, group).applyInPandas(run, schema)


def distributed_fft(df: DataFrame, key: str) -> DataFrame:
    """Discrete Fourier transform of series too long for one task.

    Rows are (key, n, m1, m2, i, re, im) with a transform length of m1 * m2,
    about the square root each. Two grouped passes over columns of length m1
    and m2 give every coefficient, so no group exceeds max(m1, m2) rows.
    """
    cols = df.withColumns({"_col": F.col("i") % F.col("m2"), "_row": F.floor(F.col("i") / F.col("m2"))})
    first = _fft_pass(cols, key, "_col", "_row", "m1", True)
    second = first.select(
        key, "n", "m1", "m2", F.col("k").alias("_k1"), F.col("g").alias("_n2"), "re", "im"
    )
    done = _fft_pass(second, key, "_k1", "_n2", "m2", False)
    return done.select(
        key, "n", "m1", "m2", (F.col("g") + F.col("m1") * F.col("k")).alias("i"), "re", "im"
    )


def _autocorrelation_long(centered: DataFrame, key: str) -> DataFrame:
    """(key, n, lag, r) of long series via two distributed transforms."""
    bits = F.ceil(F.log2(F.col("n").cast("double") * 2)).cast("int")
    one = F.lit(1).cast("bigint")
    shaped = centered.withColumns(
        {
            "m1": F.call_function("shiftleft", one, F.floor(bits / 2).cast("int")),
            "m2": F.call_function("shiftleft", one, (bits - F.floor(bits / 2)).cast("int")),
            "im": F.lit(0.0),
        }
    ).select(key, "n", "m1", "m2", "i", "re", "im")
    power = distributed_fft(shaped, key).select(
        key, "n", "m1", "m2", "i",
        (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"),
        F.lit(0.0).alias("im"),
    )
    back = distributed_fft(power, key)
    return back.filter(F.col("i") < F.col("n")).select(
        key, "n", F.col("i").alias("lag"), (F.col("re") / (F.col("m1") * F.col("m2"))).alias("r")
    )


def periodicity(
    df: DataFrame, key: str, idx: str, v: str, direct_limit: int = DIRECT_LIMIT, chunk: int = CHUNK
) -> DataFrame:
    """Strength of the strongest repeating pattern of each series.

    All lags are used. Keys are split by length: short ones become one bounded
    array each, long ones go through ``distributed_fft``.
    """
    stats = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std")
    )
    rows = df.select(key, idx, v).join(stats, key)
    direct = (
        rows.filter(F.col("n") <= direct_limit)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct(idx, v))).getField(v).alias("_a"))
    )
    strength = F.pandas_udf(_peak_strength, "double")
    short = direct.select(key, strength("_a").alias("periodicity"))

    live = (F.col("n") > direct_limit) & (F.col("n") >= 10) & (F.col("_std") >= 1e-8)
    centered = rows.filter(live).select(
        key, "n", F.col(idx).alias("i"), (F.col(v) - F.col("_mean")).alias("re")
    )
    r = _autocorrelation_long(centered, key)
    cut, w = with_halo(r, [key], "lag", 1, 1, chunk)
    near = own_rows(cut.withColumns({"_p": F.lag("r").over(w), "_q": F.lead("r").over(w)}))
    r0 = r.filter("lag = 0").select(key, (F.col("r") + 1e-10).alias("_r0"))
    peak = (F.col("lag") >= 2) & (F.col("r") > F.col("_p")) & (F.col("r") > F.col("_q"))
    tall = near.filter(peak).groupBy(key).agg(F.max("r").alias("_top"))
    best = tall.join(r0, key).select(key, (F.col("_top") / F.col("_r0")).alias("_s"))
    long = (
        stats.filter(F.col("n") > direct_limit)
        .join(best, key, "left")
        .select(key, F.when(F.col("_s") > 0.3, F.col("_s")).otherwise(0.0).alias("periodicity"))
    )
    return short.unionByName(long)


def temporal_consistency(df: DataFrame, key: str, idx: str, v: str) -> DataFrame:
    """Overall consistency of a score series, with its flags."""
    parts = series_terms(df, key, idx, v).groupBy(key).agg(
        F.count(F.lit(1)).alias("num_frames"),
        F.avg(v).alias("score_mean"),
        F.stddev_pop(v).alias("score_std"),
        smoothness_expr().alias("_sm"),
        flicker_expr().alias("_fl"),
        trend_expr().alias("_tr"),
    )
    joined = parts.join(periodicity(df, key, idx, v), key)
    few = F.col("num_frames") < 3
    s = joined.select(
        key,
        "num_frames",
        "score_mean",
        "score_std",
        F.when(few, 0.5).otherwise(F.col("_sm")).alias("smoothness"),
        F.when(few, 0.0).otherwise(F.col("_fl")).alias("flicker"),
        F.when(few, 0.5).otherwise(F.col("_tr")).alias("trend_stability"),
        F.when(few, 0.0).otherwise(F.col("periodicity")).alias("periodicity"),
    )
    mix = F.col("smoothness") * 0.4 + (1.0 - F.col("flicker")) * 0.3 + F.col("trend_stability") * 0.3
    notes = flags(
        (~few & (F.col("smoothness") < 0.4), "Low temporal smoothness - possible frame-level manipulation"),
        (~few & (F.col("flicker") > 0.15), fmt("Score flickering detected (flicker=%.3f)", F.col("flicker"))),
        (~few & (F.col("trend_stability") < 0.3), "Unstable score trend - manipulation boundary suspected"),
        (F.col("periodicity") > 0.6, fmt("Periodic score pattern detected (strength=%.3f)", F.col("periodicity"))),
    )
    return s.withColumns(
        {"consistency": F.when(few, 0.5).otherwise(clip(mix)), "anomalies": notes}
    )


# --- lip closures -----------------------------------------------------------


def _box(v: str, w: Window, width: Column) -> Column:
    """Centred zero-padded moving average whose width is 2, 3, 4 or 5."""
    frames = {2: (-1, 0), 3: (-1, 1), 4: (-2, 1), 5: (-2, 2)}
    out = F.col(v)
    for n, (a, b) in frames.items():
        out = F.when(width == n, F.sum(v).over(w.rowsBetween(a, b)) / n).otherwise(out)
    return out


def closure_events(
    df: DataFrame, key: str, idx: str, v: str, fps: float = 30.0, chunk: int = CHUNK
) -> DataFrame:
    """Lip closures: deep local minima of the smoothed mouth opening."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = df.select(key, idx, v).join(n, key).filter("_n >= 5")
    cut, w = with_halo(rows, [key], idx, 8, 8, chunk)
    width = F.least(F.lit(5), F.floor(F.col("_n") / 2))
    s = cut.withColumn("_s", _box(v, w, width))
    near = s.withColumns(
        {
            "_p1": F.lag("_s", 1).over(w),
            "_p2": F.lag("_s", 2).over(w),
            "_q1": F.lead("_s", 1).over(w),
            "_q2": F.lead("_s", 2).over(w),
            "_top": F.max("_s").over(w.rowsBetween(-5, 4)),
        }
    )
    c = F.col("_s")
    low = (
        (c < F.col("_p1"))
        & (c < F.col("_p2"))
        & (c < F.col("_q1"))
        & (c < F.col("_q2"))
        & (c < F.col("_top") * 0.7)
    )
    t = F.col(idx) / fps
    return own_rows(near.filter(low)).select(
        key,
        F.col(idx).alias("frame"),
        t.alias("time"),
        (c / (F.col("_top") + 1e-6)).alias("opening_ratio"),
        (1.0 - c / (F.col("_top") + 1e-6)).alias("confidence"),
        t.between(0.3, 2.0).alias("natural_range"),
    )


def closure_rhythm(
    df: DataFrame, key: str, idx: str, v: str, fps: float = 30.0, chunk: int = CHUNK
) -> DataFrame:
    """Score of the intervals between closures; 0.5 below two closures."""
    frames = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_frames"))
    ev = materialize(closure_events(df, key, idx, v, fps, chunk), "closures")  # few rows, read twice
    seq = dense_index(ev, [key], F.col("frame"), [F.col("frame")], "_e", 1)
    cut, w = with_halo(seq, [key], "_e", 1, 0, chunk)
    gaps = own_rows(cut.withColumn("_gap", F.col("time") - F.lag("time").over(w)))
    g = gaps.groupBy(key).agg(
        F.count(F.lit(1)).alias("closures"),
        F.avg("_gap").alias("mean_interval"),
        F.stddev_pop("_gap").alias("std_interval"),
        F.avg(F.when(F.col("_gap").isNotNull(), F.col("_gap").between(0.3, 2.0).cast("double"))).alias(
            "natural_ratio"
        ),
    )
    j = frames.join(g, key, "left").withColumn("closures", F.coalesce("closures", F.lit(0)))
    cv, score = _rhythm_score(fps)
    return j.select(key, "n_frames", "closures", "natural_ratio", cv.alias("interval_cv"), score.alias("pv_score"))


def _rhythm_score(fps: float) -> tuple[Column, Column]:
    """Variation of the intervals and the score of their rhythm."""
    cv = F.col("std_interval") / (F.col("mean_interval") + 1e-6)
    score = (
        F.when(F.col("natural_ratio") < 0.5, 0.35).otherwise(0.0)
        + F.when((cv < 0.2) & (F.col("closures") - 1 > 3), 0.25).otherwise(0.0)
        + F.when(F.col("closures") < F.col("n_frames") / fps * 0.3, 0.3).otherwise(0.0)
    )
    return cv, F.when(F.col("closures") < 2, 0.5).otherwise(F.least(score, F.lit(1.0)))


# --- frame feature series --------------------------------------------------


def _frame_terms(brightness: str, compression: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_frames"),
        F.avg(brightness).alias("brightness_mean"),
        F.stddev_pop(brightness).alias("brightness_std"),
        F.coalesce(F.avg(compression), F.lit(0.0)).alias("compression_mean"),
        F.coalesce(F.stddev_pop(compression), F.lit(0.0)).alias("compression_std"),
    ]


def _splice_score(df: DataFrame) -> DataFrame:
    score = F.when(F.col("jumps") > F.col("n_frames") * 0.1, 0.4).otherwise(0.0) + F.when(
        (F.col("compression_std") > F.col("compression_mean") * 0.5) & (F.col("compression_mean") > 0), 0.3
    ).otherwise(0.0)
    even = 1.0 - F.least(F.col("compression_std") / (F.col("compression_mean") + 1e-6), F.lit(1.0))
    return df.withColumns({"compression_consistency": even, "metadata_score": F.least(score, F.lit(1.0))})


def brightness_jumps(
    df: DataFrame, key: str, idx: str, brightness: str, compression: str, chunk: int = CHUNK
) -> DataFrame:
    """Splice hints: steps above two standard deviations, uneven compression."""
    stats = df.groupBy(key).agg(*_frame_terms(brightness, compression))
    cut, w = with_halo(df.select(key, idx, brightness), [key], idx, 1, 0, chunk)
    step = own_rows(cut.withColumn("_d", F.abs(F.col(brightness) - F.lag(brightness).over(w))))
    jumps = (
        step.join(stats.select(key, "brightness_std"), key)
        .groupBy(key)
        .agg(F.sum(F.when(F.col("_d") > F.col("brightness_std") * 2, 1).otherwise(0)).alias("jumps"))
    )
    return _splice_score(stats.join(jumps, key))


def _count_above(signals: pd.Series, limits: pd.Series) -> pd.Series:
    """Steps of each signal that are above its limit."""
    pairs = zip(signals, limits)
    return pd.Series([int((np.abs(np.diff(np.asarray(a, dtype=np.float64))) > m).sum()) for a, m in pairs], dtype="int64")


def _closure_places(signals: pd.Series) -> pd.Series:
    """Positions of the closures of each signal, as ``closure_events`` has them; an empty sample is NaN."""

    def one(values: np.ndarray) -> np.ndarray:
        x = np.asarray(values, dtype=np.float64)
        n = len(x)
        if n < 5:
            return np.empty(0, dtype=np.int64)
        width = min(5, n // 2)
        back = width // 2
        none = np.isnan(x)
        wide = np.zeros(n + width - 1)
        wide[back : back + n] = np.where(none, 0.0, x)
        s = wide[:n].copy()
        for j in range(1, width):  # from the left, as a window adds
            s += wide[j : j + n]
        s /= width
        if none.any():
            some = np.zeros(n + width - 1, dtype=bool)
            some[back : back + n] = ~none
            s[~np.any([some[j : j + n] for j in range(width)], axis=0)] = np.nan
        edge = np.full(n + 9, np.nan)
        edge[5 : 5 + n] = s
        two = np.fmax(edge[:-1], edge[1:])
        four = np.fmax(two[:-2], two[2:])
        top = np.fmax(np.fmax(four[:n], four[4 : 4 + n]), two[8 : 8 + n])  # from five before to four after
        low = s < top * 0.7
        for j in (3, 4, 6, 7):
            low &= s < edge[j : j + n]
        return np.flatnonzero(low)

    return signals.map(one)


def _signal_rows(df: DataFrame, key: str, order: str, brightness: str, compression: str) -> DataFrame:
    """One row for each key: its frames' terms and its signal ``sig`` along ``order``, NULL last."""
    at = F.struct(F.col(order).isNull().alias("_last"), order, brightness)
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*_frame_terms(brightness, compression), F.sort_array(F.collect_list(at)).getField(brightness).alias("sig"))
    )


def short_brightness_jumps(df: DataFrame, key: str, order: str, brightness: str, compression: str) -> DataFrame:
    """``brightness_jumps`` of series that are bounded, each one array; rows that lie together by key are not shuffled."""
    above = F.pandas_udf(_count_above, "bigint")
    rows = _signal_rows(df, key, order, brightness, compression)
    return _splice_score(rows.withColumn("jumps", above("sig", F.col("brightness_std") * 2)))


def short_alignment(
    df: DataFrame, key: str, order: str, brightness: str, compression: str, fps: float = 30.0
) -> DataFrame:
    """``brightness_jumps`` and ``closure_rhythm`` of bounded series and their signals ``sig``, in one pass.

    Each series is one array, as for ``periodicity``. Rows that lie together by key are neither shuffled nor read again,
    where the forms for any length store the rows, cut them into chunks and join what they find.
    """
    above, places = F.pandas_udf(_count_above, "bigint"), F.pandas_udf(_closure_places, "array<bigint>")
    rows = _signal_rows(df, key, order, brightness, compression)
    found = rows.withColumns({"jumps": above("sig", F.col("brightness_std") * 2), "_at": places("sig")})
    times = F.transform("_at", lambda i: i / fps)
    gaps = let(
        times, lambda t: F.transform(F.slice(t, F.lit(2), F.greatest(F.array_size(t) - 1, F.lit(0))), lambda x, i: x - F.get(t, i))
    )
    g = found.withColumn("_gaps", gaps).withColumns(
        {
            "closures": F.array_size("_at").cast("bigint"),
            "mean_interval": array_mean(F.col("_gaps")),
            "std_interval": array_std(F.col("_gaps")),
            "natural_ratio": array_mean(F.transform("_gaps", lambda x: x.between(0.3, 2.0).cast("double"))),
        }
    )
    cv, score = _rhythm_score(fps)
    return _splice_score(g).withColumns({"interval_cv": cv, "pv_score": score}).drop("_at", "_gaps")


def sequence_consistency(df: DataFrame, key: str, idx: str, changed: str, pairs: int = 29) -> DataFrame:
    """Consistency of the changed share over the first frame pairs."""
    head = df.filter(F.col(idx).between(1, pairs))
    s = head.groupBy(key).agg(F.avg(changed).alias("avg_diff"), F.stddev_pop(changed).alias("std_diff"))
    a, sd = F.col("avg_diff"), F.col("std_diff")
    extreme = (a > 0.95) | (a < 0.001)
    score = F.when(extreme, 0.5).otherwise(1.0) * F.when(sd > 0.2, 0.7).otherwise(1.0)
    warn = flags(
        (a > 0.95, "Extreme frame-to-frame changes detected"),
        (a < 0.001, "Frames appear nearly identical (possible loop)"),
        (sd > 0.3, "Inconsistent frame changes (possible splicing)"),
    )
    return s.withColumns({"consistency_score": score, "warnings": warn})


def blink_runs(
    df: DataFrame, key: str, idx: str, left: str, right: str, fps: float = 30.0,
    threshold: float = 0.21, chunk: int = CHUNK,
) -> DataFrame:
    """Blinks (closed runs of two frames or more), their rate and symmetry.

    A run counts at its second row: closed here and before, open two before.
    """
    cut, w = with_halo(df.select(key, idx, left, right), [key], idx, 2, 0, chunk)
    shut = cut.withColumn("_c", (F.col(left) + F.col(right)) / 2 < threshold)
    second = shut.withColumn(
        "_hit",
        F.col("_c")
        & F.coalesce(F.lag("_c", 1).over(w), F.lit(False))
        & ~F.coalesce(F.lag("_c", 2).over(w), F.lit(False)),
    )
    g = own_rows(second).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.sum(F.col("_hit").cast("int")).alias("_b"),
        F.corr(left, right).alias("_corr"),
        F.stddev_pop(left).alias("_sl"),
        F.stddev_pop(right).alias("_sr"),
    )
    few = F.col("n_frames") < 5
    varied = (F.col("_sl") > 1e-6) & (F.col("_sr") > 1e-6)
    sym = F.when(varied, F.greatest(F.col("_corr"), F.lit(0.0))).otherwise(1.0)
    duration = F.col("n_frames") / fps
    return g.select(
        key,
        "n_frames",
        F.when(few, 0).otherwise(F.col("_b")).alias("blink_count"),
        F.when(few, 1.0).otherwise(sym).alias("blink_symmetry"),
        duration.alias("duration_sec"),
        (F.when(few, 0).otherwise(F.col("_b")) / duration * 60).alias("blink_rate"),
    )


def gaze_dynamics(
    df: DataFrame, key: str, idx: str, h: str, v: str, fps: float = 30.0, chunk: int = CHUNK
) -> DataFrame:
    """Gaze stability and the saccade score from frame-to-frame movement."""
    cut, w = with_halo(df.select(key, idx, h, v), [key], idx, 1, 0, chunk)
    dh, dv = F.col(h) - F.lag(h).over(w), F.col(v) - F.lag(v).over(w)
    g = own_rows(cut.withColumn("_vel", F.sqrt(dh * dh + dv * dv) * fps)).groupBy(key).agg(
        F.count(F.lit(1)).alias("gaze_points"),
        F.stddev_pop(h).alias("_sh"),
        F.stddev_pop(v).alias("_sv"),
        F.avg("_vel").alias("mean_velocity"),
        F.stddev_pop("_vel").alias("std_velocity"),
    )
    few = F.col("gaze_points") < 5
    sacc = (
        F.when((F.col("std_velocity") < 0.01) & (F.col("mean_velocity") > 0.1), 0.3)
        .when(F.col("mean_velocity") > 5.0, 0.2)
        .otherwise(clip(1.0 - F.col("mean_velocity") * 0.1, 0.3, 1.0))
    )
    return g.select(
        key,
        "gaze_points",
        "mean_velocity",
        "std_velocity",
        F.when(few, 1.0).otherwise(clip(1.0 - (F.col("_sh") + F.col("_sv")) * 2)).alias("gaze_stability"),
        F.when(few, 1.0).otherwise(sacc).alias("saccade_score"),
    )


def moving_average(
    df: DataFrame, keys: list[str], idx: str, v: str, width: int, chunk: int = CHUNK
) -> DataFrame:
    """Centred moving average of a long series, zero padded at the ends."""
    d = (width - 1) // 2
    cut, w = with_halo(df, keys, idx, width - 1 - d, d, chunk)
    return own_rows(
        cut.withColumn("smoothed", F.sum(v).over(w.rowsBetween(-(width - 1 - d), d)) / width)
    )


def znorm(df: DataFrame, keys: list[str], v: str, min_rows: int = 30) -> DataFrame:
    """Zero mean, unit variance; flat or short series are marked invalid."""
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s")
    )
    ok = (F.col("_n") >= min_rows) & (F.col("_s") >= 1e-6)
    z = F.when(F.col("_n") < min_rows, F.col(v)).otherwise(F.col(v) - F.col("_m"))
    return (
        df.join(s, keys)
        .withColumns({"is_valid": ok, "z": F.when(ok, safe_div(z, F.col("_s"))).otherwise(z)})
        .drop("_n", "_m", "_s")
    )
