"""Signals, grids, spectra and input checks against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.operators import features as X
from provenir.operators import sampling as P
from provenir.operators import signals as G
from tests.conftest import rows

RNG = np.random.default_rng(7)
N = 90
PULSE = np.sin(2 * np.pi * 1.2 * np.arange(N) / 30)
SIGNALS = [("a", j, (PULSE + RNG.normal(0, 0.4, N)).tolist()) for j in range(6)] + [("a", 6, [1.0] * N), ("b", 0, RNG.normal(size=N).tolist())]


def smooth(x, w=7):
    return np.convolve(x, np.ones(w) / w, "same")


def z(x):
    x = np.asarray(x)
    return (x - x.mean()) / x.std()


@pytest.fixture(scope="module")
def signals(spark):
    return spark.createDataFrame(SIGNALS, "item string, channel int, sig array<double>").cache()


def test_sync_equals_mean_of_all_pairs(signals):
    f = [smooth(z(s)) for k, j, s in SIGNALS if k == "a" and j < 6]
    want = np.mean([np.corrcoef(f[i], f[j])[0, 1] for i in range(6) for j in range(i + 1, 6)])
    got = rows(G.pairwise_sync(signals, "item", "sig"), "item")
    assert (got[0]["channels"], got[0]["valid"]) == (7, 6)
    assert got[0]["sync"] == pytest.approx(want)
    assert got[1]["sync"] == 0.0
    per = [r["mean_corr"] for r in rows(G.channel_sync(signals, "item", "channel", "sig"), "item", "channel") if r["item"] == "a"]
    assert np.mean(per) == pytest.approx(want)


def test_pulse_is_found_and_flat_channel_counts_against_coverage(signals):
    r = rows(G.heart_rates(signals, "item", "channel", "sig"), "item")[0]
    assert r["mean_bpm"] == pytest.approx(72, abs=10.5)
    assert r["pulses"] == 6 and r["pulse_coverage"] == pytest.approx(6 / 7)
    s = rows(G.band_strength(signals, ["item", "channel"], "sig"), "item", "channel")[0]
    mag = np.abs(np.fft.rfft(np.asarray(SIGNALS[0][2]) - np.mean(SIGNALS[0][2])))
    freq = np.fft.rfftfreq(N, 1 / 30)
    band = mag[(freq >= 0.7) & (freq <= 4.0)]
    assert s["strength"] == pytest.approx(band.max() / mag.max())
    assert s["quality"] == pytest.approx(min(5 * band.max() ** 2 / (mag**2).sum(), 1.0))


def test_grid_coherence(spark):
    g = RNG.random(12)
    g[5] = 0.0
    got = spark.createDataFrame([(g.tolist(),)], "g array<double>").select(X.grid_coherence("g", 3, 4).alias("c")).first()["c"]
    m = g.reshape(3, 4)
    for r in range(3):
        for c in range(4):
            v = [m[r, c]] + [m[a, b] for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if 0 <= a < 3 and 0 <= b < 4]
            want = 1 - min(np.std(v) / (np.mean(v) + 1e-10), 1) if m[r, c] > 0 else 0.0
            assert got[r * 4 + c] == pytest.approx(want)


def test_attention_rows_sum_to_one(spark):
    v = RNG.normal(size=64)
    df = spark.createDataFrame([(v.tolist(),)], "v array<double>").select(X.split_patches("v", 4).alias("p"))
    att = np.array(df.select(X.self_attention("p").alias("a")).first()["a"])
    p = v.reshape(16, 4)
    u = p / (np.linalg.norm(p, axis=1, keepdims=True) + 1e-8)
    e = np.exp(u @ u.T / 2 - (u @ u.T / 2).max(axis=1, keepdims=True))
    assert np.allclose(att, e / (e.sum(axis=1, keepdims=True) + 1e-10))


def test_snr_of_quiet_and_loud_halves(spark):
    x = np.concatenate([RNG.normal(0, 0.01, 2000), RNG.normal(0, 1.0, 2000)])
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0)], "item string, i bigint, v double")
    got = rows(X.estimate_snr(df, "item", "i", "v", 1000), "item")
    e = np.array([(x[s : s + 25] ** 2).sum() for s in range(0, len(x) - 24, 10)])
    e = np.sort(e[e > 0])
    want = 10 * np.log10(e[int(len(e) * 0.7) :].mean() / e[: int(len(e) * 0.1)].mean())
    assert got[0]["snr_db"] == pytest.approx(min(want, 40.0))
    assert got[1]["snr_db"] == 0.0


@pytest.mark.parametrize("n", [3, 10, 11, 57, 240])
def test_even_sampling_matches_linspace(spark, n):
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("idx"))
    got = [r["idx"] for r in rows(P.sample_even(df, "k", "idx", 10), "idx")]
    want = sorted(set(np.linspace(0, n - 1, 10, dtype=int).tolist())) if n > 10 else list(range(n))
    assert got == want


def test_stride_and_ends(spark):
    df = spark.range(130).select(F.lit("a").alias("k"), F.col("id").alias("idx"))
    assert [r["idx"] for r in rows(P.sample_stride(df, "k", "idx", 60), "idx")] == list(range(0, 120, 2))
    assert [r["idx"] for r in rows(P.sample_ends(df, "k", "idx"), "idx")] == [0, 65, 129]


def test_sanity_rejects_and_short_items(spark):
    counts = spark.createDataFrame([("ok", 20), ("adv", 20), ("one", 1)], "item string, n_frames bigint")
    seq = spark.createDataFrame([("ok", 1.0), ("adv", 0.35)], "item string, consistency_score double").withColumn("warnings", F.array().cast("array<string>"))
    shape = spark.createDataFrame([("ok", True), ("adv", True)], "item string, same_shape boolean")
    f = spark.createDataFrame([(k, i, g, 100.0, 0.0, 200.0, 0.1) for k, g in (("ok", 10.0), ("adv", 900.0)) for i in range(10)], "item string, idx bigint, gradient double, mean_val double, min_val double, max_val double, high_freq_share double")
    got = {r["item"]: r for r in X.sanity_result(counts, seq, shape, X.content_checks(f, "item", "idx"), "item").collect()}
    assert got["ok"]["is_valid"] and got["ok"]["rejection_reason"] is None
    assert got["adv"]["rejection_reason"] == "Potential adversarial attack detected"
    assert got["one"]["checks_failed"] == ["INSUFFICIENT_FRAMES"] and not got["one"]["quick_ok"]


def test_few_frames_are_undecided(spark):
    cols = "grid_score kurtosis noise_std blur_var detail_ratio flow_dir_var flow_mag".split()
    df = spark.createDataFrame([("a", *[1.0] * 7)] * 3, "item string, " + ", ".join(f"{c} double" for c in cols))
    r = X.artifact_result(df, "item").first()
    assert (r["score"], r["confidence"], r["status"], r["anomalies"]) == (0.5, 0.3, "WARN", ["LOW_FRAME_COUNT"])
