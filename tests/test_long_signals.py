"""Signals as rows, in chunks, against whole arrays."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.operators import long_signals as L
from provenir.operators import signals as G


@pytest.mark.parametrize("n,chunk", [(64, 64), (97, 10), (500, 33), (1, 4), (2, 1), (10_007, 4096)])
def test_shares_add_up_to_the_spectrum(n, chunk):
    x = np.random.default_rng(n).standard_normal(n)
    want = np.fft.fft(x)
    low, high = n // 5, n // 2 + 1
    got = sum(L.chirp_share(x[s : s + chunk], s, n, low, high) for s in range(0, n, chunk))
    assert np.abs(got - want[low:high]).max() < 1e-9 * max(1, n)


def test_share_far_into_a_long_signal():
    """The phase of a chunk that starts at 10**9 is exact."""
    n, start = 3 * 10**9 + 7, 10**9
    x = np.random.default_rng(0).standard_normal(100)
    low = 7 * 10**7
    got = L.chirp_share(x, start, n, low, low + 5)
    for i in range(5):
        turns = [((low + i) * (start + j)) % n / n for j in range(100)]
        want = sum(v * complex(math.cos(2 * math.pi * a), -math.sin(2 * math.pi * a)) for v, a in zip(x, turns))
        assert abs(got[i] - want) < 1e-6


@pytest.fixture(scope="module")
def arrays(spark):
    rng = np.random.default_rng(5)
    t = np.arange(301)
    rows = []
    for c in range(5):
        rows.append((1, c, (np.sin(2 * np.pi * 1.3 * t / 30 + c) + rng.standard_normal(301) * 0.5).tolist()))
    rows += [(1, 8, [2.0] * 301), (2, 0, rng.standard_normal(45).tolist()), (2, 1, rng.standard_normal(45).tolist()), (3, 0, [1.0, 2.0] * 6), (4, 0, rng.standard_normal(200).tolist())]
    return spark.createDataFrame(rows, "item bigint, channel bigint, sig array<double>").cache()


@pytest.fixture(scope="module")
def samples(arrays):
    return arrays.select("item", "channel", F.posexplode("sig").alias("t", "v")).repartition(5)


def same(got, want, keys, digits=9):
    def table(df):
        return {tuple(r[k] for k in keys): {c: r[c] for c in want.columns if c not in keys} for r in df.collect()}

    a, b = table(got), table(want)
    assert a.keys() == b.keys()
    for k in b:
        for c, y in b[k].items():
            x = a[k][c]
            assert x == y or (x is not None and y is not None and abs(x - y) < 10.0**-digits), (k, c, x, y)


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_rows_equal_arrays(arrays, samples, chunk):
    args = ("item", "channel", "t", "v", 30.0, chunk)
    same(L.band_peak_rows(samples, *args), G.band_peak(arrays, "item", "channel", "sig"), ["item", "channel"], 7)
    same(L.heart_rates_rows(samples, *args), G.heart_rates(arrays, "item", "channel", "sig"), ["item"], 6)
    same(L.pairwise_sync_rows(samples, *args), G.pairwise_sync(arrays, "item", "sig"), ["item"])
    same(L.channel_sync_rows(samples, *args), G.channel_sync(arrays, "item", "channel", "sig"), ["item", "channel"])
    same(L.band_strength_rows(samples, ["item", "channel"], "t", "v", 30.0, chunk), G.band_strength(arrays, ["item", "channel"], "sig"), ["item", "channel"], 7)


def test_no_rows(samples):
    args = ("item", "channel", "t", "v")
    for f in (L.band_peak_rows, L.heart_rates_rows, L.pairwise_sync_rows, L.channel_sync_rows):
        assert f(samples.limit(0), *args).collect() == []
    assert L.band_strength_rows(samples.limit(0), ["item", "channel"], "t", "v").collect() == []
