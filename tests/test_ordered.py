"""Skew-safe ordering against plain Python, with chunks far smaller than a key."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.operators import ordered as O
from provenir.operators import series as S
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows."""
    rng = random.Random(3)
    data = [("hot", i * 3 + 1, rng.random()) for i in range(400)]
    data += [(f"k{j}", i, rng.random()) for j in range(20) for i in range(j)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "key string, at bigint, v double").cache()


def by_key(data):
    out: dict[str, list] = {}
    for k, at, v in sorted(data):
        out.setdefault(k, []).append((at, v))
    return out


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_dense_index_counts_within_key(skewed, levels):
    data, df = skewed
    got = rows(O.dense_index(df, ["key"], F.col("at"), [F.col("at")], levels=levels), "key", "at")
    want = [(k, at, i) for k, s in sorted(by_key(data).items()) for i, (at, _) in enumerate(s)]
    assert [(r["key"], r["at"], r["idx"]) for r in got] == want


def test_prefix_sums_across_cells_and_without_key(skewed):
    data, df = skewed
    got = rows(O.prefix_sums(df, [], F.floor(F.col("at") / 7), [F.col("at"), F.col("v")], {"s": F.lit(1)}), "at", "v")
    assert [r["s"] for r in got] == list(range(1, len(data) + 1))


def test_halo_gives_exact_lag_across_chunks(skewed):
    data, df = skewed
    d = O.dense_index(df, ["key"], F.col("at"), [F.col("at")])
    cut, w = O.with_halo(d, ["key"], "idx", 2, 1, chunk=5)
    got = rows(O.own_rows(cut.withColumns({"a": F.lag("v", 2).over(w), "b": F.lead("v").over(w)})), "key", "idx")
    i = 0
    for _, s in sorted(by_key(data).items()):
        v = [x for _, x in s]
        for j in range(len(v)):
            assert got[i]["a"] == (v[j - 2] if j >= 2 else None)
            assert got[i]["b"] == (v[j + 1] if j + 1 < len(v) else None)
            i += 1
    assert i == len(got) == len(data)


def test_quantiles_match_numpy(skewed):
    data, df = skewed
    got = rows(O.quantiles(df, ["key"], "v", {"p50": 0.5, "p95": 0.95}, O.unit_cell(F.col("v"))), "key")
    series = by_key(data)
    for r in got:
        v = [x for _, x in series[r["key"]]]
        assert r["p50"] == pytest.approx(np.percentile(v, 50), abs=1e-12)
        assert r["p95"] == pytest.approx(np.percentile(v, 95), abs=1e-12)


def test_quantiles_of_tied_values_without_key(spark):
    v = [1.0] * 50 + [2.0, 3.0, 3.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    r = O.quantiles(df, [], "v", {"p50": 0.5, "p95": 0.95}, O.log_cell(F.col("v"))).first()
    assert (r["p50"], r["p95"]) == (1.0, pytest.approx(np.percentile(v, 95)))


def indexed(df):
    return O.dense_index(df, ["key"], F.col("at"), [F.col("at")])


def test_series_terms_do_not_depend_on_chunk(skewed):
    _, df = skewed
    d = indexed(df)
    one = rows(S.series_terms(d, "key", "idx", "v"), "key", "idx")
    many = rows(S.series_terms(d, "key", "idx", "v", chunk=6), "key", "idx")
    assert one == many


def autocorrelation_peak(x):
    x = np.asarray(x)
    if len(x) < 10:
        return 0.0
    c = x - x.mean()
    r = np.correlate(c, c, "full")[len(x) - 1 :]
    r = r / (r[0] + 1e-10)
    p = [r[i] for i in range(2, len(r) - 1) if r[i] > r[i - 1] and r[i] > r[i + 1] and r[i] > 0.3]
    return max(p, default=0.0)


def test_periodicity_direct_and_distributed_agree_with_all_lags(spark):
    rng = np.random.default_rng(5)
    data = []
    for k in range(4):
        n = (300, 57, 12, 9)[k]
        v = 0.5 + 0.3 * np.sin(np.arange(n) * 2 * np.pi / (7 + k)) + rng.normal(0, 0.05, n)
        data += [(k, i, float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(data, "key bigint, idx bigint, v double").cache()
    want = {k: autocorrelation_peak([x for kk, _, x in data if kk == k]) for k in range(4)}
    for limit in (1 << 15, 20):
        got = {r["key"]: r["periodicity"] for r in S.periodicity(df, "key", "idx", "v", direct_limit=limit, chunk=16).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_distributed_fft_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=24)
    df = spark.createDataFrame([("a", 24, 8, 4, i, float(v), 0.0) for i, v in enumerate(x)], "key string, n bigint, m1 bigint, m2 bigint, i bigint, re double, im double")
    got = rows(S.distributed_fft(df, "key"), "i")
    want = np.fft.fft(x, 32)
    assert np.allclose([r["re"] + 1j * r["im"] for r in got], want, atol=1e-9)


def test_closures_do_not_depend_on_chunk(skewed):
    _, df = skewed
    d = indexed(df)
    one = rows(S.closure_events(d, "key", "idx", "v"), "key", "frame")
    many = rows(S.closure_events(d, "key", "idx", "v", chunk=9), "key", "frame")
    assert one == many and one
    assert rows(S.closure_rhythm(d, "key", "idx", "v"), "key") == rows(S.closure_rhythm(d, "key", "idx", "v", chunk=9), "key")


def test_blinks_count_runs_of_two(spark):
    shut = [0, 1, 1, 1, 0, 1, 0, 1, 1, 0, 0, 1, 1]
    data = [("a", i, 0.1 if s else 0.3, 0.1 if s else 0.31) for i, s in enumerate(shut)]
    df = spark.createDataFrame(data, "key string, idx bigint, l double, r double")
    for chunk in (4096, 2):
        r = S.blink_runs(df, "key", "idx", "l", "r", fps=13.0, chunk=chunk).first()
        assert (r["blink_count"], r["blink_rate"]) == (3, pytest.approx(180.0))


def test_moving_average_pads_with_zeros(spark):
    v = [1.0, 2.0, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "key string, idx bigint, v double")
    got = rows(S.moving_average(df, ["key"], "idx", "v", 3, chunk=2), "idx")
    assert [r["smoothed"] for r in got] == pytest.approx(list(np.convolve(v, np.ones(3) / 3, "same")))


def test_quantiles_of_any_number(spark):
    """Zeros, negatives and infinities have ranks; NULL values do not count."""
    from provenir.operators.evaluation import timing_stats

    values = [0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0, -5.0, -0.25, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = timing_stats(df, "v", O.log_cell(F.col("v")), 2).first()
    known = sorted(v for v in values if v is not None)
    assert got.median_time == 0.0 and abs(got.p95_time - (3 + (4 - 3) * 0.6)) < 1e-9 and abs(got.avg_time - sum(known) / 9) < 1e-12
    tail = df.unionAll(spark.createDataFrame([(float("inf"),), (float("nan"),)], "v double"))
    assert tail.select(O.log_cell(F.col("v")).alias("c"), "v").orderBy("v").filter("c is not null").select("c").rdd.map(lambda r: r.c).collect() == sorted(r.c for r in tail.select(O.log_cell(F.col("v")).alias("c")).collect() if r.c is not None)
