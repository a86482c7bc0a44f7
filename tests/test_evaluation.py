"""Curves and calibration against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.operators import calibration as C
from provenir.operators import evaluation as E
from tests.conftest import rows


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(11)
    data = []
    for g, n in (("hot", 500), ("small", 40)):
        for _ in range(n):
            y = rng.random() < 0.4
            s = round(min(max(rng.gauss(0.6 if y else 0.4, 0.2), 0.0), 1.0), 2)
            data.append((g, s, int(y)))
    data.append(("one", 0.5, 1))
    return data, spark.createDataFrame(data, "g string, s double, y int").cache()


def part(data, g):
    return np.array([s for k, s, _ in data if k == g]), np.array([y for k, _, y in data if k == g])


def curve(s, y):
    """Distinct thresholds, highest first, with running counts."""
    out = []
    for t in sorted(set(s), reverse=True):
        out.append((t, int(((s >= t) & (y == 1)).sum()), int(((s >= t) & (y == 0)).sum())))
    return out


def test_auc_is_the_share_of_ordered_pairs(sample):
    data, df = sample
    got = {r["g"]: r["auc_roc"] for r in E.auc_roc(df, ["g"], "y", "s").collect()}
    for g in ("hot", "small"):
        s, y = part(data, g)
        p, n = s[y == 1], s[y == 0]
        want = np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])
        assert got[g] == pytest.approx(want)
    assert got["one"] == 0.0


def test_average_precision(sample):
    data, df = sample
    got = {r["g"]: r["auc_pr"] for r in E.auc_pr(df, ["g"], "y", "s").collect()}
    s, y = part(data, "hot")
    prev, want = 0, 0.0
    for _, tp, fp in curve(s, y):
        want += (tp - prev) / y.sum() * tp / (tp + fp)
        prev = tp
    assert got["hot"] == pytest.approx(want) and got["one"] == 0.0


def kept(points):
    """Corner points: ends, and those off the straight run of neighbours."""
    out = []
    for i, (t, tp, fp) in enumerate(points):
        if i in (0, len(points) - 1):
            out.append((t, tp, fp))
            continue
        a, b = points[i - 1], points[i + 1]
        if a[1] - 2 * tp + b[1] != 0 or a[2] - 2 * fp + b[2] != 0:
            out.append((t, tp, fp))
    return out


@pytest.mark.parametrize("chunk", [4096, 3])
def test_roc_corners(sample, chunk):
    data, df = sample
    got = rows(E.roc_points(df.filter("g <> 'one'"), ["g"], "y", "s", chunk=chunk), "g", "place")
    for g in ("hot", "small"):
        s, y = part(data, g)
        p, n = (y == 1).sum(), (y == 0).sum()
        want = [(0.0, 0.0)] + [(fp / n, tp / p) for _, tp, fp in kept(curve(s, y))]
        assert np.allclose([(r["fpr"], r["tpr"]) for r in got if r["g"] == g], want)


def test_fpr_at_tpr_takes_the_nearest_corner(sample):
    data, df = sample
    got = {r["g"]: r for r in E.fpr_at_tpr(df.filter("g <> 'one'"), ["g"], "y", "s").collect()}
    s, y = part(data, "hot")
    pts = [(0.0, 0.0)] + [(fp / (y == 0).sum(), tp / (y == 1).sum()) for _, tp, fp in kept(curve(s, y))]
    for t in (0.90, 0.95, 0.99):
        i = int(np.argmin([abs(tpr - t) for _, tpr in pts]))
        assert got["hot"][f"fpr_at_tpr_{round(t * 100)}"] == pytest.approx(pts[i][0])


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.2, 0)], "g string, s double, y int")
    r = E.classification_metrics(df, ["g"], "y", "s").first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_platt_descent(sample):
    data, df = sample
    got = {r["g"]: r for r in C.platt_fit(df, "g", "s", "y").collect()}
    assert "one" not in got
    s, y = part(data, "small")
    a, b = -1.0, 0.0
    for _ in range(1000):
        p = np.clip(1 / (1 + np.exp(-(a * s + b))), 1e-7, 1 - 1e-7)
        a, b = a - 0.01 * np.mean((p - y) * s), b - 0.01 * np.mean(p - y)
    assert (got["small"]["a"], got["small"]["b"]) == pytest.approx((a, b), rel=1e-9)


def test_fit_takes_scores_as_they_are(spark):
    rng = np.random.default_rng(3)
    s = np.concatenate([0.5 + rng.random(300) * 2e-4, [0.0, 1.0]])
    y = (rng.random(len(s)) < 0.3).astype(int)
    df = spark.createDataFrame([("g", float(v), int(k)) for v, k in zip(s, y)] + [("g", None, 1), ("g", 0.5, None)], "g string, s double, y int")
    a, b = -1.0, 0.0
    for _ in range(1000):
        p = 1 / (1 + np.exp(-(a * s + b)))
        a, b = a - 0.01 * np.mean((p - y) * s), b - 0.01 * np.mean(p - y)
    got = C.platt_fit(df, "g", "s", "y").first()
    assert (got["a"], got["b"]) == pytest.approx((a, b), rel=1e-10)
    assert C.score_histogram(df, "g", "s", "y").count() == len(set(s))


def ece(p, y):
    edges, out = np.linspace(0, 1, 11), 0.0
    for lo, hi in zip(edges, edges[1:]):
        m = (p >= lo) & (p < hi)
        if m.any():
            out += m.sum() / len(p) * abs(p[m].mean() - y[m].mean())
    return out


def test_temperature_has_the_lowest_error(sample):
    data, df = sample
    got = {r["g"]: r for r in C.temperature_fit(df, "g", "s", "y").collect()}
    s, y = part(data, "small")
    errs = {}
    for t in C.TEMPERATURES:
        z = np.log(s / (1 - s + 1e-10) + 1e-10) / t
        errs[t] = ece(1 / (1 + np.exp(-z)), y)
    assert got["small"]["ece"] == pytest.approx(min(errs.values()))
    assert "one" not in got


def test_ece_drops_certainty(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 0.5, 1)], "g string, p double, y int")
    r = C.ece(df, ["g"], "p", F.lit(1), F.col("y")).first()
    assert r["ece"] == pytest.approx(0.25)


def test_unfitted_groups_stay_as_they_are(spark):
    df = spark.createDataFrame([("a", 0.9, 0.8)], "g string, s double, c double")
    params = spark.createDataFrame([], "g string, a double, b double, temperature double")
    r = C.calibrate(df, params, "g", "s", "c").first()
    assert (r["calibrated_score"], r["method"]) == (0.9, "uncalibrated")
    assert r["reliability"] == pytest.approx(0.4 + 0.4)


def test_one_ranking_gives_all_metrics(spark):
    """The metric row equals the single metrics, with ties, one class, and rows without a score or a label."""
    rows = [("a", k * 7 % 10 / 10, int(k * 3 % 7 > 3)) for k in range(60)] + [("b", 0.4, 1), ("b", 0.8, 1), ("c", 0.5, 0), ("a", None, 1), ("a", 0.9, None)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    known = df.filter("s is not null and y is not null")
    got = {r["g"]: r.asDict() for r in E.all_metrics(df, ["g"], "y", "s").collect()}
    parts = [E.classification_metrics(df, ["g"], "y", "s"), E.auc_roc(known, ["g"], "y", "s"), E.auc_pr(known, ["g"], "y", "s"), E.fpr_at_tpr(known, ["g"], "y", "s")]
    want = {}
    for p in parts:
        for r in p.collect():
            want.setdefault(r["g"], {}).update(r.asDict())
    assert want["a"]["samples"] == 62  # rows without a score or a label are samples, and in no cell
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx({k: v for k, v in want[g].items() if k != "g"} | {"g": g})
