"""The stored history, and quantile sketches."""

from __future__ import annotations

import glob
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from provenir.operators.evaluation import exact_quantiles, merged_quantiles, quantile_sketches, quantile_values
from provenir.session import scratch_dir
from provenir.sources.history import HistoryStore

START = datetime(2024, 3, 1, 12)
SCHEMA = "session_id string, timestamp timestamp, verdict string"


def entries(n=30, per_day=5):
    return [(f"s{k:03d}", START + timedelta(days=k // per_day, minutes=k % per_day), "x") for k in range(n)]


@pytest.fixture
def store(spark):
    s = HistoryStore(spark, scratch_dir(spark, "t-history"))
    s.add(spark.createDataFrame(entries(), SCHEMA))
    return s


def ids(store):
    return sorted(r.session_id for r in store.read().collect())


def files(store):
    return {f for f in glob.glob(f"{store._path.removeprefix('file:')}/day=*/part-*")}


def test_delete_rewrites_only_its_days(spark, store):
    before = files(store)
    gone = ["s001", "s002", "s010", "s011", "s012", "s013", "s014", "absent", None]
    assert store.delete(spark.createDataFrame([(g,) for g in gone], "session_id string")) == 7
    assert ids(store) == sorted(e[0] for e in entries() if e[0] not in gone)
    after = files(store)
    kept = {f for f in before if not any(d in f for d in ("day=2024-03-01", "day=2024-03-03"))}
    assert kept <= after and len(after) == len(before) - 1  # the third day is empty and its folder is gone
    assert not any("day=2024-03-03" in f for f in after)
    assert store.delete(spark.createDataFrame([("absent",)], "session_id string")) == 0 and files(store) == after


def test_add_after_delete(spark, store):
    store.delete(spark.createDataFrame([("s000",)], "session_id string"))
    store.add(spark.createDataFrame(entries(1), SCHEMA))
    assert ids(store) == [e[0] for e in entries()]


@pytest.mark.parametrize("n", [1, 5, 7, 30, 100])
def test_retain(store, n):
    before = files(store)
    assert store.retain(n) == max(0, 30 - n)
    assert ids(store) == [e[0] for e in entries()][-n:]
    whole = {f for f in before if any(f"day=2024-03-{6 - k:02d}" in f for k in range(min(n, 30) // 5))}
    assert whole <= files(store)


def test_clear(store):
    assert store.clear() == 30 and files(store) == set()


def test_sketches_are_exact_while_small_and_close_when_large(spark):
    rng = random.Random(1)
    rows = [("small", START + timedelta(seconds=k), float(k)) for k in range(100)] + [("large", START + timedelta(seconds=k % 3600), rng.gauss(0, 1)) for k in range(40_000)] + [("small", START, None)]
    df = spark.createDataFrame(rows, "kind string, ts timestamp, v double").repartition(8)
    sketches = quantile_sketches(df, ["kind"], "ts", "v")
    assert sketches.filter("kind = 'large'").count() == 60
    got = {r.kind: r for r in merged_quantiles(sketches, ["kind"], {"median": 0.5, "p95": 0.95}).collect()}
    assert (got["small"].n, got["small"].median, got["small"].p95) == (100, 49.0, 94.0)
    values = sorted(r[2] for r in rows if r[0] == "large")
    for name, p in (("median", 0.5), ("p95", 0.95)):
        rank = sum(x <= got["large"][name] for x in values) / len(values)
        assert abs(rank - p) < 0.02
    assert got["large"].n == 40_000


def test_no_sketches(spark):
    df = spark.createDataFrame([], "kind string, ts timestamp, v double")
    assert merged_quantiles(quantile_sketches(df, ["kind"], "ts", "v"), ["kind"], {"median": 0.5}).collect() == []


def test_exact_quantiles_of_many_values(spark):
    """More values than a sketch holds, in spans that are merged; no value at all; no kind."""
    rows = [("a", datetime(2024, 1, 1, 0, k % 50), float(k * 7919 % 3001)) for k in range(3001)]
    rows += [("b", datetime(2024, 1, 1), None), (None, datetime(2024, 1, 1), -1.5)]
    df = spark.createDataFrame(rows, "kind string, ts timestamp, v double")
    got = exact_quantiles(quantile_values(df, ["kind"], "ts", "v"), ["kind"], {"median": 0.5, "p95": 0.95}).collect()
    assert {tuple(r) for r in got} == {("a", 3001, 1500.0, 2850.0), ("b", 1, None, None), (None, 1, -1.5, -1.5)}
