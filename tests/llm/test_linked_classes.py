"""Classes of items by links that imply a shared bucket, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from provenir.llm import common


def _near(left, right, i, j):
    return np.ones(len(i), bool)


def _linked(left, right, i, j):
    return np.array([len(set(left[a]) & set(right[b])) >= 4 for a, b in zip(i.tolist(), j.tolist())], bool)


def classes(sets):
    top = {k: k for k in sets}
    while True:
        new = {a: min(top[b] for b in sets if len(sets[a] & sets[b]) >= 4 or a == b) for a in sets}
        new = {a: min(new[a], new[new[a]]) for a in sets}
        if new == top:
            return top
        top = new


@pytest.mark.parametrize("rows,seed", [(4, 0), (4, 1), (256, 2)])
def test_against_brute_force(spark, monkeypatch, rows, seed):
    monkeypatch.setattr(common, "BLOCK_ROWS", rows)
    rng = random.Random(seed)
    common_part = [frozenset(rng.sample(range(200), 6)) for _ in range(4)]
    sets = {k: set(rng.sample(range(200), 3)) | set(rng.sample(sorted(rng.choice(common_part)), rng.randint(1, 4))) | {255} for k in range(120)}
    buckets = spark.createDataFrame([(e, k) for k, s in sets.items() for e in s], "bucket bigint, item bigint").repartition(5)
    data = spark.createDataFrame([(k, len(s), bytes(sorted(s))) for k, s in sets.items()], "item bigint, weight bigint, data binary")
    got = {r.node: r.comp for r in common.linked_classes(buckets, lambda items: data.join(items, "item"), _near, _linked, "t-lc").collect()}
    want = classes(sets)
    members = {}
    for k, c in want.items():
        members.setdefault(c, []).append(k)
    assert any(len(m) > 3 for m in members.values())
    for k, c in want.items():
        assert got.get(k, k) == c


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint").repartition(4)
    got = {r.node: r.comp for r in common.components(edges, "t-path").collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_no_buckets(spark):
    none = spark.createDataFrame([], "bucket bigint, item bigint")
    data = spark.createDataFrame([], "item bigint, weight bigint, data binary")
    assert common.linked_classes(none, lambda items: data, _near, _linked, "t-none").collect() == []
