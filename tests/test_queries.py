"""The contract module, and a cross-section of queries against their SQL."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import Window

import __spark_entry__ as entry_module
from tools.check import TABLES
from tools.check import rows as normal

SF = "/root/testdata/sf0.001"
PICKED = (
    "text_scan", "fuse_cores", "temporal_consistency", "closure_rhythm", "alignment_result", "biosignal_result",
    "artifact_result", "spectrogram_result", "gaze_result", "sanity_result", "patch_stats", "cross_dataset",
    "temperature_fit", "platt_fit", "weights_as_of", "ledger_append", "custody", "sign_payload", "active_at", "task_state",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[0] == "doc_id" and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 150


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry_module.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = normal(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols) and len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6))


def test_frames_of_odd_lines(spark, tmp_path):
    """A line without item or date has its place as in SQL; lines are read and shuffled once to be summed, once to be numbered."""
    lines = duckdb.sql(f"SELECT * REPLACE (CASE WHEN l_orderkey % 7 <> 0 THEN l_suppkey END AS l_suppkey, CASE WHEN l_orderkey % 5 <> 0 THEN l_shipdate END AS l_shipdate) FROM '{SF}/lineitem.parquet'")
    lines.write_parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    for name in ("quality_profile", "content_checks", "sequence_consistency"):
        df = entry_module.queries()[name](spark, str(tmp_path))
        cur = con.execute(entry_module.oracle_sql()[name])
        cols = [d[0] for d in cur.description]
        got, want = normal(df.columns, [tuple(r) for r in df.collect()]), normal(cols, cur.fetchall())
        assert len(got) == len(want)
        for a, b in zip(got, want):
            for x, y in zip(a, b):
                assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Join" not in plan


def test_closures_are_found_once(spark):
    from provenir.operators.series import closure_rhythm

    df = spark.range(400).selectExpr("id % 2 AS item", "id DIV 2 AS idx", "10 + 9 * sin(id / 9) AS v")
    plan = closure_rhythm(df, "item", "idx", "v")._jdf.queryExecution().executedPlan().toString()
    assert "lead" not in plan  # the windows that find closures are not in what reads them


def test_frames_sum_no_line_before_it_is_dealt(spark, monkeypatch):
    """Sums of a whole split are not held: below the first shuffle there is no aggregate, and partitions grow with the lines."""
    from provenir.plans import bindings as D

    plan = D.frame_features(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Aggregate" not in plan[plan.rindex("Exchange"):]
    lines = D.table(spark, SF, "lineitem")
    monkeypatch.setattr(D, "LINES", 50)
    assert D._line_parts(lines) == min(D.DIRECT, -(-lines.count() // 50))
    monkeypatch.setattr(D, "MOST_LINES", 20)
    assert D._line_parts(lines) == -(-lines.count() // 20)


def test_alignment_reads_and_deals_frames_once(spark):
    """Lines are read once and dealt as ``frame_features`` deals them; no frame is shuffled, stored or joined after that."""
    for name in ("alignment_result", "brightness_jumps"):
        plan = entry_module.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange") == 2 and "Join" not in plan and "lineitem" in plan


def test_short_series_equal_series_of_any_length(spark):
    """Short, flat, tied and gappy series: one array gives what chunked windows give; a row without a place comes last."""
    from pyspark.sql import functions as F

    from provenir.operators import series as S

    n = F.expr("CASE WHEN key < 14 THEN key WHEN key < 40 THEN 60 ELSE 300 END")
    df = spark.range(60).withColumnRenamed("id", "key").withColumn("n", n).selectExpr("key", "explode(sequence(0L, n)) AS idx")
    df = df.selectExpr(
        "key", "idx", "CASE WHEN key % 5 = 1 AND idx % 9 < 6 THEN NULL WHEN key % 5 = 2 THEN 7D WHEN key % 5 = 3 THEN round(10 + 9 * sin(idx * key / 5)) ELSE hash(key, idx) % 100 / 1D END AS v",
        "CASE WHEN key % 7 > 0 THEN abs(hash(idx, key) % 50) / 1D END AS c",
    ).unionByName(spark.createDataFrame([(None, 0, 1.0, 1.0)], "key bigint, idx bigint, v double, c double"))
    rhythm, jumps = S.closure_rhythm(df, "key", "idx", "v", chunk=50), S.brightness_jumps(df, "key", "idx", "v", "c", chunk=50)
    want = {r["key"]: r.asDict() for r in jumps.join(rhythm.drop("n_frames"), "key").collect()}
    last = df.withColumn("idx", F.when(F.col("idx") < F.max("idx").over(Window.partitionBy("key")), F.col("idx")))
    for d in (df, last):
        got = {r["key"]: r.asDict() for r in S.short_alignment(d, "key", "idx", "v", "c").collect()}
        alone = {r["key"]: r["jumps"] for r in S.short_brightness_jumps(d, "key", "idx", "v", "c").collect()}
        assert got.keys() == want.keys() == alone.keys() and len(got) == 60
        assert sum(w["closures"] for w in want.values()) > 100 and sum(w["jumps"] for w in want.values()) > 100
        for k, w in want.items():
            assert alone[k] == w["jumps"]
            for c, x in w.items():
                assert got[k][c] == x or math.isclose(got[k][c], x, rel_tol=1e-9, abs_tol=1e-9), (k, c)
