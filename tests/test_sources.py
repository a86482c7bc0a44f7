"""File manifests, sinks and streams over small folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from provenir.sources import manifest as M
from provenir.sources import objects as O
from provenir.sources import sinks as K
from provenir.streaming import jobs as J
from tests.conftest import rows


def test_manifest_of_labelled_folders(spark, tmp_path):
    for d in ("real", "fake"):
        (tmp_path / d).mkdir()
        for n in ("b.MP4", "a.avi", "note.txt"):
            (tmp_path / d / n).write_bytes(b"x" * 5)
    got = [(r["label"], r["name"], r["ext"], r["length"]) for r in M.media_manifest(spark, str(tmp_path)).collect()]
    assert got == [("fake", "a.avi", ".avi", 5), ("fake", "b.MP4", ".mp4", 5), ("real", "a.avi", ".avi", 5), ("real", "b.MP4", ".mp4", 5)]


def test_inventory_hashes_content(spark, tmp_path):
    import hashlib

    (tmp_path / "m.onnx").write_bytes(b"weights")
    (tmp_path / "m.txt").write_bytes(b"no")
    r = M.file_inventory(spark, str(tmp_path)).collect()
    assert [(x["name"], x["sha256"]) for x in r] == [("m.onnx", hashlib.sha256(b"weights").hexdigest())]


def test_routing_and_result_keys(spark):
    names = ["a.mp4", "b.JPG", "c.exe", "noext", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["media_type"] for r in M.route_media(df, "n").collect()] == ["video", "image", "reject", "reject", "text"]
    got = spark.createDataFrame([("in/x.y.mp4",), ("plain",)], "k string").select(K.result_key("k")).collect()
    assert [r[0] for r in got] == ["in/x.y_result.json", "plain_result.json"]


def test_split_manifest(spark):
    paths = ["/d/train/real/v1/0.jpg", "/d/train/real/v1/1.jpg", "/d/val/fake/i.png", "/d/val/fake/i.txt"]
    m = M.split_manifest(spark.createDataFrame([(p,) for p in paths], "path string"), "path")
    got = [(r["split"], r["label"], r["sample"], r["is_video"]) for r in rows(m, "path")]
    assert got == [("train", 0, "v1", True), ("train", 0, "v1", True), ("val", 1, "i.png", False)]


def test_result_document(spark, tmp_path):
    doc = {"metadata": {"dataset": "d"}, "samples": [{"file": "a", "label": 1, "fusion_score": 0.5, "verdict": "X"}], "metrics": {"auc": 0.9}}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=2))
    r = K.read_result_document(spark, str(tmp_path / "r.json")).first()
    assert (r["dataset"], r["file"], r["fusion_score"]) == ("d", "a", 0.5)


def entries(spark, n):
    return spark.range(n).select(
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 20).alias("ts"), F.concat(F.lit("u"), F.col("id") % 3).alias("user"), F.col("id"),
    )


def test_update_stream_continues_from_its_checkpoint(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    df = entries(spark, 30)
    df.filter("id < 20").coalesce(1).write.mode("append").parquet(src)
    agg = lambda: J.live_counters(J.read_table_stream(spark, src), ["user"])
    J.update_stream(agg(), out, cp).awaitTermination()
    df.filter("id >= 20").coalesce(1).write.mode("append").parquet(src)
    J.update_stream(agg(), out, cp).awaitTermination()
    assert [(r["user"], r["n"]) for r in rows(J.latest(spark, out, ["user"]), "user")] == [("u0", 10), ("u1", 10), ("u2", 10)]


def test_rate_limit_and_latest(spark, tmp_path):
    src = str(tmp_path / "src")
    entries(spark, 40).coalesce(1).write.parquet(src)
    s = J.read_table_stream(spark, src)
    limited = J.run_update(J.rate_limit(s, "user", "ts", 0), ["user", "minute"], "t-rate")
    assert limited.agg(F.sum("requests")).first()[0] == 40 and limited.filter("limited").count() == limited.count()
    base = str(tmp_path / "latest")
    J.latest_stream(J.read_table_stream(spark, src), "user", ["ts", "id"], [], base, f"{base}/cp").awaitTermination()
    assert [r["id"] for r in rows(J.read_state(spark, base), "user")] == [39, 37, 38]


def feed(spark, src, *values):
    """Append (name, second, content) rows as one file."""
    df = spark.createDataFrame(values, "name string, s int, sha string")
    df.select("name", F.timestamp_seconds(1_700_000_000 + F.col("s")).alias("ts"), "s", "sha").coalesce(1).write.mode("append").parquet(src)


def test_changes_over_batches(spark, tmp_path):
    src, base = (str(tmp_path / x) for x in ("src", "out"))

    def run():
        J.change_stream(J.read_table_stream(spark, src), "name", "sha", ["ts", "s"], base, f"{base}/cp", "1 hour").awaitTermination()

    def seen():
        return {(r["name"], r["s"], r["sha"]) for r in spark.read.parquet(f"{base}/changes").collect()}

    feed(spark, src, ("a", 1, "A"), ("a", 2, "B"), ("a", 3, "A"), ("b", 1, "X"), ("b", 2, "X"), (None, 1, "X"))
    run()
    first = {("a", 1, "A"), ("a", 2, "B"), ("a", 3, "A"), ("b", 1, "X")}
    assert seen() == first
    feed(spark, src, ("a", 2, "C"), ("a", 4, "A"), ("b", 3, "Y"), ("b", 4, "X"))  # the first row is late
    run()
    second = first | {("b", 3, "Y"), ("b", 4, "X")}
    assert seen() == second
    feed(spark, src, ("b", 9000, "X"))
    run()
    assert seen() == second
    assert [r["name"] for r in J.read_state(spark, base).collect()] == ["b"]  # the other one is idle and gone


def test_dead_letters(spark, tmp_path):
    src, good, dead, cp = (str(tmp_path / x) for x in ("src", "good", "dead", "cp"))
    entries(spark, 10).write.parquet(src)
    J.split_failures(J.read_table_stream(spark, src), F.when(F.col("id") < 3, "E"), good, dead, cp).awaitTermination()
    assert spark.read.parquet(good).count() == 7
    assert {r["error_code"] for r in spark.read.parquet(dead).collect()} == {"E"}


def test_one_even_sample(spark):
    from provenir.operators.sampling import sample_even

    df = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 0)], "item string, idx bigint")
    assert {(r.item, r.idx) for r in sample_even(df, "item", "idx", 1).collect()} == {("a", 0), ("b", 0)}


def test_inventory_reads_long_files_in_pieces(spark, tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "a b.onnx").write_bytes(b"0123456789" * 100)
    (tmp_path / "c.pt").write_bytes(b"small")
    (tmp_path / "e.pt").write_bytes(b"")
    monkeypatch.setattr(M, "PIECE", 64)
    got = {r["name"]: (r["length"], r["sha256"]) for r in M.file_inventory(spark, str(tmp_path), whole=10).collect()}
    want = {"a b.onnx": b"0123456789" * 100, "c.pt": b"small"}  # Spark lists no empty files
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in want.items()}


def folders(tmp_path):
    names = ["top.mp4", "in/a.mp4", "in/b.txt", "in/deep/er/c.mp4", "inner/d.mp4", "out/e.mp4"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(n.encode())
    return names


def test_listing(spark, tmp_path):
    names = folders(tmp_path)
    for depth in (0, 1, 2, 5):
        got = {(r.key, r.size) for r in O.objects(spark, str(tmp_path), depth).collect()} if depth else None
        assert got is None or got == {(n, len(n)) for n in names}
    listed = O.objects(spark, str(tmp_path))
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(listed.filter(F.col("key").startswith("in/"))) == ["in/a.mp4", "in/b.txt", "in/deep/er/c.mp4"]
    assert keys(listed.filter(F.col("key").startswith("in") & F.col("key").endswith(".mp4") & (F.col("size") > 8))) == ["in/deep/er/c.mp4", "inner/d.mp4"]
    assert keys(listed.filter(F.col("key").startswith("none"))) == []
    assert [r.key for r in M.list_objects(listed, "in", 2).collect()] == ["in/a.mp4", "in/b.txt"]


def test_a_prefix_cuts_folders_before_they_are_listed(tmp_path):
    folders(tmp_path)
    r = O.Listing(str(tmp_path), 1)
    assert list(r.pushFilters([O.StringStartsWith(("key",), "in/de")])) == []
    assert [(p.path, p.recursive) for p in r.partitions()] == [("", False), ("in", True)]


def results_below(tmp_path):
    return {str(p.relative_to(tmp_path)): json.loads(p.read_text()) for p in tmp_path.rglob("*") if p.is_file() and "_result.json" in p.name}


def test_results_beside_their_sources(spark, tmp_path):
    folders(tmp_path)
    df = spark.createDataFrame([("in/a.mp4", 0.5), ("in/deep/er/c.mp4", 0.25), ("new/f.mp4", 1.0), ("in/a.mp4", 0.75), (None, 1.0)], "key string, score double")
    want = {"in/a_result.json": {"score": 0.75}, "in/deep/er/c_result.json": {"score": 0.25}, "new/f_result.json": {"score": 1.0}}
    for _ in range(2):  # a replay leaves the same files
        O.write_beside(df, "key", F.struct("score"), str(tmp_path))
        assert results_below(tmp_path) == want


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(20, numPartitions=4).select(F.format_string("k%02d.mp4", "id").alias("key"), F.when(F.col("id") == 17, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="broken"):
        O.write_beside(df, "key", F.struct("n"), str(tmp_path))
    assert not any(tmp_path.rglob("*.json"))
    w = O.Beside(str(tmp_path))
    (tmp_path / "x_result.json.tmp-1").write_text("{}")
    w.abort([None, O.Written([(f"{tmp_path}/x_result.json.tmp-1", f"{tmp_path}/x_result.json")])])
    assert list(tmp_path.iterdir()) == []


def test_results_of_a_stream(spark, tmp_path):
    src, cp, out = (str(tmp_path / x) for x in ("src", "cp", "out"))
    df = entries(spark, 6).select(F.format_string("in/k%d.mp4", "id").alias("key"), "id")
    for part in ("id < 3", "id >= 3"):
        df.filter(part).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(df.schema).parquet(src)
        O.results_stream(s, "key", F.struct("id"), out, cp).awaitTermination()
    assert {k: v["id"] for k, v in results_below(tmp_path).items()} == {f"out/in/k{i}_result.json": i for i in range(6)}
