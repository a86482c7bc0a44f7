"""WARC index, whitening and ranked search: against brute force, and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from provenir.llm import ranked_search, warc_index, whitening
from provenir.llm.token_files import _open
from provenir.session import scratch_dir

PAGES = "page_id bigint, url string, html string, file string, at string, refers_to string"


def page_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES).repartition(3)


def round_trip(spark, pages, least=0, lines=3, **kw):
    folder = scratch_dir(spark, "t-warc")
    captures = warc_index.write_archives(pages, folder, least, **kw)
    directory = warc_index.write_index(captures, folder, lines)
    places = warc_index.find_captures(pages.select("url", "page_id"), directory, folder)
    return folder, captures, directory, warc_index.read_records(places, folder, 4096)


PAGE_ROWS = [(k, f"http://h{k % 3}.example.org/p{k}", f"<p>page {k % 11}</p>") for k in range(40)]
PAGE_ROWS += [(50, None, None), (51, None, ""), (52, "http://a.example/x y\nz", "ünï\r\n\r\ncode"), (53, "HTTP://User@WWW.Example.com:80", "x" * 300_000)]
PAGE_ROWS += [(None, "http://n.example/", "<p>page 3</p>"), (None, "http://m.example/", "only here"), (60, "http://one.example/a", "same url"), (61, "http://one.example/a", "same url, other")]
PAGE_ROWS += [(62, "http://d.example/", "twice"), (62, "http://d.example/", "twice"), (62, "http://d.example/", "not twice")]


def expected_pages(rows, least=0):
    top = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= least:
            top[html or ""] = max(page, top.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = top.get(html or "")
        again = to is not None and page != to
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 12])
def test_warc_round_trip(spark, least):
    _, captures, directory, got = round_trip(spark, page_table(spark, PAGE_ROWS), least, file_bytes=2000)
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[f] for f in fields) for r in got.collect()), key=str) == expected_pages(PAGE_ROWS, least)
    assert captures.select("file").distinct().count() > 3  # archives are closed at their size
    assert directory.agg({"n_captures": "sum"}).first()[0] == len(PAGE_ROWS)


def test_warc_files_are_gzip_records(spark):
    folder, captures, _, _ = round_trip(spark, page_table(spark, PAGE_ROWS))
    store, root = _open(folder)
    for r in captures.groupBy("file").agg({"size": "sum"}).collect():
        data = store.open_input_file(f"{root}/{r[0]}").read()
        assert len(data) == r[1]
        while data:
            one = zlib.decompressobj(wbits=31)
            text = one.decompress(data)
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: re") and text.endswith(b"\r\n\r\n")
            data = one.unused_data


def test_warc_look_up_reads_little(spark):
    rows = [(k, f"http://h{k % 7}.example.org/{k}", f"p{k}") for k in range(2000)]
    folder, _, directory, _ = round_trip(spark, page_table(spark, rows), lines=16)
    tops = [tuple(r) for r in directory.select("first_key", "first_page", "index_file", "at", "size").collect()]
    for page, url, _ in random.Random(1).sample(rows, 20):
        index = warc_index.CaptureIndex(folder, tops)
        assert len(index.find(warc_index.url_key(url), page)) == 1
        assert index.reads <= 6  # directories and blocks at most on either side of a border
        assert index.find(warc_index.url_key(url), page + 5000) == []
        index.close()


def test_warc_damaged_payload_is_noticed():
    good = warc_index.record(7, "http://a.example/", b"payload", None)
    assert warc_index.parsed(good)[:2] == (7, 7)
    bad = zlib.compressobj(wbits=31)
    text = zlib.decompress(good, wbits=31).replace(b"\r\n\r\npayload", b"\r\n\r\npaYload")
    with pytest.raises(ValueError):
        warc_index.parsed(bad.compress(text) + bad.flush())


def test_url_keys():
    key = warc_index.url_key
    assert key("http://www.Example.com/A?b=C#d") == "com,example,www)/A?b=C"
    assert key("https://u@example.com:8080") == "com,example:8080)/"
    assert key("//b.a") == "a,b)/"
    assert key("Mailto:X") == "mailto:x" and key(None) == "" and key("") == ""


def test_warc_empty_table(spark):
    assert round_trip(spark, spark.createDataFrame([], PAGES))[3].collect() == []


VECTORS = "vec_id bigint, embedding array<float>, n bigint, component string, x int"


def vector_table(spark, rows):
    return spark.createDataFrame([(k, v, None, "c", 1) for k, v in rows], VECTORS).repartition(4)


def check_whitened(got, vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, d = x.shape
    y = n * x - x.sum(axis=0)
    cov = (y / n).T @ (y / n) / n
    values, v = np.linalg.eigh(cov)
    values, v = values[::-1], v[:, ::-1]
    some = int((values[:k] > d * 2.0**-52 * values[0]).sum()) if values[0] > 0 else 0
    assert len(got) == n * some
    if not some:
        return
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, some + 1))
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(map(int, (y.astype(object) ** 2).sum(axis=1)))
    assert max(r.identity_error for r in got) < 1e-9
    for c in range(1, some + 1):
        mine = [r for r in got if r.component == c]
        assert math.isclose(mine[0].explained, values[c - 1] / np.trace(cov), rel_tol=1e-9)
    return values, v, y / n


def test_whitening_against_dense(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 20)) * np.linspace(0.1, 2, 20)).astype(np.float32).tolist()
    got = whitening.whitened(vector_table(spark, list(enumerate(vectors)))).collect()
    values, v, c = check_whitened(got, vectors)
    for comp in range(1, 9):
        mine = np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == comp])
        want = c @ v[:, comp - 1] / math.sqrt(values[comp - 1])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [-1.5, 2.25, 9.0], [3.0, -1.0, 0.25]]
    rows = list(zip([1, 2, 2, None, 5], good)) + [(6, None), (7, []), (8, [1.0, None, 2.0]), (9, [nan, 1.0, 1.0]), (10, [inf, 0.0, 0.0]), (11, [1.0, 2.0]), (12, [3e38, 0.0, 0.0])]
    got = whitening.whitened(vector_table(spark, rows)).collect()
    check_whitened(got, good)
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got if r.component == 1) == [(False, 1), (False, 2), (False, 2), (False, 5), (True, 0)]
    flat = whitening.whitened(vector_table(spark, [(1, [1.0, 2.0]), (2, [3.0, 6.0]), (3, [5.0, 10.0])])).collect()  # rank one
    check_whitened(flat, [[1.0, 2.0], [3.0, 6.0], [5.0, 10.0]])
    for rows in ([], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(4)], [(1, None)]):
        assert whitening.whitened(vector_table(spark, rows)).collect() == []


@pytest.mark.parametrize("d,k", [(1, 8), (8, 8), (9, 8), (120, 5)])
def test_jacobi_davidson(d, k):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((3 * d, d))
    v = a.T @ a
    values, vectors = whitening.leading_pairs(lambda u: v @ u, d, k)
    want = np.linalg.eigvalsh(v)[::-1][: min(k, d)]
    assert np.allclose(values, want, rtol=1e-12)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_jacobi_davidson_equal_values():
    v = np.diag([4.0, 4, 4, 4, 4, 2, 2, 1, 1, 0, 0, 0])
    values, vectors = whitening.leading_pairs(lambda u: v @ u, 12, 6)
    assert np.allclose(values, [4, 4, 4, 4, 4, 2]) and np.allclose(vectors.T @ vectors, np.eye(6))


def test_exact_offsets_of_any_size():
    x = np.array([[2**61, -(2**61)], [5, 7]])
    sums = [int(s) for s in x.astype(object).sum(axis=0)]
    y = whitening.offsets(x, 2, sums)
    assert y.tolist() == [[2 * 2**61 - sums[0], -2 * 2**61 - sums[1]], [10 - sums[0], 14 - sums[1]]]
    assert whitening.square_sums(y) == [sum(v * v for v in r) for r in y.tolist()]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k=50):
    held = [(d, TERM.findall((t or "").translate(LOW))) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOW)))
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for i, words in asked.items():
        scores = []
        for d, t in held:
            m = 50 + 50 * len(t) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * t.count(w) // (1000 * t.count(w) + 20 * m)) for w in words if w in t)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def doc_table(spark, rows):
    return spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id bigint, text string, score bigint, rank bigint").repartition(3)


def item_table(spark, rows):
    return spark.createDataFrame([(d, t, 0) for d, t in rows], "item_id bigint, text string, doc_id bigint").repartition(2)


def test_search_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["École", "naïve", "x_y", "A-B"]
    docs = [(d, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(64)], k=rng.randint(1, 80)))) for d in range(300)]
    docs += [(400, docs[5][1]), (399, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (401, None), (402, ""), (403, "-- !"), (404, "w1 w2 " * 20_000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for k in range(12)] + [(20, None), (21, "?!"), (22, "absent"), (None, "w1"), (23, "W3 w3"), (23, "w4\nw5")]
    want = ranked(docs, items)
    for kw in ({}, {"shard": 40}, {"block_bytes": 700}):
        got = ranked_search.search(doc_table(spark, docs), item_table(spark, items), **kw)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect())) == want
    short = ranked_search.search(doc_table(spark, docs), item_table(spark, items), k=3)
    assert sorted(map(tuple, short.collect())) == ranked(docs, items, 3)


def test_search_empty_tables(spark):
    none, some = doc_table(spark, [(1, None)]), doc_table(spark, [(1, "a b")])
    assert ranked_search.search(none, item_table(spark, [(1, "a")])).collect() == []
    assert ranked_search.search(some.limit(0), item_table(spark, [(1, "a")])).collect() == []
    assert ranked_search.search(some, item_table(spark, [(1, "a")]).limit(0)).collect() == []


def test_best_positions_stop_early():
    """One document leads both lists; the rest is in reversed order, so last-read positions alone would go on."""
    n = 4000
    doc = np.concatenate([np.arange(n), np.arange(n)])
    term = np.repeat([0, 1], n)
    impact = np.concatenate([np.r_[10**6, np.arange(n - 1, 0, -1)], np.r_[10**6, np.arange(1, n)]])
    shard = ranked_search.Shard(doc, term, impact, n, 2)
    found, score, reads = shard.best(np.array([0, 1]), np.arange(n), 1, 16)
    assert found.tolist() == [0] and score.tolist() == [2 * 10**6] and reads <= 64


@pytest.mark.parametrize("seed", range(5))
def test_best_positions_with_ties(seed):
    rng = np.random.default_rng(seed)
    n, lists = 200, 5
    some = rng.random((lists, n)) < 0.4
    term, doc = np.nonzero(some)
    impact = rng.integers(1, 5, len(term))
    shard = ranked_search.Shard(doc, term, impact, n, lists)
    total = np.bincount(doc, impact, n).astype(int)
    want = sorted((-s, d) for d, s in enumerate(total.tolist()) if s > 0)[:10]
    found, score, _ = shard.best(np.arange(lists), np.arange(n), 10, 3)
    assert [(-s, d) for d, s in zip(found.tolist(), score.tolist())] == want
