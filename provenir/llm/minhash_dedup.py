"""Near-duplicate documents: MinHash bands, then sequential Bayesian verification.

A document is the set of its 5-word shingles over ASCII-lower-cased words
``[^\\x20\\x09-\\x0D]+``; a text with fewer words is one shingle. Two documents
link when ``100 * |A & B| >= 75 * |A | B|``.

1. One pass computes for each document the 64-bit shingle hashes, a 128-bit
   digest of the set and 128 minima. Equal sets fall into one class by the
   digest, so copies cost one row each and never form pairs.
2. 32 bands of 4 minima make the buckets: a pair at the threshold escapes all
   bands with probability (1 - .75**4)**32 = 5e-6.
3. Candidates come from ``linked_classes``: members against a hub, then what
   is open. Their signatures are compared in batches of 32 minima; after each
   batch a pair is pruned if the posterior probability of a similarity at or
   above the threshold (uniform prior) is below ``miss``.
4. Survivors are confirmed on the full sets.

Results for odd rows: a null or wordless text has an empty set and links with
nothing; rows that share a doc_id count as one document; a row without doc_id
comes back with a null component and is kept. Only the columns ``doc_id`` and
``text`` are read, so further columns cannot clash. An empty table gives no row.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .catalog import query
from .common import linked_classes, may_hold, table

THRESHOLD = 75
MINIMA = 128
BAND = 4
STEP = 32
MISS = 1e-4

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, n + 1, dtype=np.uint64)
    return mix(k * np.uint64(0x9E3779B97F4A7C15)), mix(k * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


class WordHashes(dict):
    """64-bit hash of a word, kept for words seen before (at most ``most``)."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_set(text: bytes, cache: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text."""
    found = text.lower().split()  # on bytes: A-Z only, and exactly the white space of the contract
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = mix(out + h[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


def minima(shingles: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """One 32-bit minimum for each hash function."""
    low = np.full(len(xor), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        np.minimum(low, ((shingles[k : k + 512, None] ^ xor) * mul).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def texts_of(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """UTF-8 bytes of a text column without a copy as str; null gives b''."""
    return ((x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(batch.schema.get_field_index(name)))


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in column), np.uint32).reshape(-1, MINIMA)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache, (xor, mul) = WordHashes(), _constants(MINIMA)
    for b in batches:
        n, d1, d2, sig = [], [], [], []
        for t in texts_of(b, "text"):
            s = shingle_set(t, cache)
            d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            n.append(len(s))
            d1.append(int.from_bytes(d[:8], "little", signed=True))
            d2.append(int.from_bytes(d[8:], "little", signed=True))
            sig.append(minima(s, xor, mul).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n", "d1", "d2", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x.slice(k, 4096) for x in batches for k in range(0, x.num_rows, 4096)):
        sig = _signatures(b.column(1)).reshape(b.num_rows, MINIMA // BAND, BAND)
        key = np.broadcast_to(np.arange(1, MINIMA // BAND + 1, dtype=np.uint64), sig.shape[:2])
        for k in range(BAND):
            key = mix(key + sig[:, :, k] + np.uint64(0x9E3779B97F4A7C15))
        item = np.repeat(np.asarray(b.column(0)), MINIMA // BAND)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(item)], ["bucket", "item"])


@functools.cache
def least_matches(threshold: float, miss: float, step: int, total: int) -> tuple[int, ...]:
    """Fewest matches after ``step``, ``2 * step``, ... minima with posterior P(similarity >= threshold) >= miss.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1);
    for whole numbers its upper tail is a binomial sum.
    """
    out = []
    for n in range(step, total + 1, step):
        tail, m = 0.0, -1
        while tail < miss:  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, text, sig): signature and set as one value."""
    cache = WordHashes()
    for b in (x.slice(k, 256) for x in batches for k in range(0, x.num_rows, 256)):
        data = [s.as_buffer().to_pybytes() + shingle_set(t, cache).tobytes() for s, t in zip(b.column(2), texts_of(b, "text"))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(data, pa.binary())], ["item", "weight", "data"])


def _near(left: list[bytes], right: list[bytes], i: np.ndarray, j: np.ndarray, bounds: tuple[int, ...]) -> np.ndarray:
    """Pairs whose sizes allow a link and that no batch of minima prunes."""
    nx, ny = (np.fromiter(map(len, v), np.int64, len(v)) // 8 - MINIMA // 2 for v in (left, right))
    x, y = (np.frombuffer(b"".join(v[: 4 * MINIMA] for v in side), np.uint32).reshape(-1, MINIMA) for side in (left, right))
    alive = np.flatnonzero(100 * np.minimum(nx[i], ny[j]) >= THRESHOLD * np.maximum(nx[i], ny[j]))
    same = np.zeros(len(i), np.int64)
    for k, least in enumerate(bounds):
        s = slice(k * STEP, (k + 1) * STEP)
        same[alive] += (x[i[alive], s] == y[j[alive], s]).sum(axis=1)
        alive = alive[same[alive] >= least]
    good = np.zeros(len(i), bool)
    good[alive] = True
    return good


def _linked(left: list[bytes], right: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that link by their full sets."""
    good = np.zeros(len(i), bool)
    for k, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = np.frombuffer(left[p], np.uint64, offset=4 * MINIMA), np.frombuffer(right[q], np.uint64, offset=4 * MINIMA)
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        good[k] = 100 * shared >= THRESHOLD * (len(a) + len(b) - shared)
    return good


def near_duplicates(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``.

    ``miss``: posterior probability below which a candidate is given up.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = materialize(docs.mapInArrow(_sketches, "doc_id bigint, n bigint, d1 bigint, d2 bigint, sig binary"), "mh-each")
    named = each.filter("doc_id is not null and n > 0")
    firsts = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("item"), F.min_by("sig", "doc_id").alias("sig"))
    firsts = materialize(firsts, "mh-firsts")
    buckets = firsts.select("item", "sig").mapInArrow(_bands, "bucket bigint, item bigint")

    def loader(items: DataFrame) -> DataFrame:
        some = may_hold(docs.withColumnRenamed("doc_id", "item"), F.xxhash64("item"), items, F.xxhash64("item")).join(items, "item")
        sigs = firsts.join(items, "item").select("item", "sig").dropDuplicates(["item"])
        return some.join(sigs, "item").select("item", "text", "sig").mapInArrow(_data, "item bigint, weight bigint, data binary").dropDuplicates(["item"])

    near = functools.partial(_near, bounds=least_matches(THRESHOLD / 100, miss, STEP, MINIMA))
    classes = firsts.select("d1", "d2", "item")
    labels = linked_classes(buckets, loader, near, _linked, "mh").withColumnRenamed("node", "item")
    rows = each.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").withColumn("item", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("item")))
    rows = rows.join(labels, "item", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "item", "doc_id").alias("component_id"))
    return rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the first of their group; a repeated doc_id stays once for each row."""
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(materialize(gone, "mh-gone"), "doc_id", "left_anti")


@query("op1_minhash_dedup")
def op1(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
