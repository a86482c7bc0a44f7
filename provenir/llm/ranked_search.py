r"""Ranked lexical search by the Best Position Algorithm.

Terms are the maximal matches of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` in
whole texts, A-Z in lower case. With N documents that hold a term, L terms in
all, n terms in a document, tf occurrences of a term there and df documents that
hold it, a term adds ``w * ((1000000000 * tf) div (1000 * tf + 20 * m))`` with
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and
``m = 50 + (50 * n * N) div L``; an item counts each of its terms once.

1. ``postings``: one pass over the documents counts, for the terms of the items
   alone, what each document holds of them; a row is a document with two packed
   arrays, so no occurrence is shuffled. N, L and the df are sums over it.
2. The rows are dealt into shards of up to ``SHARD`` documents. A shard turns
   its rows into impact lists: for each term the documents by falling impact,
   and the place of each document in that order for direct access.
3. For each item a shard reads the impact lists in step (sorted access). A
   document that shows up is looked up in all the other lists (direct access):
   that gives its score and marks its places there as seen. The best position of
   a list is the last one of the run of seen places that starts at its top, so
   it runs ahead of what was read. No unseen document can score above the sum of
   the impacts at the best positions; reading stops once that sum is strictly
   below the k-th score, so that no tie is missed.
4. The k best of every shard are merged to the k best of all.

Items are taken in blocks of bounded size, as their terms are sent to every task.

Odd rows: a null text has no term; a document without terms counts nowhere; one
without doc_id counts in N, L and df but is in no result; rows that share a
doc_id are documents of their own and may stand twice in a result. Rows of items
that share an item_id are one item with the terms of all; those without item_id
are left out. Items without terms, or without a document of positive score, have
no row; nor have empty tables. Only ``doc_id``, ``item_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .catalog import query
from .common import table
from .minhash_dedup import texts_of

K = 50
SHARD = 16_384
#: Bytes of item texts whose terms go to the tasks at once (one text may be longer); places of each list that one step reads.
BLOCK_BYTES, DEPTH = 4 << 20, 64

_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in order."""
    return text.translate(_TERM_BYTES).split()


def _counts(vocabulary: Broadcast):
    """Rows (doc_id, n, ids, tfs): of each document with a term, the known terms as packed 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in (x.slice(k, 1024) for x in batches for k in range(0, x.num_rows, 1024)):
            doc, size, ids, tfs = [], [], [], []
            for d, text in zip(b.column(0).to_pylist(), texts_of(b, "text")):
                found = terms(text)
                if found:
                    held = Counter(map(known.get, found))
                    held.pop(None, None)
                    doc.append(d)
                    size.append(len(found))
                    ids.append(np.fromiter(held.keys(), np.int32, len(held)).tobytes())
                    tfs.append(np.fromiter(held.values(), np.int32, len(held)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "ids", "tfs"])

    return run


def postings(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(texts.mapInArrow(_counts(vocabulary), "doc_id bigint, n bigint, ids binary, tfs binary"), "bpa-postings")


def _held(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(_flat(b.column(0))[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    return run


def _flat(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all packed rows, and how many each row has."""
    parts = [x.as_buffer().to_pybytes() for x in column]
    return np.frombuffer(b"".join(parts), np.int32), np.array([len(p) // 4 for p in parts], np.int64)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of each document; whole numbers of any size while they are formed."""
    wide = n if 50 * docs * int(n.max(initial=0)) < 1 << 63 else n.astype(object)
    return (50 + 50 * wide * docs // total).astype(np.int64)


class Shard:
    """Impact lists over documents 0 .. size - 1.

    List t is the stretch ``starts[t] : starts[t + 1]`` of ``by_impact`` (documents
    by falling impact) and ``impact``; the same stretch of ``by_doc`` and ``place``
    gives for each document, in ascending order, its place in that list.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int, lists: int):
        order = np.lexsort((doc, -impact, term))
        self.size = size
        self.starts = np.searchsorted(term[order], np.arange(lists + 1))
        self.by_impact, self.impact = doc[order], impact[order]
        place = np.arange(len(order)) - self.starts[term[order]]
        again = np.lexsort((self.by_impact, term[order]))
        self.by_doc, self.place = self.by_impact[again], place[again]

    def best(self, item: np.ndarray, ids: np.ndarray, k: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents of an item (a list of term numbers) with positive scores, falling, ties by ``ids``; and the number of sorted accesses."""
        lists = [(int(s), int(e)) for s, e in zip(self.starts[item], self.starts[item + 1]) if e > s]
        seen, score = np.zeros(self.size, bool), np.zeros(self.size, np.int64)
        marked = [np.zeros(e - s, bool) for s, e in lists]
        best = [0] * len(lists)
        touched: list[np.ndarray] = []
        at = reads = 0
        while True:
            fresh = []
            for s, e in lists:
                stretch = self.by_impact[s + at : min(e, s + at + depth)]
                reads += len(stretch)
                fresh.append(stretch[~seen[stretch]])
                seen[stretch] = True
            new = np.unique(np.concatenate(fresh)) if fresh else np.empty(0, np.int64)
            at += depth
            bound = 0
            for j, (s, e) in enumerate(lists):
                if len(new):
                    i = np.searchsorted(self.by_doc[s:e], new)
                    i[i == e - s] = 0
                    hit = self.by_doc[s + i] == new
                    places = self.place[s + i[hit]]
                    score[new[hit]] += self.impact[s + places]
                    marked[j][places] = True
                if best[j] < e - s:
                    ahead = marked[j][best[j] :]
                    best[j] = e - s if ahead.all() else best[j] + int(ahead.argmin())
                if best[j] < e - s:
                    bound += int(self.impact[s + best[j] - 1])  # every list is read from its top, so its first place is seen
            if len(new):
                touched.append(new)
            found = np.concatenate(touched) if touched else np.empty(0, np.int64)
            if bound == 0 or (len(found) >= k and bound < np.partition(score[found], len(found) - k)[len(found) - k]):
                found = found[score[found] > 0]
                order = np.lexsort((ids[found], -score[found]))[:k]
                return found[order], score[found[order]], reads


def _searched(items: Broadcast, stats: tuple[int, int], k: int, shard: int):
    """Rows (item_id, doc_id, score): the k best of each item in every ``shard`` rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, w = items.value

        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids = np.array(b.column(0))
            (term, per), (tf, _) = _flat(b.column(2)), _flat(b.column(3))
            doc = np.repeat(np.arange(len(ids)), per)
            m = lengths(np.asarray(b.column(1)), *stats)
            impact = w[term] * (1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 20 * m[doc]))
            some = impact > 0
            lists_here = Shard(doc[some], term[some], impact[some], len(ids), len(w))
            for name, item in lists:
                found, score, _ = lists_here.best(item, ids, k)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), name)), pa.array(ids[found]), pa.array(score)], ["item_id", "doc_id", "score"])

        held, count = [], 0
        for b in (x.slice(s, 1024) for x in batches for s in range(0, x.num_rows, 1024)):
            held.append(b)
            count += b.num_rows
            if count >= shard:
                yield from out(held)
                held, count = [], 0
        if count:
            yield from out(held)

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x.slice(k, 256) for x in batches for k in range(0, x.num_rows, 256)):
        each = [sorted(set(terms(t))) for t in texts_of(b, "text")]
        item = np.repeat(np.asarray(b.column(0)), [len(e) for e in each])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([t.decode() for e in each for t in e], pa.string())], ["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """Rows (item_id, term), each once."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL")
    return materialize(rows.mapInArrow(_item_terms, "item_id bigint, term string").distinct(), "bpa-items")


def search(docs: DataFrame, items: DataFrame, k: int = K, shard: int = SHARD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of every item: (item_id, rank, doc_id, score)."""
    spark = docs.sparkSession
    asked = item_terms(items)
    size = asked.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = -(-int(size) // block_bytes)
    out = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about block_bytes
        known = {t: i for i, t in enumerate(sorted({r.term.encode() for r in part}))}
        each: dict[int, list[int]] = {}
        for r in part:
            each.setdefault(r.item_id, []).append(known[r.term.encode()])
        if not each:
            continue
        found = postings(docs, spark.sparkContext.broadcast(known))
        n_docs, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(known), np.int64)
        for r in found.select("ids").mapInArrow(_held(len(known)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df  # a row for each term of the block at most
        shared = spark.sparkContext.broadcast(([(name, np.array(e, np.int64)) for name, e in each.items()], weights(df, n_docs)))
        dealt = found.filter("doc_id IS NOT NULL").repartition(max(1, -(-n_docs // shard)))
        best = dealt.mapInArrow(_searched(shared, (n_docs, total), k, 2 * shard), "item_id bigint, doc_id bigint, score bigint")
        out = out.unionByName(materialize(best, "bpa-best"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS t FROM documents),
s AS (SELECT count(*) AS big_n, sum(len(t))::BIGINT AS big_l FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark WHERE item_id IS NOT NULL),
o AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term),
p AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term), s WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id, r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM p WHERE score > 0 QUALIFY rank <= 50
"""


@query("op13_ranked_search", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
