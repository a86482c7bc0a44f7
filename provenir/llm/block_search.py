"""Nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt into groups by a hash of their id, and each
group of queries meets each group of candidates in one cell: every vector is
sent to the cells of its group in one shuffle, without a join, so nothing is
broadcast. The groups are as many as make both sides' copies weigh the same. A
task holds the queries of its cell, a bounded number, and streams the cell's
candidates past them in blocks. There the vectors, scaled to int8, are
multiplied as one matrix product (whole numbers, exact in float32 up to 1,040
components, else in float64). With the norms of the rounding residues known, the
product bounds the true distance from both sides. A pair survives unless its
lower bound is above the k-th smallest upper bound of its query in this tile, or
above the k-th distance found so far; survivors are recomputed in float64 on the
original vectors and merged into the k best of their query. The cells' short
lists are merged by rank. The bounds are safe, so the search is exact and recall
is 1.

Odd rows: a vector that is null, all zero, or has a null or non-finite
component takes no part, neither does one without a vec_id; vectors of
different lengths never meet; rows that repeat a vec_id count once, with the
least of their vectors. Ties go to the smaller vec_id. Fewer than k candidates
give fewer rows. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import query
from .common import table

K = 10
BLOCK = 4096
STEP = 100

#: Queries that a task holds, in blocks, and those that are multiplied at once.
HELD, SLICE = 4, 256


def clean_vectors(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, v, dim) that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    some = some.filter(finite & F.exists("v", lambda x: x != 0))
    return some.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def _cells(vectors: DataFrame, step: int, n_q: int, n_c: int) -> DataFrame:
    """A row for each cell (q, c) that a vector takes part in, and whether as a candidate; a cell's queries come first."""
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    place = lambda q, c, candidate: F.struct(q.alias("q"), c.alias("c"), F.lit(candidate).alias("candidate"))
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    asked = F.when(F.col("vec_id") % step == 0, F.transform(every(n_c), lambda c: place(own(n_q), c, False)))
    met = F.transform(every(n_q), lambda q: place(q, own(n_c), True))
    rows = vectors.withColumn("at", F.explode(F.concat(met, F.coalesce(asked, F.slice(met, 1, 0)))))
    rows = rows.select("dim", "at.q", "at.c", "at.candidate", "vec_id", "v")
    return rows.repartition("dim", "q", "c").sortWithinPartitions("dim", "q", "c", "candidate")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, their scale, and the norms of the rounded vector and of the residue, by row."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1  # smaller than the least normal number
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


class _Cell:
    """The queries of a cell, in slices, with the k nearest of the candidates that have come so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.k, self.exact = k, np.float32 if vectors.shape[1] <= 1040 else np.float64
        self.slices = []
        for s in range(0, len(ids), SLICE):
            q = vectors[s : s + SLICE]
            best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            self.slices.append([ids[s : s + SLICE], q, quantised(q), (q * q).sum(axis=1), best])

    def add(self, cid: np.ndarray, c: np.ndarray) -> None:
        """Merge a block of candidates."""
        ci, cs, cn, ce = quantised(c)
        ci, norms = ci.T.astype(self.exact), (c * c).sum(axis=1)
        for part in self.slices:
            qid, q, (qi, qs, qn, qe), own, (rows, ids, score) = part
            # as rows are sorted by query and score, the last of k rows is the k-th
            known = np.full(len(qid), np.inf)
            last = np.searchsorted(rows, np.arange(len(qid)), "right") - 1
            full = np.bincount(rows, minlength=len(qid)) == self.k
            known[full] = score[last[full]] ** 2 * (1 + 1e-12)
            error = 2 * (qn[:, None] * ce + qe[:, None] * (cn + ce)) + 1e-12 * (own[:, None] + norms)
            middle = (qi.astype(self.exact) @ ci).astype(np.float64)
            middle *= qs[:, None] * (-2 * cs)
            middle += own[:, None] + norms
            same = np.nonzero(qid[:, None] == cid)
            if not full.all() and len(cid) > self.k:
                upper = middle + error
                upper[same] = np.inf
                known = np.fmin(known, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
            middle -= error
            near = ~(middle > known[:, None])  # a bound that is not a number excludes nothing
            near[same] = False
            i, j = np.nonzero(near)
            if not len(i):
                continue
            found = [np.sqrt(((q[i[s : s + 65536]] - c[j[s : s + 65536]]) ** 2).sum(axis=1)) for s in range(0, len(i), 65536)]
            rows, ids, score = np.concatenate([rows, i]), np.concatenate([ids, cid[j]]), np.concatenate([score, *found])
            order = np.lexsort((ids, score, rows))
            rows, ids, score = rows[order], ids[order], score[order]
            kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
            part[4] = rows[kept], ids[kept], score[kept]

    def out(self) -> Iterator[pa.RecordBatch]:
        for qid, _, _, _, (rows, ids, score) in self.slices:
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(qid[rows]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])


def _search(k: int, block: int):
    """Rows sorted by (dim, q, c, candidate) as the k nearest of each query within its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell, held, count = None, None, [], 0

        def take() -> tuple[np.ndarray, np.ndarray]:
            got = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            return got

        def settle() -> Iterator[pa.RecordBatch]:
            if held and cell is not None:
                cell.add(*take())
            if cell is not None:
                yield from cell.out()

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([np.asarray(b.column(n).cast(pa.int32())) for n in range(4)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                here, candidate = tuple(keys[:3, s].tolist()), bool(keys[3, s])
                if here != at:
                    with np.errstate(all="ignore"):
                        yield from settle()
                    at, cell, count = here, None, 0
                    held.clear()
                if candidate and cell is None:
                    if not held:
                        continue  # no query in this cell
                    cell, count = _Cell(*take(), k), 0
                while s < e:
                    n = min(e - s, block - count) if candidate else e - s
                    ids = np.asarray(b.column(4).slice(s, n)).astype(np.int64)
                    held.append((ids, np.asarray(b.column(5).slice(s, n).flatten()).astype(np.float64).reshape(n, here[0])))
                    s, count = s + n, count + n
                    if candidate and count == block:
                        with np.errstate(all="ignore"):
                            cell.add(*take())
                        count = 0
        with np.errstate(all="ignore"):
            yield from settle()

    return run


def nearest(rows: DataFrame, k: int = K, step: int = STEP, block: int = BLOCK) -> DataFrame:
    """The k nearest rows of every row whose vec_id is a multiple of ``step``: (query_id, rank, vec_id, score)."""
    count, asked = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id").cast("bigint") % step == 0)).first()
    n_q = max(1, -(-asked // (HELD * block)))
    n_c = max(1, min(-(-count // block), -(-n_q * count // max(1, asked))))
    found = _cells(clean_vectors(rows), step, n_q, n_c).mapInArrow(_search(k, block), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM v AS q JOIN v AS c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, score FROM p QUALIFY rank <= 10
"""


@query("op5_block_search", SQL)
def op5(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))
