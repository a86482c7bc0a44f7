"""Whitening of embeddings: leading eigenpairs of their covariance by Jacobi-Davidson.

Entries become whole numbers, ``x = floor(1024 * c) + 100000``. With the sums S
of all n vectors, ``n * x - S`` is a whole number too and is formed exactly; its
n-th part is the centred value. Centred vectors are stored once, in packs of
bounded size; the covariance is never formed.

Jacobi-Davidson, in blocks:

1. ``covariance_product`` multiplies the covariance with a few vectors at once:
   every pack adds ``C.T @ (C @ U)``, and the sums are added up in a tree. This
   is all that touches the rows, and all that a step of the method needs of
   them; what the driver holds is the basis, d numbers for each vector.
2. Rayleigh-Ritz: the dense eigenproblem of the basis gives Ritz pairs. A pair
   whose residual is at the level of double precision is locked.
3. For each other wanted pair the correction equation
   ``(I - QQ')(A - t I)(I - QQ') z = -r`` (Q: locked and current Ritz vectors)
   is solved by a few steps of MINRES. All equations of a round go in step, so
   that a step is one product. The corrections widen the basis.
4. A full basis is restarted from its best Ritz vectors.

The sign of a component makes its largest entry positive, the first of equals.

Odd rows: a row takes no part if its vector is null or empty, holds a null or
non-finite entry, or an entry whose x does not fit a long, or has another length
than most vectors (of equally frequent lengths the longest). A null vec_id and
repeated rows are rows like others. Components without variance (an eigenvalue
of at most d * 2**-52 of the largest) cannot be whitened and have no rows, so
equal vectors give no row; nor does an empty table. ``deviation`` is null where
it does not fit a long (n beyond some 10**6); ``deviation_wide`` has it up to 38
digits. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .catalog import query
from .common import table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bytes of centred vectors in a pack; packs that one task takes; partial sums that the driver adds without a tree.
PACK_BYTES, FAN = 8 << 20, 64
BASIS, INNER, ROUNDS = 48, 12, 400

_LONG = float(1 << 63)


def whole_vectors(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, x array<bigint>) that take part."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.lit(SCALE) * c)
    fits = ~F.exists("y", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) >= F.lit(_LONG - 2.0**20)))
    some = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled.alias("y")).filter(F.col("y").isNotNull() & (F.size("y") > 0)).filter(fits)
    some = some.select("vec_id", F.transform("y", lambda y: F.floor(y) + F.lit(SHIFT)).alias("x"))
    lengths = some.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    usual = lengths.agg(F.max(F.struct("n", "d")).alias("most")).select(F.col("most.d").alias("_d"))
    return some.join(F.broadcast(usual), F.size("x") == F.col("_d")).drop("_d")  # one row


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of rows and exact sums by dimension, as text, of a partition."""
    n, sums = 0, None
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(0))
            # Halves of 32 bits: the sum of either over a batch fits a long.
            part = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            n, sums = n + b.num_rows, part if sums is None else sums + part
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in sums]])], ["n", "sums"])


def totals(whole: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of every dimension over all rows."""
    parts = whole.select("x").mapInArrow(_totals, "n bigint, sums array<string>")
    rows = parts.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    rows.sort(key=lambda r: r.i)  # one row for each dimension
    return (int(rows[0].n), [int(r.s) for r in rows]) if rows else (0, [])


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: as longs where these hold it, else as Python's whole numbers."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    return n * x - np.array(sums, np.int64) if most < 1 << 63 else n * x.astype(object) - np.array(sums, object)


def square_sums(y: np.ndarray) -> list[int]:
    """Exact sums of squares by row."""
    if y.dtype == object or max(abs(int(y.max())), abs(int(y.min()))) ** 2 * y.shape[1] >= 1 << 63:
        y = y.astype(object)
    return (y * y).sum(axis=1).tolist()


def _centred(n: int, sums: list[int], rows: int):
    """Packs of up to ``rows`` centred vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in (x.slice(k, rows) for x in batches for k in range(0, x.num_rows, rows)):
            held.append((offsets(_matrix(b.column(0)), n, sums) / n).astype("<f8"))
            count += b.num_rows
            if count >= rows:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["c"])
                held, count = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["c"])

    return run


def _products(u: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(u.shape)
        for b in batches:
            for c in b.column(0):
                c = np.frombuffer(c.as_buffer(), "<f8").reshape(-1, len(u))
                out += c.T @ (c @ u)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["s"])

    return run


def _added(shape: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for b in batches:
            for s in b.column(0):
                out += np.frombuffer(s.as_buffer(), "<f8").reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["s"])

    return run


def summed(parts: DataFrame, shape: tuple[int, ...], count: int) -> np.ndarray:
    """Sum of ``count`` rows of packed numbers; the driver gets at most ``FAN`` rows."""
    while count > FAN:
        count = -(-count // FAN)
        parts = parts.repartition(count).mapInArrow(_added(shape), "s binary")
    out = np.zeros(shape)
    for r in parts.collect():
        out += np.frombuffer(r.s, "<f8").reshape(shape)
    return out


def covariance_product(packs: DataFrame, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """``u -> V @ u`` for the covariance V of the packed centred vectors and a few columns u."""
    count = packs.rdd.getNumPartitions()
    return lambda u: summed(packs.mapInArrow(_products(u), "s binary"), u.shape, count) / n


def orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What the columns of ``new`` add to an orthonormal basis, orthonormal itself."""
    out = []
    for v in new.T:
        size = np.linalg.norm(v)
        for _ in range(3):  # repeated, as one pass leaves rounding errors
            v = v - basis @ (basis.T @ v)
            for o in out:
                v = v - o * (o @ v)
        if np.linalg.norm(v) > 1e-10 * size:
            out.append(v / np.linalg.norm(v))
    return np.stack(out, axis=1) if out else np.empty((len(basis), 0))


def minres(product: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, q: np.ndarray, rhs: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Approximate solutions of the projected equations, one for each column, by MINRES steps taken together."""
    away = lambda v: v - q @ (q.T @ v)
    b = away(rhs)
    beta = np.linalg.norm(b, axis=0)
    first, size = beta.copy(), np.where(beta > 0, beta, 1)
    v_old, v = np.zeros_like(b), b / size
    w_old, w, z = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    beta = np.zeros_like(first)
    c_old, s_old, c, s, eta = (np.ones_like(first), np.zeros_like(first), np.ones_like(first), np.zeros_like(first), first.copy())
    live = first > 0
    for _ in range(steps):
        y = away(product(v) - v * shifts) - v_old * beta
        alpha = (v * y).sum(axis=0)
        y = y - v * alpha
        beta_new = np.linalg.norm(y, axis=0)
        # Two Givens rotations clear the new column of the tridiagonal matrix.
        delta, rho2, rho3 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        rho1 = np.hypot(delta, beta_new)
        live = live & (rho1 > 0)
        safe = np.where(live, rho1, 1)
        c_old, s_old, c, s = c, s, np.where(live, delta / safe, 1), np.where(live, beta_new / safe, 0)
        w_new = (v - w_old * rho3 - w * rho2) / safe
        z = z + np.where(live, c * eta, 0) * w_new
        eta = np.where(live, -s * eta, eta)
        w_old, w = w, w_new
        v_old, v, beta = v, y / np.where(beta_new > 0, beta_new, 1), beta_new
        live = live & (beta_new > 1e-14 * np.abs(shifts)) & (np.abs(eta) > tol * first)
        if not live.any():
            break
    return away(z)


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, basis: int = BASIS, inner: int = INNER, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors (d x k) of a symmetric operator without negative ones."""
    k = min(k, d)
    basis = min(d, max(basis, 4 * k))
    locked, values = np.empty((d, 0)), []
    v = orthonormal(np.random.default_rng(12).standard_normal((d, k)), locked)
    av = product(v)
    for _ in range(rounds):
        theta, small = np.linalg.eigh((v.T @ av + av.T @ v) / 2)
        order = np.argsort(-theta)
        theta, small = theta[order], small[:, order]
        want = k - len(values)
        u, au = v @ small[:, :want], av @ small[:, :want]
        r = au - u * theta[:want]
        r -= locked @ (locked.T @ r)
        tol = max(d, 64) * np.finfo(float).eps * max([float(theta[0]), *values])
        done = np.linalg.norm(r, axis=0) <= tol
        ready = int(np.argmin(done)) if not done.all() else want  # only a leading run: a smaller pair may yet be overtaken
        if ready:
            locked = np.hstack([locked, u[:, :ready]])
            values += theta[:ready].tolist()
            v, av = v @ small[:, ready:], av @ small[:, ready:]
            u, r, theta, small, want = u[:, ready:], r[:, ready:], theta[ready:], np.eye(v.shape[1]), want - ready
        if not want:
            break
        if v.shape[1] + want > basis - len(values) and v.shape[1] > 2 * want:
            v, av = v @ small[:, : 2 * want], av @ small[:, : 2 * want]
        z = minres(product, theta[:want], np.hstack([locked, u]), -r, inner, 1e-3)
        held = np.hstack([locked, v])
        more = orthonormal(z, held)
        if not more.shape[1]:  # the basis holds every correction: go on with directions it lacks
            more = orthonormal(np.random.default_rng(d + v.shape[1]).standard_normal((d, want)), held)
        if not more.shape[1]:  # it is the whole space: products anew, without the roundings of its history
            av = product(v)
        else:
            v, av = np.hstack([v, more]), np.hstack([av, product(more)])
    else:
        raise RuntimeError(f"{k - len(values)} of {k} eigenpairs have not converged in {rounds} rounds")
    order = np.argsort(-np.array(values))
    vectors = locked[:, order]
    top = np.abs(vectors).argmax(axis=0)
    return np.array(values)[order], vectors * np.where(vectors[top, np.arange(k)] < 0, -1.0, 1.0)


def _projected(n: int, sums: list[int], to: np.ndarray):
    """Rows (vec_id, deviation as text, whitened values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = offsets(_matrix(b.column(1)), n, sums)
                w = np.ascontiguousarray((y / n).astype(float) @ to)
                ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * to.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(str, square_sums(y)), pa.string()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["vec_id", "deviation", "w"])

    return run


def _moments(mean: np.ndarray | None, k: int):
    """Sums of the whitened values, or with a mean the products of what is centred by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k if mean is None else (k, k))
        for b in batches:
            if b.num_rows:
                w = _matrix(b.column(0))
                out += w.sum(axis=0) if mean is None else (w - mean).T @ (w - mean)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["s"])

    return run


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and each component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide."""
    spark = rows.sparkSession
    whole = materialize(whole_vectors(rows), "wh-whole")
    n, sums = totals(whole)
    k, d = 0, len(sums)
    if n:
        per_pack = max(1, PACK_BYTES // (8 * d))
        spread = whole.select("x").repartition(max(1, -(-n // per_pack)))
        packs = materialize(spread.mapInArrow(_centred(n, sums, per_pack), "c binary"), "wh-packs")
        product = covariance_product(packs, n)
        values, vectors = leading_pairs(product, d, components)
        k = int((values > d * np.finfo(float).eps * values[0]).sum()) if values[0] > 0 else 0
    if not k:
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)")
    values, to = values[:k], vectors[:, :k] / np.sqrt(values[:k])
    out = materialize(whole.select("vec_id", "x").mapInArrow(_projected(n, sums, to), "vec_id bigint, deviation string, w array<double>"), "wh-out")
    out = out.withColumn("wide", F.expr("try_cast(deviation as decimal(38,0))"))
    count = out.rdd.getNumPartitions()
    mean = summed(out.select("w").mapInArrow(_moments(None, k), "s binary"), (k,), count) / n
    gram = summed(out.select("w").mapInArrow(_moments(mean, k), "s binary"), (k, k), count) / n
    error = float(np.abs(gram - np.eye(k)).max())
    trace = float(out.agg((F.sum(F.col("deviation").cast("double")) / n / n / n).alias("t")).first().t)
    explained = F.element_at(F.array(*[F.lit(float(v / trace)) for v in values]), F.col("component"))
    long = out.select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), "wide", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return long.select("vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"), F.col("wide").alias("deviation_wide"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
