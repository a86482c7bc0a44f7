"""Scoring of texts by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are ASCII-lower-cased words ``[^\\x20\\x09-\\x0D]+`` and one end for each
text. Counts of all words of the training documents are exact and stay a
table. Words with high counts (never more than ``HOT``, by a threshold found
from a histogram of counts) go to every task; only the other words are joined,
so neither a frequent word nor the whole vocabulary meets one task.

The model predicts the class of a token from the classes of the two before it:
the ``CLASSES - 2`` most frequent words, the end (which also stands before a
text), and one class for all other words, within which a word has probability
(c + 1) / (N' + V' + 1), unknown words together being one of them. With context
vectors Q, position weights C and output vectors R and biases b,
score(w | h) = (C1 * Q[h1] + C2 * Q[h2]) . R[w] + b[w].

Training reads the counts of all class triples of the training documents (at
most ``CLASSES ** 3`` rows, whatever the corpus). Contexts are dealt into
groups; each group takes Adam steps on the NCE objective in numpy, the noise
(unigram) in expectation instead of samples, and the parameters are averaged
by weight between rounds. Scores are normalised: a batched matrix product and a
softmax give log-probabilities of all classes for all contexts.

Odd rows: a null text is the end alone; rows that repeat a doc_id are scored
each; a null doc_id has the remainder of the empty string (0) and so belongs to
training. Only ``doc_id`` and ``text`` are read. An empty table gives no row;
without training documents every word is unknown.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .catalog import query
from .common import table
from .minhash_dedup import texts_of

FOLDS, HELD_OUT = 7, 2
HOT = 1 << 18
CLASSES = 256
WIDTH = 24
GROUPS, ROUNDS, STEPS, RATE, NOISE = 8, 6, 12, 0.05, 10

END, TAIL = CLASSES - 2, CLASSES - 1


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c) of the training documents, combined as far as memory allows; a null word counts documents."""
    held: Counter[bytes] = Counter()
    docs = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), texts_of(b, "text")):
            if not is_held_out(doc):
                docs += 1
                held.update(text.lower().split())
                if len(held) > 400_000:
                    yield out()
                    held = Counter()
    if held:
        yield out()
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([docs], pa.int64())], ["word", "c"])


class _Places(dict):
    """Place of a word in the hot list; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def _places(hot: list[bytes]) -> _Places:
    return _Places(zip(hot, range(len(hot))))


def _classes(places: np.ndarray) -> np.ndarray:
    """Classes of a text's tokens, the end included, with two ends before them."""
    out = np.full(len(places) + 3, END, np.int64)
    out[2:-1] = np.where((places >= 0) & (places < END), places, TAIL)
    return out


def _triples(hot: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, held, size = _places(hot).__getitem__, [], 0

        def out() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n, pa.int64())], ["code", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b, "text")):
                if is_held_out(doc):
                    continue
                found = text.lower().split()
                c = _classes(np.fromiter(map(get, found), np.int64, len(found)))
                held.append((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:])
                size += len(held[-1])
                if size > 4_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def start_parameters(unigram: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(1)
    return {"q": rng.normal(0, 0.1, (CLASSES, WIDTH)), "r": rng.normal(0, 0.1, (CLASSES, WIDTH)), "c": np.ones((2, WIDTH)) / 2, "b": np.log(unigram)}


def nce_step(p: dict[str, np.ndarray], h2: np.ndarray, h1: np.ndarray, counts: np.ndarray, noise: np.ndarray, ratio: int = NOISE) -> tuple[float, dict[str, np.ndarray]]:
    """NCE objective for rows of class counts, and its gradient; ``ratio`` noise tokens a token, in expectation."""
    total = counts.sum()
    x = p["c"][0] * p["q"][h1] + p["c"][1] * p["q"][h2]
    delta = x @ p["r"].T + p["b"] - np.log(ratio * noise)
    s = 1 / (1 + np.exp(-delta))
    weight = ratio * counts.sum(axis=1, keepdims=True) * noise
    value = (counts * np.log(s + 1e-30) + weight * np.log(1 - s + 1e-30)).sum() / total
    g = (counts * (1 - s) - weight * s) / total
    gx = g @ p["r"]
    q = np.zeros_like(p["q"])
    np.add.at(q, h1, gx * p["c"][0])
    np.add.at(q, h2, gx * p["c"][1])
    return value, {"q": q, "r": g.T @ x, "b": g.sum(axis=0), "c": np.stack([(gx * p["q"][h1]).sum(axis=0), (gx * p["q"][h2]).sum(axis=0)])}


def _trained(start: dict[str, np.ndarray], noise: np.ndarray, steps: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        context, row = np.unique(group["code"].to_numpy() // CLASSES, return_inverse=True)
        counts = np.zeros((len(context), CLASSES), np.float32)
        counts[row, group["code"].to_numpy() % CLASSES] = group["n"].to_numpy()
        p = {k: v.copy() for k, v in start.items()}
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            _, g = nce_step(p, context // CLASSES, context % CLASSES, counts, noise)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] += RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-12)
        return pd.DataFrame({"weight": [float(counts.sum())], "params": [np.concatenate([p[k].ravel() for k in sorted(p)]).astype("<f8").tobytes()]})

    return run


def train(triples: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, groups: int = GROUPS) -> dict[str, np.ndarray]:
    """Parameters from rows (code, n) of class triples. ``groups`` rows of parameters reach the driver in each round."""
    p = start_parameters(unigram)
    for _ in range(rounds):
        dealt = triples.withColumn("g", F.pmod(F.xxhash64(F.floor(F.col("code") / CLASSES)), F.lit(groups)))
        found = dealt.groupBy("g").applyInPandas(_trained(p, unigram, steps), "weight double, params binary").collect()
        if not found:
            break
        mean = np.average([np.frombuffer(r.params, "<f8") for r in found], axis=0, weights=[r.weight for r in found])
        at = 0
        for k in sorted(p):
            p[k], at = mean[at : at + p[k].size].reshape(p[k].shape), at + p[k].size
    return p


def log_probabilities(p: dict[str, np.ndarray]) -> np.ndarray:
    """log10 P(class | the two before it), one row for each context, as float32."""
    out = np.empty((CLASSES * CLASSES, CLASSES), np.float32)
    for h2 in range(CLASSES):
        s = (p["c"][0] * p["q"] + p["c"][1] * p["q"][h2]) @ p["r"].T + p["b"]
        s -= s.max(axis=1, keepdims=True)
        out[h2 * CLASSES : (h2 + 1) * CLASSES] = (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / math.log(10)
    return out


SCORED = "row bigint, doc_id bigint, word binary, tf bigint, n_tokens bigint, n_known bigint, base double, score double, rare bigint"


def _scored(hot: list[bytes], counts: np.ndarray, p: dict[str, np.ndarray], ends: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, table_ = _places(hot).__getitem__, None
        logs = np.log10(counts + 1.0)
        row = TaskContext.get().partitionId() << 40
        for b in (x.slice(k, 1000) for x in batches for k in range(0, x.num_rows, 1000)):
            table_ = log_probabilities(p) if table_ is None else table_
            cols: list[list] = [[] for _ in range(9)]

            def put(*values) -> None:
                for c, v in zip(cols, values):
                    c.append(v)

            for doc, text in zip(b.column(0).to_pylist(), texts_of(b, "text")):
                found = text.lower().split()
                at = np.fromiter(map(get, found), np.int64, len(found))
                c = _classes(at)
                score = float(table_[c[:-2] * CLASSES + c[1:-1], c[2:]].sum(dtype=np.float64))
                known = at[at >= 0]
                tail = known[known >= END]
                rare = np.flatnonzero(at < 0).tolist()
                put(row, doc, None, None, len(found) + 1, len(known) + (ends > 0), float(logs[known].sum()) + math.log10(ends + 1), score + float(logs[tail].sum()), len(rare) + len(tail))
                for w, n in Counter(found[k] for k in rare).items():
                    put(row, None, w, n, None, None, None, None, None)
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in SCORED.split(", ")])

    return run


def scores(docs: DataFrame) -> DataFrame:
    """One row for each document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_counts, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    counts = materialize(counts, "lm-counts")
    words = counts.filter("word is not null")
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.filter("word is null").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    total, vocabulary = n_words + ends, distinct + (ends > 0)
    level = F.floor(F.log2("c") * 16)
    hot, least = 0, math.inf
    for r in sorted(words.groupBy(level.alias("l")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r.l):  # at most 16 rows for each doubling of a count
        hot += r.n
        if hot > HOT:
            break
        least = r.c
    top = words.filter(F.col("c") >= least).collect() if math.isfinite(least) else []
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    names, sizes = [bytes(r.word) for r in top], np.array([r.c for r in top], np.float64)
    tail_words, tail_kinds = n_words - int(sizes[:END].sum()), distinct - min(len(names), END)
    share = np.zeros(CLASSES)
    share[: min(len(names), END)] = sizes[:END]
    share[END], share[TAIL] = ends, tail_words
    share = (share + 1) / (share + 1).sum()
    triples = texts.mapInArrow(_triples(names), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    p = train(materialize(triples, "lm-triples"), share)
    parts = materialize(texts.mapInArrow(_scored(names, sizes, p, ends), SCORED), "lm-parts")
    rare = parts.filter("word is not null").select("row", "word", "tf").join(words, "word", "left")
    sums = rare.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("_l"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("_k"))
    rows = parts.filter("n_tokens is not null").drop("word", "tf").join(sums, "row", "left")
    more = F.coalesce("_l", F.lit(0.0))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    base = F.col("base") + more - F.col("n_tokens") * math.log10(total + vocabulary + 1)
    score = F.col("score") + more - F.col("rare") * math.log10(tail_words + tail_kinds + 1)
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("_k", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


@query("op10_lm_scoring")
def op10(spark, sf_dir):
    return scores(table(spark, sf_dir, "documents"))
