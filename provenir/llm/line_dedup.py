"""Near-duplicate lines across documents by a segment-partition edit join.

A line is what stands between newlines, without ASCII white space at its ends;
lines without anything else are no lines. Lines of at least 60 code points link
within edit distance 2, of at least 30 within 1, shorter ones only if equal;
of two lines the shorter one decides. Classes are the connected components of
these links; in each, the earliest occurrence by (doc_id, line number) stays
and all others are dropped.

Equal lines are one item (a 64-bit digest) from the start. For distance t a
line is cut into t + 1 segments, of which one must occur unchanged in any
linked line. The index holds (length, segment number, segment); a line of
length L is looked up under the lengths L - t .. L with the substrings that
can still align (the multi-match-aware windows), all hashed from one prefix
sum for a whole batch. Equal keys are buckets of ``linked_classes``, so
families of thousands of variants need no pairs. Candidates are verified by
banded bit-parallel edit distance, many pairs at a time.

Odd rows: a null or empty text has no lines; rows that share a doc_id are one
document, so a line at the same place in them is one occurrence; rows without
doc_id take no part and keep all lines. Only ``doc_id`` and ``text`` are read;
``drop_lines`` passes other columns on. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .catalog import query
from .common import linked_classes, may_hold, table
from .minhash_dedup import mix

#: Least length -> distance allowed.
DISTANCES = ((30, 1), (60, 2))
CHUNK = 1 << 20
ENDS = " \t\n\x0b\f\r"

_BASE = 0x9E3779B97F4A7C15 | 1


def distance_for(length: np.ndarray) -> np.ndarray:
    """Edit distance allowed for lines of these lengths (0: equal lines only)."""
    return np.sum([(length >= n) for n, _ in DISTANCES], axis=0)


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """Numbered lines of a text, trimmed, without blank ones."""
    found = ((k, x.strip(ENDS)) for k, x in enumerate((text or "").split("\n")))
    return [(k, x) for k, x in found if x]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line, and one with a null line for each document."""
    for b in (x.slice(k, 1000) for x in batches for k in range(0, x.num_rows, 1000)):
        ids, docs, nos = [], [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            found = lines_of(text.as_py())
            ids += [None, *(line_id(x) for _, x in found)]
            nos += [-1, *(k for k, _ in found)]
            docs += [doc] * (len(found) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(nos, pa.int32())], ["line", "doc_id", "no"])


def _distinct(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[dict[int, str]]:
    """Distinct lines of at least ``least`` code points, a bounded number of code points at a time."""
    held: dict[int, str] = {}
    size = 0
    for b in batches:
        for text in b.column(1):
            for _, x in lines_of(text.as_py()):
                if len(x) >= least and (h := line_id(x)) not in held:
                    held[h] = x
                    size += len(x)
            if size >= CHUNK:
                yield held
                held, size = {}, 0
    if held:
        yield held


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def windows(t: int, shift: int) -> list[tuple[int, int]]:
    """(segment, offset of the substring from the segment's place) for lines ``shift`` longer than the indexed length."""
    out = []
    for i in range(t + 1):
        low, high = max(-i, shift - (t - i)), min(i, shift + (t - i))
        out += [(i, o) for o in range(low, high + 1)]
    return out


def segment_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the line): index entries and look-ups of every line."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    begin = np.cumsum(length) - length
    power, inverse = _powers(_BASE, len(codes)), _powers(pow(_BASE, -1, 1 << 64), len(codes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes + np.uint64(0x632BE59BD9B4E019)) * power[:-1], dtype=np.uint64)])
    keys, owners = [], []
    for shift in range(len(DISTANCES) + 1):
        indexed = length - shift
        for t in range(max(1, shift), len(DISTANCES) + 1):
            who = np.flatnonzero(distance_for(indexed) == t)
            if not len(who):
                continue
            n, at, full = indexed[who], begin[who], length[who]
            short, longer = n // (t + 1), n % (t + 1)
            for i, offset in windows(t, shift):
                size = short + (i >= t + 1 - longer)
                start = i * short + np.maximum(0, i - (t + 1 - longer)) + offset
                fits = (start >= 0) & (start + size <= full)
                s, e = (at + start)[fits], (at + start + size)[fits]
                h = (total[e] - total[s]) * inverse[s]
                keys.append(mix(h + mix((n[fits] * 8 + i).astype(np.uint64))))
                owners.append(who[fits])
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _distinct(batches, DISTANCES[0][0]):
        ids = np.fromiter(held, np.int64, len(held))
        keys, owners = segment_keys(list(held.values()))
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(ids[owners[k : k + 100_000]])], ["bucket", "item"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _distinct(batches, DISTANCES[0][0]):
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.string())], ["item", "line"])


def _matrix(strings: list[str], fill: int) -> np.ndarray:
    out = np.full((len(strings), max(map(len, strings))), fill, np.uint32)
    for k, s in enumerate(strings):
        out[k, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def within(left: list[str], right: list[str], t: int) -> np.ndarray:
    """Which pairs of strings longer than ``t`` are within edit distance ``t`` (< 31), the band's columns as bits of one word for each pair.

    The top bit of the words follows the lower edge of the band: its diagonal
    differences give the distance there until the first string ends, then the
    horizontal differences of the last row are followed to the end.
    """
    u = np.uint64
    pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b in zip(left, right)]
    n1 = np.array([len(a) for a, _ in pairs])
    n2 = np.array([len(b) for _, b in pairs])
    a, b = _matrix([x for x, _ in pairs], 0xFFFFFFFF), _matrix([y for _, y in pairs], 0xFFFFFFFE)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    vp = np.full(len(pairs), ((1 << (t + 1)) - 1) << (63 - t), u)
    vn = np.zeros(len(pairs), u)
    dist = np.full(len(pairs), t)
    edge = np.full(len(pairs), 1 << 62, u)
    for j in range(b.shape[0]):
        x = np.zeros(len(pairs), u)
        for d in range(2 * t + 2):
            if 0 <= j + t - d < a.shape[0]:
                x |= (a[j + t - d] == b[j]).astype(u) << u(63 - d)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        live, early = j < n2, j < n1 - t
        late = live & ~early
        dist += live & early & ((d0 >> u(63)) == 0)
        dist += late & ((hp & edge) != 0)
        dist -= late & ((hn & edge) != 0)
        edge = np.where(late, edge >> u(1), edge)
        d0 >>= u(1)
        vp, vn = hn | ~(d0 | hp), d0 & hp
    return (dist <= t) & (n1 - n2 <= t)


def links(la: list[str], lb: list[str]) -> np.ndarray:
    """Which pairs of lines link."""
    size = np.array([(len(x), len(y)) for x, y in zip(la, lb)]).reshape(-1, 2)
    t = distance_for(size.min(axis=1))
    good = np.zeros(len(la), bool)
    for k in range(1, len(DISTANCES) + 1):
        some = np.flatnonzero((t == k) & (np.abs(size[:, 0] - size[:, 1]) <= k))
        some = some[np.argsort(size[some].max(axis=1), kind="stable")]
        while len(some):
            n = max(1, min(len(some), (1 << 21) // int(size[some[min(len(some), 2048) - 1]].max()), 2048))
            part, some = some[:n], some[n:]
            good[part] = within([la[i] for i in part], [lb[i] for i in part], k)
    return good


def _bags(lines: list[str]) -> np.ndarray:
    """Counts of the code points of each line, in 64 bins."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) & 63
    return np.bincount(np.repeat(np.arange(len(lines)) * 64, size) + codes, minlength=64 * len(lines)).reshape(-1, 64).astype(np.int32)


def _near(left: list[bytes], right: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs whose lengths and bags allow a link: an edit changes at most two counts of a bag."""
    la, lb = ([x.decode() for x in side] for side in (left, right))
    na, nb = (np.fromiter(map(len, side), np.int64, len(side)) for side in (la, lb))
    t = distance_for(np.minimum(na[i], nb[j]))
    return (np.abs(na[i] - nb[j]) <= t) & (np.abs(_bags(la)[i] - _bags(lb)[j]).sum(axis=1) <= 2 * t)


def _linked(left: list[bytes], right: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return links([left[k].decode() for k in i.tolist()], [right[k].decode() for k in j.tolist()])


def line_classes(texts: DataFrame) -> DataFrame:
    """(node, comp) of every line, by its digest, that links with a different one."""
    buckets = texts.mapInArrow(_buckets, "bucket bigint, item bigint")

    def loader(items: DataFrame) -> DataFrame:
        some = may_hold(texts.mapInArrow(_lines, "item bigint, line string"), F.col("item"), items, F.col("item"))
        lines = some.join(items, "item").groupBy("item").agg(F.min("line").alias("line"))
        return lines.select("item", F.octet_length("line").cast("bigint").alias("weight"), F.col("line").cast("binary").alias("data"))

    return linked_classes(buckets, loader, _near, _linked, "ld")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """One row for each document: (doc_id, n_lines, n_dropped, dropped, first_docs).

    ``dropped``: numbers of the lines that go; ``first_docs``: for each of them the
    document that keeps the line of its class.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(texts.mapInArrow(_occurrences, "line bigint, doc_id bigint, no int"), "ld-found")
    named = texts.filter("doc_id is not null")
    labels = line_classes(named)
    placed = found.filter("line is not null and doc_id is not null")
    each = materialize(placed.groupBy("line").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.max(F.struct("doc_id", "no")).alias("last")), "ld-each")
    classed = each.join(labels, each.line == labels.node, "left").select("line", "first", "last", F.coalesce("comp", "line").alias("class"))
    classed = materialize(classed, "ld-classed")
    kept = classed.groupBy("class").agg(F.min("first").alias("keep"), F.max("last").alias("end")).filter("keep <> end")
    repeats = materialize(classed.join(materialize(kept.select("class", "keep"), "ld-kept"), "class").select("line", "keep"), "ld-repeats")
    gone = placed.join(repeats, "line").filter("doc_id <> keep.doc_id or no <> keep.no").select("doc_id", "no", F.col("keep.doc_id").alias("of")).distinct()
    lists = gone.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "of"))).alias("g"))
    base = found.groupBy("doc_id").agg(F.countDistinct("no", "line").alias("n_lines"))
    g = F.coalesce("g", F.array().cast("array<struct<no: int, of: bigint>>"))
    return base.join(lists, "doc_id", "left").select("doc_id", "n_lines", F.size(g).cast("bigint").alias("n_dropped"), g["no"].alias("dropped"), g["of"].alias("first_docs"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated lines; documents of which nothing is left go, others keep their columns."""
    gone = materialize(repeated_lines(docs).filter("n_dropped > 0").select(F.col("doc_id").alias("_id"), "n_lines", "n_dropped", F.col("dropped").alias("_gone")), "ld-gone")
    joined = docs.join(gone, F.col("doc_id") == F.col("_id"), "left").filter("n_dropped is null or n_dropped < n_lines")
    lines = F.split("text", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    rest = F.element_at(F.transform(F.array(lines), lambda x: F.array_join(F.transform(places, lambda i: F.get(x, i)), "\n")), 1)
    joined = joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return joined.select(*docs.columns)


@query("op6_line_dedup")
def op6(spark, sf_dir):
    return repeated_lines(table(spark, sf_dir, "documents"))
