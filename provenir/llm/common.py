"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Blocks of an open bucket: at most about so much data (bytes) and so many items.
BLOCK_WEIGHT, BLOCK_ROWS = 4 << 20, 256

SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: a lambda variable is not copied by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def may_hold(df: DataFrame, key: Column, keys: DataFrame, of: Column, bits: int = 23) -> DataFrame:
    """Rows of ``df`` whose bigint hash ``key`` may occur among ``of`` in ``keys``.

    A bitmap of ``2**bits`` bits in 64-bit words is built by a bitwise
    aggregate and broadcast; it never has more than ``2**(bits - 6)`` rows,
    whatever the input. It passes too much, never too little, so a join on
    the real key follows. Its use is to keep rows out of that join's shuffle.
    """
    n = bits - 6
    word = lambda h: h.bitwiseAND(F.lit((1 << n) - 1))
    bit = lambda h: F.shiftright(h, n).bitwiseAND(F.lit(63)).cast("int")
    one = F.lit(1).cast("bigint")
    marks = keys.select(of.alias("_h")).filter("_h is not null")
    marks = marks.groupBy(word(F.col("_h")).alias("_w")).agg(F.bit_or(F.call_function("shiftleft", one, bit(F.col("_h")))).alias("_m"))
    kept = df.withColumn("_k", key).withColumn("_w", word(F.col("_k"))).join(F.broadcast(marks), "_w")
    hit = F.call_function("shiftright", F.col("_m"), bit(F.col("_k"))).bitwiseAND(one) == 1
    return kept.filter(hit).drop("_w", "_k", "_m")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, comp), comp the smallest node.

    Alternates the large-star and small-star steps until every node hangs on
    one node that hangs on none. Each step is written to the shared folder, so
    that no lineage grows and both sides of the join are plain reads, whose hot
    keys Spark can split. Nodes without an edge are absent.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, f"{name}-edges")
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-low")
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b"), f"{name}-large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(small.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), f"{name}-edges")
        ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select("b", "b").distinct())


class _Joined:
    """Which places of a tile are known to be one class."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist()):
            a, b = self.label[x], self.label[y]
            if a != b:
                self.label[self.label == b] = a


Compare = Callable[[list[bytes], list[bytes], np.ndarray, np.ndarray], np.ndarray]


def _tile_links(near: Compare, exact: Compare):
    """Links within tiles (bucket, one or two blocks c, x: list of item, comp, data, buckets).

    A pair is looked at in the least of the buckets that both its items are
    open in, if it passes ``near`` and nothing has joined its ends so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                bucket, blocks = batch.column(0)[r].as_py(), [e["x"] for e in sorted(batch.column(1)[r].as_py(), key=lambda e: e["c"])]
                x, y, same = blocks[0], blocks[-1], len(blocks) == 1
                every = x if same else x + y
                base = 0 if same else len(x)
                known = _Joined(np.array([e["comp"] for e in every], np.int64))
                ix, iy = (np.array([e["item"] for e in v], np.int64) for v in (x, y))
                dx, dy = ([e["data"] for e in v] for v in (x, y))
                bx, by = ([frozenset(e["buckets"]) for e in v] for v in (x, y))
                step = max(1, 65536 // len(y))
                for s in range(0, len(x), step):
                    part = slice(s, min(s + step, len(x)))
                    ahead = ix[part, None] < iy if same else ix[part, None] != iy
                    i, j = np.nonzero((known.label[part, None] != known.label[base : base + len(y)]) & ahead)
                    i += s
                    if len(i):
                        some = near(dx, dy, i, j)
                        i, j = i[some], j[some]
                    if len(i):
                        here = np.array([min(bx[a] & by[b]) == bucket for a, b in zip(i.tolist(), j.tolist())], bool)
                        i, j = i[here], j[here]
                    count = 64
                    while len(i):
                        a, b, i, j, count = i[:count], j[:count], i[count:], j[count:], count * 2
                        good = exact(dx, dy, a, b)
                        if good.any():
                            a, b = a[good], b[good]
                            yield pa.RecordBatch.from_arrays([pa.array(ix[a]), pa.array(iy[b])], ["a", "b"])
                            known.join(a, b + base)
                            still = known.label[i] != known.label[j + base]
                            i, j = i[still], j[still]

    return run


def _hub_links(near: Compare, exact: Compare):
    """Links of hubs: rows (hub, list of item, data), the hub's own among them; tested together up to a bounded weight."""

    def tested(hubs: list[tuple[int, bytes]], others: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        left, right = [d for _, d in hubs], [d for _, _, d in others]
        i, j = np.array([k for k, _, _ in others], np.int64), np.arange(len(others))
        for test in (near, exact):
            if len(j):
                good = test(left, right, i, j)
                i, j = i[good], j[good]
        return pa.RecordBatch.from_arrays([pa.array([hubs[k][0] for k in i.tolist()], pa.int64()), pa.array([others[k][1] for k in j.tolist()], pa.int64())], ["hub", "item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs, others, weight = [], [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                hub, every = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                others += [(len(hubs), e["item"], e["data"]) for e in every if e["item"] != hub]
                hubs.append((hub, next(e["data"] for e in every if e["item"] == hub)))
                weight += sum(len(e["data"]) for e in every)
                if weight >= BLOCK_WEIGHT:
                    yield tested(hubs, others)
                    hubs, others, weight = [], [], 0
        if others:
            yield tested(hubs, others)

    return run


def _blocks(rows: DataFrame, key: str, data: DataFrame, name: str) -> DataFrame:
    """(key, blocks): into how many blocks of bounded weight and size the items of a key are cut."""
    n = F.ceil(F.greatest(F.sum("weight") / BLOCK_WEIGHT, F.count("*") / BLOCK_ROWS)).alias("blocks")
    return materialize(rows.join(data.select("item", "weight"), "item").groupBy(key).agg(n), f"{name}-blocks")


def _dealt() -> Column:
    return F.pmod(F.xxhash64("item"), F.col("blocks"))


def linked_classes(buckets: DataFrame, loader: Callable[[DataFrame], DataFrame], near: Compare, exact: Compare, name: str) -> DataFrame:
    """Components (node, comp) of items whose links show up as shared buckets, without emitting the pairs of a bucket.

    ``buckets``: (bucket bigint, item bigint); a link between two items implies a
    shared bucket. ``loader(items)`` returns (item, weight, data binary) for the
    items that share one. ``near`` and ``exact`` take two lists of such data and
    the places of pairs in them: a quick test that passes every link, and the link.

    First every member of a bucket is held against one member, its hub: the one
    whose buckets are largest, as the centre of a family of near copies shares
    most with the rest. Items that hang on one hub, or on hubs that do, get one
    label. The members of a bucket that have different labels still are cut into
    blocks of bounded weight; each two blocks are one row, within which the open
    pairs are compared and only links come out. So no link that would join
    components is missed, and pairs are never rows.
    """
    found = buckets.groupBy("bucket").agg(F.min("item").alias("low"), F.max("item").alias("high"))
    common = materialize(found.filter("low <> high").select("bucket"), f"{name}-common")
    rows = materialize(may_hold(buckets, F.col("bucket"), common, F.col("bucket")).join(common, "bucket").select("bucket", "item").distinct(), f"{name}-rows")
    sizes = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")), f"{name}-sizes")
    degree = materialize(rows.join(sizes, "bucket").groupBy("item").agg(F.sum("n").alias("d")), f"{name}-degree")
    hubs = materialize(rows.join(degree, "item").groupBy("bucket").agg(F.max(F.struct("d", "item")).alias("hub")).select("bucket", "hub.d", F.col("hub.item").alias("hub")), f"{name}-hubs")
    data = materialize(loader(degree.select("item")), f"{name}-data")
    others = materialize(rows.join(hubs, "bucket").filter("item <> hub"), f"{name}-others")

    pairs = materialize(others.select("hub", "item").distinct(), f"{name}-pairs")
    blocks = _blocks(pairs, "hub", data, f"{name}-hub")
    dealt = pairs.join(blocks, "hub").select("hub", "item", _dealt().alias("c"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("c")
    dealt = dealt.union(blocks.select("hub", F.col("hub").alias("item"), every)).join(data.select("item", "data"), "item")
    # Little data, much work: a task for each shuffle partition, which a repartitioning of given number keeps.
    tasks = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = dealt.repartition(tasks, "hub", "c").groupBy("hub", "c").agg(F.collect_list(F.struct("item", "data")).alias("y")).select("hub", "y")
    links = materialize(held.mapInArrow(_hub_links(near, exact), "hub bigint, item bigint"), f"{name}-links")

    top = F.max(F.struct("d", "hub"))
    leaders = links.join(degree.withColumnRenamed("item", "hub"), "hub").groupBy("item").agg(top.alias("t")).select("item", F.col("t.hub").alias("leader"))
    leaders = materialize(leaders, f"{name}-leaders")
    above = leaders.select(F.col("item").alias("leader"), F.col("leader").alias("above"))
    labels = materialize(leaders.join(above, "leader", "left").select("item", F.coalesce("above", "leader").alias("label")), f"{name}-labels")

    placed = materialize(others.join(labels, "item", "left").select("bucket", "item", F.coalesce("label", "item").alias("comp")), f"{name}-placed")
    spread = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    rest = materialize(placed.join(materialize(spread.select("bucket"), f"{name}-spread"), "bucket"), f"{name}-rest")
    edges = links.select(F.col("hub").alias("a"), F.col("item").alias("b"))
    if not rest.isEmpty():
        open_in = rest.groupBy("item").agg(F.collect_set("bucket").alias("buckets"))  # an item has a bounded number of buckets
        loaded = data.join(open_in, "item")
        dealt = rest.join(_blocks(rest, "bucket", data, name), "bucket").withColumn("c", _dealt()).join(loaded, "item")
        packed = dealt.groupBy("bucket", "blocks", "c").agg(F.collect_list(F.struct("item", "comp", "data", "buckets")).alias("x"))
        # Each block goes to the tiles it is part of: one with every block of its bucket.
        parts = packed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        parts = parts.select("bucket", F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q"), "c", "x").repartition(tasks, "bucket", "p", "q")
        tiles = parts.groupBy("bucket", "p", "q").agg(F.collect_list(F.struct("c", "x")).alias("t"))
        tiles = tiles.select("bucket", "t")
        edges = edges.union(materialize(tiles.mapInArrow(_tile_links(near, exact), "a bigint, b bigint"), f"{name}-more"))
    return components(edges, name)
