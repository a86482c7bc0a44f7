"""Packing of documents into fixed-length sequences: first-fit decreasing in random groups.

A document becomes its token ids and an end id. Whole stretches of ``capacity``
tokens are sequences of their own; what is left of each document is a piece.
Pieces are dealt into groups by a hash of document, position and row, so that
repeated rows spread as well; each group holds about ``group_size`` pieces, whatever the sources or copies are, and is
packed on its own: pieces in decreasing length go into the first sequence with
room, found in a tournament tree whose nodes hold the largest room below them.
A group's leftover is at most one poorly filled sequence or so, which
``group_size`` pieces make small.

Only lengths and checksums are shuffled, never texts or ids.

Odd rows: a null or empty text is the end id alone; rows that repeat a doc_id
are packed as documents of their own (equal rows get equal pieces in different
places); a null doc_id is kept as null. Columns besides ``doc_id`` and ``text``
are not read. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .catalog import query
from .common import table
from .tokens import TextEncoder

CAPACITY = 2048
GROUP_SIZE = 4096
END = 1

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cut(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = TextEncoder(path, lead=True), np.array([end], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.encode(text.as_py() or "") + tail
                n = len(ids) // 4
                rows += [(doc, k, min(capacity, n - k), zlib.crc32(ids[4 * k : 4 * (k + capacity)]), n) for k in range(0, n, capacity)]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length, taken in the given order.

    ``room`` is the tournament tree: leaf ``size + k`` holds the room left in
    sequence k, every inner node the larger of its two children.
    """
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    room = [capacity] * (2 * size)
    bins, offsets = [], []
    for n in lengths:
        k = 1
        while k < size:
            k *= 2
            if room[k] < n:
                k += 1
        bins.append(k - size)
        offsets.append(capacity - room[k])
        room[k] -= n
        while k > 1:
            k //= 2
            top = max(room[2 * k], room[2 * k + 1])
            if room[k] == top:
                break
            room[k] = top
    return bins, offsets


def _packed(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit(group["length"].tolist(), capacity)
        return group.assign(bin=bins, offset=offsets)

    return run


def pack(docs: DataFrame, path: str, end: int = END, capacity: int = CAPACITY, group_size: int = GROUP_SIZE) -> DataFrame:
    """One row for each piece: its place in the document, its checksum, sequence and offset."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(texts.mapInArrow(_cut(path, end, capacity), PIECES), "pieces")
    groups = max(1, -(-pieces.count() // group_size))
    spread = pieces.withColumn("_g", F.pmod(F.xxhash64(F.lit(7), "doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    placed = spread.groupBy("_g").applyInPandas(_packed(capacity), f"{PIECES}, _g bigint, bin bigint, offset bigint")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("bin") * groups + F.col("_g")).alias("sequence_id"), "offset")


@query("op4_packing")
def op4(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
