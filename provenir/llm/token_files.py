"""Token-id files with directly addressable codes.

Documents are put in ascending doc_id order by a range partitioning; each
partition encodes its texts and writes one file. A file is a run of segments
of bounded size, so neither writer nor reader holds a partition of ids. In a
segment the ids are split into 8-bit chunks, lowest first: level 0 has the
first chunk of every id, level k + 1 the next chunk of the ids that go on.
Each level but the last has a continuation bitmap and a directory with the
number of set bits before each block of 512. An id is found by one byte per
level, its place at the next level being the rank of its bit: any token is
read without decoding the others.

A row of the manifest names a file and its counts. The manifest is written by
Spark's own commit, so the file of a lost or repeated task attempt, which has
a name of its own, is in no manifest and is never read.

Layout of a segment, little-endian: u32 number of ids, u32 number of levels,
then for each level u32 number of chunks, the chunks, and unless it is the
last, the directory (u32 for each block) and the bitmap (u64 words).

Odd rows: a null or empty text is the end id alone; a null doc_id sorts
first; rows that share a doc_id stand next to each other, in the order of
their texts. Other columns are not read. An empty table writes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_dir
from .catalog import query
from .common import table
from .tokens import shared_encoder

END = 2
BLOCK = 512
SEGMENT = 1 << 18

MANIFEST = "file string, first_doc bigint, n_docs bigint, n_tokens bigint"
DOCS = "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"


def encode_segment(ids: np.ndarray) -> bytes:
    """A segment of the file for an array of 32-bit ids."""
    out, rest = [], ids.astype(np.uint32)
    levels = []
    while True:
        levels.append(rest)
        more = rest > 0xFF
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out.append(struct.pack("<II", len(ids), len(levels)))
    for k, v in enumerate(levels):
        out += [struct.pack("<I", len(v)), (v & np.uint32(0xFF)).astype(np.uint8).tobytes()]
        if k + 1 < len(levels):
            blocks = -(-len(v) // BLOCK)
            bits = np.zeros(blocks * BLOCK, np.uint8)
            bits[: len(v)] = v > 0xFF
            ones = bits.reshape(blocks, BLOCK).sum(axis=1, dtype=np.uint32)
            out += [(np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes(), np.packbits(bits, bitorder="little").tobytes()]
    return b"".join(out)


class Segment:
    """A segment over a buffer; ``seg[i]`` reads one id, ``all()`` every id."""

    def __init__(self, data: bytes | memoryview):
        n, depth = struct.unpack_from("<II", data)
        self._levels, at = [], 8
        for k in range(depth):
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
            chunks = np.frombuffer(data, np.uint8, size, at)
            at += size
            ranks = words = None
            if k + 1 < depth:
                blocks = -(-size // BLOCK)
                ranks = np.frombuffer(data, "<u4", blocks, at)
                words = np.frombuffer(data, "<u8", blocks * BLOCK // 64, at + 4 * blocks)
                at += blocks * (4 + BLOCK // 8)
            self._levels.append((chunks, ranks, words))
        self._n = n

    def __len__(self) -> int:
        return self._n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self._n:
            raise IndexError(i)
        value = 0
        for k, (chunks, ranks, words) in enumerate(self._levels):
            value |= int(chunks[i]) << (8 * k)
            if words is None or not int(words[i >> 6]) >> (i & 63) & 1:
                break
            block, word = i // BLOCK, i >> 6
            below = sum(int(w).bit_count() for w in words[block * BLOCK // 64 : word])
            i = int(ranks[block]) + below + (int(words[word]) & ((1 << (i & 63)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self._n, np.uint32)
        at: np.ndarray | None = None
        for k, (chunks, _, words) in enumerate(self._levels):
            part = chunks.astype(np.uint32) << np.uint32(8 * k)
            if at is None:
                out |= part
                at = np.arange(self._n)
            else:
                out[at] |= part
            if words is not None:
                more = np.unpackbits(words.view(np.uint8), bitorder="little")[: len(chunks)].astype(bool)
                at = at[more]
        return out


def _open(uri: str):
    """The file system of a folder (local, or whatever pyarrow reaches) and the path there."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (fs.LocalFileSystem(), uri)


def _written(folder: str, path: str, end: int):
    """A partition of sorted (doc_id, text) rows as one file; yields its manifest row and its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        encoder, tail = shared_encoder(path, False), np.array([end], "<u4").tobytes()
        name, sink, total, pending, held = f"{uuid.uuid4().hex}.dac", None, 0, [], 0
        directory = [0]

        def flush(limit: int) -> None:
            nonlocal pending, held
            data = b"".join(pending)
            k = 0
            while len(data) - k > limit or (not limit and k < len(data)):
                part = encode_segment(np.frombuffer(data[k : k + 4 * SEGMENT], "<u4"))
                sink.write(part)
                directory.append(directory[-1] + len(part))
                k += 4 * SEGMENT
            pending, held = [data[k:]], max(0, len(data) - k)

        for b in batches:
            docs, ats, sizes = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                if sink is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(f"{root}/{name}")
                ids = encoder.encode(text.as_py() or "") + tail
                docs.append(doc)
                ats.append(total)
                sizes.append(len(ids) // 4)
                total += len(ids) // 4
                pending.append(ids)
                held += len(ids)
                if held >= 4 * SEGMENT:
                    flush(4 * SEGMENT - 1)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(docs)), pa.array(docs, pa.int64()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int64())], ["file", "doc_id", "at", "n_tokens"])
        if sink is not None:
            flush(0)
            sink.write(np.array(directory, "<u8").tobytes() + struct.pack("<QQ", len(directory), total))
            sink.close()

    return run


class TokenFile:
    """Reader of one file: ``token(i)`` for any position, ``ids(start, n)`` for a stretch."""

    def __init__(self, folder: str, name: str):
        store, root = _open(folder)
        self._file = store.open_input_file(f"{root}/{name}")
        size = self._file.size()
        n, self.total = struct.unpack("<QQ", self._file.read_at(16, size - 16))
        self._at = np.frombuffer(self._file.read_at(8 * n, size - 16 - 8 * n), "<u8").tolist()
        self._last: tuple[int, Segment, np.ndarray | None] = (-1, None, None)

    def _segment(self, k: int) -> Segment:
        return Segment(self._file.read_at(self._at[k + 1] - self._at[k], self._at[k]))

    def token(self, i: int) -> int:
        if self._last[0] != i // SEGMENT:
            self._last = (i // SEGMENT, self._segment(i // SEGMENT), None)
        return self._last[1][i % SEGMENT]

    def ids(self, start: int, n: int) -> np.ndarray:
        out = []
        while n > 0:
            k, at = divmod(start, SEGMENT)
            if self._last[0] != k or self._last[2] is None:
                seg = self._segment(k)
                self._last = (k, seg, seg.all())
            out.append(self._last[2][at : at + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def close(self) -> None:
        self._file.close()


def write_token_files(docs: DataFrame, folder: str, path: str, end: int = END) -> DataFrame:
    """Write the files and return their documents: (file, doc_id, at, n_tokens), ``at`` within the file."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(_written(folder, path, end), "file string, doc_id bigint, at bigint, n_tokens bigint"), "dac-manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name = None, None
        for b in batches:
            sums = []
            for f, at, n in zip(b.column("file").to_pylist(), b.column("at").to_pylist(), b.column("n_tokens").to_pylist()):
                if f != name:
                    if file is not None:
                        file.close()
                    file, name = TokenFile(folder, f), f
                sums.append(zlib.crc32(file.ids(at, n).astype("<u4").tobytes()))
            yield b.append_column("ids_crc32", pa.array(sums, pa.int64()))
        if file is not None:
            file.close()

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the documents of a manifest back: (doc_id, start, n_tokens, ids_crc32), ``start`` over all files in doc_id order."""
    # One row per file in this window: a count of files, not of documents.
    files = manifest.groupBy("file").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nameless"), F.sum("n_tokens").alias("n"))
    order = Window.orderBy(F.col("nameless").desc(), "first", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    rows = manifest.join(F.broadcast(files), "file").select("file", "doc_id", "at", "n_tokens", "before")
    spread = rows.repartitionByRange("file", "at").sortWithinPartitions("file", "at")
    return spread.mapInArrow(_read(folder), "file string, doc_id bigint, at bigint, n_tokens bigint, before bigint, ids_crc32 bigint").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "dac")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest, folder)
