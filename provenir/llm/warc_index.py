"""WARC archives with a two-level capture index.

Writing. Pages whose payloads (the html in UTF-8) are equal and of at least
``least`` bytes share one ``response`` record, that of the largest page_id; the
others are ``revisit`` records that name it. Digests and roles are settled on
narrow rows; then each partition writes its pages as one archive, every record
a gzip member of its own, and returns the place (file, offset, length) of each
record.

Index. Captures are range-sorted by (reversed-host URL key, page_id). Each
partition writes one index file: blocks of up to ``LINES`` captures, compressed
one by one, then a sparse directory with the first key of each block and its
place. The first keys of the files, one row for each file, are the level above.

Reading. Wanted (key, page_id) pairs are range-sorted too; a binary search over
the files, another over the file's directory, and one range read give the block
that holds a pair. The captures found are dealt by file and offset, so that
neighbouring records come with one range read. The payload's digest is
computed anew and must be the one of the header.

Manifests (places, directories) are tables that Spark commits, so a file left
by a lost task attempt is in none and is never read.

Odd rows: a null html is an empty payload; a null url has the empty key and no
target header; a null page_id is smaller than every other and is never referred
to, unless all pages of the payload have none, which are then all responses;
rows that share page_id and payload are each written and have the same role;
rows that share key and page_id are found together, once. Other columns are not
read. An empty table writes no file and gives no row.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_dir
from .catalog import query
from .common import table
from .token_files import _open

LEAST = 0
LINES = 2048
#: An archive is closed beyond so many bytes; neighbouring records are read in runs of at most so many.
FILE_BYTES, RUN_BYTES = 1 << 30, 4 << 20
DATE = "1970-01-01T00:00:00Z"

CAPTURE = "url_key string, page_id bigint, file string, at bigint, size bigint"
DIRECTORY = "index_file string, first_key string, first_page bigint, n_blocks bigint, n_captures bigint, at bigint, size bigint"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"

_PARTS = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)")
_UNSAFE = re.compile(r"[\x00-\x20\x7F]")


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, ``)``, then path and query; other strings stay, in lower case."""
    found = _PARTS.match(url or "")
    if not found:
        return (url or "").lower()
    host, _, port = found[1].lower().partition(":")
    return ",".join(reversed(host.rstrip(".").split("."))) + (f":{port}" if port else "") + ")" + (found[2] or "/")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member: a response, or a revisit without the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Date: {date}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["WARC-Payload-Digest: sha1:" + base32(hashlib.sha1(payload).digest()), "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(wbits=31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> tuple[int | None, int, str, str, int | None, str | None]:
    """A row of ``RECORD`` from the bytes of a record; the payload of a response must have the digest of its header."""
    data = zlib.decompress(member, wbits=31)
    top, _, rest = data.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    named = lambda field: int(head[field][10:-1]) if len(head.get(field, "")) > 11 else None  # noqa: E731  <urn:page:N>
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response":
        size = len(payload)
        if base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not have the digest {digest}")
    else:
        size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    return named("WARC-Record-ID"), size, digest, head["WARC-Type"], named("WARC-Refers-To"), head.get("WARC-Target-URI")


def with_roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (page_id, url, html, refers_to): the page whose payload a page repeats, null for a response."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    own = own.withColumn("_sha", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    narrow = materialize(own.filter(F.octet_length("html") >= least).select("page_id", "_sha"), "warc-digests")
    tops = narrow.groupBy("_sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    tops = materialize(tops.filter("n > 1 AND refers_to IS NOT NULL").select("_sha", "refers_to"), "warc-tops")
    # A hot payload's rows meet its single top row here; the join feeds nothing but a write, so its hot key can be split.
    repeats = materialize(narrow.join(tops, "_sha").filter("page_id IS NULL OR page_id < refers_to"), "warc-repeats").distinct()
    repeats = repeats.select(F.col("page_id").alias("_page"), F.col("_sha").alias("_same"), "refers_to")
    joined = own.join(repeats, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_sha") == F.col("_same")), "left")
    return joined.select("page_id", "url", "html", "refers_to")


def _written(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        sink, name, at = None, "", 0
        for b in batches:
            rows = []
            for page, url, html, top in zip(*(b.column(n) for n in range(4))):
                if sink is not None and at >= file_bytes:
                    sink.close()
                    sink = None
                if sink is None:
                    store.create_dir(root, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                page, url = page.as_py(), url.as_py()
                member = record(page, url, html.as_buffer().to_pybytes(), top.as_py())
                sink.write(member)
                rows.append((url_key(url), page, name, at, len(member)))
                at += len(member)
            if rows:
                key, page, file, place, size = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(page, pa.int64()), pa.array(file, pa.string()), pa.array(place, pa.int64()), pa.array(size, pa.int64())], ["url_key", "page_id", "file", "at", "size"])
        if sink is not None:
            sink.close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one or more archives for each partition; the places of their records as ``CAPTURE`` rows."""
    return materialize(with_roles(pages, least).mapInArrow(_written(folder, file_bytes), CAPTURE), "warc-captures")


def _order(key: str, page: int | None) -> tuple[str, bool, int]:
    return key, page is not None, page or 0


def _indexed(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        name, sink, at, total = f"{uuid.uuid4().hex}.idx", None, 0, 0
        directory: list[list] = []
        held: list[list] = []

        def flush() -> None:
            nonlocal at, total
            block = zlib.compress("\n".join(json.dumps(h) for h in held).encode())
            directory.append([*held[0][:2], at, len(block)])
            sink.write(block)
            at, total = at + len(block), total + len(held)
            held.clear()

        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in range(5))):
                if sink is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                held.append(list(row))
                if len(held) == lines:
                    flush()
        if sink is not None:
            if held:
                flush()
            tail = zlib.compress(json.dumps(directory).encode())
            sink.write(tail)
            sink.close()
            key, page = directory[0][:2]
            row = [[name], [key], [page], [len(directory)], [total], [at], [len(tail)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k < 2 else pa.int64()) for k, v in enumerate(row)], ["index_file", "first_key", "first_page", "n_blocks", "n_captures", "at", "size"])

    return run


def write_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Sort the captures into compressed blocks; one ``DIRECTORY`` row for each index file."""
    ordered = captures.select("url_key", "page_id", "file", "at", "size").repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return materialize(ordered.mapInArrow(_indexed(folder, lines), DIRECTORY), "warc-directory")


class CaptureIndex:
    """Look-ups in the index files of a folder.

    ``tops``: (first key, first page, index file, place and size of its
    directory) of every index file. One directory and one block stay in memory.
    """

    def __init__(self, folder: str, tops: list[tuple[str, int | None, str, int, int]]):
        self._store, self._root = _open(folder)
        self._tops = sorted(tops, key=lambda t: _order(t[0], t[1]))
        self._firsts = [_order(t[0], t[1]) for t in self._tops]
        self._file: tuple[int, object, list, list] | None = None
        self._block: tuple[tuple[int, int], list, list] | None = None
        self.reads = 0

    def _range(self, source, at: int, size: int) -> bytes:
        self.reads += 1
        return zlib.decompress(source.read_at(size, at))

    def _directory(self, k: int) -> tuple[object, list, list]:
        if self._file is None or self._file[0] != k:
            if self._file is not None:
                self._file[1].close()
            source = self._store.open_input_file(f"{self._root}/{self._tops[k][2]}")
            entries = json.loads(self._range(source, *self._tops[k][3:]))
            self._file = (k, source, entries, [_order(e[0], e[1]) for e in entries])
        return self._file[1:]

    def _lines(self, k: int, n: int) -> tuple[list, list]:
        if self._block is None or self._block[0] != (k, n):
            source, entries, _ = self._directory(k)
            lines = [json.loads(x) for x in self._range(source, *entries[n][2:]).decode().split("\n")]
            self._block = ((k, n), lines, [_order(x[0], x[1]) for x in lines])
        return self._block[1:]

    def find(self, key: str, page: int | None) -> list[tuple[str, int, int]]:
        """(file, at, size) of every capture of a key and page; equal ones may stand in several blocks."""
        want, out = _order(key, page), []
        k = max(0, bisect.bisect_left(self._firsts, want) - 1)
        while k < len(self._tops) and self._firsts[k] <= want:
            firsts = self._directory(k)[2]
            n = max(0, bisect.bisect_left(firsts, want) - 1)
            while n < len(firsts) and firsts[n] <= want:
                lines, orders = self._lines(k, n)
                i = bisect.bisect_left(orders, want)
                while i < len(lines) and orders[i] == want:
                    out.append(tuple(lines[i][2:]))
                    i += 1
                n += 1
            k += 1
        return out

    def close(self) -> None:
        if self._file is not None:
            self._file[1].close()


def _found(folder: str, tops: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, before = CaptureIndex(folder, tops), None
        for b in batches:
            rows = []
            for key, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (key, page) != before:  # sorted, so pairs that are asked for twice stand together
                    before = (key, page)
                    rows += index.find(key, page)
            if rows:
                file, at, size = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], ["file", "at", "size"])
        index.close()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string()), b.column(1)], ["url_key", "page_id"])


def find_captures(wanted: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Places (file, at, size) of the records of wanted (url, page_id) pairs, each once.

    The first keys of the index files go to every task: one row for each
    partition that wrote the index, whatever the number of captures.
    """
    tops = [tuple(r) for r in directory.select("first_key", "first_page", "index_file", "at", "size").collect()]
    keys = wanted.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("bigint").alias("page_id"))
    keys = keys.mapInArrow(_keys, "url_key string, page_id bigint").repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return keys.mapInArrow(_found(folder, tops), "file string, at bigint, size bigint")


def _read(folder: str, run_bytes: int):
    def rows_of(source, places: list[tuple[int, int]]) -> list[tuple]:
        start = places[0][0]
        data = source.read_at(places[-1][0] + places[-1][1] - start, start)
        return [parsed(data[at - start : at - start + size]) for at, size in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        name, source, places = None, None, []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

        for b in batches:
            for file, at, size in zip(*(b.column(n).to_pylist() for n in range(3))):
                if places and (file != name or at + size - places[0][0] > run_bytes):
                    yield batch(rows_of(source, places))
                    places = []
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                places.append((at, size))
        if places:
            yield batch(rows_of(source, places))
        if source is not None:
            source.close()

    return run


def read_records(places: DataFrame, folder: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Records at places (file, at, size), as ``RECORD`` rows."""
    spread = places.repartitionByRange("file", "at").sortWithinPartitions("file", "at")
    return spread.mapInArrow(_read(folder, run_bytes), RECORD)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i) // 4 + 1, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d
"""


@query("op11_warc_index", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    captures = write_archives(pages, folder)
    directory = write_index(captures, folder)
    places = find_captures(pages.select("url", "page_id"), directory, folder)
    return read_records(places, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
