"""Repeated passages by hashing sentences, lines and paragraphs.

A text is cut into pieces: its lines, and within a line the sentences (up to
``.``, ``!`` or ``?`` before white space or the end). Units are the pieces and
the paragraphs (runs of lines between blank ones, if they have more than one
line): a repeated line is a run of repeated pieces, a paragraph may be broken
into lines otherwise. A unit is normalised: ASCII lower case, words joined by
single spaces. Its digest is 128 bits. Digests are grouped over all documents;
the earliest occurrence by (doc_id, start) stays, the others are to go.

Neighbouring units that go are joined into one span, and spans of at least
``least`` words are removed, with their place in the original text as code
points, end exclusive. So a passage set in short lines or short sentences is
found as a whole, one inside running text by the sentences that lie in it, while
a lone short line that many texts share stays.

Only digests and places are shuffled. A digest shared by a third of all rows is
first combined on each side and then joined as rows, which Spark can split.

Odd rows: null and empty texts have no units; rows that share a doc_id are one
document, where the same place is one occurrence, and its different texts have
spans of their own; rows without doc_id take no part. Only ``doc_id`` and
``text`` are read. An empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .catalog import query
from .common import may_hold, table

#: Words that a span has at least: about a sentence, as whole sentences are what is found of a passage inside running text.
LEAST = 16

_LINE = re.compile(r"[^\n]+")
_PIECE = re.compile(r"[^\x20\x09-\x0D].*?(?:[.!?]+(?=[\x20\x09-\x0D]|$)|$)")

UNIT = "h1 bigint, h2 bigint, doc_id bigint, text_id bigint, start bigint, end bigint, piece bigint, last_piece bigint, word bigint, last_word bigint"


def units(text: str) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, first piece, last piece, first word, word after the last) of every unit."""
    out, run = [], []
    pieces = words = 0

    def close() -> None:
        if len(run) > 1:
            out.append((run[0][0], run[-1][1], run[0][2], run[-1][3], run[0][4], run[-1][5]))
        run.clear()

    last = -1
    for line in _LINE.finditer(text):
        first = len(out)
        for m in _PIECE.finditer(line[0]):
            found = m[0].rstrip(" \t\n\x0b\f\r")
            n = len(found.encode("utf-8", "surrogatepass").split())
            start = line.start() + m.start()
            out.append((start, start + len(found), pieces, pieces, words, words + n))
            pieces, words = pieces + 1, words + n
        if line.start() > last + 1 or first == len(out):
            before, out = out[first:], out[:first]
            close()
            out += before
            first = len(out) - len(before)
        last = line.end()
        if first < len(out):
            run.append((out[first][0], out[-1][1], out[first][2], out[-1][3], out[first][4], out[-1][5]))
    close()
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x.slice(k, 1000) for x in batches for k in range(0, x.num_rows, 1000)):
        rows = []
        for doc, value in zip(b.column(0).to_pylist(), b.column(1)):
            text = value.as_py() or ""
            text_id = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
            for unit in units(text):
                h = xxhash.xxh3_128_intdigest(b" ".join(text[unit[0] : unit[1]].encode("utf-8", "surrogatepass").lower().split()))
                rows.append(((h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), doc, text_id, *unit))
        cols = list(zip(*rows)) if rows else [()] * 10
        names = [c.split(" ")[0] for c in UNIT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def repeated_units(docs: DataFrame) -> DataFrame:
    """Every unit that is not the first of its digest, with ``first``, the place (doc_id, start) of the first."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    found = materialize(texts.mapInArrow(_units, UNIT), "sd-units")
    place = F.struct("doc_id", "start")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    firsts = materialize(firsts.select("h1", "h2", "first"), "sd-firsts")
    again = may_hold(found, F.col("h1"), firsts, F.col("h1")).join(firsts, ["h1", "h2"]).filter("doc_id <> first.doc_id or start <> first.start")
    return again.drop("h1", "h2").distinct()


def repeated_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each span to remove: (doc_id, start, end, n_words, n_pieces, first_doc, first_start), the last two where its first unit stays."""
    again = repeated_units(docs)
    # A span goes on while a unit starts no later than one piece after those before it end; the window is one text.
    order = Window.partitionBy("doc_id", "text_id").orderBy("piece", F.col("last_piece").desc())
    reach = F.max("last_piece").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = again.withColumn("_new", F.coalesce((F.col("piece") > reach + 1).cast("int"), F.lit(1)))
    cut = cut.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = cut.groupBy("doc_id", "text_id", "_span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last_word") - F.min("word")).alias("n_words"),
        (F.max("last_piece") - F.min("piece") + 1).alias("n_pieces"), F.min(F.struct("piece", "first")).alias("_f"),
    )
    g = g.filter(F.col("n_words") >= least)
    return g.select("doc_id", "start", "end", "n_words", "n_pieces", F.col("_f.first.doc_id").alias("first_doc"), F.col("_f.first.start").alias("first_start"))


@query("op7_substring_dedup")
def op7(spark, sf_dir):
    return repeated_spans(table(spark, sf_dir, "documents"))
