"""Mixing sources to target weights along a training curriculum.

Sizes are words. Sources in code-point order (null last) weigh 1, 2, 3, 1, ...
and share all words by weight; a share stops at ``MOST`` times its source, and
what is over goes to the others by weight until none is above. Only totals of
sources take part in this; the level is found by repeated aggregates.

Within a source, documents stand in the order of a hash of their id. A source
is read from the start, again and again, until its target is met: the running
size of a document tells how often it is taken, the last one in part. Each
source also has a weight schedule over training time in [0, 1], linear with
integral 1: sources of weight 1 fade out, those of weight 3 fade in. The words
taken before the middle of a copy, over the target, are the source's
cumulative demand there; inverting the integrated schedule gives the training
position of the copy, and a range sort by position is the training order.

Running sums use the hash digits: totals of 256 cells, of 256 cells in each,
then rows of one small cell, so a source with a third of all rows is spread
over all tasks.

Odd rows: a null text has size 0 and is never taken, like an empty one; null
sources are one source; a null doc_id is hashed as the empty string; repeated
rows follow each other and count each. Columns of the input are kept; its
columns named like a result column are replaced. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .catalog import query
from .common import table, words

MOST = 3
SLOPES = (-1.0, 0.0, 1.0)

RESULT = ("size", "source_size", "target", "taken", "copies", "position")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 in code-point order, null last, without a window over all of them."""
    order = [F.col("source").isNull(), F.col("source")]
    spread = materialize(sources.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "mix-sources")
    counts = spread.groupBy("_p").agg(F.count("*").alias("n"))  # one row for each partition
    before = counts.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return spread.join(before, "_p").withColumn("rank", F.col("_before") + inside - 1).drop("_p", "_before")


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Rows (source, source_size, weight, target) from rows (source, _size)."""
    totals = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    ranked = materialize(_ranked(totals).select("source", "source_size", (F.col("rank") % len(SLOPES) + 1).alias("weight")), "mix-totals")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) > most * F.col("source_size")
        spent, weight = ranked.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        reached = (total - spent) / weight
        if reached <= level:
            break
        level = reached
    return ranked.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.col("weight") * F.lit(level)))


def _key(c: str = "source") -> Column:
    """The source as a join key that tells null from the empty string."""
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))


def mixture(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``docs`` (with ``_size``) and the columns of ``RESULT``.

    ``sizes``: the columns doc_id, source and _size of the same rows, cheap to read.
    ``taken`` counts words; ``copies`` rounds the last, partial copy; ``position``
    is that of the first copy, null if nothing is taken.
    """
    targets = source_targets(sizes)

    def celled(df: DataFrame) -> DataFrame:
        h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
        return df.withColumns({"_s": _key(), "_h": h}).withColumns({"_c1": F.substring("_h", 1, 2), "_c2": F.substring("_h", 3, 2)})

    cells = materialize(celled(sizes).groupBy("_s", "_c1", "_c2").agg(F.sum("_size").alias("_n")), "mix-cells")
    low = Window.partitionBy("_s", "_c1").orderBy("_c2").rowsBetween(Window.unboundedPreceding, -1)
    high = Window.partitionBy("_s").orderBy("_c1").rowsBetween(Window.unboundedPreceding, -1)
    tops = cells.groupBy("_s", "_c1").agg(F.sum("_n").alias("_n")).select("_s", "_c1", F.coalesce(F.sum("_n").over(high), F.lit(0)).alias("_top"))
    inner = cells.select("_s", "_c1", "_c2", F.coalesce(F.sum("_n").over(low), F.lit(0)).alias("_low"))
    shares = targets.select(_key().alias("_s"), "source_size", "target", "weight")
    starts = inner.join(tops, ["_s", "_c1"]).join(shares, "_s")
    starts = materialize(starts.select("_s", "_c1", "_c2", (F.col("_top") + F.col("_low")).alias("_start"), "source_size", "target", "weight"), "mix-starts")
    rows = celled(docs.drop(*[c for c in RESULT if c in docs.columns])).join(starts, ["_s", "_c1", "_c2"])
    last = Window.partitionBy("_s", "_c1", "_c2").orderBy("_h", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.col("_start") + F.coalesce(F.sum("_size").over(last), F.lit(0)))
    goal = F.round("target").cast("bigint")
    rows = rows.withColumns({"size": F.col("_size"), "_goal": goal, "_full": F.coalesce(F.floor(F.try_divide(goal, F.col("source_size"))), F.lit(0))})
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_goal") - F.col("_full") * F.col("source_size") - F.col("_at")))
    rows = rows.withColumn("_part", part)
    rows = rows.withColumn("taken", F.col("_full") * F.col("_size") + F.col("_part"))
    rows = rows.withColumn("copies", F.when(F.col("_size") > 0, F.col("_full") + (2 * F.col("_part") >= F.col("_size")).cast("bigint")).otherwise(0))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, position(F.lit(0))))
    return rows


def position(copy: Column) -> Column:
    """Training position in [0, 1] of a copy (0, 1, ...) of a row of ``mixture``."""
    words_in = F.when(copy < F.col("_full"), F.col("_size")).otherwise(F.col("_part"))
    u = (copy * F.col("source_size") + F.col("_at") + words_in / 2) / F.col("_goal")
    a = F.element_at(F.array(*[F.lit(s) for s in SLOPES]), F.col("weight").cast("int"))
    b = 1 - a / 2
    return F.when(a == 0, u).otherwise((F.sqrt(F.greatest(b * b + 2 * a * u, F.lit(0.0))) - b) / a)


def _copies(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each whole copy, with ``_copy`` and ``_position``."""
    copies = mixture(docs, sizes).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return copies.withColumn("_position", position(F.col("_copy")))


def training_order(docs: DataFrame) -> DataFrame:
    """Whole copies of documents in the order of training, with the columns of ``docs``."""
    names = docs.columns
    sized = docs.select("doc_id", "source", F.struct("*").alias("_doc"), F.size(words(F.col("text"))).cast("bigint").alias("_size"))
    sizes = materialize(sized.select("doc_id", "source", "_size"), "mix-sizes")
    placed = _copies(sized, sizes).select("_doc", "_position", "_copy", "_h")
    return placed.repartitionByRange("_position", "_h").sortWithinPartitions("_position", "_h", "_copy").select(*[F.col("_doc")[c].alias(c) for c in names])


def training_ranks(docs: DataFrame) -> DataFrame:
    """One row for each whole copy: (doc_id, copy, position, rank), rank from 0 in the order of training."""
    sizes = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("_size"))
    sizes = materialize(sizes, "mix-sizes")
    order = ["_position", "_h", "_copy"]
    placed = _copies(sizes, sizes).select("doc_id", *order)
    spread = materialize(placed.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "mix-order")
    counts = spread.groupBy("_p").agg(F.count("*").alias("n"))  # one row for each partition
    before = counts.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    ranked = spread.join(F.broadcast(before), "_p").withColumn("rank", F.col("_before") + inside - 1)
    return ranked.select("doc_id", F.col("_copy").alias("copy"), F.col("_position").alias("position"), "rank")


def mixed(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document."""
    sizes = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("_size"))
    sizes = materialize(sizes, "mix-sizes")
    return mixture(sizes, sizes).select("doc_id", *RESULT)


SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
      md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS k, coalesce(sum(3 * source_size) OVER q, 0) AS spent, sum(weight) OVER () - coalesce(sum(weight) OVER q, 0) AS open,
      sum(source_size) OVER () AS total FROM w WINDOW q AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT min_by((total - spent)::DOUBLE / open, k) FILTER ((total - spent)::DOUBLE / open * weight <= 3 * source_size) AS level FROM r),
t AS (SELECT source, source_size, weight, least((3 * source_size)::DOUBLE, weight * level) AS target FROM w, v),
p AS (SELECT doc_id, size, source_size, target, weight, round(target)::BIGINT AS goal,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE goal // source_size END AS n FROM p),
g AS (SELECT *, greatest(0, least(size, goal - n * source_size - pos)) AS part, [-1.0, 0.0, 1.0][weight]::DOUBLE AS a FROM f),
u AS (SELECT *, (pos + CASE WHEN n > 0 THEN size ELSE part END::DOUBLE / 2) / goal AS u FROM g)
SELECT doc_id, size, source_size, target, (n * size + part)::BIGINT AS taken, CASE WHEN size > 0 THEN n + (2 * part >= size)::INT ELSE 0 END::BIGINT AS copies,
  CASE WHEN n * size + part > 0 THEN CASE WHEN a = 0 THEN u ELSE (sqrt(greatest((1 - a / 2) * (1 - a / 2) + 2 * a * u, 0)) - (1 - a / 2)) / a END END AS position FROM u
"""


@query("op8_source_mixing", SQL)
def op8(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents"))


ORDER_SQL = SQL[: SQL.index("SELECT doc_id, size, source_size, target, (n * size")] + r""",
c AS (SELECT *, unnest(range(n + CASE WHEN size > 0 AND 2 * part >= size THEN 1 ELSE 0 END)) AS copy FROM u WHERE size > 0),
v2 AS (SELECT doc_id, a, copy, (copy * source_size + pos + CASE WHEN copy < n THEN size ELSE part END::DOUBLE / 2) / goal AS x FROM c),
o AS (SELECT doc_id, copy, CASE WHEN a = 0 THEN x ELSE (sqrt(greatest((1 - a / 2) * (1 - a / 2) + 2 * a * x, 0)) - (1 - a / 2)) / a END AS position FROM v2)
SELECT doc_id, copy::BIGINT AS copy, position, row_number() OVER (ORDER BY position, md5(coalesce(doc_id::VARCHAR, '')), copy) - 1 AS rank FROM o
"""


@query("op8_training_order", ORDER_SQL)
def op8_order(spark, sf_dir):
    return training_ranks(table(spark, sf_dir, "documents"))
