"""Ordered computation that never needs one task to hold a whole key.

A window partitioned by the key alone would put every row of a hot key into
one task. Two devices replace it:

* ``prefix_sums`` / ``dense_index``: running totals from per-cell totals, where
  a cell is a monotone integer bucket of the order column. Cells are folded in
  groups of ``FAN``, so each window holds at most ``FAN`` small rows or the
  rows of a single cell.
* ``with_halo``: rows with a dense position are cut into chunks of ``CHUNK``
  rows; each chunk also receives the few rows around its edges, so lag, lead
  and moving frames are exact inside the chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN_BITS = 12
FAN = 1 << FAN_BITS
CHUNK = 4096


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    cell: Column,
    order: list[Column],
    sums: dict[str, Column],
    levels: int = 1,
) -> DataFrame:
    """Add inclusive running sums along ``order`` inside ``keys``.

    ``cell`` is a bigint that never decreases along ``order``. ``levels`` says
    how often cells are folded by ``FAN`` before the top window, which then
    spans range(cell) / FAN**levels rows per key. Rows with a NULL key or cell
    are left out.
    """
    names = list(sums)
    # Rows without a key or place belong to no series. Saying so here keeps the
    # branches below alike, so Spark runs their common exchange once.
    placed = F.col("_c0").isNotNull()
    for k in keys:
        placed = placed & F.col(k).isNotNull()
    folded = F.col("_c0")
    for _ in range(levels):
        folded = F.shiftright(folded, FAN_BITS)
        placed = placed & folded.isNotNull()
    base = df.withColumn("_c0", cell.cast("bigint")).filter(placed)
    for n in names:
        base = base.withColumn(f"_v_{n}", sums[n])
    totals = [
        base.groupBy(*keys, "_c0").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    ]
    for lv in range(1, levels + 1):
        up = totals[-1].withColumn(f"_c{lv}", F.shiftright(f"_c{lv - 1}", FAN_BITS))
        totals[-1] = up
        totals.append(
            up.groupBy(*keys, f"_c{lv}").agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in names])
        )

    def exclusive(frame: DataFrame, part: list[str], by: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumns(
            {f"_e_{n}": F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0)) for n in names}
        )

    offsets = exclusive(totals[levels], keys, f"_c{levels}")
    for lv in range(levels - 1, -1, -1):
        inner = exclusive(totals[lv], [*keys, f"_c{lv + 1}"], f"_c{lv}")
        outer = offsets.select(
            *keys, f"_c{lv + 1}", *[F.col(f"_e_{n}").alias(f"_o_{n}") for n in names]
        )
        offsets = inner.join(outer, [*keys, f"_c{lv + 1}"]).select(
            *keys, f"_c{lv}", *[(F.col(f"_e_{n}") + F.col(f"_o_{n}")).alias(f"_e_{n}") for n in names]
        )
    offsets = offsets.select(*keys, "_c0", *[f"_e_{n}" for n in names])
    w = (
        Window.partitionBy(*keys, "_c0")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = base.join(offsets, [*keys, "_c0"]).withColumns(
        {n: F.sum(f"_v_{n}").over(w) + F.col(f"_e_{n}") for n in names}
    )
    return out.select(*df.columns, *names)


def dense_index(
    df: DataFrame,
    keys: list[str],
    cell: Column,
    order: list[Column],
    out: str = "idx",
    levels: int = 1,
) -> DataFrame:
    """Add the 0-based position of each row inside its key."""
    seq = prefix_sums(df, keys, cell, order, {out: F.lit(1).cast("bigint")}, levels)
    return seq.withColumn(out, F.col(out) - 1)


def with_halo(
    df: DataFrame, keys: list[str], idx: str, before: int, after: int, chunk: int = CHUNK
) -> tuple[DataFrame, Window]:
    """Chunk rows by dense position and copy the edge rows to the neighbours.

    Returns the chunked rows and the window to use over them. Keep only rows
    with ``_own`` after the window columns are computed.
    """
    i = F.col(idx)
    lo = F.greatest(F.floor((i - after) / chunk), F.lit(0))
    hi = F.floor((i + before) / chunk)
    cut = df.withColumn("_blk", F.explode(F.sequence(lo, hi))).withColumn(
        "_own", F.col("_blk") == F.floor(i / chunk)
    )
    return cut, Window.partitionBy(*keys, "_blk").orderBy(idx)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_blk")


def second_cell(ts: Column) -> Column:
    """Monotone cell of a timestamp: seconds since the epoch."""
    return F.unix_seconds(ts.cast("timestamp"))


def unit_cell(v: Column) -> Column:
    """Monotone cell of a value in [0, 1]."""
    return F.floor(v * (FAN * FAN))


def log_cell(v: Column) -> Column:
    """Monotone cell of any number: by magnitude on either side of zero, zero alone, NaN last; NULL has none."""
    size = lambda x: F.floor((F.least(F.log2(x), F.lit(1100.0)) + 1100) * (1 << 20)) + 1
    return (
        F.when(F.isnan(v), F.lit(1 << 32))
        .when(v > 0, size(v))
        .when(v < 0, -size(-v))
        .when(v == 0, F.lit(0))
    )


def histogram_ranks(
    df: DataFrame, keys: list[str], value: str, cell: Column, levels: int = 1
) -> DataFrame:
    """Distinct values with their rank range ``[lo, hi)`` and the key's total.

    Equal values collapse before any shuffle of rows, so a value shared by a
    third of all rows costs one row per map task. NULL values have no rank and
    do not count towards the total; rows with a NULL key belong to no series.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(hist, keys, cell, [F.col(value)], {"hi": F.col("n")}, levels)
    ranked = ranked.withColumn("lo", F.col("hi") - F.col("n"))
    if keys:
        return ranked.join(hist.groupBy(*keys).agg(F.sum("n").alias("total")), keys)
    return ranked.withColumn("total", hist.agg(F.sum("n")).scalar())


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    cell: Column,
    levels: int = 1,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name."""
    ranks = histogram_ranks(df, keys, value, cell, levels)
    aggs = []
    for name, q in probs.items():
        pos = F.col("total").cast("double") * q - q
        low = F.floor(pos)
        high = F.ceil(pos)
        at_low = F.max(F.when((F.col("lo") <= low) & (low < F.col("hi")), F.col(value)))
        at_high = F.max(F.when((F.col("lo") <= high) & (high < F.col("hi")), F.col(value)))
        frac = F.max(pos - low)
        aggs.append((at_low + (at_high - at_low) * frac).alias(name))
    return ranks.groupBy(*keys).agg(*aggs)


def disc_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], cell: Column, levels: int = 1) -> DataFrame:
    """Exact quantiles that are values of the table: the smallest with at least a share ``q`` at or below it."""
    ranks = histogram_ranks(df, keys, value, cell, levels)
    n = F.col("total").cast("double")
    aggs = []
    for name, q in probs.items():
        at = F.greatest(n - F.floor(n - n * q), F.lit(1.0))
        aggs.append(F.max(F.when((F.col("lo") < at) & (at <= F.col("hi")), F.col(value))).alias(name))
    return ranks.groupBy(*keys).agg(*aggs)


def ordered_mean(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Add ``_a``, the mean of each key, with its sum taken in the given order.

    A sum of doubles depends on the order of its terms in the last digit, which
    decides scores that lie on a threshold. In a fixed order it is the same in
    every run. Such a sum is serial: a key streams through one task, with one
    number of state.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("_a", F.avg(value).over(w))
