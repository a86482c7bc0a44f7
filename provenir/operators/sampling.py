"""Samplers over keyed, positioned rows. Each is the feature itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col


def _with_count(df: DataFrame, key: str) -> DataFrame:
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each key; the rank limit also runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def balanced_cap(df: DataFrame, class_col: str, order: list[Column], max_samples: int) -> DataFrame:
    """First half of the allowance from each class, by name."""
    return top_rows(df, [class_col], order, max_samples // 2)


def sample_stride(df: DataFrame, key: str, idx: str, max_frames: int = 60) -> DataFrame:
    """Every (n div max_frames)-th row, at most ``max_frames`` of them."""
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / max_frames))
    picked = (F.col(idx) % step == 0) & (F.floor(F.col(idx) / step) < max_frames)
    return _with_count(df, key).filter(picked).drop("_n")


def even_pick(idx: str | Column, n: str | Column, k: int) -> Column:
    """Whether a position belongs to ``k`` evenly spaced, truncated positions."""
    i, total = col(idx), col(n)
    if k <= 1:
        return (i == 0) if k == 1 else F.lit(False)
    step = (total - 1) / F.lit(float(k - 1))
    near = F.ceil(i / step)
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        j = near + shift
        hit = hit | (j.between(0, k - 1) & (F.floor(j * step) == i))
    return F.when(total <= k, F.lit(True)).otherwise(hit | (i == total - 1))


def sample_even(df: DataFrame, key: str, idx: str, k: int) -> DataFrame:
    return _with_count(df, key).filter(even_pick(idx, "_n", k)).drop("_n")


def sample_seconds(df: DataFrame, idx: str, fps: str | Column, rate: float) -> DataFrame:
    """One row per ``rate`` seconds of footage."""
    step = F.greatest(F.lit(1), (col(fps) * rate).cast("int"))
    return df.filter(F.col(idx) % step == 0)


def sample_every(df: DataFrame, idx: str, n: int = 10) -> DataFrame:
    return df.filter(F.col(idx) % n == 0)


def sample_head(df: DataFrame, key: str, idx: str, k: int) -> DataFrame:
    """First ``k`` rows of each key, from the dense position alone."""
    return df.filter(F.col(idx) < k)


def sample_ends(df: DataFrame, key: str, idx: str) -> DataFrame:
    """First, middle and last row of each key."""
    i, n = F.col(idx), F.col("_n")
    keep = (i == 0) | (i == F.floor(n / 2)) | (i == n - 1)
    return _with_count(df, key).filter(keep).drop("_n")


def retain_last(df: DataFrame, order: list[Column], n: int = 10_000) -> DataFrame:
    """Newest ``n`` rows; ``order`` is descending."""
    return df.orderBy(*order).limit(n)
