"""Score calibration: Platt fit, temperature search, calibration error."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, logit, sigmoid

MIN_SAMPLES = 10
BINS = 10
CELLS = 4096
TEMPERATURES = [round(0.1 * k, 1) for k in range(1, 50)]


def score_histogram(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """Distinct scores of each group with row and positive counts.

    Rows without a score or a label take no part. A score that many rows share
    is one row of each map task before the shuffle.
    """
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(group, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )


def score_moments(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """Moments of the scores around the middle ``c`` of each of ``CELLS`` cells of a unit.

    A group of scores in [0, 1] has at most ``CELLS`` + 1 rows however many
    samples it holds; no score is rounded.
    """
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("_cell", F.floor(F.col(score).cast("double") * CELLS))
    s, y, c = F.col(score).cast("double"), F.col(label).cast("double"), (F.col("_cell") + 0.5) / CELLS
    d = s - c
    return known.groupBy(group, "_cell").agg(
        F.max(c).alias("c"), F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(y * s).alias("ys"),
        F.sum(d).alias("m1"), F.sum(d * d).alias("m2"), F.sum(d * d * d).alias("m3"),
    )


def _descend(pdf: pd.DataFrame) -> tuple[float, float]:
    c, n, m1, m2, m3 = (pdf[k].to_numpy(float) for k in ("c", "n", "m1", "m2", "m3"))
    total, y, ys = n.sum(), pdf["y"].sum(), pdf["ys"].sum()
    a, b = -1.0, 0.0
    for _ in range(1000):
        p = np.clip(1.0 / (1.0 + np.exp(-(a * c + b))), 1e-7, 1 - 1e-7)
        # derivatives of the curve at the middle of the cell, over the factorials
        p1 = a * p * (1 - p)
        p2, p3 = a * p1 * (1 - 2 * p) / 2, a * a * p1 * (1 - 6 * p + 6 * p * p) / 6
        near = p1 * m1 + p2 * m2 + p3 * m3
        at_b = (p * n + near).sum() - y
        at_a = (c * (p * n + near) + p * m1 + p1 * m2 + p2 * m3).sum() - ys
        a, b = a - 0.01 * float(at_a) / total, b - 0.01 * float(at_b) / total
    return a, b


def platt_fit(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """Slope and intercept per group; groups below ten samples give no row.

    The descent runs on the moments of ``score_moments``. After 1,000 steps of
    .01 the slope is below 11 in size, so over half a cell the cubic expansion
    of the curve is off by less than 1e-11. Scores are taken to lie in [0, 1].
    """
    cells = score_moments(df, group, score, label)
    kind = df.schema[group].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        enough = pdf["n"].sum() >= MIN_SAMPLES
        a, b = _descend(pdf) if enough else (np.nan, np.nan)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "a": [a], "b": [b]})

    fitted = cells.groupBy(group).applyInPandas(fit, f"{group} {kind}, a double, b double")
    return fitted.filter(F.col("a").isNotNull() & ~F.isnan("a"))


def apply_temperature(score: Column, temperature: Column) -> Column:
    return sigmoid(logit(score) / temperature)


def ece_bin(p: Column) -> Column:
    """Half-open bin of a probability on the edges k/10; NULL at 1.0."""
    b = F.floor(p * BINS).cast("int")
    # The product can round across an edge; compare with the edge itself.
    b = F.when(p < b / F.lit(float(BINS)), b - 1).when(p >= (b + 1) / F.lit(float(BINS)), b + 1).otherwise(b)
    return F.when((p >= 0) & (p < 1), b)


def ece(df: DataFrame, keys: list[str], p: str, n: Column, pos: Column) -> DataFrame:
    """Expected calibration error; ``n`` and ``pos`` weigh collapsed rows."""
    rows = df.withColumns({"_bin": ece_bin(F.col(p)), "_n": n, "_pos": pos})
    bins = rows.groupBy(*keys, "_bin").agg(
        F.sum("_n").alias("_n"), F.sum(F.col(p) * F.col("_n")).alias("_p"), F.sum("_pos").alias("_y")
    )
    gap = F.abs(F.col("_p") - F.col("_y"))
    return bins.groupBy(*keys).agg(
        (F.sum(F.when(F.col("_bin").isNotNull(), gap).otherwise(0.0)) / F.sum("_n")).alias("ece"),
        F.sum("_n").alias("samples"),
    )


def temperature_grid(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """Calibration error of every group at every candidate temperature."""
    hist = score_histogram(df, group, score, label)
    grid = F.array(*[F.lit(t) for t in TEMPERATURES])
    wide = hist.withColumn("temperature", F.explode(grid)).withColumn(
        "_p", apply_temperature(F.col("score"), F.col("temperature"))
    )
    return ece(wide, [group, "temperature"], "_p", F.col("n"), F.col("pos"))


def temperature_fit(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """First temperature with the lowest calibration error."""
    g = temperature_grid(df, group, score, label).filter(F.col("samples") >= MIN_SAMPLES)
    best = F.min(F.struct("ece", "temperature")).alias("_b")
    return g.groupBy(group).agg(best).select(group, F.col("_b.temperature").alias("temperature"), F.col("_b.ece").alias("ece"))


def calibrate(df: DataFrame, params: DataFrame, group: str, score: str, confidence: str) -> DataFrame:
    """Apply fitted parameters; rows of unfitted groups stay as they are."""
    j = df.join(params.select(group, "a", "b", "temperature"), group, "left")
    fitted = F.col("a").isNotNull()
    s = F.when(fitted, sigmoid(F.col("a") * F.col(score) + F.col("b"))).otherwise(F.col(score))
    c = F.when(fitted, apply_temperature(F.col(confidence), F.col("temperature"))).otherwise(F.col(confidence))
    d = j.withColumns({"_s": s, "_c": c})
    return d.withColumns(
        {
            "calibrated_score": clip(F.col("_s")),
            "calibrated_confidence": clip(F.col("_c")),
            "reliability": clip(F.abs(F.col("_s") - 0.5) * 2 * 0.5 + F.col("_c") * 0.5),
            "method": F.when(fitted, "platt_scaling").otherwise("uncalibrated"),
        }
    ).drop("_s", "_c", "a", "b", "temperature")
