"""Numeric kit: small Column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def logit(p: Column, eps: float = 1e-10) -> Column:
    return F.ln(p / (1.0 - p + eps) + eps)


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    """``a / b``, or ``default`` where ``b`` is zero."""
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def cv(std: Column, mean: Column, eps: float = 0.0) -> Column:
    return safe_div(std, mean + eps)


def round4(c: Column) -> Column:
    return F.round(c, 4)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Inside a lambda the bound value is a variable reference. A plain column
    used there would not do: when the optimizer moves a filter below the
    projection that computes the column, it copies the whole expression into
    the loop, and an O(n) array becomes O(n^2).
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flags(*pairs: tuple[Column, str | Column]) -> Column:
    """ARRAY<STRING> of the texts whose condition holds, in the given order."""
    items = [F.when(cond, F.lit(t) if isinstance(t, str) else t) for cond, t in pairs]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def array_mean(arr: Column) -> Column:
    """Mean of the elements, NULL for an empty array."""
    return let(arr, lambda a: F.when(F.array_size(a) > 0, array_sum(a) / F.array_size(a)))


def array_var(arr: Column) -> Column:
    """Population variance of the elements, two passes for stability."""

    def spread(a: Column) -> Column:
        return let(array_mean(a), lambda m: array_mean(F.transform(a, lambda x: (x - m) * (x - m))))

    return let(arr, spread)


def array_std(arr: Column) -> Column:
    return F.sqrt(array_var(arr))


def running_std(arr: Column) -> Column:
    """Population deviation with mean and squares updated value by value, as SQL's stddev_pop has it.

    Where it lies on a threshold, the last digit decides, and two passes may give another one.
    """

    def mean(a: Column, x: Column) -> Column:
        return a["m"] + (x - a["m"]) / (a["k"] + 1)

    def step(a: Column, x: Column) -> Column:
        return F.struct((a["k"] + 1).alias("k"), mean(a, x).alias("m"), (a["q"] + (x - mean(a, x)) * (x - a["m"])).alias("q"))

    start = F.struct(*[F.lit(0.0).alias(n) for n in "kmq"])
    return F.aggregate(arr, start, step, lambda a: F.when(a["k"] > 0, F.sqrt(a["q"] / a["k"])))


def mean_of_present(*parts: Column) -> Column:
    """Mean over the non-null parts, NULL when there is none."""
    return let(F.filter(F.array(*parts), lambda x: x.isNotNull()), array_mean)


def fmt(pattern: str, *cols: Column) -> Column:
    return F.format_string(pattern, *cols)
