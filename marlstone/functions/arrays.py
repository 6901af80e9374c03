"""Functions on fixed-length numeric arrays. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def positives(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: v > 0)).cast("bigint")


def is_finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < float("inf"))


def non_finite(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: ~is_finite(v))).cast("bigint")


def finite_or_zero(x: Column) -> Column:
    return F.transform(x, lambda v: F.when(is_finite(v), v).otherwise(F.lit(0.0)))


def scaled_log1p(x: Column, target: float = 10_000.0) -> Column:
    """Scaled to a common total, then log1p; an all-zero array stays."""
    summed = F.get(F.transform(F.array(total(x)), lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s)), F.lit(0))
    return F.get(F.transform(F.array(summed), lambda s: F.transform(x, lambda v: F.log1p(v * target / s))), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.when(norm(a) * norm(b) == 0, F.lit(1.0)).otherwise(norm(a) * norm(b))


def negative_l2(a: Column, b: Column) -> Column:
    return -F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def argmax(x: Column) -> Column:
    return (F.array_position(x, F.array_max(x)) - 1).cast("bigint")


def with_cls(x: Column, value: float = 0.0) -> Column:
    return F.concat(F.array(F.lit(value)), x)


def nonzero_pairs(genes: Column, x: Column) -> Column:
    return F.filter(F.arrays_zip(genes.alias("gene"), x.alias("value")), lambda p: p["value"] != 0)


def permuted(x: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.get(x, i.cast("int")))


def column_order(have: list[str], want: list[str]) -> list[int]:
    """For each wanted name its place among those at hand, for :func:`permuted`. Sets
    that differ and repeated names raise: this is a pure reordering."""
    at = {name: i for i, name in enumerate(have)}
    if len(at) != len(have) or len(set(want)) != len(want):
        raise ValueError("repeated names")
    if at.keys() != set(want):
        raise ValueError(f"names differ: {sorted(at.keys() ^ set(want))[:5]}")
    return [at[name] for name in want]
