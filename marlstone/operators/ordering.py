"""Global order without a single-task sort.

Rows get numbers from counts per bucket, where buckets follow the order: the
running sum runs over the few buckets only, and the sort inside each bucket is a
task of its own. ``bucket`` must grow with the order columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import UNIT, unit_key


#: A bucket is sorted in one task.
LEAST_BUCKETS, BUCKET_ROWS = 16, 1_000_000


def global_row_number(df: DataFrame, order: list[Column], bucket: Column, name: str = "row") -> DataFrame:
    """``df`` with whole numbers from 0 in the given order. ``order`` must be total."""
    dealt = df.withColumn("bucket__", bucket)
    sizes = dealt.groupBy("bucket__").agg(F.count(F.lit(1)).alias("n__"))
    before = Window.orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("start__"))
    within = F.row_number().over(Window.partitionBy("bucket__").orderBy(*order)) - 1
    # one row per bucket; AQE broadcasts it where it is small
    return dealt.withColumn("in__", within).join(starts, "bucket__").withColumn(name, F.col("start__") + F.col("in__")).drop("bucket__", "start__", "in__")


def shuffled(df: DataFrame, seed: int, ids: list[str], buckets: int | None = None, name: str = "row") -> DataFrame:
    """Rows numbered in a seeded random order that any engine reproduces. The number
    of buckets, which doesn't change the order, grows with the rows unless it is given."""
    if buckets is None:
        buckets = max(LEAST_BUCKETS, -(-df.count() // BUCKET_ROWS))
    keyed = df.withColumn("key__", unit_key(seed, *[F.col(c) for c in ids]))
    width = UNIT // buckets
    order = [F.col("key__"), *[F.col(c) for c in ids]]
    return global_row_number(keyed, order, F.floor(F.col("key__") / width), name).drop("key__")


def in_chunks(df: DataFrame, size: int, row: str = "row", keep_rest: bool = False, total: int | None = None) -> DataFrame:
    """``chunk`` and ``at`` (place in it) from row numbers; an incomplete last
    chunk is dropped unless kept."""
    out = df.withColumn("chunk", F.floor(F.col(row) / size)).withColumn("at", F.pmod(F.col(row), F.lit(size)))
    if keep_rest:
        return out
    n = df.count() if total is None else total
    return out.where(F.col(row) < n - n % size)


def by_label(df: DataFrame, label: str, id_: str, name: str = "row") -> DataFrame:
    """Rows numbered in the order of their label, then whole-numbered id. A bucket is
    a range of ids within a label, so that a frequent label is many tasks."""
    bucket = F.struct(F.col(label), F.floor(F.col(id_) / BUCKET_ROWS))
    return global_row_number(df, [F.col(label), F.col(id_)], bucket, name)
