"""Data-quality and randomness checks over tables of arrays and labels."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays


def cell_reductions(df: DataFrame, x: str = "x") -> DataFrame:
    """Largest value, sum, positive and non-finite entries of each array;
    non-finite values count as zero."""
    clean = arrays.finite_or_zero(F.col(x))
    return df.withColumn("bad", arrays.non_finite(F.col(x))).withColumn("clean__", clean).select(
        *df.columns,
        "bad",
        F.coalesce(F.array_max("clean__"), F.lit(0.0)).alias("val_max"),
        arrays.total(F.col("clean__")).alias("libsize"),
        arrays.positives(F.col("clean__")).alias("nnz"),
        F.size(x).cast("bigint").alias("width"),
    )


def file_distribution(reduced: DataFrame, width: int, file: str = "file") -> DataFrame:
    """One row per file of reduced arrays."""
    p = lambda c, *qs: [F.get(F.percentile(c, F.array(*map(F.lit, qs))), F.lit(i)) for i in range(len(qs))]
    m50, m99, m999 = p("val_max", 0.5, 0.99, 0.999)
    l50, l99 = p("libsize", 0.5, 0.99)
    return reduced.groupBy(file).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("width") != width).alias("shape_bad"),
        F.sum("bad").alias("bad_values"),
        F.count_if(F.col("bad") > 0).alias("bad_cells"),
        F.max("val_max").alias("val_max"),
        m50.alias("cellmax_p50"),
        m99.alias("cellmax_p99"),
        m999.alias("cellmax_p999"),
        l50.alias("libsize_p50"),
        l99.alias("libsize_p99"),
        F.max("libsize").alias("libsize_max"),
        F.percentile("nnz", F.lit(0.5)).alias("nnz_p50"),
        F.max("nnz").alias("nnz_max"),
        (1 - F.avg("nnz") / width).alias("sparsity_mean"),
        F.min("species").alias("species_min"),
        F.max("species").alias("species_max"),
    )


def grouped_rollup(reduced: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and maxima by each key on its own, in one pass (grouping sets)."""
    sets = [[F.col(k)] for k in keys]
    out = reduced.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"), F.max("val_max").alias("val_max"), F.max("libsize").alias("libsize_max")
    )
    return out.where(F.coalesce(*[F.col(k).cast("bigint") for k in keys]).isNotNull())


def outlier_verdict(per_file: DataFrame, value: str = "val_max", limit: float = 3.0) -> DataFrame:
    """Whether the largest file lies far above the median one."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    out = per_file.where(F.col(value) > float("-inf")).agg(
        F.max(value).alias("largest"), F.get(q, F.lit(0)).alias("median"), F.get(q, F.lit(1)).alias("p95"), F.count(F.lit(1)).alias("files")
    )
    ratio = F.when(F.col("median") == 0, F.lit(float("inf"))).otherwise(F.col("largest") / F.col("median"))
    return out.withColumn("ratio", ratio).withColumn("verdict", F.when(F.col("ratio") >= limit, F.lit("big spread")).otherwise(F.lit("even")))


def label_ranges(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Per label column: nulls, values outside ``0 <= v < limit``, least and largest."""
    pairs = ", ".join(f"'{c}', cast({c} as bigint), cast({n} as bigint)" for c, n in limits.items())
    long = df.selectExpr(f"stack({len(limits)}, {pairs}) as (label, v, top)")
    return long.groupBy("label").agg(
        F.count_if(F.col("v").isNull()).alias("nulls"),
        F.count_if((F.col("v") < 0) | (F.col("v") >= F.col("top"))).alias("outside"),
        F.min("v").alias("least"),
        F.max("v").alias("largest"),
    )


def shape_check(df: DataFrame, width: int, x: str = "x") -> DataFrame:
    """Rows whose array has another length or a non-finite element."""
    bad = F.exists(F.col(x), lambda v: ~arrays.is_finite(v))
    return df.withColumn("wrong_length", F.size(x) != width).withColumn("not_finite", bad).where("wrong_length or not_finite")


def change_ratio(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Share of neighbours that differ, and what random order would give: 1 − Σp²."""
    w = Window.partitionBy(group).orderBy(order)
    changed = F.col(value) != F.lag(value).over(w)
    got = df.withColumn("c__", changed.cast("int")).groupBy(group).agg(F.avg("c__").alias("ratio"), F.count(F.lit(1)).alias("n"))
    share = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("k"))
    share = share.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy(group)))
    expected = share.groupBy(group).agg((1 - F.sum(F.col("p") * F.col("p"))).alias("expected"), F.sum(F.col("p") / (1 - F.col("p"))).alias("expected_run"))
    return got.join(expected, group)


def run_lengths(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Mean and largest length of runs of equal neighbours."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    island = F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = df.withColumn("new__", new).withColumn("island__", island).groupBy(group, "island__").agg(F.count(F.lit(1)).alias("len"))
    return runs.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), F.avg("len").alias("mean_run"), F.max("len").alias("max_run"))


def runs_test(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Wald-Wolfowitz z of values above their median; the p-value by :func:`two_sided`."""
    median = df.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("m__"))
    w = Window.partitionBy(group).orderBy(order)
    up = df.join(median, group).withColumn("up", (F.col(value) > F.col("m__")).cast("int"))
    up = up.withColumn("new__", F.coalesce((F.col("up") != F.lag("up").over(w)).cast("int"), F.lit(1)))
    out = up.groupBy(group).agg(F.sum("new__").alias("runs"), F.sum("up").alias("n1"), F.count_if(F.col("up") == 0).alias("n2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    mean = 2 * n1 * n2 / (n1 + n2) + 1
    variance = (mean - 1) * (mean - 2) / F.when(n1 + n2 > 1, n1 + n2 - 1)
    return out.withColumn("z", F.when(variance > 0, (F.col("runs") - mean) / F.sqrt(variance)))


def two_sided(z: Column) -> Column:
    """Two-sided normal p-value; a pandas function, as no built-in has erfc."""
    @F.pandas_udf("double")
    def p(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))

    return p(z)


def spread(df: DataFrame, label: str, file: str) -> DataFrame:
    """How far apart the first and the last file of each label lie among all
    files in order, with a verdict; and whether a rare label's rows are all in one."""
    files = df.select(file).distinct().withColumn("i__", F.row_number().over(Window.orderBy(file)) - 1)
    n = files.agg(F.count(F.lit(1)).alias("files"))
    out = df.join(files, file).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(file).alias("in_files"), F.max("i__").alias("hi__"), F.min("i__").alias("lo__")
    )
    out = out.crossJoin(n).withColumn("spread", (F.col("hi__") - F.col("lo__")) / F.greatest(F.col("files") - 1, F.lit(1))).drop("hi__", "lo__")
    verdict = F.when(F.col("spread") >= 0.85, "uniform").when(F.col("spread") >= 0.5, "moderate").when(F.col("spread") >= 0.05, "BATCH SEGMENT").otherwise("NEAR-SINGLE BATCH")
    return (
        out.withColumn("verdict", verdict)
        .withColumn("rare", F.col("n") <= 5 * F.col("files"))
        .withColumn("suspicious", F.col("rare") & (F.col("n") > 3) & (F.col("in_files") == 1))
    )


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Both-sided counts, and per value the share of pairs that agree."""
    a = left.select(*keys, *[F.col(v).alias(v + "_l") for v in values], F.lit(1).alias("in_l"))
    b = right.select(*keys, *[F.col(v).alias(v + "_r") for v in values], F.lit(1).alias("in_r"))
    both = (F.col("in_l") == 1) & (F.col("in_r") == 1)
    aggs = [F.count_if(both).alias("overlap"), F.count_if(F.col("in_r").isNull()).alias("only_left"), F.count_if(F.col("in_l").isNull()).alias("only_right")]
    for v in values:
        pair = both & F.col(v + "_l").isNotNull() & F.col(v + "_r").isNotNull()
        aggs.append(F.try_divide(F.count_if(pair & (F.col(v + "_l") == F.col(v + "_r"))), F.count_if(pair)).alias(v + "_match"))
    return a.join(b, keys, "full_outer").agg(*aggs)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two sides whose keys are unique; a repeated key on either raises.
    Rows with a null key match nothing."""
    for side, df in (("left", left), ("right", right)):
        twice = df.dropna(subset=keys).groupBy(*keys).count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"repeated keys on the {side}: {[tuple(r)[:-1] for r in twice]}")
    return left.join(right, keys)
