"""Evaluation statistics: masked losses, distributions, moments per feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mse(t: Column, p: Column) -> Column:
    return (p - t) * (p - t)


def huber(t: Column, p: Column, delta: float = 1.0) -> Column:
    e = F.abs(p - t)
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))


def bernoulli_nll(t: Column, zero_prob: Column) -> Column:
    """Of whether the target is above zero; the probability of zero is given."""
    p = F.least(F.greatest(zero_prob, F.lit(1e-8)), F.lit(1 - 1e-8))
    return F.when(t > 0, -F.log(1 - p)).otherwise(-F.log(p))


def relative(t: Column, p: Column) -> Column:
    return F.abs(p - t) / (t + 1e-6)


def masked_losses(df: DataFrame, by: list[str], delta: float = 1.0) -> DataFrame:
    """Means over masked elements of ``target, pred, zero_prob, mask``; null where none is."""
    t, p, m = F.col("target"), F.col("pred"), F.col("mask")
    each = {"mse": mse(t, p), "huber": huber(t, p, delta), "nll": bernoulli_nll(t, F.col("zero_prob")), "relative": relative(t, p)}
    return df.groupBy(*by).agg(F.count_if(m).alias("n_masked"), *[F.avg(F.when(m, e)).alias(k) for k, e in each.items()])


def masked_stats(df: DataFrame, by: list[str]) -> DataFrame:
    m = df.where("mask")
    err = F.abs(F.col("pred") - F.col("target"))
    out = []
    for c in ("target", "pred"):
        q = F.percentile(c, F.array(F.lit(0.95), F.lit(0.99)))
        out += [F.avg(c).alias(c + "_mean"), F.stddev_pop(c).alias(c + "_std"), F.get(q, F.lit(0)).alias(c + "_p95"), F.get(q, F.lit(1)).alias(c + "_p99"),
                F.avg((F.col(c) > 0).cast("int")).alias(c + "_nonzero")]
    q = F.percentile(err, F.array(F.lit(0.95), F.lit(0.99)))
    return m.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *out, F.get(q, F.lit(0)).alias("err_p95"), F.get(q, F.lit(1)).alias("err_p99"))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        *[F.get(q, F.lit(i)).alias(f"p{k}") for i, k in enumerate((50, 90, 95, 99))],
        *[F.avg((F.abs(value) > t).cast("int")).alias(f"over_{t}") for t in (5, 10, 20)],
    )


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Batches of weight 0 don't count; null where all are."""
    w = df.where(F.col(weight) > 0)
    return w.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(value), F.sum(weight).alias(weight))


def feature_moments(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Mean over features of the standard deviation of each over the rows."""
    each = df.select(*by, F.posexplode(x).alias("pos", "v")).groupBy(*by, "pos").agg(F.stddev_pop("v").alias("s"), F.avg("v").alias("m"))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("features"), F.avg("s").alias("mean_std"), F.avg("m").alias("mean_mean"))


def checkpoint_rollup(df: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Means over file sets that leave NaN out."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("sets"), *[F.avg(F.when(~F.isnan(v), F.col(v))).alias(v) for v in values])


def parameter_stats(df: DataFrame, name: str, values: str) -> DataFrame:
    """Norm, mean and deviation of arrays of parameters, and whether they are of
    the last layer (largest number in ``layers.N.``)."""
    layer = F.nullif(F.regexp_extract(name, r"layers\.(\d+)\.", 1), F.lit("")).cast("bigint")
    long = df.select(name, layer.alias("layer"), F.explode(values).alias("v"))
    out = long.groupBy(name, "layer").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    top = df.agg(F.max(layer).alias("top__"))  # one row
    return out.crossJoin(F.broadcast(top)).withColumn("last_layer", F.col("layer") == F.col("top__")).drop("top__")
