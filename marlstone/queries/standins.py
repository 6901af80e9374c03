"""The driver's tables in the shapes that the operators work on, and the same as
SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_binary(df: DataFrame, places: int = 6) -> DataFrame:
    """:func:`rounded` as DuckDB rounds: the double times the power of ten, ties away
    from zero, where Spark rounds the shortest decimal that stands for the double."""

    def near(c):
        p = F.abs(c) * F.lit(10.0**places)
        whole = F.floor(p).cast("double")
        away = (whole + (p - whole >= 0.5).cast("double")) / F.lit(10.0**places)
        return F.when(p < 2.0**52, F.when(F.col(c) < 0, -away).otherwise(away)).otherwise(F.col(c))

    return df.select(*[near(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log row per event: the run is the user, the step a four-hour slot, so
    that steps repeat."""
    hours = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))) * 24 + F.hour("ts")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("line"),
        F.floor(hours / 4).cast("bigint").alias("step"),
        F.col("value").alias("loss"),
        (F.col("value") / 10).alias("norm"),
        (F.col("event_type") == "click").alias("clipped"),
        (F.col("event_type") == "error").alias("skipped"),
        F.when(F.col("event_type") == "click", "clip").when(F.col("event_type") == "error", "skip_norm").otherwise("pass").alias("action"),
        (F.lit(1.0) / (1 + F.floor(hours / 4))).alias("lr"),
        (F.col("event_id") % 4).alias("rank"),
    )


METRICS = """m AS (
  SELECT user_id AS run, event_id AS line, CAST((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts)) // 4 AS BIGINT) AS step,
         value AS loss, value / 10 AS norm, event_type = 'click' AS clipped, event_type = 'error' AS skipped,
         CASE event_type WHEN 'click' THEN 'clip' WHEN 'error' THEN 'skip_norm' ELSE 'pass' END AS action,
         1.0 / (1 + (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts)) // 4) AS lr, event_id % 4 AS rank
  FROM events)"""
DEDUPED = METRICS + """, d AS (
  SELECT run, line, step, loss, norm, clipped, skipped, action, lr, rank
  FROM (SELECT *, row_number() OVER (PARTITION BY run, step ORDER BY line DESC) AS k FROM m) WHERE k = 1)"""


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import last_wins

    return last_wins(metrics(spark, sf_dir), ["run", "step"], ["line"])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell per vector, with counts of its positive part."""
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform(x, lambda v: F.greatest(v, F.lit(0.0))).alias("x"),
        x.alias("raw"),
        F.col("label").cast("bigint").alias("species"),
        (F.col("vec_id") % 7).alias("dataset"),
        F.floor(F.col("vec_id") / 64).alias("file"),
    )


CELLS = """c AS (
  SELECT vec_id AS id, list_transform(embedding, lambda v: greatest(CAST(v AS DOUBLE), 0.0)) AS x,
         list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS raw,
         CAST(label AS BIGINT) AS species, vec_id % 7 AS dataset, vec_id // 64 AS file
  FROM embeddings)"""
#: One row per element; ``pos`` from 0.
ELEMENTS = CELLS + """, e AS (
  SELECT id, species, dataset, file, unnest(x) AS v, unnest(raw) AS r, unnest(range(len(x))) AS pos FROM c)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.arrays_zip("x", "raw")
    return (
        cells(spark, sf_dir)
        .select("id", "species", "dataset", "file", F.posexplode(pairs).alias("pos", "p"))
        .select("id", "species", "dataset", "file", F.col("p.x").alias("v"), F.col("p.raw").alias("r"), F.col("pos").cast("bigint").alias("pos"))
    )


def hash_sql(seed: str, *ids: str) -> str:
    """The uniform key of :func:`marlstone.functions.scalars.unit_key`."""
    inner = ", ".join([seed, *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"CAST('0x' || substr(md5(concat_ws(':', {inner})), 1, 13) AS BIGINT)"
