"""The catalogue's tables from metric rows of many runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import lineage, metrics, rules


def tables(rows: DataFrame, names: DataFrame, most_points: int = 2000) -> dict[str, DataFrame]:
    """``runs``, ``metric_series``, ``metric_summaries``, ``diagnostic_events``,
    ``run_relationships``. ``rows(run, line, step, loss, norm, clipped, skipped,
    lr)`` of all runs at once, ``names(id, name)``."""
    one = metrics.last_wins(rows, ["run", "step"], ["line"])
    flags = one.withColumn("clipped", F.col("clipped").cast("int")).withColumn("skipped", F.col("skipped").cast("int"))
    series = metrics.downsample(one.where("loss is not null").select("run", "step", F.col("loss").alias("value")), most_points)
    raw = rows.select("run", "line", "step", "loss", "lr", F.col("clipped").cast("double").alias("clip"), F.col("skipped").cast("double").alias("skip"),
                      F.lit(None).cast("double").alias("head"), F.lit(None).cast("double").alias("other"), F.lit(False).alias("resumed"))
    parsed = lineage.variables(lineage.parse_names(names))
    runs = lineage.timeline(parsed).withColumn("ord", F.col("place")).withColumn("stage", lineage.stage(F.col("name"), F.col("model_size"), F.col("data_recipe")))
    edges = lineage.parents(runs.select("id", "ord", "tags", *lineage.PARENT_WEIGHTS), lineage.PARENT_WEIGHTS, tags="tags", later=lineage.LATER_WEIGHT)
    return {
        "runs": runs.withColumn("key", scalars.short_hash(F.col("name"))),
        "metric_series": series.withColumn("series", F.lit("loss")),
        "metric_summaries": metrics.summarise(flags),
        "diagnostic_events": rules.events(rules.features(raw)),
        "run_relationships": edges,
    }


def compare(series: DataFrame, runs: list[int]) -> DataFrame:
    """The series of a few runs side by side."""
    chosen = series.where(F.col("run").isin(runs)).select("step", F.col("run").cast("string").alias("series"), "value", F.col("step").alias("line"))
    return lineage.pivoted(chosen, [str(r) for r in runs])


def presence_mask(df: DataFrame, fields: list[str]) -> DataFrame:
    """A bit per field that a sparse row has; first field lowest."""
    bits = sum((F.when(F.col(f).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fields)), F.lit(0).cast("bigint"))
    return df.withColumn("present", bits)
