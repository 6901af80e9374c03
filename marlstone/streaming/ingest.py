"""Append-only metric files as a stream, kept as a last-wins table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import last_wins
from ..sources.writers import replace_rows


def metric_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def upsert_metrics(stream: DataFrame, table: str, state: str, keys: tuple[str, ...] = ("run", "step"), order: str = "line"):
    """Runs what is there and stops. Each micro-batch is reduced to the last row
    of each key, then replaces the table's rows; a row that comes late with a
    smaller ``order`` than the table's doesn't win."""
    spark = stream.sparkSession

    def put(batch: DataFrame, _: int) -> None:
        new = batch
        try:
            old = spark.read.parquet(table)
            new = batch.unionByName(old.join(batch.select(*keys).distinct(), list(keys), "left_semi"))
        except Exception as e:  # noqa: BLE001 - the table doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        replace_rows(spark, table, last_wins(new, list(keys), [order]), list(keys))

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(stream: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums per event-time window, finished when the watermark passes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
