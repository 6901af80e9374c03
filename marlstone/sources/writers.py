"""Writers: shards, manifests, lookups, keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def prepare_output(spark: SparkSession, path: str, prefix: str, overwrite: bool = False) -> None:
    """A folder without earlier output: not empty raises, unless ``overwrite``,
    which deletes only entries of the prefix."""
    p, fs = _path(spark, path)
    found = list(fs.listStatus(p)) if fs.exists(p) else []
    if found and not overwrite:
        raise FileExistsError(f"{path} is not empty")
    for x in found:
        if x.getPath().getName().startswith(prefix):
            fs.delete(x.getPath(), True)
    fs.mkdirs(p)


def shards(df: DataFrame, path: str, chunk: str = "chunk", order: str = "at", compression: str = "snappy") -> DataFrame:
    """Numbered chunks, a folder each, rows in order; returns their manifest."""
    from ..operators.layout import manifest

    dealt = df.repartition(chunk).sortWithinPartitions(chunk, order)
    dealt.drop(order).write.partitionBy(chunk).option("compression", compression).mode("errorifexists").parquet(path)
    return manifest(df.sparkSession.read.parquet(path), chunk)


def csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with a header, nulls empty; a given order makes one file (manifests)."""
    out = df.orderBy(*order).coalesce(1) if order else df
    out.write.option("header", "true").option("nullValue", "").option("emptyValue", "").mode("overwrite").csv(path)


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def lookup(df: DataFrame, path: str) -> None:
    """Dictionaries with explicit ids, a folder per column."""
    df.select("column", F.col("id").cast("bigint").alias("id"), "label").write.partitionBy("column").mode("overwrite").parquet(path)


def checked(df: DataFrame, path: str, rows: int) -> None:
    """Writes, then holds the row count against what was expected."""
    df.write.mode("overwrite").parquet(path)
    got = df.sparkSession.read.parquet(path).count()
    if got != rows:
        raise ValueError(f"{path} has {got} rows, expected {rows}")


def replace_rows(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """Upsert into a Parquet table: rows of equal keys are replaced. The new
    version is written beside the old one and renamed into its place."""
    from ..operators.lineage import upserted

    p, fs = _path(spark, path)
    if not fs.exists(p):
        new.write.parquet(path)
        return
    fresh, old = path.rstrip("/") + "__new", path.rstrip("/") + "__old"
    upserted(spark.read.parquet(path), new, keys).write.mode("overwrite").parquet(fresh)
    fs.delete(_path(spark, old)[0], True)
    fs.rename(p, _path(spark, old)[0])
    fs.rename(_path(spark, fresh)[0], p)
    fs.delete(_path(spark, old)[0], True)
    spark.catalog.refreshByPath(path)
