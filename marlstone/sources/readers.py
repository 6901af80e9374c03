"""Readers: files and listings to DataFrames with stated schemas and checks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def list_files(spark: SparkSession, path: str | list[str], pattern: str = "*.parquet", recursive: bool = True, first: int | None = None) -> DataFrame:
    """``path, name, size, mtime`` of matching files, each once; contents aren't
    opened. ``first``: only so many in path order. No match raises."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    out = reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    out = out.dropDuplicates(["path"])
    if out.isEmpty():
        raise FileNotFoundError(f"no {pattern} under {path}")
    if first is not None:
        out = out.orderBy("path").limit(first)
    return out


def inside(path: str, roots: list[str]) -> bool:
    """Whether a local path, links followed, is one of the roots or lies in one."""
    real = os.path.realpath(path)
    return any(os.path.commonpath([real, r]) == r for r in map(os.path.realpath, roots))


def require(df: DataFrame, columns: list[str], what: str = "input") -> DataFrame:
    """``df`` cut to the columns; missing ones raise with their names."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"{what} lacks {', '.join(lost)}")
    return df.select(*columns)


def wanted_or_all(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns if any is there, else all."""
    have = [c for c in wanted if c in df.columns]
    return df.select(*have) if have else df


def parquet(spark: SparkSession, path: str | list[str], columns: list[str], every_file: bool = False) -> DataFrame:
    """Parquet cut to ``columns``. ``every_file``: check each file's own schema
    (a footer each), not only the first's."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if every_file:
        for f in df.inputFiles():
            require(spark.read.parquet(f), columns, f)
    return require(df, columns)


def row_count(spark: SparkSession, path: str) -> int:
    """From the footers."""
    return spark.read.parquet(path).count()


def file_rows(df: DataFrame, most: int) -> DataFrame:
    """At most the first ``most`` rows of each file of a Parquet frame."""
    return df.select("*", F.col("_metadata.file_path").alias("file__"), F.col("_metadata.row_index").alias("row__")).where(F.col("row__") < most).drop("row__").withColumnRenamed("file__", "file")


def _ordered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value, file, line`` of text files. ``line`` sorts as the files' lines do: by
    the number of a ``name.<number>-<rank>`` file, its name, the place of the block
    in it, then the row. Spark's own row numbers don't: it deals out large files first."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"))
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("name", r"\.(\d{1,18})-\d+\.[^.]+$", 1), F.lit("")), F.lit("9" * 18)).cast("bigint"), F.lit(-1).cast("bigint"))
    place = F.struct(number.alias("number"), "file", "block", F.monotonically_increasing_id().alias("row"))
    return lines.select("value", "file", place.alias("line"))


def jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON rows with ``line``, which sorts in file order over all files. Strict: a
    malformed line raises with its file and text; else it is left out. Blank lines
    never count."""
    text = _ordered(spark, path).where(F.trim("value") != "")
    fine = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    if strict:
        said = F.concat("file", F.lit(": malformed line: "), F.substring("value", 1, 200))
        text = text.withColumn("value", F.when(fine, F.col("value")).otherwise(F.raise_error(said)))
    else:
        text = text.where(fine)
    return text.select("line", F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r")).select("line", "r.*")


def keyed_csv(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """CSV with a header and unique keys; a repeated key raises."""
    df = spark.read.option("header", "true").schema(schema).csv(path)
    twice = df.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated {key}: {[r[0] for r in twice]}")
    return df


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Training log lines: ``line, epoch, batch, batches, update_step, checkpoint_step, alarm``."""
    v = F.col("value")
    number = lambda p, i=1: F.nullif(F.regexp_extract(v, p, i), F.lit("")).cast("bigint")
    progress = r"\[e: *(\d+), *(\d+)/(\d+)\]"
    return _ordered(spark, path).select(
        "line",
        number(progress).alias("epoch"),
        number(progress, 2).alias("batch"),
        number(progress, 3).alias("batches"),
        number(r"update_step=(\d+)").alias("update_step"),
        number(r"step_?(\d+)[^/ ]*\.pt\b").alias("checkpoint_step"),
        v.rlike(r"Traceback|Error|\bnan\b").alias("alarm"),
    )


def start_arguments(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ``args={…}`` block at a log's start."""
    text = spark.read.option("wholetext", "true").text(path)
    block = F.regexp_extract("value", r"(?s)args=(\{.*?\})\s*(?:\n|$)", 1)
    return text.select(F.from_json(block, schema).alias("a")).where("a is not null").select("a.*")


def gene_list(df: DataFrame) -> DataFrame:
    """``ord, gene`` from the first column named like genes (else the first),
    cleaned, each once at its first place. ``df`` has an order column ``ord``."""
    names = [c for c in df.columns if c != "ord"]
    column = next((c for c in names if "gene" in c.lower()), names[0])
    clean = df.select("ord", F.lower(F.trim(column)).alias("gene")).where("gene <> ''")
    return clean.groupBy("gene").agg(F.min("ord").alias("ord")).select("ord", "gene")


def gene_map(spark: SparkSession, path: str) -> DataFrame:
    """``gene_id, symbol`` of one JSON object; blank ones out, keys cleaned, of
    equal keys the last."""
    from ..functions.scalars import gene_key

    text = spark.read.option("wholetext", "true").text(path)
    pairs = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}))).alias("at", "e"))
    rows = pairs.select("at", gene_key(F.col("e.key")).alias("gene_id"), F.trim("e.value").alias("symbol")).where("gene_id <> '' and symbol <> ''")
    return rows.groupBy("gene_id").agg(F.max_by("symbol", "at").alias("symbol"))


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """``cell_id, pos, value`` (from 0) of a coordinate matrix in text form; read
    as lines, so that a large file is split over tasks."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = _ordered(spark, path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    entries = rows.select((F.get(parts, F.lit(0)).cast("bigint") - 1).alias("cell_id"), (F.get(parts, F.lit(1)).cast("bigint") - 1).alias("pos"), F.get(parts, F.lit(2)).cast("double").alias("value"),
                          "line")
    head = entries.agg(F.min("line").alias("head"))  # the line with the sizes
    return entries.join(F.broadcast(head), F.col("line") > F.col("head")).select("cell_id", "pos", "value")


def up_to_step(df: DataFrame, cutoff: int, step: str = "update_step") -> DataFrame:
    """Rows of a seed copy: steps up to the cutoff; rows without one stay."""
    return df.where(F.col(step).isNull() | (F.col(step) <= cutoff))


def log_up_to_step(df: DataFrame, cutoff: int, file: str = "file") -> DataFrame:
    """Log lines before the first of a later step. ``df(file, line, update_step, …)``."""
    late = F.max((F.coalesce("update_step", F.lit(-1)) > cutoff).cast("int")).over(Window.partitionBy(file).orderBy("line"))
    return df.withColumn("late__", late).where("late__ = 0").drop("late__")


def checkpoint_step(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"step_?(\d+)", 1), F.lit("")).cast("bigint")
