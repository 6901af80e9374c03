"""Shared helpers: table access, shared-folder materialisation, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Keys that hold this fraction of all rows are joined by broadcast.
HOT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a new
    temporary one only where that setting is absent in local mode. A cluster
    without it raises, as its nodes share no temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage so that a lost executor costs no recomputation of the
    work above, and gives later joins the real size of the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/marlstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it differ from all columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*cols: str) -> Column:
    """A non-null 64-bit key of a row, also for null ids and repeated ids."""
    return F.xxhash64(*[F.col(c) for c in cols])


def dealt(df: DataFrame) -> DataFrame:
    """``df``, joined by shuffles on both sides. For joins with exploded rows: the
    planner takes these for as small as the table that they come from, and would
    send millions of them to the driver to broadcast them."""
    return df.hint("shuffle_merge")


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` joined with ``keyed``, whose column ``n`` says in how many rows each
    key stands. Keys that hold ``1/HOT`` of all rows or more are at most ``HOT``,
    whatever the input, and are broadcast, so that none of them lands in one task; the
    others, which may be any number, never are."""
    total = keyed.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    often = F.col(n) * HOT >= total
    hot, rest = keyed.where(often).drop(n), keyed.where(~often).drop(n)
    left = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(left.join(dealt(rest), key))
