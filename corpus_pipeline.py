"""A corpus through five stages: toxic documents go, repeated lines go, one of
each group of near copies stays, contaminated documents go, the rest is packed.

Each stage is written as Parquet to the shared folder and read again as the next
one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, line_dedup, packing, toxicity
from marlstone.llm import near_copies as near
from marlstone.llm.common import materialise, table, unused
from marlstone.llm.queries import tokenizer_file

#: Models and packing can't be expressed in SQL; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    added = unused(docs, "n_lines__"), unused(docs, "n_removed__")
    out = line_dedup.dedup_lines(docs, runs=True, added=added)
    changed = F.col(added[1]) > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_first(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic),
    ("line dedup", repeated_lines),
    ("near duplicates", near_copies),
    ("decontamination", contaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
