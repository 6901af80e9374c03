"""From sparse cells, observations and dictionaries to shuffled training shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import encode, layout, ordering


def training_rows(coo: DataFrame, obs: DataFrame, meta: DataFrame, genes: DataFrame, lookup: DataFrame, labels: list[str], least_genes: int = 200, raw: bool = False) -> DataFrame:
    """``cell_id, x`` and an id per label, one lazy plan. ``coo(cell_id, symbol,
    pos, value)``, ``genes(ord, gene)`` is the canonical axis; genes that a cell
    lacks are zero."""
    axis = genes.select(F.col("gene").alias("symbol"), F.col("ord").alias("axis"))
    kept = encode.collapse_columns(coo).drop("pos").join(axis, "symbol").select("cell_id", F.col("axis").alias("pos"), "value")
    cells = encode.min_genes(kept, least_genes).select("cell_id")
    width = genes.count()
    x = encode.dense(kept.join(cells, "cell_id", "left_semi"), width)
    if not raw:
        x = x.withColumn("x", arrays.scaled_log1p(F.col("x")))
    described = encode.encode(encode.fill_obs(obs, meta, "accession"), lookup, labels)
    return x.join(described.select("cell_id", *[c + "_id" for c in labels]), "cell_id")


def shards(rows: DataFrame, seed: int, ids: list[str], size: int, keep_rest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Globally shuffled rows with ``chunk`` and ``at``, and their manifest."""
    chunks = ordering.in_chunks(ordering.shuffled(rows, seed, ids), size, keep_rest=keep_rest)
    return chunks, layout.manifest(chunks)
