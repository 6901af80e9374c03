"""From labelled sparse rows to dictionary-encoded training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from .ordering import global_row_number


#: Rows of a prototype table, which is sent to all tasks.
MOST_PROTOTYPES = 10_000


def min_genes(coo: DataFrame, least: int, cell: str = "cell_id") -> DataFrame:
    """Cells with at least so many positive genes, with the number."""
    return coo.where("value > 0").groupBy(cell).agg(F.count(F.lit(1)).alias("genes")).where(F.col("genes") >= least)


def keep_genes(coo: DataFrame, genes: DataFrame, gene: str = "gene") -> DataFrame:
    """Entries of listed genes, case aside; repeated columns stay."""
    keys = genes.select(scalars.gene_key(F.col(gene)).alias("key__")).distinct()
    return coo.withColumn("key__", scalars.gene_key(F.col(gene))).join(keys, "key__", "left_semi").drop("key__")


def missing_genes(genes: DataFrame, coo: DataFrame, gene: str = "gene") -> DataFrame:
    """Listed genes that no entry has, in list order (``ord``)."""
    return genes.join(coo.select(gene).distinct(), gene, "left_anti")


def symbols(df: DataFrame, mapping: DataFrame, gene: str = "gene") -> DataFrame:
    """``symbol`` of each gene id by a map of ``gene_id, symbol``; itself where unknown."""
    m = mapping.select(scalars.gene_key(F.col("gene_id")).alias("key__"), F.col("symbol").alias("symbol__")).where("key__ <> '' and symbol__ is not null")
    out = df.withColumn("key__", scalars.gene_key(F.col(gene))).join(m, "key__", "left")
    return out.withColumn("symbol", F.coalesce("symbol__", gene)).drop("key__", "symbol__")


def collapse_columns(coo: DataFrame, cell: str = "cell_id", symbol: str = "symbol") -> DataFrame:
    """Columns of one symbol summed; ``pos`` is where it appears first."""
    return coo.groupBy(cell, symbol).agg(F.sum("value").alias("value"), F.min("pos").alias("pos"))


def dense(coo: DataFrame, width: int, cell: str = "cell_id") -> DataFrame:
    """Arrays of ``width`` from ``pos, value`` entries, zero where there is none."""
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int"), F.col("value"))))
    held = coo.groupBy(cell).agg(entries.alias("m__"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m__", i), F.lit(0.0)))
    return held.select(cell, filled.alias("x"))


def fill_obs(obs: DataFrame, meta: DataFrame, on: str) -> DataFrame:
    """Left join on text keys. The right side is cut to one row per key (its
    smallest), so that rows aren't multiplied; a missing value is ``unknown``."""
    values = [c for c in meta.columns if c != on]
    one = meta.groupBy(F.col(on).cast("string").alias("key__")).agg(F.min(F.struct(*values)).alias("v__")).select("key__", "v__.*")
    out = obs.withColumn("key__", F.col(on).cast("string")).join(one, "key__", "left").drop("key__")
    for v in values:
        if dict(out.dtypes)[v] == "string":
            out = out.withColumn(v, F.coalesce(scalars.lower_underscore(F.col(v)), F.lit("unknown")))
    return out


def distinct_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, label`` of all distinct non-null values, in one pass."""
    pairs = ", ".join(f"'{c}', cast({c} as string)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) as (column, label)").where("label is not null").distinct()


def unified_lookup(old: DataFrame, seen: DataFrame) -> DataFrame:
    """Ids of the old dictionary stay; new labels follow after the largest, in
    label order, per column. ``old(column, id, label)``, ``seen(column, label)``."""
    new = seen.join(old, ["column", "label"], "left_anti")
    top = old.groupBy("column").agg(F.max("id").alias("top__"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("label"))
    ids = new.join(top, "column", "left").select("column", (F.coalesce("top__", F.lit(-1)) + rank).cast("bigint").alias("id"), "label")
    return old.select("column", "id", "label").unionByName(ids)


def encode(df: DataFrame, lookup: DataFrame, columns: list[str], normalise: dict[str, Column] | None = None) -> DataFrame:
    """Labels to ids; unknown and null are -1."""
    for c in columns:
        own = lookup.where(F.col("column") == c).select(F.col("label").alias("label__"), F.col("id").alias(c + "_id"))
        key = (normalise or {}).get(c, F.col(c).cast("string"))
        df = df.withColumn("key__", key).join(own, F.col("key__") == F.col("label__"), "left").drop("key__", "label__")
        df = df.withColumn(c + "_id", F.coalesce(c + "_id", F.lit(-1)).cast("bigint"))
    return df


def decode(df: DataFrame, lookup: DataFrame, columns: list[str]) -> DataFrame:
    """Ids to labels; unknown is the empty text."""
    for c in columns:
        own = lookup.where(F.col("column") == c).select(F.col("id").alias("id__"), F.col("label").alias(c + "_label"))
        df = df.join(own, F.col(c) == F.col("id__"), "left").drop("id__").withColumn(c + "_label", F.coalesce(c + "_label", F.lit("")))
    return df


def project(coo: DataFrame, weights: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Sparse rows times a sparse matrix ``pos, k, w``: ``cell, k, value``."""
    return coo.join(weights, "pos").groupBy(cell, "k").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def nearest(df: DataFrame, prototypes: DataFrame, r: int, tau: float = 1.0) -> DataFrame:
    """The ``r`` most similar prototypes of each row by cosine, weighted by a
    softmax over them. ``df(id, vec)``; ``prototypes(k, proto)`` has at most
    ``MOST_PROTOTYPES`` rows, more raise."""
    from ..functions.arrays import cosine

    if prototypes.limit(MOST_PROTOTYPES + 1).count() > MOST_PROTOTYPES:
        raise ValueError(f"more than {MOST_PROTOTYPES} prototypes")

    by = Window.partitionBy("id")
    scored = df.join(F.broadcast(prototypes)).withColumn("sim", cosine(F.col("vec"), F.col("proto")))
    top = scored.withColumn("rank", F.row_number().over(by.orderBy(F.desc("sim"), "k")).cast("bigint")).where(F.col("rank") <= r)
    e = F.exp(F.col("sim") / tau)
    return top.withColumn("w", e / F.sum(e).over(by)).select("id", "k", "rank", "sim", "w")


def vocabulary(tokens: DataFrame, least: int = 1, specials: tuple[str, ...] = ("<pad>", "<cls>")) -> DataFrame:
    """``id, token, n`` by falling frequency, then token; specials come first."""
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & ~F.col("token").isin(*specials))
    # buckets in order: by frequency, and where those hold a single one by first character
    level = -F.floor(F.log2("n") * 16) * 256
    bucket = level + F.when(F.col("n") <= 16, F.least(F.ascii("token"), F.lit(255))).otherwise(0)
    ids = global_row_number(counted, [F.desc("n"), F.col("token")], bucket, "id")
    first = tokens.sparkSession.createDataFrame([(i, s, 0) for i, s in enumerate(specials)], "id bigint, token string, n bigint")
    return first.unionByName(ids.select((F.col("id") + len(specials)).cast("bigint").alias("id"), "token", "n"))


def orderings(var: DataFrame, file: str = "file", gene: str = "gene", pos: str = "pos") -> DataFrame:
    """Files grouped by the fingerprint of their column order."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, gene))), lambda s: s[gene]), "\n")
    prints = var.groupBy(file).agg(F.sha1(names).alias("order_id"), F.count(F.lit(1)).alias("n_var"))
    return prints.groupBy("order_id", "n_var").agg(F.count(F.lit(1)).alias("files"), F.slice(F.array_sort(F.collect_list(file)), 1, 5).alias("examples"))


def dense_ids(df: DataFrame, label: str, order: str) -> DataFrame:
    """``label, id`` in order of first appearance."""
    first = df.groupBy(label).agg(F.min(order).alias("first__"))
    return first.select(label, (F.row_number().over(Window.orderBy("first__", label)) - 1).cast("bigint").alias("id"))


def masked(x: Column, key: Column, share: float, keep: int = 1, fill: float = -1.0, seed: int = 0) -> Column:
    """Each element after the first ``keep`` replaced with probability ``share``,
    by a hash of seed, row and place."""
    cut = int(share * scalars.UNIT)
    at = lambda i: scalars.unit_key(seed, key, i)
    return F.transform(x, lambda v, i: F.when((i >= keep) & (at(i) < cut), F.lit(fill)).otherwise(v))
