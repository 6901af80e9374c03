"""Merging, shuffling and cutting datasets into shards, with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import UNIT, unit_key


def renumber(files: DataFrame, start: int = 0) -> DataFrame:
    """New indexes per species over all batches: ``species, batch_order,
    original_index, name`` -> ``new_index, new_name``."""
    w = Window.partitionBy("species").orderBy("batch_order", "original_index", "name")
    out = files.withColumn("new_index", (F.row_number().over(w) - 1 + start).cast("bigint"))
    return out.withColumn("new_name", F.concat(F.lit("part_"), F.col("new_index").cast("string"), F.lit(".parquet")))


def first_of_each(files: DataFrame, keys: list[str], order: list[str], n: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return files.withColumn("rank__", rank).where(F.col("rank__") <= n).drop("rank__")


def choose(df: DataFrame, column: str, include: list | None = None, exclude: list | None = None) -> DataFrame:
    """Rows of chosen values; names that don't occur, or an empty choice, raise."""
    known = {r[0] for r in df.select(column).distinct().collect()}
    unknown = (set(include or ()) | set(exclude or ())) - known
    if unknown:
        raise ValueError(f"unknown {column}: {sorted(unknown)}")
    left = (set(include) if include else known) - set(exclude or ())
    if not left:
        raise ValueError(f"no {column} is left")
    return df.where(F.col(column).isin(sorted(left)))


def auto_skipped(df: DataFrame, suffix: str, names: list[str]) -> DataFrame:
    """Without the rows of a batch suffix and a name in the list."""
    return df.where(~(F.col("batch_name").endswith(suffix) & F.col("species").isin(names)))


def bucketed(df: DataFrame, seed: int, ids: list[str], buckets: int) -> DataFrame:
    """Bucket, and place in it, of each row by a uniform key: the external shuffle.
    Spark's own exchange deals the buckets out."""
    key = unit_key(seed, *[F.col(c) for c in ids])
    out = df.withColumn("key__", key).withColumn("bucket", F.least(F.floor(F.col("key__") * buckets / UNIT), F.lit(buckets - 1)).cast("bigint"))
    return out.withColumn("at", (F.row_number().over(Window.partitionBy("bucket").orderBy("key__", *ids)) - 1).cast("bigint")).drop("key__")


def write_shards(df: DataFrame, path: str, chunk: str = "chunk", compression: str = "snappy") -> None:
    """One folder for each chunk, the rows in their order."""
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = df.repartitionByRange(int(n), chunk).sortWithinPartitions(chunk, "at")
    dealt.drop("at", "row").write.partitionBy(chunk).option("compression", compression).mode("errorifexists").parquet(path)


def windowed_shuffle(df: DataFrame, file: str, seed: int, ids: list[str], files_at_once: int) -> DataFrame:
    """Files in seeded order, shuffled within windows of so many files:
    ``window`` and ``at``."""
    ranks = df.select(file).distinct().withColumn("f__", F.row_number().over(Window.orderBy(unit_key(seed, F.col(file)), file)) - 1)
    out = df.join(ranks, file).withColumn("window", F.floor(F.col("f__") / files_at_once).cast("bigint"))
    key = unit_key(F.col("window") + seed, *[F.col(c) for c in ids])
    return out.withColumn("at", (F.row_number().over(Window.partitionBy("window").orderBy(key, *ids)) - 1).cast("bigint")).drop("f__")


def manifest(chunks: DataFrame, chunk: str = "chunk") -> DataFrame:
    """``output_file, start_row, end_row_exclusive, num_rows``."""
    sizes = chunks.groupBy(chunk).agg(F.count(F.lit(1)).alias("num_rows"))
    end = F.sum("num_rows").over(Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, 0))
    name = F.concat(F.lit("chunk_"), F.lpad(F.col(chunk).cast("string"), 6, "0"), F.lit(".parquet"))
    return sizes.select(name.alias("output_file"), (end - F.col("num_rows")).alias("start_row"), end.alias("end_row_exclusive"), "num_rows")


def source_ids(files: DataFrame, manifest_: DataFrame) -> DataFrame:
    """``source_file_id`` in file order and ``source_batch_id`` of each input file
    by its manifest row; files without one, or with two, raise."""
    lost = files.join(manifest_, files["file"] == manifest_["target_path"], "left_anti").count()
    twice = manifest_.groupBy("target_path").count().where("count > 1").count()
    if lost or twice:
        raise ValueError(f"{lost} files without a manifest row, {twice} paths listed twice")
    ids = files.withColumn("source_file_id", (F.row_number().over(Window.orderBy("file")) - 1).cast("bigint"))
    joined = ids.join(manifest_, ids["file"] == manifest_["target_path"])
    return joined.select("file", "source_file_id", F.col("batch_order").cast("bigint").alias("source_batch_id"))


def with_provenance(df: DataFrame, ids: DataFrame, file: str = "file") -> DataFrame:
    """``df`` with both ids of its file; the id table has a row per file."""
    return df.join(ids, file)


def file_plan(files: DataFrame, ranks: int, seed: int, epoch: int = 0) -> DataFrame:
    """Files dealt round-robin to ranks in seeded order: count, rows, names."""
    order = F.row_number().over(Window.orderBy(unit_key(seed + epoch, F.col("file")), "file")) - 1
    dealt = files.withColumn("rank", F.pmod(order, F.lit(ranks)).cast("bigint"))
    return dealt.groupBy("rank").agg(
        F.count(F.lit(1)).alias("files"), F.sum("n_rows").alias("n_rows"), F.array_join(F.array_sort(F.collect_list(F.col("file").cast("string"))), ";").alias("names")
    )


def sampled_ranks(n: int, world: int, drop_last: bool) -> tuple[int, int]:
    """Rows of each rank, and of all, of a padded or truncated sampler."""
    each = -(-(n - world) // world) if drop_last and n % world else -(-n // world)
    return each, each * world


def sampled_files(files: DataFrame, ranks: int, seed: int, epoch: int = 0, drop_last: bool = False, file: str = "file") -> DataFrame:
    """``rank, place, file``: the same number of files for each rank, dealt by stride
    from a seeded order. Missing ones are filled by repeating the order from its
    start, or, with ``drop_last``, its end is cut. No files give no rows."""
    n = files.count()
    _, total = sampled_ranks(n, ranks, drop_last)
    at = F.row_number().over(Window.orderBy(unit_key(seed + epoch, F.col(file)), file)) - 1
    ordered = files.select(file, at.cast("bigint").alias("i__")).where(F.col("i__") < total)
    last = F.lit(total - 1).cast("bigint")
    dealt = ordered.select(file, F.explode(F.sequence("i__", last, F.lit(max(n, 1)).cast("bigint"))).alias("p__"))
    return dealt.select(F.pmod("p__", F.lit(ranks)).cast("bigint").alias("rank"), F.floor(F.col("p__") / ranks).cast("bigint").alias("place"), file)


def read_ranges(files: DataFrame, chunk_files: int, start: int, stop: int, order: str = "ord") -> DataFrame:
    """``chunk, row_start, row_end, drop_head, keep_rows`` of the chunks of so many
    files that meet the rows ``start <= row < stop``. ``files(ord from 0, n_rows)``;
    the running sum sees one row per chunk."""
    sizes = files.groupBy(F.floor(F.col(order) / chunk_files).cast("bigint").alias("chunk")).agg(F.sum("n_rows").alias("n"))
    end = F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
    spans = sizes.select("chunk", (end - F.col("n")).alias("row_start"), end.alias("row_end"))
    lo, hi = F.greatest("row_start", F.lit(start)), F.least("row_end", F.lit(stop))
    return spans.where(lo < hi).select("chunk", "row_start", "row_end", (lo - F.col("row_start")).alias("drop_head"), (hi - lo).alias("keep_rows"))


def common_batches(rows: DataFrame, size: int, n: str = "n_rows") -> DataFrame:
    """``batches``: how many every rank can make, so that none waits for another."""
    return rows.agg(F.min(F.floor(F.col(n) / size)).cast("bigint").alias("batches"))


def unseen(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Names of a skip list that never occur: what a merge warns of."""
    expected = df.sparkSession.createDataFrame([(x,) for x in names], f"{column} string").distinct()
    return expected.join(df.select(column), column, "left_anti")


def batches(numbered: DataFrame, size: int, row: str = "row", offset: int = 0) -> DataFrame:
    """``batch`` of numbered rows; every batch but the last is full. Rows before
    ``offset`` are skipped (resume)."""
    rest = numbered.where(F.col(row) >= offset)
    return rest.withColumn("batch", F.floor((F.col(row) - offset) / size).cast("bigint"))


def same_label_batches(df: DataFrame, label: str, seed: int, ids: list[str], size: int, drop_last: bool = True) -> DataFrame:
    """Batches that never mix labels, each label's rows in seeded order."""
    by = Window.partitionBy(label)
    at = F.row_number().over(by.orderBy(unit_key(seed, *[F.col(c) for c in ids]), *ids)) - 1
    out = df.withColumn("at__", at).withColumn("n__", F.count(F.lit(1)).over(by))
    if drop_last:
        out = out.where(F.col("at__") < F.col("n__") - F.col("n__") % size)
    return out.withColumn("batch", F.floor(F.col("at__") / size).cast("bigint")).drop("at__", "n__")


def aligned(df: DataFrame, group: str, order: str, multiple: int) -> DataFrame:
    """Rows of each group down to a multiple of the row-group size."""
    by = Window.partitionBy(group)
    out = df.withColumn("i__", F.row_number().over(by.orderBy(order)) - 1).withColumn("n__", F.count(F.lit(1)).over(by))
    return out.where(F.col("i__") < F.col("n__") - F.col("n__") % multiple).drop("i__", "n__")


def manifest_check(listed: DataFrame, found: DataFrame, key: str, rows: str) -> DataFrame:
    """Files only in one of both, and whether the row totals agree."""
    a, b = listed.select(key, F.col(rows).alias("a__")), found.select(key, F.col(rows).alias("b__"))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("b__").isNull()).alias("not_found"),
        F.count_if(F.col("a__").isNull()).alias("not_listed"),
        F.sum("a__").alias("rows_listed"),
        F.sum("b__").alias("rows_found"),
        (F.coalesce(F.sum("a__"), F.lit(0)) == F.coalesce(F.sum("b__"), F.lit(0))).alias("equal"),
    )


def evenly(files: DataFrame, count: int, order: str, n: int | None = None) -> DataFrame:
    """So many files, evenly spaced in order, first and last included."""
    n = files.count() if n is None else n
    places = sorted({i * (n - 1) // max(count - 1, 1) for i in range(min(count, n))}) if n else []
    return files.withColumn("i__", F.row_number().over(Window.orderBy(order)) - 1).where(F.col("i__").isin(places)).drop("i__")


def locate(wanted: DataFrame, sizes: DataFrame, index: str = "global_idx", block: int = 1 << 16) -> DataFrame:
    """File and local row of global row numbers, by running sums of file sizes. Both
    sides meet by blocks of ``block`` row numbers, so that the join is one of equality;
    a file stands once for each block that it reaches into. Empty files hold no row."""
    end = F.sum("n_rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0))
    spans = sizes.select("file", (end - F.col("n_rows")).alias("lo"), end.alias("hi")).where("hi > lo")
    blocks = F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))
    spans = spans.select("file", "lo", "hi", F.explode(blocks).alias("block__"))
    dealt = wanted.withColumn("block__", F.floor(F.col(index) / block)).join(spans, "block__")
    inside = (F.col(index) >= F.col("lo")) & (F.col(index) < F.col("hi"))
    return dealt.where(inside).select(*wanted.columns, "file", (F.col(index) - F.col("lo")).alias("local_row"))


def mixed_seed(seed, epoch, rank, chunk):
    """Seed of a chunk's row shuffle, of numbers or columns."""
    return seed + epoch * 1_000_003 + rank * 10_007 + chunk * 101


def ordinals(df: DataFrame, group: str, order: list[str], name: str = "idx") -> DataFrame:
    """Row numbers from 0 within each group, by a stated order."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("bigint"))


def paired(left: DataFrame, right: DataFrame, index: str = "idx") -> DataFrame:
    """Rows of both sides with equal numbers; a number on one side only raises."""
    lost = left.select(index).join(right.select(index), index, "left_anti").count() + right.select(index).join(left.select(index), index, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} rows without a partner")
    return left.join(right, index)


def traced(df: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Rows of every so-many-th step; none for 0."""
    return df.where(F.pmod(F.col(step), F.lit(every)) == 0) if every > 0 else df.limit(0)
