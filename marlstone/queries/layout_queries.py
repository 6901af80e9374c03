"""Queries over merging, shuffling and shard layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import layout, ordering
from .registry import register
from .standins import CELLS, cells, hash_sql, table

_FILES = "f AS (SELECT p_brand AS species, p_size % 3 AS batch_order, p_partkey AS original_index, p_name AS name FROM part)"


def _files(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("species"), (F.col("p_size") % 3).alias("batch_order"), F.col("p_partkey").alias("original_index"), F.col("p_name").alias("name")
    )


@register(
    "merge_renumber",
    f"""WITH {_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY batch_order, original_index, name) - 1 + 100 AS new_index FROM f)
SELECT species, batch_order, original_index, name, new_index, 'part_' || CAST(new_index AS VARCHAR) || '.parquet' AS new_name FROM r""",
)
def merge_renumber(spark, sf_dir):
    return layout.renumber(_files(spark, sf_dir), 100)


@register(
    "test_mode_first_n",
    f"WITH {_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY batch_order, species ORDER BY original_index) AS k FROM f) SELECT species, batch_order, original_index, name FROM r WHERE k <= 3",
)
def test_mode_first_n(spark, sf_dir):
    return layout.first_of_each(_files(spark, sf_dir), ["batch_order", "species"], ["original_index"])


@register(
    "species_choice",
    f"WITH {_FILES} SELECT species, count(*) AS n FROM f WHERE species IN (SELECT DISTINCT species FROM f ORDER BY species LIMIT 6) AND species <> (SELECT min(species) FROM f) GROUP BY species",
)
def species_choice(spark, sf_dir):
    f = _files(spark, sf_dir)
    names = sorted(r[0] for r in f.select("species").distinct().collect())
    return layout.choose(f, "species", names[:6], names[:1]).groupBy("species").agg(F.count(F.lit(1)).alias("n"))


@register(
    "auto_skip",
    f"WITH {_FILES} SELECT species, batch_order, count(*) AS n FROM f WHERE NOT (batch_order = 2 AND species IN ('Brand#11', 'Brand#12')) GROUP BY species, batch_order",
)
def auto_skip(spark, sf_dir):
    f = _files(spark, sf_dir).withColumn("batch_name", F.concat(F.lit("round_"), F.col("batch_order").cast("string")))
    return layout.auto_skipped(f, "_2", ["Brand#11", "Brand#12"]).groupBy("species", "batch_order").agg(F.count(F.lit(1)).alias("n"))


_ROWS = f"s AS (SELECT event_id, row_number() OVER (ORDER BY {hash_sql(chr(39) + '42' + chr(39), 'event_id')}, event_id) - 1 AS row, count(*) OVER () AS n FROM events)"


def _shuffled(spark, sf_dir):
    return ordering.shuffled(table(spark, sf_dir, "events").select("event_id"), 42, ["event_id"])


@register(
    "hash_shuffle_chunks",
    f"WITH {_ROWS} SELECT event_id, CAST(row // 512 AS BIGINT) AS chunk, CAST(row % 512 AS BIGINT) AS \"at\" FROM s WHERE row < n - n % 512",
)
def hash_shuffle_chunks(spark, sf_dir):
    n = table(spark, sf_dir, "events").count()  # from the file footers
    return ordering.in_chunks(_shuffled(spark, sf_dir), 512, total=n).select("event_id", "chunk", F.col("at").cast("bigint").alias("at"))


@register(
    "shuffle_manifest",
    f"""WITH {_ROWS}, c AS (SELECT row // 512 AS chunk, count(*) AS num_rows FROM s GROUP BY row // 512)
SELECT 'chunk_' || lpad(CAST(chunk AS VARCHAR), 6, '0') || '.parquet' AS output_file, CAST(sum(num_rows) OVER (ORDER BY chunk) - num_rows AS BIGINT) AS start_row,
  CAST(sum(num_rows) OVER (ORDER BY chunk) AS BIGINT) AS end_row_exclusive, num_rows FROM c""",
)
def shuffle_manifest(spark, sf_dir):
    return layout.manifest(ordering.in_chunks(_shuffled(spark, sf_dir), 512, keep_rest=True))


@register(
    "bucketed_shuffle",
    f"""WITH k AS (SELECT event_id, {hash_sql("'7'", 'event_id')} AS h FROM events), b AS (SELECT event_id, h, least(CAST(floor(h * 12.0 / {scalars.UNIT}) AS BIGINT), 11) AS bucket FROM k)
SELECT event_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY h, event_id) - 1 AS "at" FROM b""",
)
def bucketed_shuffle(spark, sf_dir):
    return layout.bucketed(table(spark, sf_dir, "events").select("event_id"), 7, ["event_id"], 12)


@register(
    "batch_shuffle",
    f"""WITH {CELLS}, r AS (SELECT file, row_number() OVER (ORDER BY {hash_sql("'3'", 'file')}, file) - 1 AS k FROM (SELECT DISTINCT file FROM c)),
w AS (SELECT id, c.file AS file, k // 3 AS "window" FROM c JOIN r ON c.file = r.file)
SELECT id, file, CAST("window" AS BIGINT) AS "window", row_number() OVER (PARTITION BY "window" ORDER BY {hash_sql('CAST("window" + 3 AS VARCHAR)', 'id')}, id) - 1 AS "at" FROM w""",
)
def batch_shuffle(spark, sf_dir):
    return layout.windowed_shuffle(cells(spark, sf_dir).select("id", "file"), "file", 3, ["id"], 3)


@register(
    "provenance_join",
    f"""WITH {CELLS}, i AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS fid FROM (SELECT DISTINCT file FROM c))
SELECT id, c.file AS file, fid AS source_file_id, CAST(c.file % 3 AS BIGINT) AS source_batch_id FROM c JOIN i ON c.file = i.file""",
)
def provenance_join(spark, sf_dir):
    c = cells(spark, sf_dir).select("id", "file")
    files = c.select("file").distinct()
    listed = files.select(F.col("file").alias("target_path"), (F.col("file") % 3).alias("batch_order"))
    return layout.with_provenance(c, layout.source_ids(files, listed)).select("id", "file", "source_file_id", "source_batch_id")


@register(
    "file_plan_by_rank",
    f"""WITH {CELLS}, n AS (SELECT file, count(*) AS n_rows FROM c GROUP BY file), k AS (SELECT *, (row_number() OVER (ORDER BY {hash_sql("'11'", 'file')}, file) - 1) % 4 AS rank FROM n)
SELECT CAST(rank AS BIGINT) AS rank, count(*) AS files, CAST(sum(n_rows) AS BIGINT) AS n_rows, string_agg(CAST(file AS VARCHAR), ';' ORDER BY CAST(file AS VARCHAR)) AS names FROM k GROUP BY rank""",
)
def file_plan_by_rank(spark, sf_dir):
    files = cells(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
    return layout.file_plan(files, 4, 10, 1)


@register("batch_assignment", f"WITH {_ROWS} SELECT event_id, CAST((row - 100) // 96 AS BIGINT) AS batch FROM s WHERE row >= 100")
def batch_assignment(spark, sf_dir):
    return layout.batches(_shuffled(spark, sf_dir), 96, offset=100).select("event_id", "batch")


@register(
    "same_label_batches",
    f"""WITH {CELLS}, k AS (SELECT id, species, row_number() OVER (PARTITION BY species ORDER BY {hash_sql("'9'", 'id')}, id) - 1 AS i, count(*) OVER (PARTITION BY species) AS n FROM c)
SELECT id, species, CAST(i // 8 AS BIGINT) AS batch FROM k WHERE i < n - n % 8""",
)
def same_label_batches(spark, sf_dir):
    return layout.same_label_batches(cells(spark, sf_dir).select("id", "species"), "species", 9, ["id"], 8)


@register(
    "rowgroup_align",
    f"WITH {CELLS}, k AS (SELECT id, species, row_number() OVER (PARTITION BY species ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY species) AS n FROM c) SELECT id, species FROM k WHERE i < n - n % 16",
)
def rowgroup_align(spark, sf_dir):
    return layout.aligned(cells(spark, sf_dir).select("id", "species"), "species", "id", 16)


@register(
    "manifest_check",
    """WITH a AS (SELECT o_orderkey AS k, 4 AS n FROM orders WHERE o_orderkey % 10 <> 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT count(CASE WHEN b.k IS NULL THEN 1 END) AS not_found, count(CASE WHEN a.k IS NULL THEN 1 END) AS not_listed, CAST(sum(a.n) AS BIGINT) AS rows_listed, CAST(sum(b.n) AS BIGINT) AS rows_found,
  sum(a.n) = sum(b.n) AS equal FROM a FULL JOIN b ON a.k = b.k""",
)
def manifest_check(spark, sf_dir):
    listed = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("k"), F.lit(4).cast("bigint").alias("n"))
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return layout.manifest_check(listed, found, "k", "n")


@register(
    "even_file_sample",
    """WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier), g AS (SELECT unnest(range(7)) AS j)
SELECT DISTINCT s_suppkey FROM r JOIN g ON i = j * (n - 1) // 6""",
)
def even_file_sample(spark, sf_dir):
    return layout.evenly(table(spark, sf_dir, "supplier").select("s_suppkey"), 7, "s_suppkey")


@register(
    "global_index_lookup",
    f"""WITH {CELLS}, n AS (SELECT file, count(*) AS k FROM c GROUP BY file), z AS (SELECT file, sum(k) OVER (ORDER BY file) - k AS lo, sum(k) OVER (ORDER BY file) AS hi FROM n)
SELECT vec_id AS global_idx, file, CAST(vec_id - lo AS BIGINT) AS local_row FROM embeddings JOIN z ON vec_id >= lo AND vec_id < hi""",
)
def global_index_lookup(spark, sf_dir):
    c = cells(spark, sf_dir)
    sizes = c.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
    return layout.locate(c.select(F.col("id").alias("global_idx")), sizes)


@register("species_counter", f"WITH {CELLS} SELECT species, count(*) AS n FROM c GROUP BY species")
def species_counter(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("species").agg(F.count(F.lit(1)).alias("n"))


@register("duplicate_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@register(
    "set_operations",
    """WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'left', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
)
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("doc_id").distinct()
    b = table(spark, sf_dir, "labels").select("doc_id").distinct()
    parts = {"both": a.intersect(b), "left": a.exceptAll(b), "right": b.exceptAll(a), "all": a.unionByName(b)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("row_ordinals", f"WITH {CELLS} SELECT id, species, row_number() OVER (PARTITION BY species ORDER BY file, id) - 1 AS idx FROM c")
def row_ordinals(spark, sf_dir):
    return layout.ordinals(cells(spark, sf_dir).select("id", "species", "file"), "species", ["file", "id"]).select("id", "species", "idx")


@register("row_pairing", "SELECT vec_id AS idx, label, len(embedding) AS width FROM embeddings")
def row_pairing(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    obs, x = e.select(F.col("vec_id").alias("idx"), "label"), e.select(F.col("vec_id").alias("idx"), F.size("embedding").cast("bigint").alias("width"))
    return layout.paired(obs, x)


@register("trace_rows", "SELECT event_id FROM events WHERE event_id % 250 = 0")
def trace_rows(spark, sf_dir):
    return layout.traced(table(spark, sf_dir, "events").select("event_id"), 250, "event_id")


@register("row_counts", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def row_counts(spark, sf_dir):
    out = None
    for name in ("events", "orders", "part"):
        one = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
