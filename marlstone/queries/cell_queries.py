"""Queries over cell tables: quality, encoding, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, scalars
from ..operators import encode, evalstats, quality
from .registry import register
from .standins import CELLS, ELEMENTS, cells, elements, hash_sql, rounded, table

_RED = ELEMENTS + """, red AS (
  SELECT id, species, dataset, file, max(v) AS val_max, sum(v) AS libsize, count(CASE WHEN v > 0 THEN 1 END) AS nnz, count(*) AS width FROM e GROUP BY id, species, dataset, file)"""


def _reduced(spark, sf_dir):
    return quality.cell_reductions(cells(spark, sf_dir).select("id", "x", "species", "dataset", "file"))


@register("cell_reductions", f"WITH {_RED} SELECT id, CAST(0 AS BIGINT) AS bad, round(val_max, 6) AS val_max, round(libsize, 6) AS libsize, nnz, width FROM red")
def cell_reductions(spark, sf_dir):
    return rounded(_reduced(spark, sf_dir).select("id", "bad", "val_max", "libsize", "nnz", "width"))


@register(
    "file_distribution",
    f"""WITH {_RED} SELECT file, count(*) AS n_rows, count(CASE WHEN width <> 64 THEN 1 END) AS shape_bad, CAST(0 AS BIGINT) AS bad_values, CAST(0 AS BIGINT) AS bad_cells,
  round(max(val_max), 6) AS val_max, round(quantile_cont(val_max, 0.5), 6) AS cellmax_p50, round(quantile_cont(val_max, 0.99), 6) AS cellmax_p99,
  round(quantile_cont(val_max, 0.999), 6) AS cellmax_p999, round(quantile_cont(libsize, 0.5), 6) AS libsize_p50, round(quantile_cont(libsize, 0.99), 6) AS libsize_p99,
  round(max(libsize), 6) AS libsize_max, round(quantile_cont(nnz, 0.5), 6) AS nnz_p50, max(nnz) AS nnz_max, round(1 - avg(nnz) / 64, 6) AS sparsity_mean,
  min(species) AS species_min, max(species) AS species_max FROM red GROUP BY file""",
)
def file_distribution(spark, sf_dir):
    return rounded(quality.file_distribution(_reduced(spark, sf_dir), 64))


@register(
    "group_rollup",
    f"""WITH {_RED} SELECT dataset, species, count(*) AS n, round(max(val_max), 6) AS val_max, round(max(libsize), 6) AS libsize_max
FROM red GROUP BY GROUPING SETS ((dataset), (species))""",
)
def group_rollup(spark, sf_dir):
    return rounded(quality.grouped_rollup(_reduced(spark, sf_dir), ["dataset", "species"]))


@register(
    "outlier_verdict",
    f"""WITH {_RED}, f AS (SELECT file, max(val_max) AS val_max FROM red GROUP BY file),
o AS (SELECT max(val_max) AS a, quantile_cont(val_max, 0.5) AS m, quantile_cont(val_max, 0.95) AS p, count(*) AS files FROM f)
SELECT round(a, 6) AS largest, round(m, 6) AS median, round(p, 6) AS p95, files, round(a / m, 6) AS ratio, CASE WHEN a / m >= 3 THEN 'big spread' ELSE 'even' END AS verdict FROM o""",
)
def outlier_verdict(spark, sf_dir):
    per_file = _reduced(spark, sf_dir).groupBy("file").agg(F.max("val_max").alias("val_max"))
    return rounded(quality.outlier_verdict(per_file))


@register(
    "label_range_check",
    f"""WITH {CELLS}, l AS (SELECT 'species' AS label, species AS v, 8 AS top FROM c UNION ALL SELECT 'dataset', dataset, 7 FROM c)
SELECT label, count(CASE WHEN v IS NULL THEN 1 END) AS nulls, count(CASE WHEN v < 0 OR v >= top THEN 1 END) AS outside, min(v) AS least, max(v) AS largest FROM l GROUP BY label""",
)
def label_range_check(spark, sf_dir):
    return quality.label_ranges(cells(spark, sf_dir), {"species": 8, "dataset": 7})


@register(
    "shape_finite_check",
    f"""WITH {CELLS} SELECT id, id % 50 = 1 AS wrong_length, id % 40 = 2 AS not_finite FROM c WHERE id % 50 = 1 OR id % 40 = 2""",
)
def shape_finite_check(spark, sf_dir):
    x = F.when(F.col("id") % 50 == 1, F.slice("raw", 1, 60)).when(F.col("id") % 40 == 2, F.transform("raw", lambda v, i: F.when(i == 3, F.lit(float("nan"))).otherwise(v))).otherwise(F.col("raw"))
    both = F.when((F.col("id") % 50 == 1) & (F.col("id") % 40 == 2), F.transform(F.slice("raw", 1, 60), lambda v: F.lit(float("inf")))).otherwise(x)
    return quality.shape_check(cells(spark, sf_dir).withColumn("x", both), 64).select("id", "wrong_length", "not_finite")


@register(
    "feature_moments",
    f"""WITH {ELEMENTS}, p AS (SELECT species, pos, stddev_pop(r) AS s, avg(r) AS m FROM e GROUP BY species, pos)
SELECT species, count(*) AS features, round(avg(s), 6) AS mean_std, round(avg(m), 6) AS mean_mean FROM p GROUP BY species""",
)
def feature_moments(spark, sf_dir):
    return rounded(evalstats.feature_moments(cells(spark, sf_dir), "raw", ["species"]))


def _evaluated(spark, sf_dir):
    """Elements with a made prediction and mask."""
    return elements(spark, sf_dir).select(
        "id", "species", "file", "pos", (F.col("v") * 40).alias("target"), (F.col("v") * 36 + F.col("pos") / 64).alias("pred"),
        (F.lit(1.0) / (1 + F.col("pos"))).alias("zero_prob"), ((F.col("id") + F.col("pos")) % 5 == 0).alias("mask"),
    )


_EVAL = ELEMENTS + """, ev AS (SELECT id, species, file, pos, v * 40 AS target, v * 36 + pos / 64.0 AS pred, 1.0 / (1 + pos) AS zero_prob, (id + pos) % 5 = 0 AS mask FROM e)"""


@register(
    "masked_losses",
    f"""WITH {_EVAL}, x AS (SELECT *, abs(pred - target) AS err, least(greatest(zero_prob, 1e-8), 1 - 1e-8) AS p FROM ev)
SELECT species, count(*) AS n_masked, round(avg(err * err), 6) AS mse, round(avg(CASE WHEN err <= 1 THEN 0.5 * err * err ELSE err - 0.5 END), 6) AS huber,
  round(avg(CASE WHEN target > 0 THEN -ln(1 - p) ELSE -ln(p) END), 6) AS nll, round(avg(err / (target + 1e-6)), 3) AS relative FROM x WHERE mask GROUP BY species""",
)
def masked_losses(spark, sf_dir):
    out = evalstats.masked_losses(_evaluated(spark, sf_dir), ["species"])
    return rounded(out.withColumn("relative", F.round("relative", 3)))


@register(
    "masked_stats",
    f"""WITH {_EVAL}, x AS (SELECT *, abs(pred - target) AS err FROM ev WHERE mask)
SELECT species, count(*) AS n, round(avg(target), 6) AS target_mean, round(stddev_pop(target), 6) AS target_std, round(quantile_cont(target, 0.95), 6) AS target_p95,
  round(quantile_cont(target, 0.99), 6) AS target_p99, round(avg(CAST(target > 0 AS INT)), 6) AS target_nonzero, round(avg(pred), 6) AS pred_mean,
  round(stddev_pop(pred), 6) AS pred_std, round(quantile_cont(pred, 0.95), 6) AS pred_p95, round(quantile_cont(pred, 0.99), 6) AS pred_p99,
  round(avg(CAST(pred > 0 AS INT)), 6) AS pred_nonzero, round(quantile_cont(err, 0.95), 6) AS err_p95, round(quantile_cont(err, 0.99), 6) AS err_p99 FROM x GROUP BY species""",
)
def masked_stats(spark, sf_dir):
    return rounded(evalstats.masked_stats(_evaluated(spark, sf_dir), ["species"]))


@register(
    "eval_distribution",
    f"""WITH {_EVAL}, x AS (SELECT file, pred - target AS err FROM ev)
SELECT file, count(err) AS n, round(avg(err), 6) AS mean, round(stddev_pop(err), 6) AS std, round(quantile_cont(err, 0.5), 6) AS p50, round(quantile_cont(err, 0.9), 6) AS p90,
  round(quantile_cont(err, 0.95), 6) AS p95, round(quantile_cont(err, 0.99), 6) AS p99, round(avg(CAST(abs(err) > 5 AS INT)), 6) AS over_5,
  round(avg(CAST(abs(err) > 10 AS INT)), 6) AS over_10, round(avg(CAST(abs(err) > 20 AS INT)), 6) AS over_20 FROM x GROUP BY file""",
)
def eval_distribution(spark, sf_dir):
    return rounded(evalstats.distribution(_evaluated(spark, sf_dir).withColumn("err", F.col("pred") - F.col("target")), ["file"], "err"))


@register(
    "mask_weighted_mean",
    """SELECT user_id AS run, round(sum(value * (event_id % 4)) / sum(event_id % 4), 6) AS loss, CAST(sum(event_id % 4) AS BIGINT) AS weight
FROM events WHERE event_id % 4 > 0 GROUP BY user_id""",
)
def mask_weighted_mean(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("value").alias("loss"), (F.col("event_id") % 4).alias("weight"))
    return rounded(evalstats.weighted_mean(df, ["run"], "loss", "weight"))


@register(
    "checkpoint_rollup",
    """WITH c AS (SELECT DISTINCT label AS ck FROM embeddings), f AS (SELECT DISTINCT vec_id % 7 AS fs FROM embeddings),
p AS (SELECT ck, fs, count(v.vec_id) AS n, avg(CASE WHEN v.vec_id IS NULL THEN NULL ELSE CAST(v.vec_id AS DOUBLE) END) AS score
  FROM c CROSS JOIN f LEFT JOIN embeddings v ON v.label = ck AND v.vec_id % 7 = fs GROUP BY ck, fs)
SELECT CAST(ck AS BIGINT) AS ck, count(*) AS sets, round(avg(score), 6) AS score FROM p GROUP BY ck""",
)
def checkpoint_rollup(spark, sf_dir):
    c = cells(spark, sf_dir).select("id", "species", "dataset")
    pairs = c.select(F.col("species").alias("ck")).distinct().crossJoin(c.select(F.col("dataset").alias("fs")).distinct())  # two short lists
    scored = pairs.join(c, (F.col("ck") == F.col("species")) & (F.col("fs") == F.col("dataset")), "left")
    per = scored.groupBy("ck", "fs").agg(F.coalesce(F.avg(F.col("id").cast("double")), F.lit(float("nan"))).alias("score"))
    return rounded(evalstats.checkpoint_rollup(per, "ck", ["score"]))


@register(
    "change_ratio",
    f"""WITH {CELLS}, l AS (SELECT file, species, lag(species) OVER (PARTITION BY file ORDER BY id) AS b FROM c),
r AS (SELECT file, avg(CAST(species <> b AS INT)) AS ratio, count(*) AS n FROM l GROUP BY file),
s AS (SELECT file, species, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY file) AS p FROM c GROUP BY file, species),
x AS (SELECT file, 1 - sum(p * p) AS expected, sum(p / (1 - p)) AS expected_run FROM s GROUP BY file)
SELECT r.file AS file, round(ratio, 6) AS ratio, n, round(expected, 6) AS expected, round(expected_run, 6) AS expected_run FROM r JOIN x ON r.file = x.file""",
)
def change_ratio(spark, sf_dir):
    return rounded(quality.change_ratio(cells(spark, sf_dir).select("id", "file", "species"), "file", "id", "species"))


@register(
    "run_lengths",
    f"""WITH {CELLS}, l AS (SELECT id, file, CASE WHEN species = lag(species) OVER (PARTITION BY file ORDER BY id) THEN 0 ELSE 1 END AS n FROM c),
g AS (SELECT file, sum(n) OVER (PARTITION BY file ORDER BY id) AS isl FROM l), r AS (SELECT file, isl, count(*) AS len FROM g GROUP BY file, isl)
SELECT file, count(*) AS runs, round(avg(len), 6) AS mean_run, max(len) AS max_run FROM r GROUP BY file""",
)
def run_lengths(spark, sf_dir):
    return rounded(quality.run_lengths(cells(spark, sf_dir).select("id", "file", "species"), "file", "id", "species"))


@register(
    "runs_test",
    """WITH m AS (SELECT user_id, median(value) AS md FROM events GROUP BY user_id),
u AS (SELECT e.user_id AS run, event_id, CAST(value > md AS INT) AS up FROM events e JOIN m ON e.user_id = m.user_id),
l AS (SELECT run, up, CASE WHEN up = lag(up) OVER (PARTITION BY run ORDER BY event_id) THEN 0 ELSE 1 END AS nw FROM u),
o AS (SELECT run, CAST(sum(nw) AS BIGINT) AS runs, CAST(sum(up) AS BIGINT) AS n1, count(CASE WHEN up = 0 THEN 1 END) AS n2 FROM l GROUP BY run),
v AS (SELECT *, 2.0 * n1 * n2 / (n1 + n2) + 1 AS mu FROM o)
SELECT run, runs, n1, n2, round((runs - mu) / sqrt((mu - 1) * (mu - 2) / (n1 + n2 - 1)), 6) AS z FROM v""",
)
def runs_test(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", "value")
    return rounded(quality.runs_test(df, "run", "event_id", "value"))


@register(
    "runs_test_p",
)
def runs_test_p(spark, sf_dir):
    return runs_test(spark, sf_dir).withColumn("p", quality.two_sided(F.col("z")))


@register(
    "rare_species_spread",
    f"""WITH {CELLS}, s AS (SELECT species, file FROM c WHERE NOT (species < 5 AND file % 2 = 0)), g AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS i FROM (SELECT DISTINCT file FROM s)),
t AS (SELECT count(*) AS files FROM g), o AS (SELECT species, count(*) AS n, count(DISTINCT s.file) AS in_files, max(i) - min(i) AS d FROM s JOIN g ON s.file = g.file GROUP BY species),
x AS (SELECT species, n, in_files, files, d * 1.0 / greatest(files - 1, 1) AS spread FROM o CROSS JOIN t)
SELECT species, n, in_files, files, round(spread, 6) AS spread, CASE WHEN spread >= 0.85 THEN 'uniform' WHEN spread >= 0.5 THEN 'moderate' WHEN spread >= 0.05 THEN 'BATCH SEGMENT' ELSE 'NEAR-SINGLE BATCH' END AS verdict,
  n <= 5 * files AS rare, n <= 5 * files AND n > 3 AND in_files = 1 AS suspicious FROM x""",
)
def rare_species_spread(spark, sf_dir):
    df = cells(spark, sf_dir).select("species", "file").where(~((F.col("species") < 5) & (F.col("file") % 2 == 0)))
    return rounded(quality.spread(df, "species", "file"))


@register(
    "argmax_error_rate",
    f"""WITH {ELEMENTS}, f AS (SELECT id, species, min(pos) AS p FROM (SELECT *, max(r) OVER (PARTITION BY id) AS top FROM e) WHERE r = top GROUP BY id, species)
SELECT species, count(*) AS n, round(1 - avg(CAST(p % 10 = species AS INT)), 6) AS error_rate FROM f GROUP BY species""",
)
def argmax_error_rate(spark, sf_dir):
    hit = (arrays.argmax(F.col("raw")) % 10 == F.col("species")).cast("int")
    return rounded(cells(spark, sf_dir).groupBy("species").agg(F.count(F.lit(1)).alias("n"), (1 - F.avg(hit)).alias("error_rate")))


@register(
    "parameter_stats",
    f"""WITH {ELEMENTS}, l AS (SELECT 'layers.' || CAST(id AS VARCHAR) || '.w' AS name, id AS layer, r FROM e)
SELECT name, layer, round(sqrt(sum(r * r)), 6) AS norm, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, layer = (SELECT max(vec_id) FROM embeddings) AS last_layer
FROM l GROUP BY name, layer""",
)
def parameter_stats(spark, sf_dir):
    df = cells(spark, sf_dir).select(F.concat(F.lit("layers."), F.col("id").cast("string"), F.lit(".w")).alias("name"), "raw")
    return rounded(evalstats.parameter_stats(df, "name", "raw"))


# --- encoding


@register("min_genes_filter", f"WITH {ELEMENTS} SELECT id, count(*) AS genes FROM e WHERE v > 0 GROUP BY id HAVING count(*) >= 32")
def min_genes_filter(spark, sf_dir):
    coo = elements(spark, sf_dir).select("id", F.col("v").alias("value"))
    return encode.min_genes(coo, 32, "id")


@register(
    "gene_set_semi_join",
    f"WITH {ELEMENTS} SELECT id, count(*) AS n, round(sum(v), 6) AS total FROM e WHERE pos IN (SELECT p_size FROM part) GROUP BY id",
)
def gene_set_semi_join(spark, sf_dir):
    coo = elements(spark, sf_dir).select("id", F.concat(F.lit("G"), F.col("pos").cast("string"), F.lit(".1")).alias("gene"), "v")
    genes = table(spark, sf_dir, "part").select(F.concat(F.lit("g"), F.col("p_size").cast("string")).alias("gene"))
    return rounded(encode.keep_genes(coo, genes).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")))


@register("missing_genes", "SELECT DISTINCT p_size AS gene FROM part WHERE p_size NOT IN (SELECT s_nationkey FROM supplier)")
def missing_genes(spark, sf_dir):
    genes = table(spark, sf_dir, "part").select(F.col("p_size").alias("gene")).distinct()
    return encode.missing_genes(genes, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("gene")))


@register(
    "gene_symbol_fallback",
    """SELECT s_suppkey, coalesce(n_name, 'ENS' || CAST(s_suppkey AS VARCHAR) || '.2') AS symbol FROM supplier LEFT JOIN nation ON s_suppkey = n_nationkey""",
)
def gene_symbol_fallback(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("ENS"), F.col("s_suppkey").cast("string"), F.lit(".2")).alias("gene"))
    mapping = table(spark, sf_dir, "nation").select(F.concat(F.lit("ens"), F.col("n_nationkey").cast("string"), F.lit(".7")).alias("gene_id"), F.col("n_name").alias("symbol"))
    return encode.symbols(df, mapping).select("s_suppkey", "symbol")


@register(
    "collapse_duplicate_columns",
    f"WITH {ELEMENTS} SELECT id, 'g' || CAST(pos % 10 AS VARCHAR) AS symbol, round(sum(v), 6) AS value, min(pos) AS pos FROM e GROUP BY id, pos % 10",
)
def collapse_duplicate_columns(spark, sf_dir):
    coo = elements(spark, sf_dir).select("id", F.concat(F.lit("g"), (F.col("pos") % 10).cast("string")).alias("symbol"), "pos", F.col("v").alias("value"))
    return rounded(encode.collapse_columns(coo, "id"))


@register(
    "zero_fill_columns",
    f"""WITH {ELEMENTS}, h AS (SELECT id, pos * 2 AS pos, v FROM e WHERE v > 0),
a AS (SELECT DISTINCT id FROM h), g AS (SELECT id, unnest(range(128)) AS pos FROM a)
SELECT g.id AS id, CAST(count(*) AS INT) AS width, round(sum(coalesce(v, 0) * (g.pos + 1)), 6) AS checksum FROM g LEFT JOIN h ON g.id = h.id AND g.pos = h.pos GROUP BY g.id""",
)
def zero_fill_columns(spark, sf_dir):
    coo = elements(spark, sf_dir).where("v > 0").select("id", (F.col("pos") * 2).alias("pos"), F.col("v").alias("value"))
    dense = encode.dense(coo, 128, "id")
    weighted = F.transform("x", lambda v, i: v * (i + 1))
    return rounded(dense.select("id", F.size("x").alias("width"), arrays.total(weighted).alias("checksum")))


@register(
    "normalize_sf_log1p",
    f"""WITH {ELEMENTS}, s AS (SELECT *, sum(v) OVER (PARTITION BY id) AS t FROM e)
SELECT id, round(sum(ln(1 + v * 10000 / CASE WHEN t = 0 THEN 1 ELSE t END)), 6) AS total, round(max(ln(1 + v * 10000 / CASE WHEN t = 0 THEN 1 ELSE t END)), 6) AS top FROM s GROUP BY id""",
)
def normalize_sf_log1p(spark, sf_dir):
    n = cells(spark, sf_dir).select("id", arrays.scaled_log1p(F.col("x")).alias("x"))
    return rounded(n.select("id", arrays.total(F.col("x")).alias("total"), F.array_max("x").alias("top")))


@register(
    "fill_obs_left_join",
    """WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS k, min(CAST(quality AS VARCHAR)) AS q FROM labels GROUP BY doc_id)
SELECT doc_id, source, coalesce(q, 'unknown') AS quality FROM documents LEFT JOIN s ON CAST(doc_id AS VARCHAR) = k""",
)
def fill_obs_left_join(spark, sf_dir):
    obs = table(spark, sf_dir, "documents").select("doc_id", "source")
    meta = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return encode.fill_obs(obs, meta, "doc_id")


_LOOKUP = """, old AS (SELECT * FROM (VALUES ('lang', 0, 'en'), ('lang', 1, 'xx'), ('source', 4, 'src3')) AS t("column", id, label)),
seen AS (SELECT DISTINCT 'lang' AS "column", lang AS label FROM documents WHERE lang IS NOT NULL UNION SELECT DISTINCT 'source', source FROM documents WHERE source IS NOT NULL),
fresh AS (SELECT s."column" AS "column", s.label AS label FROM seen s LEFT JOIN old o ON s."column" = o."column" AND s.label = o.label WHERE o.label IS NULL),
tops AS (SELECT "column", max(id) AS top FROM old GROUP BY "column"),
lookup AS (SELECT "column", CAST(id AS BIGINT) AS id, label FROM old
  UNION ALL SELECT f."column", CAST(coalesce(top, -1) + row_number() OVER (PARTITION BY f."column" ORDER BY label) AS BIGINT), label FROM fresh f LEFT JOIN tops ON f."column" = tops."column")"""
_OLD = [("lang", 0, "en"), ("lang", 1, "xx"), ("source", 4, "src3")]


def _lookup(spark, sf_dir):
    old = spark.createDataFrame(_OLD, "column string, id bigint, label string")
    return encode.unified_lookup(old, encode.distinct_labels(table(spark, sf_dir, "documents"), ["lang", "source"]))


@register("build_unified_lookup", f'WITH one AS (SELECT 1){_LOOKUP} SELECT "column", id, label FROM lookup')
def build_unified_lookup(spark, sf_dir):
    return _lookup(spark, sf_dir)


@register("collect_distinct_values", "SELECT 'lang' AS \"column\", lang AS label FROM documents UNION SELECT 'source', source FROM documents")
def collect_distinct_values(spark, sf_dir):
    return encode.distinct_labels(table(spark, sf_dir, "documents"), ["lang", "source"])


_KEEP = "(SELECT * FROM lookup WHERE NOT (\"column\" = 'source' AND id > 15))"


@register(
    "encode_labels",
    f"""WITH one AS (SELECT 1){_LOOKUP} SELECT doc_id, coalesce(a.id, -1) AS lang_id, coalesce(b.id, -1) AS source_id FROM documents d
LEFT JOIN {_KEEP} a ON a."column" = 'lang' AND a.label = d.lang LEFT JOIN {_KEEP} b ON b."column" = 'source' AND b.label = d.source""",
)
def encode_labels(spark, sf_dir):
    lookup = _lookup(spark, sf_dir).where(~((F.col("column") == "source") & (F.col("id") > 15)))
    return encode.encode(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), lookup, ["lang", "source"]).select("doc_id", "lang_id", "source_id")


@register(
    "decode_labels",
    f"""WITH one AS (SELECT 1){_LOOKUP} SELECT vec_id, coalesce(a.label, '') AS source_label FROM embeddings LEFT JOIN lookup a ON a."column" = 'source' AND a.id = vec_id % 40""",
)
def decode_labels(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 40).alias("source"))
    return encode.decode(df, _lookup(spark, sf_dir), ["source"]).select("vec_id", "source_label")


@register(
    "project_macrogene",
    f"""WITH {ELEMENTS}, w AS (SELECT pos, species AS k, avg(v) AS w FROM e GROUP BY pos, species)
SELECT id, k, round(sum(v * w), 6) AS value FROM e JOIN w ON e.pos = w.pos GROUP BY id, k""",
)
def project_macrogene(spark, sf_dir):
    e = elements(spark, sf_dir)
    w = e.groupBy("pos", F.col("species").alias("k")).agg(F.avg("v").alias("w"))
    return rounded(encode.project(e.select("id", "pos", F.col("v").alias("value")), w, "id"))


@register(
    "topk_similarity",
    f"""WITH {ELEMENTS}, p AS (SELECT species AS k, pos, avg(r) AS q FROM e GROUP BY species, pos),
s AS (SELECT id, k, sum(r * q) / (sqrt(sum(r * r)) * sqrt(sum(q * q))) AS sim FROM e JOIN p ON e.pos = p.pos GROUP BY id, k),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, k) AS rank FROM s)
SELECT id, k, rank, round(sim, 6) AS sim, round(exp(sim / 0.5) / sum(exp(sim / 0.5)) OVER (PARTITION BY id), 6) AS w FROM t WHERE rank <= 3""",
)
def topk_similarity(spark, sf_dir):
    mean = elements(spark, sf_dir).groupBy(F.col("species").alias("k"), "pos").agg(F.avg("r").alias("q"))
    protos = mean.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "q"))), lambda s: s["q"]).alias("proto"))
    return rounded(encode.nearest(cells(spark, sf_dir).select("id", F.col("raw").alias("vec")), protos, 3, 0.5))


@register(
    "cell_reconcile",
    """WITH l AS (SELECT doc_id, n_chars % 3 AS q FROM documents), r AS (SELECT doc_id, quality AS q FROM labels)
SELECT count(CASE WHEN l.doc_id IS NOT NULL AND r.doc_id IS NOT NULL THEN 1 END) AS overlap, count(CASE WHEN r.doc_id IS NULL THEN 1 END) AS only_left,
  count(CASE WHEN l.doc_id IS NULL THEN 1 END) AS only_right, round(count(CASE WHEN l.q = r.q THEN 1 END) / count(CASE WHEN l.doc_id IS NOT NULL AND r.doc_id IS NOT NULL THEN 1 END), 6) AS q_match
FROM l FULL JOIN r ON l.doc_id = r.doc_id""",
)
def cell_reconcile(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 3).alias("q"))
    b = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("q"))
    return rounded(quality.reconcile(a, b, ["doc_id"], ["q"]))


@register(
    "strict_int_cast",
    """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) || '.0000001' WHEN 1 THEN CAST(event_id AS VARCHAR) || '.5' WHEN 2 THEN 'x' ELSE '7' END AS s,
  ' ' || event_type || '-1' AS b FROM events), n AS (SELECT *, TRY_CAST(s AS DOUBLE) AS x FROM t)
SELECT event_id, CASE WHEN abs(x - round_even(x, 0)) <= 1e-6 THEN CAST(round_even(x, 0) AS BIGINT) END AS strict, CAST(round_even(x, 0) AS BIGINT) AS lenient, regexp_replace(trim(b), '-1$', '') AS barcode FROM n""",
)
def strict_int_cast(spark, sf_dir):
    k, e = F.col("event_id") % 4, F.col("event_id").cast("string")
    s = F.when(k == 0, F.concat(e, F.lit(".0000001"))).when(k == 1, F.concat(e, F.lit(".5"))).when(k == 2, "x").otherwise("7")
    b = F.concat(F.lit(" "), F.col("event_type"), F.lit("-1"))
    return table(spark, sf_dir, "events").select("event_id", scalars.strict_int(s).alias("strict"), scalars.lenient_int(s).alias("lenient"), scalars.barcode(b).alias("barcode"))


@register(
    "vocab_by_frequency",
    """WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM benchmark), c AS (SELECT token, count(*) AS n FROM w WHERE token <> '' GROUP BY token HAVING count(*) >= 2)
SELECT CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS BIGINT) AS id, token, n FROM c UNION ALL SELECT * FROM (VALUES (0, '<pad>', 0), (1, '<cls>', 0)) AS t(id, token, n)""",
)
def vocab_by_frequency(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")).where("token <> ''")
    return encode.vocabulary(words, 2)


@register(
    "var_ordering_fingerprints",
    """WITH f AS (SELECT p_brand AS file, sha1(string_agg(p_type, chr(10) ORDER BY p_partkey)) AS order_id, count(*) AS n_var FROM part GROUP BY p_brand)
SELECT order_id, n_var, count(*) AS files, array_to_string(list_slice(list(file ORDER BY file), 1, 5), ',') AS examples FROM f GROUP BY order_id, n_var""",
)
def var_ordering_fingerprints(spark, sf_dir):
    var = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("gene"), F.col("p_partkey").alias("pos"))
    return encode.orderings(var).withColumn("examples", F.array_join("examples", ","))


@register("category_reindex", "WITH f AS (SELECT p_type AS label, min(p_partkey) AS k FROM part GROUP BY p_type) SELECT label, CAST(row_number() OVER (ORDER BY k, label) - 1 AS BIGINT) AS id FROM f")
def category_reindex(spark, sf_dir):
    return encode.dense_ids(table(spark, sf_dir, "part").select(F.col("p_type").alias("label"), "p_partkey"), "label", "p_partkey")


@register(
    "random_masking",
    f"""WITH {ELEMENTS}, k AS (SELECT id, CASE WHEN pos >= 1 AND {hash_sql("'5'", 'id', 'pos')} < {int(0.15 * scalars.UNIT)} THEN -1.0 ELSE v END AS v FROM e)
SELECT id, count(CASE WHEN v = -1 THEN 1 END) AS masked, round(sum(v), 6) AS total FROM k GROUP BY id""",
)
def random_masking(spark, sf_dir):
    m = cells(spark, sf_dir).select("id", encode.masked(F.col("x"), F.col("id"), 0.15, seed=5).alias("x"))
    return rounded(m.select("id", F.size(F.filter("x", lambda v: v == -1)).cast("bigint").alias("masked"), arrays.total(F.col("x")).alias("total")))


@register(
    "cls_and_nonzero",
    f"WITH {ELEMENTS} SELECT id, CAST(65 AS INT) AS width, count(CASE WHEN v <> 0 THEN 1 END) AS pairs, CAST(sum(CASE WHEN v <> 0 THEN pos ELSE 0 END) AS BIGINT) AS places FROM e GROUP BY id",
)
def cls_and_nonzero(spark, sf_dir):
    genes = F.transform("x", lambda v, i: i.cast("bigint"))
    c = cells(spark, sf_dir).select("id", "x", genes.alias("genes"))
    pairs = arrays.nonzero_pairs(F.col("genes"), F.col("x"))
    places = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, p: a + p["gene"])
    return c.select("id", F.size(arrays.with_cls(F.col("x"))).alias("width"), F.size(pairs).cast("bigint").alias("pairs"), places.alias("places"))


@register("column_permutation", f"WITH {ELEMENTS} SELECT id, round(sum(r * (63 - pos)), 6) AS checksum FROM e GROUP BY id")
def column_permutation(spark, sf_dir):
    order = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 63 - i)
    c = cells(spark, sf_dir).select("id", arrays.permuted(F.col("raw"), order).alias("x"))
    return rounded(c.select("id", arrays.total(F.transform("x", lambda v, i: v * i)).alias("checksum")))
