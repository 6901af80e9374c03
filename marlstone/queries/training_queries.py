"""Queries over what a training run reads and how its health is judged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, scalars
from ..operators import layout, lineage, metrics, ordering, quality
from .registry import register
from .standins import CELLS, ELEMENTS, METRICS, cells, hash_sql, rounded, rounded_binary, table
from .standins import metrics as log

_FILES = f"{CELLS}, n AS (SELECT file, count(*) AS n_rows FROM c GROUP BY file)"


def _files(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))


def _sampler_sql(ranks, seed, total):
    return f"""WITH {_FILES}, o AS (SELECT file, row_number() OVER (ORDER BY {hash_sql(f"'{seed}'", 'file')}, file) - 1 AS i, count(*) OVER () AS n FROM n),
t AS (SELECT *, {total} AS total FROM o), p AS (SELECT file, unnest(range(i, total, n)) AS p FROM t WHERE i < total)
SELECT CAST(p % {ranks} AS BIGINT) AS rank, CAST(p // {ranks} AS BIGINT) AS place, file FROM p"""


@register("sampler_padded", _sampler_sql(5, 21, "CAST(ceil(n / 5.0) AS BIGINT) * 5"))
def sampler_padded(spark, sf_dir):
    return layout.sampled_files(_files(spark, sf_dir), 5, 20, 1)


@register("sampler_truncated", _sampler_sql(5, 20, "n // 5 * 5"))
def sampler_truncated(spark, sf_dir):
    return layout.sampled_files(_files(spark, sf_dir), 5, 20, drop_last=True)


@register(
    "chunk_read_ranges",
    f"""WITH {_FILES}, s AS (SELECT file // 2 AS chunk, sum(n_rows) AS k FROM n GROUP BY file // 2),
r AS (SELECT chunk, sum(k) OVER (ORDER BY chunk) - k AS a, sum(k) OVER (ORDER BY chunk) AS b FROM s)
SELECT CAST(chunk AS BIGINT) AS chunk, CAST(a AS BIGINT) AS row_start, CAST(b AS BIGINT) AS row_end, CAST(greatest(a, 100) - a AS BIGINT) AS drop_head,
  CAST(least(b, 450) - greatest(a, 100) AS BIGINT) AS keep_rows FROM r WHERE greatest(a, 100) < least(b, 450)""",
)
def chunk_read_ranges(spark, sf_dir):
    return layout.read_ranges(_files(spark, sf_dir), 2, 100, 450, "file")


@register("rank_barrier", f"WITH {METRICS}, k AS (SELECT rank, count(*) AS n FROM m GROUP BY rank) SELECT CAST(min(n // 32) AS BIGINT) AS batches FROM k")
def rank_barrier(spark, sf_dir):
    return layout.common_batches(log(spark, sf_dir).groupBy("rank").agg(F.count(F.lit(1)).alias("n_rows")), 32)


@register("chunk_seeds", "SELECT event_id, 42 + (event_id % 3) * 1000003 + (event_id % 4) * 10007 + (event_id // 100) * 101 AS seed FROM events")
def chunk_seeds(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e, layout.mixed_seed(42, e % 3, e % 4, F.floor(e / 100)).alias("seed"))


@register("sorted_by_label", "SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, event_id) - 1 AS row FROM events")
def sorted_by_label(spark, sf_dir):
    return ordering.by_label(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")


@register("skip_list_unseen", "SELECT unnest(['Brand#11', 'Brand#99', 'Brand#98']) AS species EXCEPT SELECT p_brand FROM part")
def skip_list_unseen(spark, sf_dir):
    return layout.unseen(table(spark, sf_dir, "part").select(F.col("p_brand").alias("species")), "species", ["Brand#11", "Brand#99", "Brand#98"])


@register("one_to_one_join", "SELECT d.doc_id AS doc_id, n_chars, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def one_to_one_join(spark, sf_dir):
    return quality.one_to_one(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


@register("canonical_columns", f"WITH {ELEMENTS} SELECT id, round(sum(r * ((pos + 1) % 64)), 6) AS checksum FROM e GROUP BY id")
def canonical_columns(spark, sf_dir):
    have = [f"g{i}" for i in range(64)]
    order = arrays.column_order(have, have[-1:] + have[:-1])
    c = cells(spark, sf_dir).select("id", arrays.permuted(F.col("raw"), F.array(*map(F.lit, order))).alias("x"))
    return rounded(c.select("id", arrays.total(F.transform("x", lambda v, i: v * i)).alias("checksum")))


@register(
    "run_folders",
    """WITH f AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'notes_' ELSE 'training_output_' END || CAST(p_partkey // 4 AS VARCHAR) || CASE WHEN (p_partkey // 4) % 7 = 0 THEN '_text_split' ELSE '' END AS name,
  CASE p_partkey % 6 WHEN 0 THEN 'summary.md' WHEN 1 THEN 'metrics.jsonl' WHEN 2 THEN 'log.0.txt' WHEN 3 THEN 'curve.PNG' ELSE 'readme.rst' END AS file FROM part)
SELECT DISTINCT name FROM f WHERE name LIKE 'training_output%' AND NOT suffix(name, '_text_split') AND file <> 'readme.rst'""",
)
def run_folders(spark, sf_dir):
    k = F.col("p_partkey")
    folder = F.floor(k / 4)
    name = F.concat(F.when(k % 5 == 0, "notes_").otherwise("training_output_"), folder.cast("string"), F.when(folder % 7 == 0, "_text_split").otherwise(""))
    file = F.when(k % 6 == 0, "summary.md").when(k % 6 == 1, "metrics.jsonl").when(k % 6 == 2, "log.0.txt").when(k % 6 == 3, "curve.PNG").otherwise("readme.rst")
    return lineage.candidates(table(spark, sf_dir, "part").select(name.alias("name"), file.alias("file")))


_TEXT = """t AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'lr5em4_clip0p5_epoch' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'skip100_' || CAST(c_custkey AS VARCHAR) || '_lrdecay7'
  WHEN 2 THEN CAST(c_custkey AS VARCHAR) || 'epoch_lr3e5' WHEN 3 THEN 'stable' ELSE 'epochs12_skip9' END AS x FROM customer)"""


@register(
    "run_settings",
    f"""WITH {_TEXT} SELECT id,
  CASE WHEN x LIKE '%lr5em4%' THEN '5e-4' WHEN x LIKE '%lr3e5%' THEN '3e-5' ELSE '' END AS lr, CASE WHEN x LIKE '%clip0p5%' THEN '0.5' ELSE '' END AS clip,
  regexp_extract(x, 'skip([0-9]+)', 1) AS skip_ratio, regexp_extract(x, 'skip[0-9]+_([0-9]+)', 1) AS skip_max,
  CASE id % 5 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 2 THEN CAST(id AS VARCHAR) WHEN 4 THEN '12' ELSE '' END AS epochs, CASE WHEN x LIKE '%lrdecay7%' THEN 'lrdecay7' ELSE '' END AS lr_decay FROM t""",
)
def run_settings(spark, sf_dir):
    k = F.col("c_custkey")
    own = k.cast("string")
    x = F.when(k % 5 == 0, F.concat(F.lit("lr5em4_clip0p5_epoch"), own)).when(k % 5 == 1, F.concat(F.lit("skip100_"), own, F.lit("_lrdecay7"))).when(
        k % 5 == 2, F.concat(own, F.lit("epoch_lr3e5"))).when(k % 5 == 3, "stable").otherwise("epochs12_skip9")
    t = table(spark, sf_dir, "customer").select(k.alias("id"), x.alias("x"))
    return t.select("id", *[c.alias(name) for name, c in scalars.run_settings(F.col("x")).items()])


_LOG = METRICS + """, q AS (SELECT run, line, step, CASE WHEN line % 9 <> 0 THEN loss END AS loss, CASE WHEN line % 7 <> 0 THEN norm END AS raw, norm * 0.8 AS ema, norm * 1.5 AS clip_at, norm * 3 AS skip_at,
  CASE WHEN line % 3 = 0 THEN 20.0 + run % 30 END AS skip_max, CASE WHEN run % 2 = 0 THEN 0.0 ELSE 24.0 END AS hard_limit, skipped, action, loss / 2 AS head, norm / 20 AS zero FROM m)"""
_EXTREMES = """x AS (SELECT run, max(raw) AS raw_max, max(ema) AS ema_max, max(clip_at) AS clip_at_max, min(skip_at) AS skip_at_min, max(skip_at) AS skip_at_max,
  arg_min(skip_max, CASE WHEN skip_max IS NOT NULL THEN line END) AS skip_max, arg_min(hard_limit, line) AS hard_limit FROM q GROUP BY run)"""
_NAMES = "round(raw_max, 6) AS raw_max, round(ema_max, 6) AS ema_max, round(clip_at_max, 6) AS clip_at_max, round(skip_at_min, 6) AS skip_at_min, round(skip_at_max, 6) AS skip_at_max, skip_max, hard_limit"


def _log(spark, sf_dir):
    line, run = F.col("line"), F.col("run")
    return log(spark, sf_dir).select(
        "run", "line", "step", F.when(line % 9 != 0, F.col("loss")).alias("loss"), F.when(line % 7 != 0, F.col("norm")).alias("raw"), (F.col("norm") * 0.8).alias("ema"),
        (F.col("norm") * 1.5).alias("clip_at"), (F.col("norm") * 3).alias("skip_at"), F.when(line % 3 == 0, 20.0 + run % 30).alias("skip_max"),
        F.when(run % 2 == 0, 0.0).otherwise(24.0).alias("hard_limit"), "skipped", "action", (F.col("loss") / 2).alias("head"), (F.col("norm") / 20).alias("zero"),
    )


@register("threshold_extremes", f"WITH {_LOG}, {_EXTREMES} SELECT run, {_NAMES} FROM x")
def threshold_extremes(spark, sf_dir):
    return rounded(metrics.extremes(_log(spark, sf_dir)))


@register(
    "stability_verdict",
    f"""WITH {_LOG}, {_EXTREMES},
i AS (SELECT run, line, skipped, sum(CASE WHEN skipped THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY line) AS g FROM q WHERE raw IS NOT NULL),
l AS (SELECT run, max(k) AS longest FROM (SELECT run, g, count(CASE WHEN skipped THEN 1 END) AS k FROM i GROUP BY run, g) GROUP BY run),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY line) AS a, row_number() OVER (PARTITION BY run ORDER BY line DESC) AS z FROM q),
e AS (SELECT run, count(CASE WHEN action = 'skip_norm' THEN 1 END) / count(*) AS share, arg_min(loss, CASE WHEN loss IS NOT NULL THEN line END) AS f, arg_max(loss, CASE WHEN loss IS NOT NULL THEN line END) AS t,
  arg_max(step, line) - arg_min(step, line) + 1 AS span, avg(CASE WHEN a <= 4 THEN head END) AS h1, avg(CASE WHEN z <= 4 THEN head END) AS h2, avg(CASE WHEN z <= 4 THEN zero END) AS z2 FROM o GROUP BY run),
v AS (SELECT e.run AS run, share, f, t, longest, x.* EXCLUDE (run), (h1 - h2) / greatest(abs(h1), 1e-12) AS hd, z2, span FROM e JOIN x ON e.run = x.run LEFT JOIN l ON e.run = l.run),
w AS (SELECT *, coalesce(share > 0.2, false) AS c1, coalesce(longest >= 2, false) AS c2, coalesce(skip_max > 0 AND raw_max >= skip_max, false) AS c3,
  coalesce(hard_limit > 0 AND raw_max >= hard_limit, false) AS c4, coalesce(t > 1.5 * f, false) AS c5, coalesce(span >= 50 AND (hd < 0.1 OR z2 > 0.65), false) AS c6 FROM v)
SELECT run, round(share, 6) AS skip_share, round(f, 6) AS first_loss, round(t, 6) AS last_loss, {_NAMES}, longest AS longest_streak, round(hd, 6) AS head_drop, round(z2, 6) AS zero_last,
  c1 AS too_many_skips, c2 AS long_streak, c3 AS over_skip_max, c4 AS over_hard_limit, c5 AS worse_loss, c6 AS primary_stuck, c1 OR c2 OR c3 OR c4 OR c5 OR c6 AS unhealthy FROM w""",
)
def stability_verdict(spark, sf_dir):
    return rounded_binary(metrics.stability(_log(spark, sf_dir), 0.2, 2, span=50, window=4, least_drop=0.1))
