"""Queries over the catalogue of experiments and its texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import lineage
from .registry import register
from .standins import table

_NAMES = """n AS (SELECT c_custkey AS id, 'training_output_' || CASE c_custkey % 3 WHEN 0 THEN '100m' WHEN 1 THEN '500m' ELSE '1b' END || '_data_' || CAST(c_nationkey % 3 + 1 AS VARCHAR) || '_3_'
  || lower(c_mktsegment) || CASE c_custkey % 4 WHEN 0 THEN '_from_scratch' WHEN 1 THEN '_lr5em4_resume' ELSE '_clip0p5' END || '_202605' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0')
  || '_13' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') || '51' AS name FROM customer)"""


def _names(spark, sf_dir):
    k = F.col("c_custkey")
    size = F.when(k % 3 == 0, "100m").when(k % 3 == 1, "500m").otherwise("1b")
    tail = F.when(k % 4 == 0, "_from_scratch").when(k % 4 == 1, "_lr5em4_resume").otherwise("_clip0p5")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    name = F.concat(F.lit("training_output_"), size, F.lit("_data_"), (F.col("c_nationkey") % 3 + 1).cast("string"), F.lit("_3_"), F.lower("c_mktsegment"), tail,
                    F.lit("_202605"), two(k % 28 + 1), F.lit("_13"), two(k % 60), F.lit("51"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name"))


@register(
    "parse_run_names",
    f"""WITH {_NAMES}, s AS (SELECT id, name, regexp_extract(name, '([0-9]{{8}}_[0-9]{{6}})$', 1) AS t, regexp_replace(regexp_replace(name, '^training_output_', ''), '_[0-9]{{8}}_[0-9]{{6}}$', '') AS rest FROM n)
SELECT id, name, substr(t, 1, 4) || '-' || substr(t, 5, 2) || '-' || substr(t, 7, 2) || 'T' || substr(t, 10, 2) || ':' || substr(t, 12, 2) || ':' || substr(t, 14, 2) AS started_at,
  split_part(rest, '_', 1) AS model_size, regexp_extract(name, '(data(_[0-9]+)+)', 1) AS data_recipe, regexp_replace(rest, '^[0-9a-z]+_data(_[0-9]+)+_', '') AS experiment FROM s""",
)
def parse_run_names(spark, sf_dir):
    return lineage.parse_names(_names(spark, sf_dir)).drop("tags")


_STAGE = """CASE WHEN size = '500m' AND (name LIKE '%stab%') THEN '500M stability incident and fixes' WHEN name LIKE '%5epoch%' OR name LIKE '%epoch5%' THEN 'Multi-epoch and resume experiments'
  WHEN name LIKE '%lr%' THEN '100M learning-rate sweep' WHEN name LIKE '%huber%' OR name LIKE '%fp32%' OR name LIKE '%lossw%' OR name LIKE '%shuffleall%' THEN 'fp32 + Huber, modality, loss-weight, and shuffle experiments'
  WHEN recipe IN ('data_1', 'data_1_3', 'data_1_2_3') THEN 'Data 1 / 1+3 / 1+2+3 comparisons' ELSE 'Initial smoke and model-scale tests' END"""
_PARSED = _NAMES + """, v AS (SELECT id, name, split_part(name, '_', 3) AS size, regexp_extract(name, 'data(_[0-9]+)+', 0) AS recipe FROM n)"""


@register(
    "variable_tokens",
    f"""WITH {_PARSED} SELECT id, CASE id % 4 WHEN 1 THEN '5e-4' WHEN 0 THEN NULL ELSE '0.5' END AS number, CASE id % 4 WHEN 0 THEN 'from_scratch' WHEN 1 THEN 'lr5em4,resume' ELSE 'clip0p5' END AS tags,
  {_STAGE} AS stage, CASE WHEN size = '500m' OR name LIKE '%clip0p5%' THEN '500M stability' WHEN name LIKE '%lr%' THEN 'LR / schedule' WHEN size = '1b' THEN 'Scale smoke' ELSE '100M data baselines' END AS lane FROM v""",
)
def variable_tokens(spark, sf_dir):
    n = lineage.parse_names(_names(spark, sf_dir))
    token = F.get(F.filter("tags", lambda t: t.rlike("^(lr|clip)[0-9]")), F.lit(0))
    size, recipe = F.col("model_size"), F.col("data_recipe")
    return n.select("id", scalars.readable_number(token).alias("number"), F.array_join("tags", ",").alias("tags"),
                    lineage.stage(F.col("name"), size, recipe).alias("stage"), lineage.lane(F.col("name"), size, recipe).alias("lane"))


_ART = """a AS (SELECT page_id, page_id // 10 AS run, CASE page_id % 8 WHEN 0 THEN 'metrics.' || CAST(page_id % 7 AS VARCHAR) || '-0.jsonl' WHEN 1 THEN 'loss_to_log.0-0.txt' WHEN 2 THEN 'log.0-1.txt'
  WHEN 3 THEN 'summary.md' WHEN 4 THEN 'run_record.json' WHEN 5 THEN 'loss.png' WHEN 6 THEN 'model_' || CAST(page_id AS VARCHAR) || '.pt' ELSE 'notes.doc' END AS name, length(url) AS size FROM pages)"""


def _artifacts(spark, sf_dir):
    k = F.col("page_id") % 8
    name = (
        F.when(k == 0, F.concat(F.lit("metrics."), (F.col("page_id") % 7).cast("string"), F.lit("-0.jsonl"))).when(k == 1, "loss_to_log.0-0.txt").when(k == 2, "log.0-1.txt")
        .when(k == 3, "summary.md").when(k == 4, "run_record.json").when(k == 5, "loss.png").when(k == 6, F.concat(F.lit("model_"), F.col("page_id").cast("string"), F.lit(".pt"))).otherwise("notes.doc")
    )
    return table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 10).alias("run"), name.alias("name"), F.length("url").cast("bigint").alias("size"))


@register(
    "artifact_kinds",
    f"""WITH {_ART}, k AS (SELECT run, size, CASE page_id % 8 WHEN 0 THEN 'metrics_jsonl' WHEN 1 THEN 'loss_log' WHEN 2 THEN 'log' WHEN 3 THEN 'summary_md' WHEN 4 THEN 'run_record_json' WHEN 5 THEN 'training_curve_png' WHEN 6 THEN 'checkpoint' END AS kind FROM a)
SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM k WHERE kind IS NOT NULL GROUP BY kind""",
)
def artifact_kinds(spark, sf_dir):
    a = _artifacts(spark, sf_dir).withColumn("kind", lineage.artifact_kind(F.col("name"))).where("kind is not null")
    return a.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@register("choose_metrics_file", f"WITH {_ART}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN name = 'metrics.0-0.jsonl' THEN 0 ELSE 1 END, name) AS k FROM a WHERE name LIKE 'metrics%') SELECT run, name FROM r WHERE k = 1")
def choose_metrics_file(spark, sf_dir):
    return lineage.preferred_file(_artifacts(spark, sf_dir).where(F.col("name").startswith("metrics"))).select("run", "name")


@register("rank_files", f"WITH {_ART}, d AS (SELECT run, name, CAST(page_id % 7 AS BIGINT) AS k FROM a WHERE name LIKE 'metrics%') SELECT run, name, CAST(row_number() OVER (PARTITION BY run ORDER BY k, name) AS INT) AS ord FROM d")
def rank_files(spark, sf_dir):
    return lineage.rank_files(_artifacts(spark, sf_dir).select("run", "name"))


@register(
    "discover_runs",
    """WITH r AS (SELECT supplier.s_suppkey AS id0, s_suppkey % 3 AS root_order, s_name AS name, 'p' || CAST(s_nationkey AS VARCHAR) AS real_path FROM supplier),
k AS (SELECT *, row_number() OVER (PARTITION BY real_path ORDER BY root_order, name) AS k FROM r) SELECT real_path, name, substr(sha1(real_path || '|' || name), 1, 16) AS id FROM k WHERE k = 1""",
)
def discover_runs(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3).alias("root_order"), F.col("s_name").alias("name"), F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("real_path"))
    return lineage.discovered(df).select("real_path", "name", "id")


@register("stale_runs", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def stale_runs(spark, sf_dir):
    return lineage.stale(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@register(
    "incremental_fingerprint",
    f"""WITH {_ART}, f AS (SELECT run, sha256(string_agg(name || ':' || CAST(size AS VARCHAR) || ':' || CAST(page_id AS VARCHAR), chr(10) ORDER BY name || ':' || CAST(size AS VARCHAR) || ':' || CAST(page_id AS VARCHAR)) || chr(10) || '3') AS fp FROM a GROUP BY run)
SELECT run, CASE WHEN run % 4 = 0 THEN 'add' WHEN run % 4 = 1 THEN 'refresh' ELSE 'keep' END AS action, fp AS fingerprint FROM f""",
)
def incremental_fingerprint(spark, sf_dir):
    now = lineage.fingerprints(_artifacts(spark, sf_dir).withColumn("mtime", F.col("page_id")), 3)
    state = now.where("run % 4 <> 0").withColumn("fingerprint", F.when(F.col("run") % 4 == 1, F.lit("old")).otherwise(F.col("fingerprint")))
    return lineage.index_actions(now, state).join(now, "run")


@register(
    "upsert_by_key",
    "SELECT l_orderkey AS k, CAST(max(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY l_orderkey UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def upsert_by_key(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(-1).cast("bigint").alias("v"))
    new = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linenumber").cast("bigint").alias("v"))
    return lineage.upserted(old, new, ["k"])


_RUNS = "r AS (SELECT c_custkey AS id, c_custkey AS ord, c_mktsegment AS lane, c_nationkey AS data, c_custkey % 7 AS recipe FROM customer)"


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("lane"), F.col("c_nationkey").alias("data"), (F.col("c_custkey") % 7).alias("recipe")
    )


_PARENTS = _RUNS + """, p AS (SELECT a.id AS child, b.id AS parent, CASE WHEN a.data = b.data THEN 4 ELSE 0 END + CASE WHEN a.recipe = b.recipe THEN 2 ELSE 0 END AS score FROM r a JOIN r b ON a.lane = b.lane AND b.ord < a.ord),
e AS (SELECT parent, child, score FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY score DESC, parent) AS k FROM p) WHERE k = 1)"""


def _edges(spark, sf_dir):
    return lineage.parents(_runs(spark, sf_dir), {"data": 4, "recipe": 2}, "lane")


@register("parent_inference", f"WITH {_PARENTS} SELECT parent, child, CAST(score AS DOUBLE) AS score FROM e")
def parent_inference(spark, sf_dir):
    return _edges(spark, sf_dir)


@register("edge_semi_join", f"WITH {_PARENTS} SELECT parent, child FROM e WHERE parent % 3 <> 0 AND child % 3 <> 0")
def edge_semi_join(spark, sf_dir):
    return lineage.edges_within(_edges(spark, sf_dir), _runs(spark, sf_dir).where("id % 3 <> 0").select("id")).select("parent", "child")


@register(
    "variable_changes",
    f"""WITH {_PARENTS}, c AS (SELECT id AS run, 'data' AS key, CAST(data AS VARCHAR) AS value FROM r UNION ALL SELECT id, 'recipe', CAST(recipe AS VARCHAR) FROM r WHERE id % 2 = 0)
SELECT e.parent AS parent, e.child AS child, b.key AS key, a.value AS before, b.value AS after, b.key || ': ' || coalesce(a.value, 'default') || ' -> ' || b.value AS label
FROM e JOIN c b ON b.run = e.child LEFT JOIN c a ON a.run = e.parent AND a.key = b.key WHERE b.value <> '0' AND b.value IS DISTINCT FROM a.value""",
)
def variable_changes(spark, sf_dir):
    r = _runs(spark, sf_dir)
    one = r.select(F.col("id").alias("run"), F.lit("data").alias("key"), F.col("data").cast("string").alias("value"))
    two = r.where("id % 2 = 0").select(F.col("id").alias("run"), F.lit("recipe").alias("key"), F.col("recipe").cast("string").alias("value"))
    return lineage.changes(_edges(spark, sf_dir).select("parent", "child"), one.unionByName(two))


_CONF = """c AS (SELECT l_suppkey AS run, 'flag' AS key, max(l_returnflag) AS value FROM lineitem GROUP BY l_suppkey UNION ALL SELECT l_suppkey, 'status', min(l_linestatus) FROM lineitem GROUP BY l_suppkey
  UNION ALL SELECT l_suppkey, 'qty', CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY l_suppkey)"""


def _configs(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(
        F.max("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.max("l_quantity").cast("bigint").cast("string").alias("qty")
    )
    long = g.selectExpr("run", "stack(3, 'flag', flag, 'status', status, 'qty', qty) as (key, value)")
    return long.where("key <> 'qty' or run % 2 = 0")


@register("config_differences", f"WITH {_CONF} SELECT key, count(DISTINCT value) AS values, count(*) AS runs, array_to_string(list_sort(list(DISTINCT value)), ',') AS seen FROM c GROUP BY key HAVING count(DISTINCT value) > 1")
def config_differences(spark, sf_dir):
    return lineage.config_differences(_configs(spark, sf_dir)).withColumn("seen", F.array_join("seen", ","))


@register("run_tags", f"WITH {_CONF} SELECT s_suppkey AS id, value AS tags FROM supplier LEFT JOIN (SELECT * FROM c WHERE key = 'qty') q ON s_suppkey = run")
def run_tags(spark, sf_dir):
    return lineage.with_tags(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), _configs(spark, sf_dir), "qty")


@register(
    "keyword_evidence",
    """WITH w AS (SELECT DISTINCT item_id % 5 AS topic, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_.\\-]+')) AS keyword FROM benchmark),
k AS (SELECT topic, keyword FROM w WHERE length(keyword) >= 6), t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_.\\-]+')) AS keyword FROM documents),
h AS (SELECT topic, doc_id, count(DISTINCT t.keyword) AS hits FROM t JOIN k ON t.keyword = k.keyword GROUP BY topic, doc_id HAVING count(DISTINCT t.keyword) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY hits DESC, doc_id) AS rank FROM h) SELECT topic, doc_id, hits, CAST(rank AS INT) AS rank FROM r WHERE rank <= 12""",
)
def keyword_evidence(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    words = items.select((F.col("item_id") % 5).alias("topic"), F.explode(scalars.keywords(F.col("text"), least=6)).alias("keyword")).distinct()
    return lineage.keyword_hits(table(spark, sf_dir, "documents"), words, 2, 12)


@register(
    "timeline_order",
    f"""WITH {_NAMES}, s AS (SELECT id, name, CASE WHEN id % 6 <> 0 THEN name END AS started_at FROM n)
SELECT id, row_number() OVER (ORDER BY coalesce(regexp_extract(started_at, '([0-9]{{8}}_[0-9]{{6}})$', 1), '9999-12-31T23:59:59'), name, id) AS place FROM s""",
)
def timeline_order(spark, sf_dir):
    n = _names(spark, sf_dir)
    started = F.when(F.col("id") % 6 != 0, F.regexp_extract("name", r"(\d{8}_\d{6})$", 1))
    return lineage.timeline(n.withColumn("started_at", started)).select("id", "place")


@register("stage_report", f"WITH {_PARSED}, s AS (SELECT name, {_STAGE} AS stage FROM v) SELECT stage, count(*) AS runs, min(name) AS first_name FROM s GROUP BY stage")
def stage_report(spark, sf_dir):
    n = lineage.parse_names(_names(spark, sf_dir))
    rule = lineage.stage(F.col("name"), F.col("model_size"), F.col("data_recipe"))
    return n.groupBy(rule.alias("stage")).agg(F.count(F.lit(1)).alias("runs"), F.min("name").alias("first_name"))


_NEST = "t AS (SELECT user_id AS batch, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id FROM events), k AS (SELECT batch, id, count(*) AS n, row_number() OVER (PARTITION BY batch ORDER BY count(*) DESC, id) AS r FROM t GROUP BY batch, id)"


def _nested(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.get_json_object("props", "$.k").cast("bigint").alias("id"))
    return lineage.top_values(e, "batch", "id", 3).withColumn("field", F.concat(F.lit("f"), (F.col("batch") % 4).cast("string")))


@register("batch_topk", f"WITH {_NEST}, u AS (SELECT batch, count(*) AS unique_count FROM k GROUP BY batch) SELECT u.batch AS batch, unique_count, id, n AS \"count\" FROM u JOIN k ON u.batch = k.batch WHERE r <= 3")
def batch_topk(spark, sf_dir):
    return _nested(spark, sf_dir).select("batch", "unique_count", F.explode("top").alias("t")).select("batch", "unique_count", "t.id", "t.count")


@register("batch_metadata_histogram", f"WITH {_NEST} SELECT 'f' || CAST(batch % 4 AS VARCHAR) AS field, id, CAST(sum(n) AS BIGINT) AS n FROM k WHERE r <= 3 GROUP BY batch % 4, id")
def batch_metadata_histogram(spark, sf_dir):
    return lineage.histogram(_nested(spark, sf_dir))


@register(
    "histogram_truncation",
    f"""WITH {_NEST}, u AS (SELECT batch, count(*) AS q FROM k GROUP BY batch)
SELECT 'f' || CAST(batch % 4 AS VARCHAR) AS field, count(*) AS rows, max(q) AS max_unique, count(CASE WHEN q > 3 THEN 1 END) AS truncated, max(greatest(q - 3, 0)) AS max_omitted FROM u GROUP BY batch % 4""",
)
def histogram_truncation(spark, sf_dir):
    return lineage.truncation(_nested(spark, sf_dir))


@register(
    "latest_notes",
    """WITH r AS (SELECT o_custkey AS run, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) SELECT run, id, CAST(place AS INT) AS place FROM r WHERE place <= 3""",
)
def latest_notes(spark, sf_dir):
    notes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    return lineage.latest_notes(notes).select("run", "id", "place")


@register(
    "notes_order",
    """WITH k AS (SELECT o_orderkey AS id, o_custkey AS run, CASE o_orderstatus WHEN 'O' THEN 'auto-context' WHEN 'F' THEN 'local' ELSE 'x' END AS author, o_orderdate AS day FROM orders)
SELECT run, id, CAST(row_number() OVER (PARTITION BY run ORDER BY CASE author WHEN 'auto-context' THEN 2 WHEN 'local' THEN 0 ELSE 1 END, day, id) AS INT) AS place FROM k""",
)
def notes_order(spark, sf_dir):
    author = F.when(F.col("o_orderstatus") == "O", "auto-context").when(F.col("o_orderstatus") == "F", "local").otherwise("x")
    w = Window.partitionBy("o_custkey").orderBy(lineage.note_order(author), "o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("id"), F.row_number().over(w).alias("place"))


@register(
    "text_shortening",
    """WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, md5(CASE WHEN length(flat) > 220 THEN rtrim(substr(flat, 1, 217)) || '...' ELSE flat END) AS short_md5, md5(substr(text, 1, 8000)) AS snippet_md5, length(text) > 8000 AS truncated FROM t""",
)
def text_shortening(spark, sf_dir):
    s = scalars.snippet(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(scalars.shorten(F.col("text"))).alias("short_md5"), F.md5(s["text"]).alias("snippet_md5"), s["truncated"].alias("truncated"))


@register(
    "markdown_fields",
    """SELECT page_id, 'Run ' || CAST(page_id AS VARCHAR) AS title, 'See ' || url || ' and bold' AS plain, url || ' x' AS first_line FROM pages""",
)
def markdown_fields(spark, sf_dir):
    md = F.concat(F.lit("\n## Run "), F.col("page_id").cast("string"), F.lit("\n\n"), F.col("url"), F.lit(" x\n\nmore\n"))
    rich = F.concat(F.lit("> See [ "), F.col("url"), F.lit(" ](http://x)  and\n**bold** "))
    plain = F.replace(scalars.plain_markdown(rich), F.lit("See  "), F.lit("See "))
    return table(spark, sf_dir, "pages").select("page_id", scalars.heading(md).alias("title"), plain.alias("plain"), scalars.first_plain_line(md).alias("first_line"))


@register(
    "redacted_arguments",
    """SELECT c_custkey, 'EPOCHS=' || CAST(c_custkey AS VARCHAR) || ' API_TOKEN=<redacted> --lr 1' AS command, CAST(c_custkey AS VARCHAR) AS epochs FROM customer""",
)
def redacted_arguments(spark, sf_dir):
    raw = F.concat(F.lit("EPOCHS="), F.col("c_custkey").cast("string"), F.lit(" API_TOKEN=abc"), F.col("c_custkey").cast("string"), F.lit(" --lr 1"))
    pairs = F.filter(F.split(raw, " "), lambda x: x.rlike("^[A-Z_][A-Z0-9_]*="))
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_replace(x, "^[^=]*=", "")))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.redact(raw).alias("command"), F.try_element_at(F.map_from_entries(entries), F.lit("EPOCHS")).alias("epochs"))


@register(
    "size_texts",
    """WITH s AS (SELECT page_id, page_id * page_id * 977 AS b FROM pages)
SELECT page_id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN printf('%.2f KiB', b / 1024.0) ELSE printf('%.2f MiB', b / 1048576.0) END AS shown, page_id * 1024 AS kib, CAST(page_id * 1572864 AS BIGINT) AS mib FROM s""",
)
def size_texts(spark, sf_dir):
    b = F.col("page_id") * F.col("page_id") * 977
    k = scalars.size_bytes(F.concat(F.col("page_id").cast("string"), F.lit(" KB")))
    m = scalars.size_bytes(F.concat((F.col("page_id") * 1.5).cast("decimal(20,1)").cast("string"), F.lit("MiB")))
    return table(spark, sf_dir, "pages").select("page_id", scalars.readable_bytes(b, "MiB").alias("shown"), k.alias("kib"), m.alias("mib"))


@register(
    "label_normalisation",
    """SELECT c_custkey, lower(replace(trim('  ' || c_name || ' x '), ' ', '_')) AS name, CASE c_custkey % 3 WHEN 0 THEN 'homo_sapiens' WHEN 1 THEN 'mus_musculus' ELSE 'other_kind' END AS species,
  CASE c_custkey % 2 WHEN 0 THEN 'normal' ELSE 'flu' END AS disease, CASE c_custkey % 2 WHEN 0 THEN '10x gene expression flex' ELSE 'unknown' END AS assay FROM customer""",
)
def label_normalisation(spark, sf_dir):
    k = F.col("c_custkey")
    species = F.when(k % 3 == 0, "Human ").when(k % 3 == 1, "mouse").otherwise("Other Kind")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", scalars.lower_underscore(F.concat(F.lit("  "), F.col("c_name"), F.lit(" x "))).alias("name"), scalars.latin_species(species).alias("species"),
        scalars.disease_label(F.when(k % 2 == 0, " Health").otherwise("Flu")).alias("disease"), scalars.assay_name(F.when(k % 2 == 0, "flex").otherwise("zz")).alias("assay"),
    )


@register(
    "shared_references",
    """WITH t AS (SELECT doc_id % 50 AS g, source, min(doc_id) AS k FROM documents GROUP BY doc_id % 50, source), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS i FROM t)
SELECT g, string_agg(source, ',' ORDER BY i) AS refs FROM r WHERE i <= 12 AND source <> 'src0' GROUP BY g""",
)
def shared_references(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 50).alias("g"), "source").agg(F.min("doc_id").alias("k"))
    refs = F.transform(F.array_sort(F.collect_list(F.struct("k", "source"))), lambda s: s["source"])
    out = d.groupBy("g").agg(F.array_except(F.slice(F.array_distinct(refs), 1, 12), F.array(F.lit("src0"))).alias("refs"))
    return out.where(F.size("refs") > 0).select("g", F.array_join("refs", ",").alias("refs"))


@register(
    "change_confidence",
    f"WITH {_PARENTS} SELECT child, CASE WHEN score >= 4 AND child % 2 = 0 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM e",
)
def change_confidence(spark, sf_dir):
    return _edges(spark, sf_dir).select("child", scalars.confidence(F.col("score") / 2, F.col("child") % 2 == 0).alias("confidence"))


@register(
    "config_values",
    """WITH v AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'true' WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN CAST(c_custkey AS VARCHAR) || '.5' WHEN 4 THEN '[1]' WHEN 5 THEN '{"a": 1}' ELSE 'text' END AS value FROM customer)
SELECT id, value, CASE id % 7 WHEN 0 THEN 'null' WHEN 1 THEN 'bool' WHEN 2 THEN 'int' WHEN 3 THEN 'float' WHEN 4 THEN 'list' WHEN 5 THEN 'dict' ELSE 'str' END AS value_type FROM v""",
)
def config_values(spark, sf_dir):
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    value = F.when(k % 7 == 1, "true").when(k % 7 == 2, text).when(k % 7 == 3, F.concat(text, F.lit(".5"))).when(k % 7 == 4, "[1]").when(k % 7 == 5, '{"a": 1}').when(k % 7 == 6, "text")
    return lineage.typed_values(table(spark, sf_dir, "customer").select(k.alias("id"), value.alias("value")))


@register(
    "parent_rows",
    """WITH e AS (SELECT o_custkey AS child, o_orderkey % 100 AS parent, o_orderdate AS day FROM orders), l AS (SELECT child, parent FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY day DESC, parent) AS k FROM e) WHERE k = 1)
SELECT c.c_custkey AS id, c.c_name AS name, l.parent AS parent, p.c_name AS parent_name FROM customer c LEFT JOIN l ON l.child = c.c_custkey LEFT JOIN customer p ON p.c_custkey = l.parent""",
)
def parent_rows(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("child"), (F.col("o_orderkey") % 100).alias("parent"), F.col("o_orderdate").alias("updated_at"))
    return lineage.parent_rows(runs, edges)


@register(
    "change_evidence",
    """WITH c AS (SELECT l_orderkey AS parent, l_orderkey + 1 AS child, l_linenumber AS key, 'item ' || CAST(l_partkey AS VARCHAR) AS label FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY key, label) AS i, count(*) OVER (PARTITION BY parent) AS n FROM c)
SELECT parent, child, string_agg(label, ',' ORDER BY i) FILTER (WHERE i <= 6) AS evidence,
  string_agg(label, ' | ' ORDER BY i) FILTER (WHERE i <= 4) || CASE WHEN max(n) > 4 THEN ' | +' || CAST(max(n) - 4 AS VARCHAR) || ' more' ELSE '' END AS summary FROM r GROUP BY parent, child""",
)
def change_evidence(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), (F.col("l_orderkey") + 1).alias("child"), F.col("l_linenumber").alias("key"),
                                                F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("label"))
    return lineage.evidence(c).withColumn("evidence", F.array_join("evidence", ","))


@register(
    "presence_masks",
    """SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END + 4 AS BIGINT) AS present FROM events""",
)
def presence_masks(spark, sf_dir):
    from ..plans.catalog import presence_mask

    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, 1).alias("a"), F.when(F.col("event_id") % 3 == 0, 1).alias("b"), F.lit("x").alias("c"))
    return presence_mask(e, ["a", "b", "c"]).select("event_id", "present")


@register(
    "weighted_parents",
    f"""WITH {_PARSED}, w AS (SELECT id, name, size, recipe, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'lr5em4,resume' ELSE 'clip0p5' END AS tags,
  CASE WHEN size = '500m' OR name LIKE '%clip0p5%' THEN 'a' WHEN name LIKE '%lr%' THEN 'b' WHEN size = '1b' THEN 'c' ELSE 'd' END AS lane FROM v),
p AS (SELECT b.id AS parent, a.id AS child, round(0.01 * b.id + CASE WHEN a.lane = b.lane THEN 5 ELSE 0 END + CASE WHEN a.size = b.size THEN 4 ELSE 0 END + CASE WHEN a.recipe = b.recipe THEN 4 ELSE 0 END + 2
  + CASE WHEN a.id % 4 = 1 AND b.id % 4 = 1 THEN 2 + 2.4 WHEN a.tags = 'clip0p5' AND b.tags = 'clip0p5' THEN 1.2 ELSE 0 END, 6) AS score FROM w a JOIN w b ON b.id < a.id)
SELECT parent, child, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY score DESC, parent) AS k FROM p) WHERE k = 1""",
)
def weighted_parents(spark, sf_dir):
    runs = lineage.variables(lineage.parse_names(_names(spark, sf_dir))).withColumn("ord", F.col("id"))
    keep = runs.select("id", "ord", "tags", *lineage.PARENT_WEIGHTS)
    return lineage.parents(keep, lineage.PARENT_WEIGHTS, tags="tags", later=lineage.LATER_WEIGHT)
