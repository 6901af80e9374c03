"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, matroska, packing, pii, ppm, secrets, simhash, token_counts, toxicity
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("score__").alias("score"),
        (F.col("score__") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    place = F.transform("findings", lambda x: F.concat_ws(":", x["start"], x["end"]))
    return found.select(
        "doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), F.array_join(place, ",").alias("spans")
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).drop("doc_key")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("n_lines__").alias("n_lines"),
        F.col("n_removed__").alias("n_removed"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.stored(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spans AS (SELECT DISTINCT least(len(w), 13) AS span FROM iw WHERE len(w) > 0),
item_windows AS (
  SELECT item_id, span, array_to_string(w[s : s + span - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS span, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM iw WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, span, s, array_to_string(w[s : s + span - 1], ' ') AS win
  FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM dw, spans WHERE len(w) >= span)),
m AS (
  SELECT DISTINCT doc_id, item_id, s, d.span AS span
  FROM doc_windows d JOIN item_windows i ON d.win = i.win AND d.span = i.span),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + span)) AS p FROM m) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN named ON dw.doc_id = named.doc_id
"""

OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, source, p, string_split(text, chr(10))[p] AS line
  FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents)),
real AS (SELECT * FROM l WHERE trim(line, ' ') <> ''),
gone AS (
  SELECT line, min(doc_id) AS keep_doc
  FROM real GROUP BY line
  HAVING count(DISTINCT coalesce('s' || source, '')) >= 8
      OR (len(regexp_extract_all(line, '[^ ]+')) > 50 AND count(DISTINCT doc_id) > 1)),
first_at AS (
  SELECT g.line AS line, g.keep_doc AS keep_doc, min(r.p) AS keep_p
  FROM gone g JOIN real r ON r.line = g.line AND r.doc_id = g.keep_doc GROUP BY g.line, g.keep_doc),
marked AS (
  SELECT l.doc_id AS doc_id, l.p AS p, l.line AS line,
         f.line IS NOT NULL AND NOT (l.doc_id = f.keep_doc AND l.p = f.keep_p) AS drop_it
  FROM l LEFT JOIN first_at f ON l.line = f.line)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum(CASE WHEN drop_it THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT drop_it), '')) AS text_md5
FROM marked GROUP BY doc_id
"""


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_toxicity": op2_toxicity,
        "op3_simhash": op3_simhash,
        "op4_secrets": op4_secrets,
        "op5_decontaminate": op5_decontaminate,
        "op6_token_counts": op6_token_counts,
        "op7_ppm": op7_ppm,
        "op8_line_dedup": op8_line_dedup,
        "op9_pii": op9_pii,
        "op10_matroska": op10_matroska,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": OP5_SQL, "op8_line_dedup": OP8_SQL}
