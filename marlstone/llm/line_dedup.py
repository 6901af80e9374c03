"""Removal of lines that repeat across sites.

A line's spread is the number of distinct sites that show it. Per line hash a
HyperLogLog sketch of the sites is aggregated (partial sketches merge on the map
side, so a line that a third of all rows holds costs one sketch per task). Lines
whose estimate lies near the threshold get an exact distinct count; only the
estimates far from it decide by themselves. A line of ``min_sites`` sites or
more is boilerplate (:func:`spread`). Beside it stands a rule of its own: a line
of more than ``long_words`` words is a repeated passage as soon as two documents
hold it (:func:`passages`). The first occurrence of each (smallest ``doc_id``,
then place) stays, so that no text leaves the corpus. With ``runs``, consecutive lines that together hold more than ``long_words`` words
and stand in two documents are a passage too: from each line on, and back from
each, the shortest run of so many words is hashed, and such runs cover every
longer one. Blank lines inside a run don't count. A line goes only where an
earlier place has the same one, so each line's first place stays.

Defined cases: a null text stays null and has no lines; blank lines stay; a null
site counts as a site of its own; a null ``doc_id`` sorts first; rows repeated
as a whole are one document and fare alike; an empty table gives an empty one;
columns of other names pass through.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reach_workers
from .common import join_hot, materialise, row_key, unused

MIN_SITES = 8
LONG_WORDS = 50
#: Relative distance from the threshold within which sites are counted exactly.
NEAR = 0.35
LG_K = 12


def _site() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))


def lines(docs: DataFrame) -> DataFrame:
    """``doc_key, doc_id, pos, line (struct of two hashes), words, site`` of each
    line that isn't blank; no text is kept."""
    each = docs.select(
        row_key("doc_id", "text").alias("doc_key"),
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id"),
        _site().alias("site"),
        F.posexplode(F.split("text", "\n")).alias("pos", "text"),
    ).where(F.trim("text") != "")
    return each.select(
        "doc_key",
        "doc_id",
        "pos",
        F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b")).alias("line"),
        F.regexp_count("text", F.lit(r"[^ ]+")).alias("words"),
        "site",
    )


def line_table(found: DataFrame) -> DataFrame:
    """Per line that occurs more than once: ``line, n, sites`` (estimate)``, words,
    low, high`` (row keys)``, first`` (struct ``doc_id, doc_key, pos``)."""
    return (
        found.groupBy("line")
        .agg(
            F.hll_sketch_agg("site", LG_K).alias("sketch"),
            F.count(F.lit(1)).alias("n"),
            F.max("words").alias("words"),
            F.min(F.struct("doc_id", "doc_key", "pos")).alias("first"),
            F.max("doc_key").alias("high"),
            F.min("doc_key").alias("low"),
        )
        .where("n > 1")
        .withColumn("sites", F.hll_sketch_estimate("sketch"))
        .drop("sketch")
    )


def spread(found: DataFrame, counted: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on ``min_sites`` sites or more: ``line, n, first`` (the occurrence
    that stays)."""
    sites, out = F.col("sites"), ["line", "n", "first"]
    sure = counted.where(sites > min_sites * (1 + NEAR)).select(*out)
    near = counted.where(sites.between(min_sites * (1 - NEAR), min_sites * (1 + NEAR)))
    exact = (
        join_hot(found.select("line", "site"), near.select("line", "n"), "line")
        .groupBy("line", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("line")
        .agg(F.count(F.lit(1)).alias("exact"))
        .where(F.col("exact") >= min_sites)
    )
    return sure.union(near.join(exact, "line").select(*out))


def passages(counted: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """Lines of more than ``long_words`` words in two documents or more, as
    :func:`spread` gives them. A rule of its own, beside the spread over sites."""
    return counted.where((F.col("words") > long_words) & (F.col("low") < F.col("high"))).select("line", "n", "first")


def shortest_runs(text: str | None, long_words: int = LONG_WORDS) -> list[tuple[int, list[int]]]:
    """``(hash, places)`` of the shortest runs of two lines or more that hold more
    than ``long_words`` words, from each line on and back from each."""
    real = [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip(" ")]
    words = [sum(map(bool, x.split(" "))) for _, x in real]
    spans, start, held = set(), 0, 0
    for end, n in enumerate(words):
        held += n
        while held - words[start] > long_words:
            held -= words[start]
            start += 1
        if held > long_words:
            spans.add((start, end))
    end, held = 0, 0
    for start, n in enumerate(words):
        while end < len(words) and held <= long_words:
            held += words[end]
            end += 1
        if held > long_words:
            spans.add((start, end - 1))
        held -= n
    return [
        (xxhash.xxh3_64_intdigest("\n".join(x for _, x in real[s : e + 1]).encode("utf-8", "surrogatepass")), [i for i, _ in real[s : e + 1]])
        for s, e in sorted(spans)
        if s < e
    ]


def repeated_runs(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """``doc_key, pos`` of the lines in runs that an earlier place has too."""

    def run(batches):
        for batch in batches:
            rows = [(k, i, h - 2**63, at) for k, i, t in zip(*(c.to_pylist() for c in batch.columns)) for h, at in shortest_runs(t, long_words)]
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_key", "doc_id", "run", "at"])

    reach_workers(docs.sparkSession)
    rows = docs.select(row_key("doc_id", "text").alias("doc_key"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id"), "text")
    found = materialise(rows.mapInArrow(run, "doc_key bigint, doc_id bigint, run bigint, at array<int>"))
    place = F.struct("doc_id", "doc_key", F.col("at")[0].alias("pos"))
    gone = materialise(
        found.groupBy("run")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.min("doc_key").alias("low"), F.max("doc_key").alias("high"))
        .where("low < high")
        .select("run", "n", "first")
    )
    later = join_hot(found, gone, "run").where((F.col("doc_key") != F.col("first.doc_key")) | (F.col("at")[0] != F.col("first.pos")))
    return later.select("doc_key", F.explode("at").alias("pos"))


def removals(docs: DataFrame, min_sites: int = MIN_SITES, long_words: int = LONG_WORDS, runs: bool = False) -> DataFrame:
    """``doc_key, gone`` (places of lines to remove), for documents with any."""
    found = materialise(lines(docs))
    counted = materialise(line_table(found))
    gone = materialise(spread(found, counted, min_sites).union(passages(counted, long_words)).distinct())
    places = (
        join_hot(found.select("doc_key", "pos", "line"), gone, "line")
        .where((F.col("doc_key") != F.col("first.doc_key")) | (F.col("pos") != F.col("first.pos")))
        .select("doc_key", "pos")
    )
    if runs:
        places = places.union(repeated_runs(docs, long_words))
    return places.groupBy("doc_key").agg(F.collect_set("pos").alias("gone"))


def _without(parts: Column, gone: Column) -> Column:
    """``parts`` less the places in ``gone``, in time linear in both: what lies
    between neighbouring places is sliced out of the lines split once."""
    lo, hi = F.concat(F.array(F.lit(-1)), F.array_sort(gone)), F.concat(F.array_sort(gone), F.array(F.size(parts)))
    return F.get(F.transform(F.array(parts), lambda p: F.flatten(F.zip_with(lo, hi, lambda a, b: F.slice(p, a + 2, b - a - 1)))), F.lit(0))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, long_words: int = LONG_WORDS, runs: bool = False, added: tuple[str, str] = ("n_lines__", "n_removed__")) -> DataFrame:
    """``docs`` with those lines removed from ``text``, and two columns ``added``:
    how many lines a text had and how many of them went. Names that the input has
    raise. All rows and all other columns stay."""
    if clash := [c for c in added if c in docs.columns]:
        raise ValueError(f"the input has {', '.join(clash)}")
    key, gone = unused(docs, "doc_key"), unused(docs, "gone")
    # texts are shuffled at every size; a broadcast of the places has no bound
    places = materialise(removals(docs, min_sites, long_words, runs)).toDF(key, gone).hint("merge")
    parts = F.split("text", "\n")
    count = F.when(F.col("text").isNotNull(), F.size(parts)).otherwise(0).cast("long")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(_without(parts, F.col(gone)), "\n"))
    joined = docs.withColumn(key, row_key("doc_id", "text")).join(places, key, "left")
    removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], count.alias(added[0]), removed.alias(added[1]))
