"""Benchmark decontamination through a positional inverted index.

Only DataFrame functions run here. The index stores, for each term that some
test item needs, its postings ``(document, position)`` over all training
documents. Every test window is located from its rarest terms: their posting
lists are shifted by the term's offset in the item and intersected, so that
only alignments where all rare terms agree are compared word by word.

Defined cases: null and empty texts have no words; an item without words has no
window; repeated rows are judged row by row; rows with a null ``doc_id`` or
``item_id`` keep it (a null ``item_id`` counts as an item and is skipped in the
joined list); an empty benchmark or an empty document table gives no hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, row_key, unused

WINDOW = 13
RARE_TERMS = 2
#: What separates words: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not wherever it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exact_words(text: Column) -> Column:
    """Words with A-Z lower-cased."""
    return _split(ascii_lower(text))


def index_words(text: Column) -> Column:
    """Words under full lower-casing, as the index stores them: no boundary and
    no count differs from :func:`exact_words`, and equal exact words are equal
    here, so that the index never misses an exact match."""
    return _split(F.lower(text))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "doc_key", row_key("doc_id", "text")
    )


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per item that has words: ``item, item_id, words, terms, span``;
    ``span`` is the window length, all words of an item that has fewer."""
    return (
        items.select("item_id", exact_words(F.col("text")).alias("words"), index_words(F.col("text")).alias("terms"))
        .where(F.size("words") > 0)
        .dropDuplicates()
        .withColumn("item", F.xxhash64("item_id", "words"))
        .withColumn("span", F.least(F.size("words"), F.lit(window)))
    )


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Occurrences in the training documents of every term of the items."""
    terms = items.select(F.explode("terms").alias("term")).distinct()
    return (
        docs.select(F.explode(index_words(F.col("text"))).alias("term"))
        .join(terms, "term")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def anchors(items: DataFrame, counts: DataFrame, rare: int = RARE_TERMS) -> DataFrame:
    """The rarest terms of each window: ``term, item, at`` (place in the item)
    and ``need``, how many of them an alignment has to show at least. A window
    with a term that no document has is left out, as it can't occur."""
    placed = items.select("item", "span", F.size("terms").alias("len"), F.posexplode("terms").alias("at", "term"))
    placed = placed.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    windows = placed.withColumn(
        "start",
        F.explode(F.sequence(F.greatest(F.col("at") - F.col("span") + 1, F.lit(0)), F.least(F.col("at"), F.col("len") - F.col("span")))),
    )
    by = Window.partitionBy("item", "start")
    return (
        windows.withColumn("least", F.min("n").over(by))
        .where("least > 0")
        .withColumn("rank", F.row_number().over(by.orderBy("n", "term", "at")))
        .where(F.col("rank") <= rare)
        .select("term", "item", "at", F.least("span", F.lit(rare)).alias("need"))
        .distinct()
    )


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: ``term, doc_key, pos`` for all occurrences of ``terms``."""
    return materialise(
        docs.select("doc_key", F.posexplode(index_words(F.col("text"))).alias("pos", "term"))
        .join(terms.select("term").distinct(), "term")
        .select("term", "doc_key", "pos")
    )


def alignments(index: DataFrame, rare: DataFrame) -> DataFrame:
    """Intersection of the offset-adjusted lists: ``doc_key, item, begin``
    (place of the item's first word; negative if the document starts inside)."""
    return (
        index.join(rare, "term")
        .groupBy("doc_key", "item", (F.col("pos") - F.col("at")).alias("begin"))
        .agg(F.count_distinct("at").alias("found"), F.max("need").alias("need"))
        .where("found >= need")
        .select("doc_key", "item", "begin")
    )


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact occurrences of item windows: ``doc_key, item_id, start, span``
    (word places in the document). ``docs`` as :func:`keyed` gives them."""
    known = materialise(item_windows(items, window))
    rare = materialise(anchors(known, term_counts(docs, known)))
    where = materialise(alignments(postings(docs, rare), rare))
    spots = where.join(known.select("item", F.size("words").alias("len")), "item")
    first = F.greatest("begin", F.lit(0))
    found = (
        docs.join(where.select("doc_key").distinct(), "doc_key", "left_semi")
        .select("doc_key", exact_words(F.col("text")).alias("doc"))
        .join(spots, "doc_key")
        .select("doc_key", "item", "begin", F.slice("doc", first + 1, F.col("len") + F.col("begin") - first).alias("part"))
        .join(known.select("item", "item_id", "words", "span"), "item")
    )
    skipped = F.greatest(-F.col("begin"), F.lit(0))

    def equal(part: Column) -> Column:
        """Element i: the item's i-th word stands at its place in the document."""
        return F.transform("words", lambda w, i: F.coalesce(F.when(i >= skipped, F.get(part, i - skipped)) == w, F.lit(False)))

    def starts(same: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size("words") - F.col("span")),
            lambda o: F.forall(F.slice(same, o + 1, F.col("span")), lambda x: x),
        )

    hit = _let(F.col("part"), lambda part: _let(equal(part), starts))
    return (
        found.select("doc_key", "item_id", "span", "begin", F.explode(hit).alias("o"))
        .select("doc_key", "item_id", (F.col("begin") + F.col("o")).alias("start"), "span")
        .distinct()
    )


def proximity_matches(docs: DataFrame, items: DataFrame, terms: int = 3, within: int = 20) -> DataFrame:
    """Documents where the ``terms`` rarest distinct terms of an item stand
    within ``within`` words: ``doc_key, item_id, least_span``.

    One ordered pass over an item's postings in a document keeps the last place
    of each term; items with fewer distinct terms use all they have; an item
    with a term that no document has can't match.
    """
    known = materialise(item_windows(items))
    counts = term_counts(docs, known)
    by = Window.partitionBy("item")
    rare = (
        known.select("item", "item_id", F.explode(F.array_distinct("terms")).alias("term"))
        .join(counts, "term", "left")
        .withColumn("k", F.row_number().over(by.orderBy(F.coalesce("n", F.lit(0)), "term")))
        .where(F.col("k") <= terms)
        .withColumn("all", F.count(F.lit(1)).over(by))
    )
    rare = materialise(rare)
    seen = postings(docs, rare).join(rare, "term")
    upto = Window.partitionBy("doc_key", "item").orderBy("pos", "k").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("k") == k, F.col("pos")), ignorenulls=True).over(upto) for k in range(1, terms + 1)]
    lasts = F.filter(F.array(*last), lambda x: x.isNotNull())
    return (
        seen.withColumn("lasts", lasts)
        .where(F.size("lasts") == F.col("all"))
        .withColumn("width", F.array_max("lasts") - F.array_min("lasts") + 1)
        .where(F.col("width") <= within)
        .groupBy("doc_key", "item_id")
        .agg(F.min("width").alias("least_span"))
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, doc_key``; a document is contaminated when a twentieth of its
    words or more lies inside occurrences of windows."""
    docs = keyed(docs)
    matches = materialise(phrase_matches(docs, items, window))
    spots = matches.select("doc_key", F.explode(F.sequence("start", F.col("start") + F.col("span") - 1)).alias("at"))
    hits = spots.distinct().groupBy("doc_key").agg(F.count(F.lit(1)).alias("n_hit"))
    names = (
        matches.select("doc_key", "item_id")
        .distinct()
        .groupBy("doc_key")
        .agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids"))
    )
    found = hits.join(names, "doc_key")
    words = F.size(_split(F.col("text"))).cast("long")
    none = F.coalesce("n_hit", F.lit(0).cast("long"))
    return docs.select("doc_id", "doc_key", words.alias("n_words")).join(found, "doc_key", "left").select(
        "doc_id",
        "n_words",
        none.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        ((none > 0) & (20 * none >= F.col("n_words"))).alias("contaminated"),
        "doc_key",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, columns unchanged."""
    bad = contamination(docs, items).where("contaminated").select("doc_key").distinct()
    key = unused(docs, "doc_key")
    return docs.withColumn(key, row_key("doc_id", "text")).join(bad.withColumnRenamed("doc_key", key), key, "left_anti").drop(key)
