"""SimHash near-duplicates by deletion-variant signatures.

The 64-bit fingerprint is cut into ``distance // 2 + 1`` segments, so that of two
fingerprints within ``distance`` bits one segment differs by at most one bit.
Each segment is indexed under all its one-wildcard variants; equal variants are
joined and the pairs verified. Exact copies share one fingerprint and take part
once. Buckets of more than ``bucket`` fingerprints aren't paired at all: inside
them the same idea is applied to the rest of the fingerprint, with keys whose
holders all lie within the distance, so that each is linked to the smallest
one; links stay complete and their number linear.

Defined cases: null, empty and blank texts have no words and fingerprint zero,
linked like any other; texts of fewer words than a shingle are one shingle; a
null ``doc_id`` is carried with its fingerprint's component but names none;
repeated rows are repeated in the result; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reach_workers
from .common import LOWER, UPPER, dealt, materialise, row_key
from .components import components

BITS = 64
SEED = 42
BUCKET = 256
#: Shingles hashed at once, a bound on memory for very long texts.
BLOCK = 1 << 17
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ROWS = (np.arange(8) * 256)[None, :]
#: bit j of byte value v
_BIT = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest bit first."""
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _ROWS).ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BIT).ravel()


def fingerprint(text: str | None, size: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return h(b" ".join(words), SEED)
    total = np.zeros(BITS, np.int64)
    n = len(words) - size + 1
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + size - 1]
        hashes = [h(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(size)))]
        total += _ones(np.array(hashes, "<u8"))
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of these shingle hashes."""
    return int.from_bytes(np.packbits(_ones(hashes) * 2 > len(hashes), bitorder="little").tobytes(), "little") if len(hashes) else 0


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long), one row per document row."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(x, size) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    reach_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _mask(bits) -> int:
    """As a signed long, all bits but these."""
    value = ~sum(1 << b for b in bits) & (2**64 - 1)
    return value - 2**64 if value >= 2**63 else value


def _masks(opened) -> Column:
    """One literal array: for each set of open bits, the mask of all others."""
    return F.lit(np.array([_mask(x) for x in opened], np.int64))


def links(prints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``prints(fp, rep)``, fingerprints distinct -> ``(u, v)`` of linked reps."""
    if distance > 3:
        raise ValueError("heavy buckets are resolved for distances up to 3")
    count = distance // 2 + 1
    width = BITS // count
    segment = [range(s * width, BITS if s == count - 1 else (s + 1) * width) for s in range(count)]
    rest = [[b for b in range(BITS) if b not in segment[s]] for s in range(count)]
    # keep only the segment's bits, less the wildcard
    keys = [[*rest[s], b] for s in range(count) for b in segment[s]]
    index = prints.select("fp", "rep", F.posexplode(_masks(keys)).alias("v", "m")).select(
        "fp", "rep", "v", F.col("fp").bitwiseAND(F.col("m")).alias("sig")
    )
    size = index.groupBy("v", "sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(index.join(dealt(size), ["v", "sig"]))
    light = shared.where(F.col("n") <= bucket)
    a, b = light.alias("a"), light.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    pairs = (
        a.join(b, (F.col("a.v") == F.col("b.v")) & (F.col("a.sig") == F.col("b.sig")) & (F.col("a.rep") < F.col("b.rep")) & near)
        .select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
        .distinct()
    )
    heavy = shared.where(F.col("n") > bucket)
    stars = []
    for s in range(count):
        here = heavy.where(F.col("v").isin(list(segment[s])))
        # wildcard bit open and distance - 1 more bits of the rest open
        outer = list(combinations(rest[s], distance - 1))
        stars.append((here.select("fp", "rep", "v"), outer))
        # the segment equal and distance bits of the rest open
        same = here.select("fp", "rep").distinct().withColumn("v", F.lit(-1))
        stars.append((same, list(combinations(rest[s], distance))))
    for rows, opened in stars:
        wild = F.when(F.col("v") >= 0, F.expr("shiftleft(1L, v)")).otherwise(F.lit(0).cast("long"))
        keyed = rows.select("rep", "v", F.posexplode(_masks(opened)).alias("o", "m"), F.col("fp").bitwiseAND(F.bitwise_not(wild)).alias("f")).select(
            "rep", "v", "o", F.col("f").bitwiseAND(F.col("m")).alias("sig")
        )
        least = keyed.groupBy("v", "o", "sig").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
        pairs = pairs.union(
            keyed.join(dealt(least), ["v", "o", "sig"]).where("rep <> low").select(F.col("low").alias("u"), F.col("rep").alias("v"))
        )
    return pairs.distinct()


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``."""
    prints = materialise(fingerprints(docs, size))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # a fingerprint that only rows without an id have can't be named
    named = distinct.where(F.col("rep").isNotNull())
    found = components(materialise(links(named, distance, bucket)))
    joined = materialise(
        distinct.join(found, distinct.rep == found.node, "left").select(
            "fp", F.coalesce("component", "rep").alias("component_id")
        )
    )
    return prints.join(joined, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """One document of each component: the smallest ``doc_id``, then row key. Rows
    with a null id stay. Of rows with equal id and text one stays."""
    named = docs.where("doc_id is not null")
    row = F.struct("doc_id", row_key("doc_id", "text").alias("doc_key"))
    prints = materialise(fingerprints(named.select(row.alias("doc_id"), "text"), size))
    # components of fingerprints, as an id can stand on several of them
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("row")))
    found = components(materialise(links(distinct.select("fp", F.col("fp").alias("rep")), distance)))
    stay = (
        distinct.join(found, distinct.fp == found.node, "left")
        .groupBy(F.coalesce("component", "fp").alias("c"))
        .agg(F.min("row").alias("row"))
        .select(F.col("row.doc_id").alias("doc_id__"), F.col("row.doc_key").alias("doc_key__"))
    )
    key = (F.col("doc_id") == F.col("doc_id__")) & (row_key("doc_id", "text") == F.col("doc_key__"))
    kept = named.join(materialise(stay), key, "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
