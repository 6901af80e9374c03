"""Near copies by word shingles, the SimHash operator at Jaccard similarity 0.8.

Links come from the deletion-variant signatures of :mod:`simhash` over the distinct
five-word shingles, each verified on the whole sets. Two texts of similarity 0.8
differ in about ten of 64 bits, too many for those signatures, so that most links
are found by another method, which completes the first: each distinct shingle set
has ``BANDS`` band keys of ``ROWS`` minhashes; sets that share a key are candidates
and every candidate pair is verified. At similarity 0.8 a pair shares no key with
probability 5e-8. Equal sets take part once. Buckets up to ``BUCKET`` are paired by
a join. Larger ones are dealt into chunks; a task compares all sets of a chunk by
one product of matrices and gives a link for each set at most. Then components are
found over all buckets. Where a bucket of several chunks still holds more than one
component, the members outside its largest one are compared with all its members,
chunk by chunk; the others are linked already. So each bucket ends either in one
component or with all its pairs between components verified, and the rows of a
large group of copies stay linear in its size.

Defined cases: null, empty and blank texts have no words and are copies of each
other; texts of fewer words than a shingle are one shingle; rows with a null
``doc_id`` stay and stand for no other; of rows with equal id and text one stays;
an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reach_workers
from . import simhash
from .common import LOWER, UPPER, dealt, join_hot, materialise, row_key
from .components import components

SIZE = 5
SIMILAR = 0.8
BANDS = 32
ROWS = 4
BUCKET = 32
#: Sets and shingles that one task compares at once, and columns of a matrix.
CHUNK, SHINGLES, COLUMNS = 256, 1 << 21, 4096
#: Bits in which the signatures' candidates may differ.
BITS = 3
SEED = 42
#: Over rounding in products with the similarity.
EPS = 1e-9
#: Shingles whose minhashes are computed at once, a bound on memory.
BLOCK = 1 << 12
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_RND = np.random.default_rng(SEED)
_FLIP, _TIMES = (_RND.integers(0, 2**64, BANDS * ROWS, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
#: Odd factors that join the minhashes of a band, other ones for each band.
_JOIN = _RND.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Hashes of the text's distinct shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    parts = zip(*(words[i:] for i in range(size))) if len(words) > size else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in parts), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, ((found[at : at + BLOCK, None] ^ _FLIP) * _TIMES).min(0))
    return (least.reshape(BANDS, ROWS) * _JOIN).sum(1, dtype=np.uint64).view(np.int64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def prints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, doc_key, id`` (of the shingle set)``, n`` (shingles)``, bands, fp``."""

    def run(batches):
        for batch in batches:
            ids, sizes, keys, fps = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, size)
                ids.append(xxhash.xxh3_64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                keys.append(bands(found) if len(found) else [])
                fps.append(simhash.majority(found))
            columns = [pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            columns.append(pa.array(np.array(fps, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "doc_key", "id", "n", "bands", "fp"])

    reach_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("doc_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, doc_key bigint, id bigint, n bigint, bands array<bigint>, fp bigint")


def _sets(docs: DataFrame, first: DataFrame, size: int) -> DataFrame:
    """``id, set`` of the sets in ``first`` (``id, doc_key`` of one row that has it)."""

    def run(batches):
        for batch in batches:
            found = [shingles(x, size).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "set"])

    texts = docs.select(row_key("doc_id", "text").alias("doc_key"), "text").join(first, "doc_key").dropDuplicates(["id"])
    return texts.select("id", "text").mapInArrow(run, "id bigint, set array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs ``u, v`` whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            sides = []
            for k in (2, 3):
                column = batch.column(k)
                flat, cut = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
                sides.append([flat[i:j] for i, j in zip(cut, cut[1:])])
            fits = []
            for a, b in zip(*sides):
                n = shared(a, b)
                fits.append(n + EPS >= similar * (len(a) + len(b) - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(fits, pa.bool_()))

    a, b = sets.toDF("u", "su"), sets.toDF("v", "sv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "su", "sv").mapInArrow(run, "u bigint, v bigint")


def _placed(rest: DataFrame, edges: DataFrame) -> DataFrame:
    """``band, id, n, comp``: members of buckets with their component so far."""
    known = components(edges)
    joined = rest.select("band", "id", "n").join(known, F.col("id") == F.col("node"), "left")
    return materialise(joined.select("band", "id", "n", F.coalesce("component", "id").alias("comp")))


def overlaps(flat: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements the sets ``left`` share with the sets ``right``, each with
    others than itself; ``owner`` says whose each element is. Products of zeros and ones, columns in blocks."""
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    many = n[at] > 1
    _, at = np.unique(at[many], return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, whose = at[order], owner[many][order]
    out = np.zeros((len(left), len(right)), np.float32)
    sets = int(owner.max()) + 1 if len(owner) else 0
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        i, j = np.searchsorted(at, [first, first + COLUMNS])
        block = np.zeros((sets, COLUMNS), np.float32)
        block[whose[i:j], at[i:j] - first] = 1
        out += block[left] @ block[right].T
    return out


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements, their rows and the sizes of the column ``set``."""
    column = rows.column("set").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    return column.values.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes), sizes


def _similar(both: np.ndarray, a: np.ndarray, b: np.ndarray, similar: float) -> np.ndarray:
    return both + EPS >= similar * (a[:, None] + b[None, :] - both)


_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _joined(similar: float):
    """Each set of a chunk with the first one of its component there."""

    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        flat, owner, sizes = _flat(rows)
        every = np.arange(len(ids))
        near = _similar(overlaps(flat, owner, every, every), sizes, sizes, similar) | np.eye(len(ids), dtype=bool)
        label = every
        while True:
            least = np.where(near, label[None, :], len(ids)).min(1)
            if (least == label).all():
                break
            label = least
        far = label != every
        return pa.table([ids[far], ids[label[far]]], schema=_PAIR)

    return run


def _compared(similar: float):
    """Members outside a bucket's largest component with those of one chunk."""

    def run(rows: pa.Table) -> pa.Table:
        ids, comps, minor = rows.column("id").to_numpy(), rows.column("comp").to_numpy(), rows.column("minor").to_numpy(zero_copy_only=False)
        flat, owner, sizes = _flat(rows)
        left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
        near = _similar(overlaps(flat, owner, left, right), sizes[left], sizes[right], similar)
        u, v = [], []
        for k, i in enumerate(left):
            # one link to each component that is near
            _, first = np.unique(comps[right[near[k]]], return_index=True)
            v += ids[right[near[k]][first]].tolist()
            u += [ids[i]] * len(first)
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_PAIR)

    return run


def links(docs: DataFrame, first: DataFrame, size: int = SIZE, similar: float = SIMILAR, bucket: int = BUCKET, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """``first(id, doc_key, n, bands, fp)``, ids distinct -> pairs ``u, v`` whose
    components are those of all similar pairs."""

    def fits(x, y):
        return F.least(x, y) + EPS >= similar * F.greatest(x, y)

    index = first.select("id", "n", F.explode("bands").alias("band"))
    often = index.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rest = materialise(join_hot(index, often, "band", "c"))
    # by signature: equal fingerprints through the smallest id, then the links between fingerprints
    worded = first.where("n > 0").select("id", "n", "fp")
    least = materialise(worded.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("rep")).select("fp", "rep.id", "rep.n"))
    same = worded.join(least.select("fp", F.col("id").alias("v"), F.col("n").alias("m")), "fp").where((F.col("id") != F.col("v")) & fits(F.col("n"), F.col("m")))
    signed = simhash.links(least.select("fp", F.col("id").alias("rep")), bits).union(same.select(F.col("id").alias("u"), "v"))
    signed = materialise(signed.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    wanted = rest.select("id").union(signed.select("u")).union(signed.select("v")).distinct()
    sets = materialise(_sets(docs, first.select("id", "doc_key").join(wanted, "id"), size))
    edges = materialise(verified(signed, sets, similar))

    here = materialise(_unsettled(_placed(rest, edges), chunk))
    light, heavy = here.where(F.col("c") <= bucket), here.where(F.col("c") > bucket)
    a, b = light.alias("a"), light.alias("b")
    apart = (F.col("a.id") < F.col("b.id")) & (F.col("a.comp") != F.col("b.comp")) & fits(F.col("a.n"), F.col("b.n"))
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & apart).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    paired = materialise(verified(pairs.distinct(), sets, similar))
    parts = heavy.select("band", F.pmod(F.xxhash64("id", "band"), F.col("chunks")).alias("chunk"), "id")
    chunked = materialise(parts.join(sets, "id").groupBy("band", "chunk").applyInArrow(_joined(similar), "u bigint, v bigint"))
    edges = edges.union(paired).union(chunked)
    split = heavy.where("chunks > 1")
    if split.isEmpty():
        return edges
    left = materialise(_unsettled(_placed(split, edges), chunk))
    most = left.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("band").agg(F.max(F.struct("k", "comp")).alias("m")).select("band", F.col("m.comp").alias("major"))
    sizes = left.groupBy("band").agg(F.count(F.lit(1)).alias("c"))
    left = join_hot(left.drop("c"), most.join(sizes, "band"), "band", "c")
    minors = left.where(F.col("comp") != F.col("major"))
    groups = minors.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.ceil(F.greatest(F.count(F.lit(1)) / (chunk / 2), F.sum("n") / (SHINGLES / 2))).alias("groups"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    minors = join_hot(minors, groups, "band", "c").select("band", F.pmod(F.xxhash64("id"), F.col("groups")).alias("group"), upto("chunks").alias("chunk"), "id", "comp", F.lit(True).alias("minor"))
    members = join_hot(left, groups, "band", "c").select("band", upto("groups").alias("group"), F.pmod(F.xxhash64("id", "band"), F.col("chunks")).alias("chunk"), "id", "comp", F.lit(False).alias("minor"))
    both = minors.unionByName(members).join(dealt(sets), "id")
    return edges.union(materialise(both.groupBy("band", "group", "chunk").applyInArrow(_compared(similar), "u bigint, v bigint")))


def _unsettled(rest: DataFrame, chunk: int) -> DataFrame:
    """``band, id, n, comp, c, chunks`` of the buckets that hold several components;
    a chunk has about ``chunk`` sets and ``SHINGLES`` shingles at most."""
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / chunk, F.sum("n") / SHINGLES))
    groups = rest.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), chunks.alias("chunks")).where("lo < hi")
    return join_hot(rest, groups.select("band", "c", F.col("c").alias("c__"), "chunks"), "band", "c__")


def keep_first(docs: DataFrame, size: int = SIZE, similar: float = SIMILAR, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """One document of each component of near copies: the smallest ``doc_id``,
    then row key. Rows with a null id stay."""
    named = docs.where("doc_id is not null")
    rows = materialise(prints(named, size))
    best = F.min(F.struct("doc_id", "doc_key"))
    first = materialise(
        rows.groupBy("id").agg(best.alias("best"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")).select(
            "id", "best", F.col("best.doc_key").alias("doc_key"), "n", "bands", "fp"
        )
    )
    found = components(materialise(links(named, first.drop("best"), size, similar, bucket, chunk=chunk)))
    stay = (
        first.join(found, first.id == found.node, "left")
        .groupBy(F.coalesce("component", "id").alias("c"))
        .agg(F.min("best").alias("best"))
        .select(F.col("best.doc_id").alias("doc_id__"), F.col("best.doc_key").alias("doc_key__"))
    )
    key = (F.col("doc_id") == F.col("doc_id__")) & (row_key("doc_id", "text") == F.col("doc_key__"))
    kept = named.join(materialise(stay), key, "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
