"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most ``length`` tokens. Full pieces are sequences
of their own; the others are dealt into shards of about ``SHARD`` pieces, so
that a task's work is bounded whatever the input. A shard is solved on several
islands: each evolves a population whose crossover injects whole well-filled
bins of one parent into the other, drops the bins that held one of those pieces
before, and best-fits the displaced pieces; then elites migrate to the next
island, the islands evolve again, and the best result counts. Bins that stay
badly filled are dissolved and their pieces packed once more over fewer shards,
until one is left. The first individual is plain best fit; a shard where it
reaches the bound (total tokens over the length, one bin more while badly filled
ones go on to another level) is done at once and nothing evolves.

Defined cases: a null or empty text is one piece, the separator alone; a null
``doc_id`` is carried; repeated rows are packed each; among equal pieces any order
counts as good, and the one chosen depends on their running number alone; an
empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reach_workers
from .common import materialise
from .tokens import ByteBpe

LENGTH = 2048
SHARD = 8192
ISLANDS = 3
POPULATION = 24
GENERATIONS = 40
PATIENCE = 12
#: Bins below this share of the length are dissolved and packed again.
WELL_FILLED = 0.98
SEPARATOR = 0


@lru_cache(maxsize=2)
def _bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def cut(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """``(piece, start, length, crc32)`` of 32-bit ids: full pieces, before them
    the shorter rest."""
    n = len(ids) // 4
    first = n % length or min(length, n)
    edges = [0, *range(first, n + 1, length)]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, uid``."""
    end = array("I", [SEPARATOR]).tobytes()

    def run(batches):
        bpe = _bpe(path)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = cut(bpe.ids(text or "") + end, length)
                at.extend([i] * len(got))
                rows.extend(got)
            uids = np.arange(uid, uid + len(rows))
            uid += len(rows)
            cols = [batch.column(0).take(pa.array(at, pa.int32()))]
            cols += [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(uids, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    reach_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, uid bigint"
    )


class Bins:
    """Open bins by what room is left, for best-fit in constant time per piece."""

    def __init__(self, length: int):
        self.length, self.items, self.room = length, [], []
        self.open: dict[int, list[int]] = {}
        self.mask = 0

    def _offer(self, b: int) -> None:
        r = self.room[b]
        if r:
            self.open.setdefault(r, []).append(b)
            self.mask |= 1 << r

    def add_bin(self, items: list[int], room: int) -> None:
        self.items.append(items)
        self.room.append(room)
        self._offer(len(self.room) - 1)

    def put(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.add_bin([item], self.length - size)
            return
        r = size + (fits & -fits).bit_length() - 1
        level = self.open[r]
        b = level.pop()
        if not level:
            self.mask &= ~(1 << r)
        self.items[b].append(item)
        self.room[b] = r - size
        self._offer(b)


def best_fit(sizes, length: int, order) -> Bins:
    bins = Bins(length)
    for i in order:
        bins.put(i, sizes[i])
    return bins


def fitness(bins: Bins) -> tuple[int, float]:
    """Fewer bins first; among as many, those with fuller and emptier bins."""
    return len(bins.room), -sum((bins.length - r) ** 2 for r in bins.room)


def _refill(bins: Bins, loose: list[int], sizes, rnd: random.Random, blur: int) -> Bins:
    """Displaced pieces by best fit, longest first but for a random blur."""
    for i in sorted(loose, key=lambda i: (-sizes[i] + (rnd.randrange(blur) if blur else 0), i)):
        bins.put(i, sizes[i])
    return bins


def crossover(a: Bins, b: Bins, sizes, rnd: random.Random, blur: int = 0) -> Bins:
    """Well-filled bins of ``b`` go whole into ``a``; bins of ``a`` that hold one of
    their pieces go, and what else those held is fitted anew."""
    order = sorted(range(len(b.room)), key=lambda x: (b.room[x], rnd.random()))
    good = order[: max(1, len(order) // 2)]
    taken = [x for x in good if rnd.random() < 0.6] or good[:1]
    held = {i for x in taken for i in b.items[x]}
    child, loose = Bins(a.length), []
    for x in taken:
        child.add_bin(list(b.items[x]), b.room[x])
    for items, room in zip(a.items, a.room):
        if held.isdisjoint(items):
            child.add_bin(list(items), room)
        else:
            loose.extend(i for i in items if i not in held)
    return _refill(child, loose, sizes, rnd, blur)


def mutate(bins: Bins, sizes, rnd: random.Random, share: float = 0.05) -> Bins:
    """The emptiest bins and a few others are dissolved and best-fitted anew."""
    worst = sorted(range(len(bins.room)), key=lambda x: -bins.room[x])[: max(2, len(bins.room) // 50)]
    gone = set(worst) | {x for x in range(len(bins.room)) if rnd.random() < share}
    out, loose = Bins(bins.length), []
    for x, (items, room) in enumerate(zip(bins.items, bins.room)):
        if x in gone:
            loose.extend(items)
        else:
            out.add_bin(list(items), room)
    return _refill(out, loose, sizes, rnd, rnd.choice((0, 64, bins.length // 4)))


def evolve(sizes: list[int], start: list[Bins], seed: int, length: int = LENGTH, population: int = POPULATION, generations: int = GENERATIONS, slack: int = 0) -> Bins:
    """Best individual of one island's epoch. It ends early where the bound (all
    tokens over the length, and ``slack`` more) is reached, or after ``PATIENCE`` generations in vain."""
    bound = -(-sum(sizes) // length) + slack
    rnd = random.Random(seed)
    by_size = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    people = list(start) or [best_fit(sizes, length, by_size)]
    best = min(people, key=fitness)
    if len(best.room) <= bound:
        return best
    while len(people) < population:
        people.append(_refill(Bins(length), by_size, sizes, rnd, length // (2 + len(people) % 8)))
    vain = 0
    for _ in range(generations):
        people.sort(key=fitness)
        children = [mutate(people[k], sizes, rnd) for k in range(max(1, population // 6))]
        while len(children) < population // 2:
            # tournaments of two choose the parents
            a, b = (people[min(rnd.randrange(len(people)), rnd.randrange(len(people)))] for _ in range(2))
            children.append(crossover(a, b, sizes, rnd, rnd.choice((0, 32, length // 8))) if a is not b else mutate(a, sizes, rnd))
        people = sorted(people[: population - len(children)] + children, key=fitness)
        vain = 0 if fitness(people[0]) < fitness(best) else vain + 1
        best = min(best, people[0], key=fitness)
        if len(best.room) <= bound or vain >= PATIENCE:
            break
    return best


def _rebuilt(sizes: list[int], bin_of: np.ndarray, length: int) -> Bins:
    got: dict[int, list[int]] = {}
    for i, b in enumerate(bin_of):
        got.setdefault(int(b), []).append(i)
    out = Bins(length)
    for b in sorted(got):
        out.add_bin(got[b], length - sum(sizes[i] for i in got[b]))
    return out


def _epoch(length: int, first: bool, slack: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _bpe.cache_clear()  # a worker that has cut texts holds on to the vocabulary
        shard, island = int(pdf.shard.iloc[0]), int(pdf.island.iloc[0])
        pdf = pdf.sort_values(["origin", "uid"])
        groups = [g for _, g in pdf.groupby("origin", sort=True)]
        uid, sizes = groups[0].uid.to_numpy(), groups[0].length.tolist()
        start = [] if first else [_rebuilt(sizes, g.bin.to_numpy(), length) for g in groups]
        best = evolve(sizes, start, shard * 1009 + island * 2 + first, length, slack=slack)
        bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, items in enumerate(best.items):
            at = 0
            for i in items:
                bin_of[i], offset[i] = b, at
                at += sizes[i]
        n, fit = fitness(best)
        solved = n <= -(-sum(sizes) // length) + slack
        room = np.array(best.room, np.int64)
        return pd.DataFrame(
            {"shard": shard, "island": island, "uid": uid, "length": sizes, "bin": bin_of, "offset": offset, "fill": length - room[bin_of], "bins": n, "fit": float(fit), "solved": solved}
        )

    return run


_SOLVED = "shard bigint, island int, uid bigint, length bigint, bin bigint, offset bigint, fill bigint, bins bigint, fit double, solved boolean"


def solve(items: DataFrame, count: int, length: int = LENGTH, islands: int = ISLANDS, slack: int = 0) -> DataFrame:
    """``items(uid, length)`` -> ``shard, uid, length, bin, offset, fill``."""
    reach_workers(items.sparkSession)
    shards = -(-count // SHARD)
    dealt = items.select((F.pmod(F.xxhash64("uid"), F.lit(shards))).alias("shard"), "uid", "length")
    own = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    own = own.withColumn("origin", F.col("island")).withColumn("bin", F.lit(0).cast("long"))
    one = materialise(own.groupBy("shard", "island").applyInPandas(_epoch(length, True, slack), _SOLVED))
    # each elite of an unsolved shard stays and goes to the next island
    solved = one.groupBy("shard").agg(F.max("solved").alias("any")).where("any").select("shard")
    open_ = one.join(solved, "shard", "left_anti")
    moved = open_.select(
        "shard", F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)))).alias("to"), F.col("island").alias("origin"), "uid", "length", "bin"
    ).withColumnRenamed("to", "island")
    two = materialise(moved.groupBy("shard", "island").applyInPandas(_epoch(length, False, slack), _SOLVED))
    ended = two.unionByName(one.join(solved, "shard", "left_semi"))
    best = ended.groupBy("shard").agg(F.min(F.struct("bins", "fit", "island")).alias("best"))
    return ended.join(best.select("shard", F.col("best.island").alias("island")), ["shard", "island"]).select(
        "shard", "uid", "length", "bin", "offset", "fill"
    )


def pack(docs: DataFrame, path: str, length: int = LENGTH, islands: int = ISLANDS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut_up = materialise(pieces(docs, path, length))
    small = cut_up.where(F.col("length") < length).select("uid", "length")
    parts, count, level = [], small.count(), 0
    while count:
        level, shards = level + 1, -(-count // SHARD)
        done = materialise(solve(small, count, length, islands, slack=int(shards > 1)))
        poor = F.col("fill") < int(WELL_FILLED * length)
        name = F.lit(level << 58) + F.shiftleft(F.col("shard"), 20) + F.col("bin")
        placed = done.select("uid", name.alias("sequence_id"), "offset", "fill", "length")
        small = placed.where(poor).select("uid", "length")
        left = small.count() if shards > 1 else 0
        # badly filled bins stay where packing them again can't bring more of them together
        again = 0 < left <= (shards - 1) * SHARD
        parts.append(placed.where(~poor) if again else placed)
        count = left if again else 0
    full = cut_up.where(F.col("length") == length).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    for part in parts:
        rest = cut_up.where(F.col("length") < length).join(part.select("uid", "sequence_id", "offset"), "uid")
        full = full.unionByName(rest.select(*full.columns))
    return full
