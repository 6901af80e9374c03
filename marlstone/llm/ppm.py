"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` with counts from all
training texts. A symbol is coded in the longest known context; where it is new,
an escape (method C: as likely as the context has distinct symbols) leads to the
next shorter one, from which all symbols of the longer one are excluded, and at
last to a uniform choice among symbols never seen. As a context's symbols are
always among those of its suffix, each node has one exclusion per parent, so a
static trie scores whole arrays of positions by table lookups.

The trie stays in the cluster, in pieces. One pass over the texts deals them into
blocks of about ``BLOCK_BYTES`` and lists each block's distinct byte grams and
words with their training counts, cut into buckets by the last three context
bytes (words: by a hash). Lists of a bucket are merged over all blocks, at most
``FAN`` at a time, to that bucket's piece of the model; each list then meets its
piece and gets a value per entry, and a block's values meet its texts again. Only
the grams of three bytes, at most 2^24 whatever the input, are sent to all tasks.
The passes over the texts are two at every size.

Defined cases: null and empty texts consist of the end alone; a null ``doc_id``
is not held out; repeated rows count and are scored each; without training rows
every symbol is uniform; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reach_workers
from .common import LOWER, UPPER, materialise

ORDER = 5
#: Context bytes that decide about a bucket; shorter contexts are known everywhere.
LAST = 3
#: Stands before and ends each text; no UTF-8 text has this byte.
END = 255
SYMBOLS = 256
BLOCK_BYTES = 1 << 24
#: Lists of one bucket that are merged at once, and blocks whose lists meet a piece at once.
FAN, MEET = 256, 4096
#: Tasks that blocks are dealt to, one for each up to this number.
MOST_TASKS = 20_000
#: Bytes scored or counted at once.
BLOCK = 1 << 18
#: Rows of a batch taken at once.
ROWS = 1024
#: Entries that wait to be summed.
WAITING = 1 << 20
#: The end as a token; words aren't empty.
END_TOKEN = b""
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def tokens(raw: bytes) -> list[bytes]:
    words = raw.translate(_LOWER).split()
    words.append(END_TOKEN)
    return words


def grams(raws: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol (ends included) behind its ``order`` preceding bytes as one
    number, text after text, and the number of symbols of each text."""
    pad = bytes([END]) * order
    data = np.frombuffer(b"".join([pad + r + b"\xff" for r in raws]), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) + 1 for r in raws], np.int64)
    key = np.zeros(len(data), np.uint64)
    for back in range(order, -1, -1):
        key[back:] |= data[: len(data) - back] << np.uint64(8 * back)
    starts = np.cumsum(sizes + order) - sizes
    keep = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return key[keep], sizes


class Table:
    """Numbers to their places, by open addressing in arrays."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(1.4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.places = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == self.EMPTY
            taken, at = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[at]
            self.keys[taken], self.places[taken] = keys[left[chosen]], left[chosen]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def valued(self, values: np.ndarray) -> np.ndarray:
        """``values`` of the keys in the order of the slots."""
        return values[self.places] if len(values) else np.zeros(len(self.places), values.dtype)

    def get(self, keys: np.ndarray, valued: np.ndarray) -> np.ndarray:
        """Values of keys that are all known."""
        slot = self._slot(keys)
        out = valued[slot]
        open_ = np.flatnonzero(self.keys[slot] != keys)
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            hit = self.keys[slot] == keys[open_]
            out[open_[hit]] = valued[slot[hit]]
            open_, slot = open_[~hit], slot[~hit]
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places, -1 where there is none."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.places[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held != self.EMPTY))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == keys[open_]
            out[open_[hit]] = self.places[slot[hit]]
            go = ~hit & (held != self.EMPTY)
            open_, slot = open_[go], slot[go]
        return out


class Trie:
    """Static model from counts of grams of ``order + 1`` bytes.

    ``keys`` may be one piece of a split table that has all grams of its contexts'
    last ``LAST`` bytes; ``low``, the counts of grams of ``LAST`` bytes in the whole
    training set, then gives the shorter contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int = ORDER):
        self.order = order
        self.entry, self.context = {}, {}
        self.log_count, self.of_entry = {}, {}
        self.direct, self.escape, self.excl, self.excl_escape = {}, {}, {}, {}
        symbols = np.bincount((low[0] & np.uint64(255)).astype(int), low[1], SYMBOLS)
        self.symbol_log = np.log10(np.maximum(symbols, 1))
        self.symbol_seen = symbols > 0
        seen = int(self.symbol_seen.sum())
        self.root_direct, self.root_escape = _denominator(float(symbols.sum()), float(seen))
        self.unseen = -math.log10(max(SYMBOLS - seen, 1))
        below = None
        for k in range(order, 0, -1):
            if k == LAST - 1:
                keys, counts = low
            keys, counts = _summed(keys & np.uint64(256 ** (k + 1) - 1), counts)
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(of, counts, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(float)
            self.entry[k], self.context[k] = Table(keys), Table(contexts)
            self.log_count[k], self.of_entry[k] = np.log10(counts), of.astype(np.int32)
            self.direct[k], self.escape[k] = _denominators(total, distinct)
            if below is not None:  # what escapes from the longer contexts leave of these
                self._exclude(k, below, keys, counts, total, distinct)
            below = (keys, of, contexts)
        if below is None:
            return
        keys, of, contexts = below
        sym = (keys & np.uint64(255)).astype(int)
        total = symbols.sum() - np.bincount(of, symbols[sym], len(contexts))
        distinct = seen - np.bincount(of, minlength=len(contexts)).astype(float)
        self.excl[1], self.excl_escape[1] = _denominators(total, distinct)

    def _exclude(self, k: int, longer, keys, counts, total, distinct) -> None:
        long_keys, long_of, long_contexts = longer
        parent = self.context[k].find(long_contexts & np.uint64(256**k - 1))
        place = self.entry[k].find(long_keys & np.uint64(256 ** (k + 1) - 1))
        rest = total[parent] - np.bincount(long_of, counts[place], len(long_contexts))
        kinds = distinct[parent] - np.bincount(long_of, minlength=len(long_contexts))
        self.excl[k + 1], self.excl_escape[k + 1] = _denominators(rest, kinds)

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each position."""
        out = np.zeros(len(key))
        at, excl = np.arange(len(key)), np.full(len(key), -1)
        for k in range(self.order, 0, -1):
            own = key[at] & np.uint64(256 ** (k + 1) - 1)
            e = self.entry[k].find(own)
            hit = e >= 0
            node = np.where(hit, self.of_entry[k][np.maximum(e, 0)], -1) if len(self.of_entry[k]) else np.full(len(at), -1)
            miss = np.flatnonzero(~hit)
            node[miss] = self.context[k].find(own[miss] >> np.uint64(8))
            plain = excl < 0
            if k < self.order and len(self.excl[k + 1]):
                den = np.where(plain, self._at(self.direct[k], node), self.excl[k + 1][np.maximum(excl, 0)])
                esc = np.where(plain, self._at(self.escape[k], node), self.excl_escape[k + 1][np.maximum(excl, 0)])
            else:
                den, esc = self._at(self.direct[k], node), self._at(self.escape[k], node)
            out[at[hit]] += self.log_count[k][e[hit]] - den[hit]
            go = ~hit
            known = go & (node >= 0)
            out[at[known]] += esc[known]
            excl = np.where(known, node, -1)[go] if k > 0 else excl
            at = at[go]
            if not len(at):
                return out
        sym = (key[at] & np.uint64(255)).astype(int)
        plain = excl < 0
        e1 = np.maximum(excl, 0)
        has = self.order > 0 and len(self.excl[1])
        den = np.where(plain, self.root_direct, self.excl[1][e1] if has else 0)
        esc = np.where(plain, self.root_escape, self.excl_escape[1][e1] if has else 0)
        out[at] += np.where(self.symbol_seen[sym], self.symbol_log[sym] - den, esc + self.unseen)
        return out

    @staticmethod
    def _at(values: np.ndarray, node: np.ndarray) -> np.ndarray:
        return values[np.maximum(node, 0)] if len(values) else np.zeros(len(node))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, of = np.unique(keys, return_inverse=True)
    return unique, np.bincount(of, counts, len(unique))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Ascending, by a sort, which is faster here than the library's hash table."""
    keys = np.sort(keys)
    return keys[np.append(np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])]


def _denominators(total: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the denominator, and of the escape (certain if nothing is left)."""
    some = distinct > 0
    den = np.log10(np.where(some, total + distinct, 1))
    return den, np.where(some, np.log10(np.where(some, distinct, 1)) - den, 0.0)


def _denominator(total: float, distinct: float) -> tuple[float, float]:
    den, esc = _denominators(np.array([total]), np.array([distinct]))
    return float(den[0]), float(esc[0])


def adaptive_log10(text: str | None, order: int = ORDER, primer: str | None = None) -> float:
    """Code length of one text by a trie that learns while it codes, after
    reading ``primer``; the general form, symbol by symbol."""
    nodes: dict[bytes, Counter] = defaultdict(Counter)
    total = 0.0
    for n, raw in enumerate([_raw(primer), _raw(text)] if primer is not None else [b"", _raw(text)]):
        history = bytes([END]) * order
        if n == 0 and primer is None:
            continue
        for s in raw + bytes([END]):
            if n:
                total += node_log10(nodes, history, s, order)
            for k in range(order + 1):
                nodes[history[len(history) - k :]][s] += 1
            history = (history + bytes([s]))[-order:] if order else b""
    return total


def node_log10(nodes, history: bytes, symbol: int, order: int) -> float:
    """log10 probability of a symbol by the nodes' counts, with exclusion."""
    out, excluded = 0.0, set()
    for k in range(order, -1, -1):
        node = nodes.get(history[len(history) - k :])
        if not node:
            continue
        open_ = {s: c for s, c in node.items() if s not in excluded}
        if not open_:
            continue
        den = sum(open_.values()) + len(open_)
        if symbol in open_:
            return out + math.log10(open_[symbol] / den)
        out += math.log10(len(open_) / den)
        excluded |= node.keys()
    return out - math.log10(max(SYMBOLS - len(excluded), 1))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 2, F.lit(False))


# --- lists of a block


def _window(data: np.ndarray, width: int) -> np.ndarray:
    """At each place the ``width`` bytes up to it as one number."""
    out = data.copy()
    for back in range(1, width):
        out[back:] |= data[:-back] << np.uint64(8 * back)
    return out


def placed_grams(raws: list[bytes], order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`grams`, but behind their bucket and with the last context bytes in
    front of the earlier ones, so that sorting joins those."""
    pad, n = bytes([END]) * order, min(LAST, order)
    data = np.frombuffer(b"".join([pad + r + b"\xff" for r in raws]), np.uint8).astype(np.uint64)
    last, key = _window(data, n), data.copy()
    bucket = ((((last + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
    key[1:] |= (last[:-1] << np.uint64(8 * (order - n + 1))) | (bucket[:-1] << np.uint64(48))
    if order > n:
        key[n + 1 :] |= _window(data, order - n)[: -n - 1] << np.uint64(8)
    sizes = np.array([len(r) + 1 for r in raws], np.int64)
    ends = np.cumsum(sizes + order)
    return np.concatenate([key[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist())]), sizes


def turned_back(key: np.ndarray, order: int) -> np.ndarray:
    """Grams from unpacked list entries."""
    n = min(LAST, order)
    first = (key >> np.uint64(8)) & np.uint64(256 ** (order - n) - 1)
    return (first << np.uint64(8 * (n + 1))) | ((key >> np.uint64(8 * (order - n + 1))) << np.uint64(8)) | (key & np.uint64(255))


def bounds(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted :func:`placed_grams` begins, and the end."""
    return np.append(np.searchsorted(key, np.arange(buckets, dtype=np.uint64) << np.uint64(48)), len(key))


def pack(key: np.ndarray) -> bytes:
    """Sorted grams byte by byte, which compresses well."""
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return out.view("<u8").ravel()


def by_bucket(words, buckets: int) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = defaultdict(list)
    for w in sorted(words):
        out[zlib.crc32(w) % buckets].append(w)
    return out


def _pieces(raws: list[bytes]):
    """Texts, about ``BLOCK`` bytes together."""
    part, size = [], 0
    for raw in raws:
        part.append(raw)
        size += len(raw)
        if size >= BLOCK:
            yield part
            part, size = [], 0
    if part:
        yield part


class Lists:
    """Distinct grams and words of a block with their training counts."""

    def __init__(self, order: int, buckets: int):
        self.order, self.buckets = order, buckets
        self.parts, self.waiting = [(np.zeros(0, np.uint64), np.zeros(0))], 0
        self.words: Counter = Counter()

    def add(self, raws: list[bytes], count: bool) -> None:
        for part in _pieces(raws):
            key, n = np.unique(placed_grams(part, self.order, self.buckets)[0], return_counts=True)
            self.parts.append((key, n.astype(float) if count else np.zeros(len(n))))
            self.waiting += len(key)
            if self.waiting > WAITING:
                self.sum()
            for raw in part:
                self.words.update(tokens(raw) if count else dict.fromkeys(tokens(raw), 0))

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        got = _summed(*(np.concatenate(x) for x in zip(*self.parts)))
        self.parts, self.waiting = [got], 0
        return got

    def rows(self):
        """``kind, bucket, keys, counts``."""
        key, n = self.sum()
        edge = bounds(key, self.buckets)
        for b in np.flatnonzero(np.diff(edge)):
            yield GRAMS, int(b), pack(key[edge[b] : edge[b + 1]]), n[edge[b] : edge[b + 1]].astype("<i4").tobytes()
        for b, ws in by_bucket(self.words, self.buckets).items():
            yield WORDS, b, b"\n".join(ws), np.array([self.words[w] for w in ws], "<i4").tobytes()


TEXTS, GRAMS, WORDS = range(3)
_LISTED = "block bigint, kind int, bucket int, keys binary, counts binary"
_KINDS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _shipped(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def listed(docs: DataFrame, order: int, buckets: int, most: int = BLOCK_BYTES) -> DataFrame:
    """``block, kind, bucket, keys, counts``: the texts of each block (compressed,
    with their ids) and its lists."""

    def run(batches):
        block, size = TaskContext.get().partitionId() << 24, 0
        lists = Lists(order, buckets)

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*((block, *r) for r in found))) or [[]] * 5, _KINDS.types)], schema=_KINDS)

        for batch in batches:
            for first in range(0, len(batch), ROWS):
                some = batch.slice(first, ROWS)
                raws, held, at = [r or b"" for r in some.column(1).cast(pa.binary()).to_pylist()], some.column(2).to_pylist(), 0
                while at < len(raws):
                    end = at
                    while end < len(raws) and size < most:
                        size += len(raws[end]) + 1
                        end += 1
                    part = pa.RecordBatch.from_arrays([some.column(0).slice(at, end - at), pa.array(raws[at:end], pa.binary())], ["doc_id", "raw"])
                    yield rows([(TEXTS, -1, _shipped(part), None)])
                    lists.add([r for r, h in zip(raws[at:end], held[at:end]) if not h], True)
                    lists.add([r for r, h in zip(raws[at:end], held[at:end]) if h], False)
                    at = end
                    if size >= most:
                        yield rows(lists.rows())
                        block, size, lists = block + 1, 0, Lists(order, buckets)
        yield rows(lists.rows())

    reach_workers(docs.sparkSession)
    return docs.select("doc_id", "text", held_out(F.col("doc_id"))).mapInArrow(run, _LISTED)


# --- the model in pieces


def _summed_words(keys: list[bytes], counts: list[bytes]) -> Counter:
    out: Counter = Counter()
    for ws, n in zip(keys, counts):
        for w, c in zip(ws.split(b"\n"), np.frombuffer(n, "<i8").tolist()):
            out[w] += c
    return out


def _merge(rows: pa.Table) -> pa.Table:
    """Lists of one bucket summed; entries that no training text has go."""
    kind, bucket, group = (rows.column(c)[0].as_py() for c in ("kind", "bucket", "group"))
    keys, counts = rows.column("keys").to_pylist(), rows.column("counts").to_pylist()
    wide = [c if f else np.frombuffer(c, "<i4").astype("<i8").tobytes() for c, f in zip(counts, rows.column("wide").to_pylist())]
    if kind == GRAMS:
        key, n = _summed(np.concatenate([unpack(k) for k in keys]), np.concatenate([np.frombuffer(c, "<i8") for c in wide]).astype(float))
        key, n = key[n > 0], n[n > 0].astype("<i8")
        out = pack(key), n
    else:
        words = _summed_words(keys, wide)
        ws = sorted(w for w, c in words.items() if c)
        out = b"\n".join(ws), np.array([words[w] for w in ws], "<i8")
    cols = [[kind], [bucket], [group], [out[0]], [out[1].tobytes()], [len(out[1])], [int(out[1].sum())]]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _MERGED)], schema=_MERGED)


_MERGED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("group", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("size", pa.int64()), ("total", pa.int64())])
_PIECE = "kind int, bucket int, group bigint, keys binary, counts binary, size bigint, total bigint"


def pieces(lists: DataFrame, blocks: int, fan: int = FAN) -> DataFrame:
    """The model: ``kind, bucket, keys, counts, size, total`` by bucket. Lists are
    merged ``fan`` at a time, in as many levels as that takes."""
    groups = max(1, -(-blocks // fan))
    dealt = F.pmod(F.hash("block"), F.lit(groups)).cast("long")
    rows = lists.select("kind", "bucket", dealt.alias("group"), "keys", "counts", F.lit(False).alias("wide"))
    while True:
        merged = materialise(rows.groupBy("kind", "bucket", "group").applyInArrow(_merge, _PIECE))
        if groups == 1:
            return merged.where("size > 0")
        groups = -(-groups // fan)
        rows = merged.where("size > 0").select("kind", "bucket", F.pmod("group", F.lit(groups)).alias("group"), "keys", "counts", F.lit(True).alias("wide"))


def low_grams(model: DataFrame, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the grams of ``LAST`` bytes; there are at most 2^24."""

    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key, n = _summed(turned_back(unpack(keys), order) & np.uint64(256**LAST - 1), np.frombuffer(counts, "<i8").astype(float))
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    got = model.where(F.col("kind") == GRAMS).select("keys", "counts").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return got["gram"].to_numpy().astype(np.uint64), got["n"].to_numpy().astype(float)


def valued(lists: DataFrame, model: DataFrame, low: tuple[np.ndarray, np.ndarray], blocks: int, order: int, meet: int = MEET) -> DataFrame:
    """``block, kind, bucket, keys``: for each list the values of its entries, in
    their order: log10 probabilities of grams, counts of words."""
    sent = lists.sparkSession.sparkContext.broadcast(low)
    salts = max(1, -(-blocks // meet))

    def run(rows: pa.Table) -> pa.Table:
        block, keys = rows.column("block").to_pylist(), rows.column("keys").to_pylist()
        kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
        own = next((i for i, b in enumerate(block) if b is None), None)
        counts = b"" if own is None else rows.column("counts")[own].as_py()
        asked = [i for i in range(len(block)) if i != own]
        if kind == GRAMS:
            known = unpack(b"" if own is None else keys[own])
            trie = Trie(turned_back(known, order), np.frombuffer(counts, "<i8").astype(float), sent.value, order)
            ask = [unpack(keys[i]) for i in asked]
            every, of = np.unique(np.concatenate(ask or [known[:0]]), return_inverse=True)
            value = trie.log10(turned_back(every, order)).astype("<f4")[of]
            edge = np.cumsum([0, *map(len, ask)])
            out = [value[a:b].tobytes() for a, b in zip(edge, edge[1:])]
        else:
            count = dict(zip(keys[own].split(b"\n"), np.frombuffer(counts, "<i8").tolist())) if own is not None else {}
            out = [np.array([count.get(w, 0) for w in keys[i].split(b"\n")], "<i8").tobytes() for i in asked]
        cols = [[block[i] for i in asked], [kind] * len(asked), [bucket] * len(asked), out]
        return pa.table([pa.array(c, t) for c, t in zip(cols, _KINDS.types)], names=_KINDS.names[:4])

    asked = lists.select("kind", "bucket", F.pmod(F.hash("block"), F.lit(salts)).alias("salt"), "block", "keys", F.lit(None).cast("binary").alias("counts"))
    known = model.select("kind", "bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("bigint").alias("block"), "keys", "counts")
    return asked.unionByName(known).groupBy("kind", "bucket", "salt").applyInArrow(run, "block bigint, kind int, bucket int, keys binary")


def _scored(raws: list[bytes], values: dict, bottom: float, order: int, buckets: int) -> list[tuple]:
    """``n_tokens, n_known, base, score`` of each text of one block."""
    every, waiting, size = np.zeros(0, np.uint64), [], 0
    for part in _pieces(raws):
        waiting.append(_distinct(placed_grams(part, order, buckets)[0]))
        size += len(waiting[-1])
        if size > WAITING:
            every, waiting, size = _distinct(np.concatenate([every, *waiting])), [], 0
    every, waiting = _distinct(np.concatenate([every, *waiting])), []
    edge = bounds(every, buckets)
    value = np.zeros(len(every), np.float32)
    for b in np.flatnonzero(np.diff(edge)):
        value[edge[b] : edge[b + 1]] = np.frombuffer(values[GRAMS, int(b)], "<f4")
    scores = []
    table = Table(every)
    slots = table.valued(value)
    for part in _pieces(raws):  # keys once more, rather than held for all positions
        key, sizes = placed_grams(part, order, buckets)
        scores.append(np.add.reduceat(table.get(key, slots).astype(float), np.cumsum(sizes) - sizes))
    scores = np.concatenate(scores)
    found: set[bytes] = set()
    for raw in raws:
        found.update(tokens(raw))
    logs: dict[bytes, float] = {}
    for b, ws in by_bucket(found, buckets).items():
        logs.update(zip(ws, (np.log10(np.frombuffer(values[WORDS, b], "<i8") + 1.0) - bottom).tolist()))
    get, new, out = logs.__getitem__, -bottom, []
    for raw, score_ in zip(raws, scores.tolist()):
        got = list(map(get, tokens(raw)))
        # a known word's value is above that of a new one
        out.append((len(got), len(got) - got.count(new), math.fsum(got), score_))
    return out


def score(docs: DataFrame, order: int = ORDER, most: int = BLOCK_BYTES, fan: int = FAN, meet: int = MEET) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    if not 1 <= order <= 5:
        raise ValueError("orders from 1 to 5")
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 << 16, max(16, size // most))
    every = materialise(listed(docs, order, buckets, most))
    lists = every.where(F.col("kind") != TEXTS)
    blocks = lists.select("block").distinct().count()
    model = pieces(lists, blocks, fan)
    words = model.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    total, bottom = words[0], math.log10(words[0] + words[1] + 1)
    values = valued(lists, model, low_grams(model, order), blocks, order, meet)
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(rows: pa.Table) -> pa.Table:
        held, ids, raws = {}, [], []
        for k, b, x in zip(*(rows.column(c).to_pylist() for c in ("kind", "bucket", "keys"))):
            if k == TEXTS:
                part = pa.ipc.open_stream(x).read_all()
                ids += part.column("doc_id").chunks
                raws += part.column("raw").to_pylist()
            else:
                held[k, b] = x
        got = zip(*_scored(raws, held, bottom, order, buckets))
        kinds = pa.int64(), pa.int64(), pa.float64(), pa.float64()
        return pa.table([pa.chunked_array(ids), *(pa.array(c, k) for c, k in zip(got, kinds))], names=names)

    texts = every.where(F.col("kind") == TEXTS).select("block", "kind", "bucket", "keys")
    dealt = texts.unionByName(values).repartition(min(max(blocks, 1), MOST_TASKS), "block")
    out = dealt.groupBy("block").applyInArrow(run, f"doc_id {kind.simpleString()}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
