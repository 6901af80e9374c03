"""Token counts by rank-synchronous merging of ragged arrays.

For a BPE tokenizer file with word ends. The pre-tokens that a batch has new are
held as one flat array of symbols with sequence numbers. In each round every
sequence merges all places of its own lowest-ranked pair at once; only the pairs
beside a merge are looked up again, and finished sequences leave the arrays.
Surviving symbols are counted. Counts of chunks between spaces are kept in a
bounded cache; whitespace never belongs to a token, so chunks don't interact.

Defined cases: null and empty texts have no tokens and no bytes; special strings
inside texts are one token each, as the library's default has them; repeated
rows are counted alike; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reach_workers
from .tokens import _bytes_of_symbols

LIMIT = 2048
CACHE = 500_000
# How this kind of tokenizer splits lower-cased text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+"
_NONE = np.int64(1 << 40)


class WordBpe:
    """``path``: a tokenizers file of a BPE with ``end_of_word_suffix``, NFC and
    lower-casing, whitespace dropped."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.size, self.cache = cache, {}
        symbols = {b: c for c, b in _bytes_of_symbols().items()}
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[symbols[b] + end] for b in range(256)], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.int64(2**62)), np.append(order, _NONE).astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.split, self.split_ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merged_sizes(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word (of one byte at least)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = sizes.copy()
        if not len(words):
            return out
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes) - 1
        sym = self.inner[raw]
        sym[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        last = np.zeros(len(sym), bool)
        last[ends] = True
        rank = np.full(len(sym), _NONE)
        inside = np.flatnonzero(~last)
        rank[inside] = self._rank(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(sym)))
            done = low == _NONE
            if done.any():
                out[word[starts[done]]] = length[done]
                keep = np.repeat(~done, length)
                sym, word, last, rank = sym[keep], word[keep], last[keep], rank[keep]
                low, length = low[~done], length[~done]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, length))
            # of overlapping places every second one, counted from the run's left
            new_run = np.append(True, at[1:] != at[:-1] + 1)
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            sym[at] = self.made[rank[at]]
            last[at] |= last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, last, rank = sym[keep], word[keep], last[keep], rank[keep]
            at = place[at]
            left = at[at > 0] - 1
            for p in (at, left[word[left] == word[left + 1]]):
                rank[p] = _NONE
                p = p[~last[p]]
                rank[p] = self._rank(sym[p], sym[p + 1])
        return out

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.split_ascii.findall(text.lower())
        return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _learn(self, chunks: list[str]) -> dict[str, int]:
        owner, words, extra = [], [], np.zeros(len(chunks), np.int64)
        for i, chunk in enumerate(chunks):
            parts = [chunk]
            if self.special is not None and "<" in chunk:
                parts = self.special.split(chunk)
                extra[i] = len(parts) // 2
                parts = parts[::2]
            for part in parts:
                for w in self.pre_tokens(part):
                    owner.append(i)
                    words.append(w.encode())
        unique = list(dict.fromkeys(words))
        sizes = dict(zip(unique, self.merged_sizes(unique).tolist()))
        counts = extra + np.bincount(np.array(owner, np.int64), np.array([sizes[w] for w in words], float), len(chunks)).astype(np.int64)
        return dict(zip(chunks, counts.tolist()))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text, the new chunks of all texts merged together."""
        split = [(t or "").split(" ") for t in texts]
        new = list({c for parts in split for c in parts}.difference(self.cache))
        if len(self.cache) + len(new) > self.size:
            self.cache.clear()
            new = list({c for parts in split for c in parts})
        self.cache.update(self._learn(new))
        get = self.cache.__getitem__
        return [sum(map(get, parts)) for parts in split]


@lru_cache(maxsize=2)
def _bpe(path: str) -> WordBpe:
    return WordBpe(path)


#: Characters of text handled at once.
BLOCK = 1 << 21


def _blocks(texts: list[str | None]):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= BLOCK:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row."""

    def run(batches):
        bpe = _bpe(path)
        for batch in batches:
            n = [x for part in _blocks(batch.column(1).to_pylist()) for x in bpe.counts(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    reach_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
        .mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
