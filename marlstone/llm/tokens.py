"""Token ids of a byte-level BPE tokenizer file, exactly as its library gives
them, and faster: chunks between single spaces are looked up in a bounded cache."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: A pre-token may span the space only where whitespace surrounds it.
_SPANS = re.compile(r"\s (?:\s|\Z)")
_SPACE = re.compile(r"\s")
CACHE = 250_000


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level BPE means."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """``path``: a tokenizers file of a byte-level BPE without a normalizer."""

    # Fixed value: how byte-level BPE splits text before merging.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, cache: int = CACHE):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec["added_tokens"]}
        symbols = _bytes_of_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.path, self.size, self.cache = path, cache, {}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.encode = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        (self.line_feed,) = self.encode("\n")
        self.library = None

    def _exact(self, text: str) -> bytes:
        """Through the library itself, special strings as its default has them."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.special is not None and self.special.search(text):
            return self._exact(text)
        if _SPANS.search(text):
            return array("I", self.encode(text)).tobytes()
        first, *rest = text.split(" ")
        cache, encode = self.cache, self.encode
        found = list(map(cache.get, rest))
        if None in found:
            new = self._learn({c for c, x in zip(rest, found) if x is None})
            found = [new[c] if x is None else x for c, x in zip(rest, found)]
        return array("I", encode(first)).tobytes() + b"".join(found)

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks, each after a space. Those without whitespace go through
        the encoder at once, a line each: a line feed before a space is always a
        token of its own."""
        plain = [c for c in chunks if c and not _SPACE.search(c)]
        new = {c: array("I", self.encode(" " + c)).tobytes() for c in chunks.difference(plain)}
        if plain:
            ids = array("I", self.encode("\n".join([" " + c for c in plain])))
            ends = np.flatnonzero(np.frombuffer(ids, np.uint32) == self.line_feed).tolist()
            raw, at = ids.tobytes(), 0
            for c, end in zip(plain, [*ends, len(ids)]):
                new[c] = raw[4 * at : 4 * end]
                at = end + 1
        if len(self.cache) + len(new) > self.size:
            self.cache.clear()
        self.cache.update((c, x) for c, x in new.items() if len(c) < 64)
        return new
