import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlstone.llm import ppm


def brute_nodes(texts, order):
    nodes = defaultdict(Counter)
    for t in texts:
        history = b"\xff" * order
        for s in (t or "").encode() + b"\xff":
            for k in range(order + 1):
                nodes[history[len(history) - k :]][s] += 1
            history = (history + bytes([s]))[-order:] if order else b""
    return nodes


def brute_symbol(nodes, history, symbol, order):
    """Escape C with exclusion, from counts alone."""
    probability, gone = 1.0, set()
    for k in range(order, -1, -1):
        node = nodes.get(history[len(history) - k :], {})
        left = {s: c for s, c in node.items() if s not in gone}
        if left:
            whole = sum(left.values()) + len(left)
            if symbol in left:
                return probability * left[symbol] / whole
            probability *= len(left) / whole
        gone |= set(node)
    return probability / max(256 - len(gone), 1)


def brute_score(nodes, text, order):
    history, total = b"\xff" * order, 0.0
    for s in (text or "").encode() + b"\xff":
        total += math.log10(brute_symbol(nodes, history, s, order))
        history = (history + bytes([s]))[-order:] if order else b""
    return total


def make_texts(n, seed=1):
    rnd = random.Random(seed)
    parts = ["ab", "ba", "c", " ", "é", "the ", "X", "\n", "zz"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + [None, "", "Q#", "é" * 30]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def low_of(keys, n):
    low, of = np.unique(keys & np.uint64(256**3 - 1), return_inverse=True)
    return low, np.bincount(of, n, len(low))


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_trie_against_nodes(order):
    train, texts = make_texts(30), make_texts(20, 2)
    keys, n = np.unique(ppm.grams([(t or "").encode() for t in train], order)[0], return_counts=True)
    nodes = brute_nodes(train, order)
    put, m = np.unique(ppm.placed_grams([(t or "").encode() for t in train], order, 7)[0], return_counts=True)
    low, mask = low_of(keys, n), np.uint64(2**48 - 1)
    for t in texts:
        ask, _ = ppm.grams([(t or "").encode()], order)
        # the whole model, and the piece of it that each symbol's bucket has
        total, piece = ppm.Trie(keys, n.astype(float), low, order).log10(ask).sum(), 0
        asked = ppm.placed_grams([(t or "").encode()], order, 7)[0]
        for b in range(7):
            own = put >> np.uint64(48) == b
            trie = ppm.Trie(ppm.turned_back(put[own] & mask, order), m[own].astype(float), low, order)
            piece += trie.log10(ppm.turned_back(asked[asked >> np.uint64(48) == b] & mask, order)).sum()
        assert np.allclose([total, piece], brute_score(nodes, t, order))


def test_lists_keep_grams():
    rng = np.random.default_rng(3)
    raws = [rng.integers(0, 255, n).astype(np.uint8).tobytes() for n in (0, 1, 3, 500)]
    for order in (1, 2, 3, 4, 5):
        (keys, sizes), (put, same) = ppm.grams(raws, order), ppm.placed_grams(raws, order, 11)
        assert (ppm.turned_back(put & np.uint64(2**48 - 1), order) == keys).all() and (sizes == same).all()
        put = np.unique(put)
        edge = ppm.bounds(put, 11)
        assert edge[-1] == len(put) and all((put[edge[b] : edge[b + 1]] >> np.uint64(48) == b).all() for b in range(11))
        assert (ppm.unpack(ppm.pack(put)) == (put & np.uint64(2**48 - 1))).all()
        table = ppm.Table(put)
        assert (table.get(put[::-1], table.valued(np.arange(len(put)))) == np.arange(len(put))[::-1]).all()


def test_probabilities_sum_to_one():
    nodes = brute_nodes(make_texts(30), 3)
    for history in (b"aba", b"zzz", b"\xff\xff\xff", b"q#!"):
        assert math.isclose(sum(10 ** ppm.node_log10(nodes, history, s, 3) for s in range(256)), 1, rel_tol=1e-9)


def test_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**40, 5000).astype(np.uint64))
    table = ppm.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(2**41)) == -1).all()
    assert (ppm.Table(keys[:0]).find(keys) == -1).all()


def test_adaptive_learns():
    text = "the same words again and again " * 8
    assert ppm.adaptive_log10(text, primer=text) > ppm.adaptive_log10(text)
    assert ppm.adaptive_log10(None) == pytest.approx(-math.log10(256))


@pytest.mark.parametrize("most,fan,meet", [(1 << 24, 256, 4096), (60, 2, 3), (1, 3, 2)])
def test_score(spark, most, fan, meet):
    texts = make_texts(40)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "ab ba", "x"), (7, "the ab", "x"), (7, "the ab", "x")]
    got = ppm.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), most=most, fan=fan, meet=meet).collect()
    train = [t for i, t, _ in rows if not held(i)]
    words = lambda t: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split(), b" "]
    count = Counter(w for t in train for w in words(t))
    total, kinds = sum(count.values()), len(count)
    nodes = brute_nodes(train, ppm.ORDER)
    want = sorted(
        (str(i), held(i), len(words(t)), sum(count[w] > 0 for w in words(t)), total,
         round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in words(t)), 6), brute_score(nodes, t, ppm.ORDER))
        for i, t, _ in rows)
    have = sorted((str(r[0]), *r[1:5], round(r[5], 6), r[6]) for r in got)
    assert [h[:-1] for h in have] == [w[:-1] for w in want]
    assert np.allclose([h[-1] for h in have], [w[-1] for w in want], rtol=1e-5)


def test_empty(spark):
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
