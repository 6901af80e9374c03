import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import simhash
from marlstone.llm.components import components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """{doc: fp} -> {doc: smallest reachable doc}"""
    comp = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and comp[a] != comp[b]:
                low = min(comp[a], comp[b])
                comp[a] = comp[b] = low
                changed = True
    return comp


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b", "A b C", "É é x\x85y z\xa0w \x1c q", "w " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_fingerprint_in_blocks(monkeypatch):
    rnd = random.Random(1)
    text = " ".join(rnd.choice(["ab", "Cd", "é", "x"]) for _ in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole == brute_print(text)


def _docs(spark, texts):
    rows = [(i, t, "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp string")


@pytest.mark.parametrize("bucket", [2, 24])
def test_near_duplicates_against_all_pairs(spark, bucket):
    rnd = random.Random(7)
    base = [" ".join(rnd.choice("abcdefgh") + rnd.choice("ijklm") for _ in range(60)) for _ in range(12)]
    texts = [None, "", "one", "One", "two words"] + base
    for b in base:
        words = b.split()
        for _ in range(6):
            w = list(words)
            w[rnd.randrange(60)] = "zz"
            texts.append(" ".join(w))
        texts.append(b.upper())
    docs = [(i * 3, t) for i, t in enumerate(texts)]
    want = brute_components({i: brute_print(t) for i, t in docs})
    got = {r.doc_id: r for r in simhash.near_duplicates(_docs(spark, docs), bucket=bucket).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == {i: brute_print(t) for i, t in docs}


def test_links_in_heavy_buckets(spark):
    """A ball of fingerprints around one centre, all in the same buckets."""
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    fps = {centre}
    while len(fps) < 120:
        x = centre
        for _ in range(rnd.randint(1, 4)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    fps = {i: f for i, f in enumerate(sorted(fps))}
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    prints = spark.createDataFrame([(signed(f), i) for i, f in fps.items()], "fp long, rep long")
    want = brute_components(fps)
    for bucket in (1, 5, 1000):
        edges = simhash.links(prints, 2, bucket)
        pairs = {(r.u, r.v) for r in edges.collect()}
        assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in pairs)
        got = {i: i for i in fps} | {r.node: r.component for r in components(edges).collect()}
        assert got == want


def test_keep_first(spark):
    docs = _docs(spark, [(5, "a b c d"), (3, "A b c d"), (9, "other words here now"), (9, "other words here now"), (None, "a b c d")])
    assert sorted((r.doc_id is None, r.doc_id) for r in simhash.keep_first(docs).collect()) == [(False, 3), (False, 9), (True, None)]


def test_empty(spark):
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0
    assert simhash.keep_first(_docs(spark, [])).count() == 0


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {199: 199, 200: 199}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hex(spark):
    row = spark.range(1).select(simhash.as_hex(F.lit(-1).cast("long")), simhash.as_hex(F.lit(10).cast("long"))).first()
    assert tuple(row) == ("f" * 16, "0" * 15 + "a")
