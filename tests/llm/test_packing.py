import random
import zlib

import numpy as np
import pytest

from marlstone.llm import packing
from marlstone.llm.tokens import ByteBpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_ids_are_the_librarys(library):
    rnd = random.Random(4)
    parts = ["a", " ", "\n", "\t", "b1", "'s", "é", "\xa0", "!", "x.", "<|endoftext|>", "\x1c", "漢", "  ", " the"]
    bpe = ByteBpe(PATH, cache=50)
    texts = ["", " ", "  ", "a  b", "\n \n", "x \n y "] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(800)]
    assert [t for t in texts if bpe.ids(t) != ids_of(library, t)[:-1].tobytes()] == []


@pytest.mark.parametrize("n", [1, 5, 2047, 2048, 2049, 4096, 5000])
def test_cut(n):
    ids = np.arange(n, dtype="<u4")
    got = packing.cut(ids.tobytes())
    assert [p[0] for p in got] == list(range(len(got))) and sum(p[2] for p in got) == n
    assert all(p[2] == 2048 for p in got[1:])
    for _, a, length, crc in got:
        assert crc == zlib.crc32(ids[a : a + length].tobytes())


@pytest.mark.parametrize("seed", range(4))
def test_evolution_keeps_items_and_improves(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([rnd.randint(1, 2047), rnd.randint(680, 1100)]) for _ in range(300)]
    best = packing.evolve(sizes, [], seed)
    assert sorted(i for items in best.items for i in items) == list(range(300))
    for items, room in zip(best.items, best.room):
        assert sum(sizes[i] for i in items) + room == 2048 and room >= 0
    plain = packing.best_fit(sizes, 2048, sorted(range(300), key=lambda i: -sizes[i]))
    assert packing.fitness(best) <= packing.fitness(plain)
    child = packing.crossover(plain, best, sizes, rnd)
    assert sorted(i for items in child.items for i in items) == list(range(300))


def triplets(k, rnd):
    """Pieces that three by three fill bins without waste."""
    out = []
    for _ in range(k):
        a = rnd.randint(780, 1000)
        b = rnd.randint((2048 - a) // 2, min(2048 - a - 400, a))
        out += [a, b, 2048 - a - b]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_evolution_needs_fewer_bins_than_best_fit(seed):
    rnd = random.Random(seed)
    for sizes in (triplets(40, rnd), [rnd.randint(300, 1300) for _ in range(1500)]):
        best = packing.evolve(sizes, [], seed)
        assert sorted(i for items in best.items for i in items) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in items) <= 2048 for items in best.items)
        assert len(best.room) < len(packing.best_fit(sizes, 2048, sorted(range(len(sizes)), key=lambda i: -sizes[i])).room)


def test_islands_and_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 60)
    monkeypatch.setattr(packing, "GENERATIONS", 5)
    rnd = random.Random(1)
    sizes = triplets(20, rnd) + [rnd.randint(1, 900) for _ in range(200)] + [500] * 30  # ties too
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    for slack in (0, 1):
        got = packing.solve(items, len(sizes), slack=slack).toPandas()
        assert sorted(got.uid) == list(range(len(sizes))) and got.groupby(["shard", "bin"]).length.sum().max() <= 2048
        assert (got.groupby(["shard", "bin"]).length.sum() == got.groupby(["shard", "bin"]).fill.first()).all()
        for _, g in got.sort_values("offset").groupby(["shard", "bin"]):
            assert (g.offset.to_numpy() == g.length.cumsum().to_numpy() - g.length.to_numpy()).all()


def test_pack(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    rnd = random.Random(2)
    texts = [None, "", "x", "word " * 3000] + [" ".join(rnd.choice(["alpha", "b", "gamma\n"]) for _ in range(rnd.randint(1, 1500))) for _ in range(100)]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "no id", "z"), (3, texts[3], "z"), (3, texts[3], "z")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, offset string"), PATH).toPandas()
    want = sorted((str(i), *p) for i, t, _ in rows for p in packing.cut(ids_of(library, t).tobytes()))
    have = sorted((str(None if x.doc_id != x.doc_id else int(x.doc_id)), x.piece, x.start, x.length, x.ids_crc32) for x in got.itertuples())
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == g.length.cumsum().to_numpy() - g.length.to_numpy()).all()
    bound = -(-got.length.sum() // 2048)
    assert got.sequence_id.nunique() <= bound + 2 * 3  # three shards, each with bins that nothing fits into


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
