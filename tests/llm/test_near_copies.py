import random

import numpy as np
import pytest

from marlstone.llm import near_copies


def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or (bool(a | b) and len(a & b) >= 0.8 * len(a | b))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string")


@pytest.mark.parametrize("bucket,chunk", [(2, 3), (2, 256), (32, 256)])
def test_keep_first_against_all_pairs(spark, bucket, chunk):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = [None, "", " ", "one", "One", "two words", "a b c d e", "A b c d e"]
    for n in (60, 200, 600):
        for _ in range(3):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for share in (0.003, 0.01, 0.02, 0.03):  # of words replaced
                for _ in range(3):
                    texts.append(" ".join(word() if rnd.random() < share else w for w in base))
    docs = list(enumerate(texts))
    sets = {i: brute_set(t) for i, t in docs}
    comp = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])]
    for _ in sets:
        for a, b in near:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert sum(sets[a] != sets[b] for a, b in near) > 100
    kept = near_copies.keep_first(_docs(spark, docs), bucket=bucket, chunk=chunk)
    assert kept.columns == ["doc_id", "text", "id"]
    assert {r.doc_id for r in kept.collect()} == set(comp.values())


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n)) for n in (0, 5, 40, 40, 9, 1)]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(6), [len(x) for x in sets])
    got = near_copies.overlaps(flat, owner, np.array([1, 2, 5]), np.arange(6))
    assert all(got[k, j] == len(np.intersect1d(sets[i], sets[j])) for k, i in enumerate((1, 2, 5)) for j in range(6) if i != j)


def test_stage_links_near_copies_of_long_texts(spark):
    import corpus_pipeline

    rnd = random.Random(6)
    base = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    near = list(base)
    for i in (50, 150, 250, 350):
        near[i] = "changed"
    other = [f"v{rnd.randrange(5000)}" for _ in range(400)]
    docs = _docs(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other))])
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 3]


def test_repeated_ids_null_ids_and_nothing(spark):
    rows = [(1, "a b c d e f"), (1, "other words stand here in it"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, "a b c d e f")]
    got = near_copies.keep_first(_docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, rows[0][1])] * 2 + [(1, rows[0][1]), (1, rows[1][1])]
    assert near_copies.keep_first(_docs(spark, [])).count() == 0
