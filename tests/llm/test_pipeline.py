import random
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from marlstone.llm import simhash, toxicity  # noqa: E402


def test_stages_against_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(30)) for i in range(5)]
    passage = prose(60)
    docs = [(i, prose(80), f"s{i % 12}") for i in range(120)]
    docs += [(200 + i, prose(40) + " moron " + prose(40), "s1") for i in range(30)]
    docs += [(300 + i, docs[i][1], "s2") for i in range(5)]
    docs += [(400 + i, prose(40) + " " + items[i][1], "s3") for i in range(5)]
    docs += [(500 + i, prose(50) + "\n" + passage, f"s{i}") for i in range(4)] + [(600, None, "s1"), (601, "", "s1")]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 300)) for i, _, _ in docs if i < 300], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(d + "/benchmark.parquet")

    frame = spark.read.parquet(d + "/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, d)
        if k < 4:
            assert out.columns == frame.columns
            out.write.parquet(f"{d}/{k}")
            frame = spark.read.parquet(f"{d}/{k}")
            kept[name] = {r.doc_id: r.text for r in frame.collect()}
    clean = {i for i, _, _ in docs} - set(range(200, 300))
    assert kept["toxicity"].keys() == clean
    lines = kept["line dedup"]
    assert lines.keys() == clean and sum(passage in (t or "") for t in lines.values()) == 1
    # one of each group, by all pairs
    prints = {i: simhash.fingerprint(t) for i, t in lines.items()}
    comp = {i: i for i in prints}
    for _ in range(3):
        for a in sorted(prints):
            for b in sorted(prints):
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    comp[b] = min(comp[a], comp[b])
    assert kept["near duplicates"].keys() == set(comp.values())
    assert kept["decontamination"].keys() == kept["near duplicates"].keys() - set(range(400, 405))
    packed = out.toPandas()
    assert set(packed.doc_id) == kept["decontamination"].keys()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    again = corpus_pipeline.run(spark, d).toPandas()
    assert Counter(zip(again.doc_id, again.piece, again.ids_crc32)) == Counter(zip(packed.doc_id, packed.piece, packed.ids_crc32))
    assert toxicity.THRESHOLD == 0.3
