import random

from marlstone.llm import line_dedup


def brute_runs(lines, long_words):
    """Places of all runs of two lines or more with so many words, by their text."""
    real = [(i, x) for i, x in enumerate(lines) if x.strip(" ")]
    for s in range(len(real)):
        for e in range(s + 1, len(real)):
            if sum(len(x.split()) for _, x in real[s : e + 1]) > long_words:
                yield tuple(x for _, x in real[s : e + 1]), [i for i, _ in real[s : e + 1]]


def test_shortest_runs_cover_all_runs():
    rnd = random.Random(4)
    for _ in range(300):
        lines = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 5))) for _ in range(rnd.randint(0, 12))]
        found = line_dedup.shortest_runs("\n".join(lines), 6)
        for _, places in brute_runs(lines, 6):
            inside = {p for _, at in found if set(at) <= set(places) for p in at}
            alone = {p for p in places if len(lines[p].split()) > 6}
            assert inside | alone == set(places)


def test_stage_removes_passages_of_several_lines(spark):
    import corpus_pipeline

    prose = lambda n, c: " ".join(f"{c}{i}" for i in range(n))
    passage = [prose(39, "p"), "", prose(20, "q")]
    short = [prose(30, "s"), prose(20, "t")]  # 50 words aren't over 50
    copy = "\n".join([prose(30, "c"), prose(60, "d"), prose(25, "e"), prose(5, "f")])
    rows = [(1, "\n".join(["own 1", *passage])), (2, "\n".join(["own 2", *passage, "end 2"])), (3, "\n".join(short)), (4, "\n".join(["x", *short]))]
    rows += [(5, copy), (6, copy), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_lines(spark, docs, "").collect()}
    want = dict(rows) | {2: "own 2\n\nend 2", 6: ""}
    assert got == {i: (t, len(t or "")) for i, t in want.items()}
