import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from marlstone.llm import decontaminate, line_dedup, pii, secrets, token_counts, toxicity
from marlstone.llm.common import row_key

public_tokenizers = pytest.importorskip("public_tokenizers")


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items):
    doc, hit, names = words(text), set(), set()
    for item, body in items:
        w = words(body)
        span = min(len(w), 13)
        for o in range(len(w) - span + 1) if span else ():
            for s in range(len(doc) - span + 1):
                if doc[s : s + span] == w[o : o + span]:
                    hit |= set(range(s, s + span))
                    names.add(str(item))
    n = len(doc)
    return n, len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= n


def test_contamination(spark):
    rnd = random.Random(1)
    vocab = ["the", "Of", "É", "é", "x1", "zeta", "K", "k"]
    make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(1, make(20)), (2, make(13)), (3, "Short item, Only"), (4, ""), (None, make(15)), (5, None), (10, make(40)), (6, "the the the the")]
    docs = [(0, None), (1, ""), (2, "!?"), (3, items[0][1]), (4, make(50) + " " + items[6][1].upper() + " " + make(9)), (5, "a SHORT item only b"),
            (6, make(400)), (7, items[6][1][20:]), (8, "the " * 200), (8, "the " * 200), (None, items[1][1]), (9, items[0][1] + " " + items[0][1])]
    frame = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, doc_key string")
    got = decontaminate.contamination(frame, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, span int")).collect()
    named = [x for x in items if x[0] is not None]
    for r in got:
        text = next(t for i, t in docs if i == r.doc_id)
        want = brute_hits(text, items)
        assert (r.n_words, r.n_hit, r.contaminated) == (want[0], want[1], want[4]), r
        if r.doc_id is not None:
            assert r.items_sha256 == brute_hits(text, named)[3]
    assert len(got) == len(docs)
    kept = decontaminate.drop_contaminated(frame.drop("doc_key"), spark.createDataFrame(named, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text"] and kept.count() == sum(not brute_hits(t, named)[4] for _, t in docs)


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(docs, none).collect()] == [0]
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def test_proximity(spark):
    docs = decontaminate.keyed(spark.createDataFrame([(1, "p q r filler s"), (2, "s x x x x x x p x q"), (3, "p p p")], "doc_id long, text string"))
    items = spark.createDataFrame([(7, "p q s"), (8, "p unseen q")], "item_id long, text string")
    got = decontaminate.proximity_matches(docs, items, terms=3, within=6).join(docs, "doc_key").collect()
    assert [(r.doc_id, r.item_id, r.least_span) for r in got] == [(1, 7, 5)]


# --- lines


def test_lines(spark):
    shared, passage = "All rights kept.", " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own {i}\n{shared}\n\nx", f"s{i}", 1) for i in range(9)]
    rows += [(20, f"a\n{passage}\nrare", "s1", 1), (21, f"{passage}\nb\nrare", "s1", 1), (22, None, "s1", 1), (23, "", "s2", 1), (24, f"{passage}\n{passage}", None, 1), (24, f"{passage}\n{passage}", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, gone int")
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(rows) and set(docs.columns) < set(got[0].asDict())
    by = {r.doc_id: r for r in got}
    assert by[0].text == f"own 0\n{shared}\n\nx" and by[3].text == "own 3\n"  # x stands on nine sites too
    assert by[20].text == f"a\n{passage}\nrare" and by[21].text == "b\nrare"
    assert by[22].text is None and by[23].text == "" and by[24].text == ""
    assert (by[0].n_removed__, by[3].n_lines__, by[3].n_removed__) == (0, 4, 2)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_near_threshold_is_exact(spark):
    rows = [(100 * n + i, f"line {n}", f"s{i}") for n in range(3, 14) for i in range(n)]
    found = line_dedup.lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert line_dedup.spread(found, line_dedup.line_table(found)).count() == sum(n >= line_dedup.MIN_SITES for n in range(3, 14))


# --- token counts


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(1)
    parts = ["a", " ", "\n", "b1", "'s", "'LL", "é", "É", "\xa0", "?!", "<|endoftext|>", "<|start", "\x1c", "\x85", "Σ", "İ", "漢", "😀", "²", "aaaa", "hehehe", "THE"]
    texts = [None, "", "a" * 3000] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    small = token_counts.WordBpe(path, cache=5)
    assert small.counts(texts) == [got[i][1] for i in range(len(texts))]
    assert token_counts.token_counts(docs.limit(0), path).count() == 0


# --- personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_base_spans():
    rnd = random.Random(2)
    parts = ["a", "@", ".", "1", "2", "255", "256", " ", "-", "+", "(", ")", "b.c", "4111111111111111", "é", "%", "_", "٣", "0004"]
    for _ in range(8000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("1" * 100_000) == [] and pii.base_spans("a" * 100_000 + "@") == []


def test_field_on_held_out_rows_and_viterbi():
    field = pii.default_field()
    table = pii.labelled_table(seed=99, rows=200)
    guess = field.decode([w for w, _ in table])
    right = sum(a == b for (_, y), p in zip(table, guess) for a, b in zip(y, p))
    assert right / sum(len(y) for _, y in table) > 0.98
    # Viterbi against all paths of short sequences
    import itertools

    for ws, _ in table[:6]:
        ws = ws[:4]
        e = field.scores([ws])[0]
        paths = itertools.product(range(len(field.labels)), repeat=len(ws))
        best = max(paths, key=lambda p: field.enter[p[0]] + sum(e[i, y] for i, y in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:])))
        assert [field.labels[i] for i in best] == field.decode([ws])[0]


def test_sentences_that_cant_hold_a_span():
    """Whole texts, against decoding every sentence."""
    field, rnd = pii.default_field(), random.Random(6)
    table = [ws for ws, _ in pii.labelled_table(seed=5, rows=300)]
    plain = ["the", "und", "Ebene", "garden", "was", "los", "ces", "Mr.", "Name", "über", "X.", "a.b", "12", "don't", "!", "straße"]
    texts = ["", " \n", "."]
    for _ in range(400):
        ws = rnd.choice(table) + [rnd.choice(plain) + rnd.choice(["", "", ",", ".", "?"]) for _ in range(rnd.randint(0, 60))]
        texts.append(rnd.choice([" ", "\n", "  "]).join(ws if rnd.random() < 0.6 else ws[-20:]))
    reader, settled = pii.Reader(field), 0
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        split = [t.split() for t in part]
        found = reader.sequences(split)
        assert [(i, w) for i, a, b, _ in found for w in split[i][a:b]] == [(i, w) for i, ws in enumerate(split) for w in ws]
        for (i, a, b, scores), labels in zip(found, field.decode([split[i][a:b] for i, a, b, _ in found])):
            settled += scores is None
            assert scores is not None or set(labels) == {"O"}, split[i][a:b]
            assert scores is None or np.allclose(scores, field.scores([split[i][a:b]])[0])
    assert settled > 300
    text = "x " * 50_000 + "call (407) 555-7710 now. " + "y " * 50_000 + "Dr. Ana Lopez lives at 12 Elm Street."
    got = [(k, text[a:b]) for k, a, b in pii.added_spans([text], field)[0]]
    assert ("phone", "(407) 555-7710") in got and ("name", "Dr. Ana Lopez") in got
    many = " ".join(f"call (407) 555-77{i % 90 + 10} now. from 1.2.3.{i % 200} it was." for i in range(20_000))
    base, every = pii.spans([many], field)[0]
    assert len(base) == 20_000 and len(every) > 30_000


def test_pii_rows(spark):
    texts = [None, "", "mail jo.e@ex.org, call (407) 555-7710 now", "+1 (826) 555-4081 190.137.223.20", "plain words only"]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert got[0].spans == got[1].spans == got[4].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].n_email == 1 and "email:5:16" in got[2].spans and got[2].n_added == 1 and "phone:23:37" in got[2].spans
    assert got[3].n_ip == 1 and got[3].n_phone == 0 and "phone:0:17" in got[3].spans
    assert pii.find(docs.limit(0)).count() == 0


# --- secrets


def brute_candidates(text):
    found = {m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", text) if re.search("[0-9]", m[0])}
    found |= {m.span(1) for m in re.finditer(r"(?i)(?:token|secret|passw(?:or)?d|passphrase|credential|key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{8,})", text)}
    out = []
    for a, b in sorted(found, key=lambda s: (s[0] - s[1], s)):
        b = a + len(text[a:b].rstrip("\"'`,;.!?&$#%*)]}"))
        if b - a >= 8 and all(b <= c or d <= a for c, d in out):
            out.append((a, b))
    return sorted(out)


def test_candidates_and_dictionary():
    rnd = random.Random(7)
    parts = ["token", "=", " ", '"', "a1", "key: ", "abcdef0123456789", "secret=", "/", ".", "zz", ",", "-"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20)))
        assert secrets.candidates(t) == brute_candidates(t), t
    assert len(secrets.candidates(" ".join(f"token={i:016d}" for i in range(100_000)))) == 100_000
    words = secrets.Words({"apple": 3, "pear": 1, "plea": 2})
    for _ in range(300):
        low = "".join(rnd.choice(["appl", "e", "pear", "plea", "x", "9", "-"]) for _ in range(rnd.randint(1, 9)))
        spots = {i for w in words.known for a in range(len(low)) if low.startswith(w, a) for i in range(a, a + len(w))}
        assert abs(words.covered(low)[0] - len(spots) / len(low)) < 1e-12, low
    assert words.likely("apple") > words.likely("xqzkv") and words.likely("") == words.likely("12") == -np.log10(26)


def test_forest_and_scan(spark):
    lots = spark.createDataFrame([(i, f"garden window river {'stone' if i % 2 else 'cloud'} rare{i}q") for i in range(40)], "doc_id long, text string")
    words = secrets.dictionary(lots)
    assert words.known == {"garden", "window", "river", "stone", "cloud", "rare"}
    forest = secrets.train(secrets.labelled_findings(words), words)
    held = secrets.labelled_findings(words, 77, 400, held_out=True)
    x = np.array([secrets.features(t, a, b, words) for t, a, b, _ in held])
    y = np.array([s for *_, s in held])
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.9
    for row in x[:20]:  # trees walked one by one
        total = 0.0
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.cut[at] else forest.right[at]
            total += forest.share[at]
        assert abs(total / len(forest.roots) - forest.score(row[None])[0]) < 1e-12
    key = "f91f2b873bc89b9c5b8b3a486adf32c8523be758"
    texts = [None, "", f'set token = "{key}" here', f"commit {key} fixed it", "7831179344661714"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, findings int")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert [got[i].n_candidates for i in range(5)] == [0, 0, 1, 1, 1]
    assert [len(got[i].findings) for i in range(5)] == [0, 0, 1, 0, 0]
    f = got[2].findings[0]
    assert texts[2][f.start : f.end] == key and f.sha256 == hashlib.sha256(key.encode()).hexdigest()
    assert secrets.scan(docs.limit(0)).count() == 0


# --- toxicity


def test_counterfactuals_free_identity_terms():
    rnd = random.Random(3)
    filler = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(600):
        ws = rnd.sample(filler, 12)
        toxic = i % 3 == 0
        if toxic:
            ws.append(rnd.choice(["moron", "scum"]))
        if rnd.random() < (0.8 if toxic else 0.1):  # labels lean on the group's name
            ws.append("muslim")
        rows.append((int(toxic and rnd.random() < 0.9), set(ws)))
    names = sorted({f for _, ws in rows for w in ws for f in toxicity.features(w)} | {f for g in toxicity.IDENTITY for t in g for f in toxicity.features(t)})
    place = {f: i for i, f in enumerate(names)}
    index = lambda ws: sorted(place[f] for w in ws for f in toxicity.features(w))
    own = [(y, index(ws)) for y, ws in rows]
    twins = [toxicity.change(index(ws), index(t)) for _, ws in rows for k in range(2) if (t := toxicity.swaps(ws, turn=k))]
    plain, balanced = toxicity.fit(own, [], names), toxicity.fit(own, twins, names)
    shift = lambda m: abs(m.score("muslim w1 w2") - m.score("christian w1 w2"))
    assert shift(balanced) < 0.2 * shift(plain)
    assert balanced.score("moron w1 w2") > 0.5 > balanced.score("muslim w1 w2")
    assert toxicity.swaps({"w1"}) is None


def test_mentions_put_in_free_shared_beginnings():
    """No text names a group, but the toxic word begins like a group's name."""
    rnd = random.Random(4)
    filler = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(400):
        ws = set(rnd.sample(filler, 10))
        if i % 3 == 0:
            end = lambda: "".join(rnd.choice("bcdfgh") for _ in range(5))
            ws |= {"woma" + end()} | ({"vile" + end()} if rnd.random() < 0.9 else set())
        rows.append((int(i % 3 == 0), ws))
    names = sorted({f for _, ws in rows for w in ws for f in toxicity.features(w)} | set(toxicity.TERMS))
    place = {f: i for i, f in enumerate(names)}
    index = lambda ws: sorted({place[f] for w in ws for f in toxicity.features(w) if f in place})
    own = [(y, index(ws)) for y, ws in rows]
    changes = [toxicity.change(index(ws), index(t)) for _, ws in rows for t in toxicity.twins(" ".join(sorted(ws)), ws)]
    assert len(changes) == 2 * len(rows)
    clean = [" ".join(ws) for y, ws in rows if not y]
    alarms = [toxicity.mention_alarms(clean, toxicity.fit(own, c, names)) for c in ([], changes)]
    assert alarms[0][1] > 0 == alarms[1][1] and alarms[0][0] == alarms[1][0]
    assert toxicity.fit(own, changes, names).score("w1 w2 w3 vilest") > 0.5


def test_penalty_is_the_squared_change():
    """The gradient of the penalty, by differences of its plain form."""
    rnd = random.Random(9)
    rows = [(i % 2, sorted(rnd.sample(range(6), 3))) for i in range(10)]
    pairs = [(i, sorted(rnd.sample(range(6), 3))) for i in range(10)]
    changes = [toxicity.change(rows[i][1], t) for i, t in pairs]
    w = np.array([rnd.random() for _ in range(6)])
    plain = lambda w: np.mean([(w[t].sum() - w[rows[i][1]].sum()) ** 2 for i, t in pairs])
    moved = [w[a].sum() - w[b].sum() for a, b in changes]
    assert np.isclose(plain(w), np.mean(np.square(moved)))
    strong = toxicity.fit(rows, changes, list("abcdef"), l1=0.0, balance=1e4)
    value = lambda m: np.array([m.weights.get(c, 0.0) for c in "abcdef"])
    assert plain(value(strong)) < 0.05 * plain(value(toxicity.fit(rows, [], list("abcdef"), l1=0.0)))


def test_columns_of_operators_names_stay(spark):
    import corpus_pipeline

    rows = [(i, f"own {i} words here\nshared line", "en", f"s{i}", 30, 7, 8, 9, "k", "g") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines__ int, n_removed__ int, score__ int, doc_key string, gone string")
    for out in (corpus_pipeline.repeated_lines(spark, docs, ""), toxicity.drop_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int")),
                decontaminate.drop_contaminated(docs, spark.createDataFrame([], "item_id long, text string"))):
        assert out.columns == docs.columns
        assert {(r.n_lines__, r.n_removed__, r.score__, r.doc_key, r.gone) for r in out.collect()} == {(7, 8, 9, "k", "g")}
    for call in (lambda: line_dedup.dedup_lines(docs), lambda: toxicity.score(docs, toxicity.Model(0.0, {}))):
        with pytest.raises(ValueError, match="the input has"):
            call()


def test_toxicity_rows(spark):
    rnd = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        docs.append((i, " ".join(rnd.choice(["aa", "bbbb", "cc dd"]) for _ in range(20)) + (" Idiot!" if toxic else ""), "q"))
        labels.append((i, int(toxic)))
    docs += [(None, None, "q"), (1000, "", "q"), (1000, "", "q")]
    labels += [(None, 1), (5000, 1), (3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(d, toxicity.train(d, lab)).collect()
    assert len(got) == len(docs) and all(0 <= r.score__ <= 1 for r in got)
    for r in got:
        if r.doc_id is not None and r.doc_id < 400:
            assert (r.score__ >= toxicity.THRESHOLD) == (r.doc_id % 4 == 0)
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and kept.count() == 303
    assert {r.score__ for r in toxicity.score(d, toxicity.train(d, lab.limit(0))).collect()} == {toxicity.Model(-500.0, {}).score("")}
    flags = {r.doc_id: r.h for r in d.where("doc_id is not null").select("doc_id", toxicity.held_out(d.doc_id).alias("h")).collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in flags}


def test_row_key_is_never_null(spark):
    df = spark.createDataFrame([(None, None), (1, "a")], "doc_id long, text string")
    assert df.select(row_key("doc_id", "text").alias("k")).where("k is null").count() == 0
