"""Secret scans: candidates by patterns, false positives removed by a random forest.

Patterns propose strings that look like keys, tokens or passwords. Each becomes a
feature row: length, kinds of characters and changes between them, how likely its
neighbouring letters are and how much of it dictionary words cover, entropy, how it
lies in paths and addresses, and what the neighbouring words say. The dictionary is
the corpus's own (:func:`dictionary`): words that stand in at least one of
``RARE`` documents, counted over all; letter pairs are counted in these words. A
random forest trained from labelled findings (the table below, or the caller's, of
at most ``MAX_FINDINGS`` rows) keeps those that are secrets.

Defined cases: null and empty texts have no candidates; overlapping candidates
of the patterns count once, the longer first, of equally long ones the earlier;
repeated rows are judged alike; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reach_workers

THRESHOLD = 0.5
MAX_FINDINGS = 20_000
TREES, DEPTH, LEAF = 40, 9, 2

_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_SET = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passphrase|credential|key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{8,})")
_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
_DIGIT = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[a-z]{4,}")
_NEAR = re.compile(r"[A-Za-z][A-Za-z0-9_]*")

#: A dictionary word stands in one of so many documents at least, so that there are at
#: most ``RARE`` times as many words as the mean document has different ones.
RARE = 1000
WORD_LENGTHS = range(4, 13)

# Neighbouring words.
FOR = frozenset("token secret password passwd passphrase credential credentials key apikey api_key api access auth authorization bearer private aws github stripe slack login pwd".split())
AGAINST = frozenset("commit sha sha1 sha256 md5 checksum hash digest revision uuid guid id isbn order invoice card example sample test dummy placeholder version etag build page image integrity".split())
# Beginnings that issuers give their keys.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "sk_live_", "rk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "glpat-", "eyJ", "npm_", "hf_")
FEATURES = (
    "length", "entropy", "digits", "upper", "lower", "other", "transitions", "longest_run", "distinct", "hex", "digits_only", "dictionary", "pairs",
    "longest_word", "slashes", "dots", "in_path", "uuid", "prefix", "assigned", "quoted", "for", "against", "vowels",
)


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Ranges of candidate strings, in order, without overlaps."""
    if not text:
        return []
    found = [(m.start(), m.end()) for m in _RUN.finditer(text) if _DIGIT.search(m[0])]
    found += [m.span(1) for m in _SET.finditer(text)]
    found += [m.span() for m in _BLOCK.finditer(text)] if "PRIVATE KEY" in text else []
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(found), key=lambda s: (-(s[1] - s[0]), s)):
        # decorations around a value aren't part of it
        while b > a and text[b - 1] in "\"'`,;.!?&$#%*)]}":
            b -= 1
        at = bisect_left(out, (b,))  # those before it begin before the end; they don't overlap each other
        if b - a >= 8 and (not at or out[at - 1][1] <= a):
            insort(out, (a, b))
    return out


class Words:
    """Dictionary words and the likelihood of neighbouring letters in them."""

    def __init__(self, counts: dict[str, int]):
        self.known = frozenset(counts)
        pairs = np.ones((26, 26))
        for w, n in counts.items():
            at = np.frombuffer(w.encode(), np.uint8).astype(int) - 97
            np.add.at(pairs, (at[:-1], at[1:]), n)
        self.pairs = np.log10(pairs / pairs.sum(1, keepdims=True))

    def covered(self, low: str) -> tuple[float, int]:
        """Share of the characters that dictionary words cover, and the longest one."""
        end, held, longest = 0, 0, 0
        for m in _LETTERS.finditer(low):
            run = m[0]
            for a in range(len(run)):
                for n in reversed(WORD_LENGTHS):
                    if a + n <= len(run) and run[a : a + n] in self.known:
                        first = max(end, m.start() + a)
                        held += max(0, m.start() + a + n - first)
                        end, longest = max(end, m.start() + a + n), max(longest, n)
                        break
        return held / max(len(low), 1), longest

    def likely(self, low: str) -> float:
        """Mean log10 likelihood of the neighbouring letters; that of random ones where
        there are none."""
        at = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8).astype(int) - 97
        both = (at[:-1] >= 0) & (at[:-1] < 26) & (at[1:] >= 0) & (at[1:] < 26)
        return float(self.pairs[at[:-1][both], at[1:][both]].mean()) if both.any() else -math.log10(26)


def dictionary(docs: DataFrame, rare: int = RARE) -> Words:
    """From all documents; see ``RARE`` for how many words that can be."""
    parts = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    wanted = F.length("word").between(WORD_LENGTHS[0], WORD_LENGTHS[-1])
    counted = docs.select(F.explode(parts).alias("word")).where(wanted).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    least = max(2, -(-docs.count() // rare))
    return Words({r.word: r.n for r in counted.where(F.col("n") >= least).collect()})


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3


def features(text: str, a: int, b: int, words: Words) -> list[float]:
    s = text[a:b]
    n = len(s)
    kinds = [_kind(c) for c in s]
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    run = best = 1
    for x, y in zip(s, s[1:]):
        run = run + 1 if x == y else 1
        best = max(best, run)
    low = s.lower()
    covered, longest = words.covered(low)
    before, after = text[max(0, a - 60) : a], text[b : b + 40]
    near = [w.lower() for w in _NEAR.findall(before)[-3:]] + [w.lower() for w in _NEAR.findall(after)[:1]]
    parts = {p for w in near for p in (w, *w.split("_"))}
    tail = before.rstrip(" \"'")
    letters = sum(c.isalpha() for c in s)
    return [
        float(n), entropy, kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n,
        sum(x != y for x, y in zip(kinds, kinds[1:])) / max(n - 1, 1), float(best), len(counts) / min(n, 64),
        float(re.fullmatch(r"[0-9a-fA-F]+", s) is not None), float(s.isdigit()), covered, words.likely(low), float(longest),
        float(s.count("/")), float(s.count(".")), float(bool(re.search(r"(?:https?:|www\.|[/\\])\S*$", before)) or after[:1] in ("/", "\\")),
        float(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s) is not None),
        float(s.startswith(PREFIXES) or s.startswith("-----BEGIN")), float(tail[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'") and after[:1] in ("\"", "'")),
        float(len(parts & FOR)), float(len(parts & AGAINST)), sum(c in "aeiouAEIOU" for c in s) / max(letters, 1),
    ]


# What labelled findings are made of; the second of each pair is for held-out ones.
SECRET_NAMES = (("api_key", "secret", "password", "access_key", "auth_token", "passphrase", "token", "SECRET_KEY", "private key"), ("client_secret", "apikey", "PASSWD", "credential", "bearer"))
OTHER_NAMES = (("commit", "sha256", "checksum", "etag", "order", "id", "image", "revision", "version", "card"), ("digest", "md5", "isbn", "build", "invoice"))
ASSIGNS = (("=", " = ", ": ", ":", " "), (" := ", " =", ":  "))
PLACEHOLDERS = (("changeme", "placeholder", "example", "your_value_here", "xxxxxxxxxxxx"), ("insert-me-please", "dummy_dummy", "not-a-real-one"))


def labelled_findings(words: Words, seed: int = 5, rows: int = 1600, held_out: bool = False) -> list[tuple[str, int, int, int]]:
    """``(text, start, end, secret)``: names, assignments, quotes and values put
    together by a rule. Held-out ones take other names, assignments and kinds of values."""
    rnd, k = random.Random(seed), int(held_out)
    pick = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexa, b64 = digits + "abcdef", digits + low + low.upper()
    known = sorted(words.known) or ["word", "other", "name", "thing"]
    word = lambda: rnd.choice(known) if rnd.random() < 0.8 else pick(low, rnd.randint(2, 9))
    phrase = lambda sep, n: sep.join(word() for _ in range(n))
    secret = [
        lambda: pick(hexa, rnd.choice((32, 40, 64)[:: 1 - 2 * k])), lambda: pick(b64, rnd.randint(20, 48)), lambda: pick(b64 + "+/", 40) + "=" * rnd.randint(0, 2),
        lambda: pick(b64 + "!?_", rnd.randint(10, 20)), lambda: rnd.choice(PREFIXES[k::2]) + pick(b64, rnd.randint(20, 36)),
        lambda: pick(hexa.upper(), 32), lambda: "-".join(pick(b64, 8) for _ in range(4)) if k else pick(b64 + "-_", 43),
    ]
    other = [
        lambda: phrase(rnd.choice(("_", "-", "")), rnd.randint(2, 4)), lambda: phrase("-", 3) + "-" + pick(digits, rnd.randint(2, 6)), lambda: rnd.choice(PLACEHOLDERS[k]) + pick(digits, rnd.randint(0, 3)),
        lambda: phrase("/", rnd.randint(3, 5)) + pick(digits, 2), lambda: f"{pick(digits, 4)}-{pick(digits, 2)}-{pick(digits, 2)}T{pick(digits, 6)}", lambda: pick(digits, rnd.randint(12, 20)),
        lambda: word() + pick(digits, 1) + word() + word(), lambda: pick("x*=-"[k : k + 2], 1) * rnd.randint(12, 24) + pick(digits, 3),
    ]
    named_other = [lambda: pick(hexa, rnd.choice((32, 40, 64))), lambda: "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), lambda: pick(digits, rnd.choice((13, 16, 18)))]
    out = []
    for _ in range(rows):
        label, kind = int(rnd.random() < 0.5), rnd.random()
        if label:
            name, value = rnd.choice(SECRET_NAMES[k]), rnd.choice(secret)()
            if value.startswith(PREFIXES) and kind < 0.5:
                name = ""
        elif kind < 0.4:
            name, value = rnd.choice(OTHER_NAMES[k]), rnd.choice(named_other)()
        else:
            name, value = rnd.choice((*SECRET_NAMES[k], "", "", "")), rnd.choice(other)()
        quote = rnd.choice(("", '"', "'")) if name else ""
        head = (name.upper() if rnd.random() < 0.2 else name) + (rnd.choice(ASSIGNS[k]) if name else "") + quote
        before = " ".join([word() for _ in range(rnd.randint(0, 5))] + [head])
        text = before + value + quote + rnd.choice((" ", ". ", "\n", ", ")) + " ".join(word() for _ in range(rnd.randint(0, 5)))
        out.append((text, len(before), len(before) + len(value), label))
    return out


class Forest:
    """Trees as flat arrays; ``left`` is the node itself at a leaf."""

    def __init__(self, feature, cut, left, right, share, roots):
        self.feature, self.cut, self.left, self.right, self.share, self.roots = feature, cut, left, right, share, roots

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves, for rows of features."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(DEPTH + 1):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.share[at].mean(1) if len(x) else np.zeros(0)


def _best_cut(x: np.ndarray, y: np.ndarray, tried: np.ndarray):
    """Of the tried features, the cut of the least Gini impurity."""
    best = (np.inf, -1, 0.0)
    n = len(y)
    for f in tried:
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        ones = np.cumsum(t)[:-1]
        size = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (size >= LEAF) & (n - size >= LEAF)
        if not ok.any():
            continue
        rest = ones[-1] + t[-1] - ones
        impurity = ones * (size - ones) / size + rest * (n - size - rest) / (n - size)
        i = int(np.argmin(np.where(ok, impurity, np.inf)))
        if impurity[i] < best[0]:
            middle = (v[i] + v[i + 1]) / 2
            best = (impurity[i], int(f), float(middle if middle < v[i + 1] else v[i]))
    return best


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 1) -> Forest:
    rng = np.random.default_rng(seed)
    nodes: list[list] = []
    roots = []
    tries = max(1, round(math.sqrt(x.shape[1])))

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([0, np.inf, me, me, float(y[rows].mean())])
        if depth < DEPTH and len(rows) >= 2 * LEAF and 0 < y[rows].sum() < len(rows):
            _, f, cut = _best_cut(x[rows], y[rows], rng.choice(x.shape[1], tries, replace=False))
            if f >= 0:
                low = x[rows, f] <= cut
                nodes[me][:4] = [f, cut, node(rows[low], depth + 1), node(rows[~low], depth + 1)]
        return me

    for _ in range(trees):
        roots.append(node(rng.integers(0, len(y), len(y)), 0))
    feature, cut, left, right, share = zip(*nodes)
    return Forest(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(share), np.array(roots))


def train(findings: list[tuple[str, int, int, int]], words: Words, trees: int = TREES) -> Forest:
    """``findings``: at most ``MAX_FINDINGS`` of ``(text, start, end, secret)``."""
    if len(findings) > MAX_FINDINGS:
        raise ValueError(f"give at most {MAX_FINDINGS} labelled findings")
    x = np.array([features(t, a, b, words) for t, a, b, _ in findings])
    return grow(x, np.array([y for *_, y in findings], float), trees)


def judge(texts: list[str | None], forest: Forest, words: Words) -> list[list[tuple[int, int, float]]]:
    """``(start, end, score)`` of the candidates of each text."""
    found = [candidates(t) for t in texts]
    rows = [features(t, a, b, words) for t, spans in zip(texts, found) for a, b in spans]
    scores = iter(forest.score(np.array(rows)) if rows else ())
    return [[(a, b, float(next(scores))) for a, b in spans] for spans in found]


def scan(docs: DataFrame, findings: list[tuple[str, int, int, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_candidates, findings``; a finding: ``start, end, score,
    sha256`` of a kept candidate (the value itself isn't spread further)."""
    words = dictionary(docs)
    forest = train(labelled_findings(words) if findings is None else findings, words)
    shared = docs.sparkSession.sparkContext.broadcast((forest, words))
    inner = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("sha256", pa.string())])

    def run(batches):
        forest, words = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, kept = [], []
            for at in range(0, len(texts), 512):
                part = texts[at : at + 512]
                for text, spans in zip(part, judge(part, forest, words)):
                    n.append(len(spans))
                    kept.append([
                        {"start": a, "end": b, "score": s, "sha256": hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()}
                        for a, b, s in spans if s >= threshold
                    ])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.list_(inner))], ["doc_id", "n_candidates", "findings"])

    reach_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_candidates bigint, findings array<struct<start: bigint, end: bigint, score: double, sha256: string>>"
    )
