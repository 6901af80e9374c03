"""Toxicity by a counterfactually regularised linear classifier.

A logistic regression over the words of a text and their beginnings. Each labelled
text gets counterfactual twins: where it mentions identity terms, these are swapped
for others of their group; where it mentions none, a neutral mention of one is put
in. Training penalises the squared change of the logit between a text and its
twins, so that a group's name by itself, or a beginning that it shares with other
words, moves no score and neutral mentions stop being false positives
(:func:`mention_alarms` measures that).

The classifier is fitted on at most about ``max_rows`` labelled rows (a hash
threshold over all labelled rows, so that the choice doesn't depend on order);
features are chosen by their document frequencies among these rows. Scoring
covers every whole text.

Defined cases: null and empty texts have no words and get the score of the
intercept; labels whose ``toxic`` or ``doc_id`` is null, or whose document is
missing, are not used; repeated rows are scored alike; no usable labels give
the score 0 everywhere; an empty table gives an empty one. Columns of the input
pass through :func:`score`, which adds one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..session import reach_workers
from .common import materialise, unused

THRESHOLD = 0.3
MAX_ROWS = 12_000
MAX_FEATURES = 2_000
#: Lengths of word beginnings that count as features.
STEMS = (4, 5, 6, 7, 8)
#: Least z value of a feature's log odds ratio.
LEAST_Z = 3.5
CACHE = 150_000

# Identity terms by group; a term is swapped for others of its group.
IDENTITY = (
    ("woman", "man", "girl", "boy", "female", "male", "transgender", "nonbinary"),
    ("women", "men", "girls", "boys", "females", "males"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
    ("frau", "mann", "mädchen", "junge"),
    ("muslime", "christen", "juden", "hindus"),
    ("femme", "homme", "fille", "garçon"),
    ("musulman", "chrétien", "juif", "hindou"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmán", "cristiano", "judío", "budista"),
)

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in STEMS if len(word) > k)]


def swaps(found: set[str], groups=IDENTITY, turn: int = 0) -> set[str] | None:
    """The words with each identity term replaced; None if there is none."""
    out, hit = set(found), False
    for group in groups:
        for i, term in enumerate(group):
            if term in found:
                hit = True
                out.discard(term)
                out.add(group[(i + 1 + turn % (len(group) - 1)) % len(group)])
    return out if hit else None


TERMS = tuple(t for g in IDENTITY for t in g)


def mentions(text: str | None, turns: int = 2) -> list[str]:
    """Identity terms to put into a text that has none, by a hash of the text."""
    start = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
    return [TERMS[(start + turn * (len(TERMS) // 2 + 1)) % len(TERMS)] for turn in range(turns)]


def twins(text: str | None, found: set[str], turns: int = 2) -> list[set[str]]:
    """Word sets of the counterfactuals of a text with the words ``found``."""
    if found.isdisjoint(TERMS):
        return [found | {t} for t in mentions(text, turns)]
    return [x for turn in range(turns) if (x := swaps(found, turn=turn))]


def change(own, twin) -> tuple[list[int], list[int]]:
    """Features that a twin has more, and fewer, than its text."""
    return sorted(set(twin) - set(own)), sorted(set(own) - set(twin))


@dataclass
class Model:
    """``weights`` by feature; a text's logit adds those of its features, each once."""

    bias: float
    weights: dict[str, float]
    cache: dict[str, tuple] = field(default_factory=dict, repr=False)
    #: First characters of all features; a word of another start has none.
    heads: frozenset = frozenset()

    def __post_init__(self):
        self.heads = frozenset(f.removeprefix("^")[: STEMS[0]] for f in self.weights)

    def _of(self, word: str) -> tuple:
        got = tuple(f for f in features(word) if f in self.weights)
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = got
        return got

    def hits(self, found: set[str]) -> set[str]:
        get, own, heads, k = self.cache.get, self._of, self.heads, STEMS[0]
        out: set[str] = set()
        for w in [w for w in found if w[:k] in heads]:
            fs = get(w)
            if fs is None:
                fs = own(w)
            if fs:
                out.update(fs)
        return out

    def score(self, text: str | None) -> float:
        z = self.bias + sum(sorted(self.weights[f] for f in self.hits(words(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}


def fit(
    rows: list[tuple[int, list[int]]],
    changes: list[tuple[list[int], list[int]]],
    names: list[str],
    l1: float = 2e-4,
    balance: float = 1.0,
    steps: int = 400,
) -> Model:
    """``rows``: (label, features); ``changes``: what a counterfactual has more and
    fewer (:func:`change`).

    Proximal Adam on the mean log loss, plus ``balance`` times the mean squared
    logit change over the counterfactuals, with an L1 penalty."""
    if not rows or len({y for y, _ in rows}) < 2:
        return Model(-500.0 if not rows or rows[0][0] == 0 else 500.0, {})
    y = np.array([r[0] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    col = np.array([c for _, f in rows for c in f], int)
    twin_at = np.repeat(np.arange(len(changes)), [len(a) + len(b) for a, b in changes])
    twin_col = np.array([c for a, b in changes for c in (*a, *b)], int)
    sign = np.array([s for a, b in changes for s in [1.0] * len(a) + [-1.0] * len(b)])
    n, k = len(rows), len(names)
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.bincount(at, w[col], n) + b
        g = (1 / (1 + np.exp(-z)) - y) / n
        grad = np.bincount(col, g[at], k)
        if len(changes):
            moved = np.bincount(twin_at, w[twin_col] * sign, len(changes)) * (2 * balance / len(changes))
            grad += np.bincount(twin_col, moved[twin_at] * sign, k)
        full = np.append(grad, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = w - step[:k]
        w = np.sign(w) * np.maximum(np.abs(w) - 0.1 * l1 / (np.sqrt(v[:k] / (1 - 0.999**t)) + 1e-3), 0)
        b -= step[k]
    return Model(float(b), {f: float(x) for f, x in zip(names, w) if x})


def mention_alarms(texts: list[str | None], model: Model, threshold: float | None = None) -> tuple[int, int]:
    """Of texts that aren't flagged: how many mentions put into them, and how many
    of those flag their text."""
    limit, tried, flagged = THRESHOLD if threshold is None else threshold, 0, 0
    for text in texts:
        if model.score(text) >= limit:
            continue
        for term in TERMS:
            tried += 1
            flagged += model.score(f"{text or ''} {term}") >= limit
    return tried, flagged


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``text, toxic`` of at most about ``max_rows`` labelled documents, without
    those held out. The label table is cut to this bound, then broadcast."""
    usable = labels.where("doc_id is not null and toxic is not null").select(
        F.col("doc_id").alias("id__"), F.col("toxic").cast("int").alias("toxic__")
    )
    usable = usable.where(~held_out(F.col("id__")))
    share = min(1.0, max_rows / max(usable.count(), 1))
    cut = int(share * 2**32)
    chosen = usable.where(F.pmod(F.xxhash64("id__"), F.lit(2**32)) < cut)
    return docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("id__")).select("text", F.col("toxic__").alias("toxic"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _frequencies(batches):
    counts, rare = ({0: Counter(), 1: Counter()} for _ in range(2))
    rows = Counter()
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            y = int(y == 1)
            rows[y] += 1
            found = words(text)
            counts[y].update({f for w in found for f in features(w)})
            for twin in twins(text, found):  # so that terms named by twins only have counts
                rare[y].update({f for w in twin - found for f in features(w)})
    names = list(counts[0].keys() | counts[1].keys() | rare[0].keys() | rare[1].keys())
    out = [names + [""], [counts[1][f] for f in names] + [rows[1]], [counts[0][f] for f in names] + [rows[0]]]
    for at in range(0, len(out[0]), 50_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0][at : at + 50_000], pa.string()), *(pa.array(x[at : at + 50_000], pa.int64()) for x in out[1:])],
            ["feature", "pos", "neg"],
        )


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, balance: float = 1.0) -> Model:
    reach_workers(docs.sparkSession)
    sample = materialise(labelled(docs, labels, max_rows))
    totals = (
        sample.mapInArrow(_frequencies, "feature string, pos bigint, neg bigint")
        .groupBy("feature")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    totals = materialise(totals)
    counted = totals.where("feature = ''").first()
    if counted is None or not (counted.pos or counted.neg):
        return Model(-500.0, {})
    a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
    c, d = F.lit(counted.pos) - F.col("pos") + 0.5, F.lit(counted.neg) - F.col("neg") + 0.5
    z = F.abs(F.log(a / F.greatest(c, F.lit(0.5))) - F.log(b / F.greatest(d, F.lit(0.5)))) / F.sqrt(1 / a + 1 / b + 1 / F.greatest(c, F.lit(0.5)) + 1 / F.greatest(d, F.lit(0.5)))
    ranked = totals.where("feature <> ''").withColumn("z", z)
    top = ranked.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    names = sorted({r.feature for r in top.collect()} | {r.feature for r in ranked.where(F.col("feature").isin(*TERMS)).collect()})
    place = {f: i for i, f in enumerate(names)}

    def index(batches):
        seen = Model(0.0, dict.fromkeys(names, 1.0))
        for batch in batches:
            y, own, more, less = [], [], [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                had = seen.hits(found)
                y.append(int(label == 1))
                own.append(sorted(place[f] for f in had))
                changes = [change(had, (had if found <= x else set()) | seen.hits(x - found if found <= x else x)) for x in twins(text, found)]
                more.append([[place[f] for f in a] for a, _ in changes])
                less.append([[place[f] for f in b] for _, b in changes])
            kinds = pa.int32(), pa.list_(pa.int32()), *[pa.list_(pa.list_(pa.int32()))] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((y, own, more, less), kinds)], ["y", "own", "more", "less"])

    got = sample.mapInArrow(index, "y int, own array<int>, more array<array<int>>, less array<array<int>>").collect()
    got.sort(key=lambda r: (r.y, r.own, r.more, r.less))  # the same sum whatever the order of tasks
    rows = [(r.y, r.own) for r in got]
    return fit(rows, [x for r in got for x in zip(r.more, r.less)], names, balance=balance)


def score(docs: DataFrame, model: Model, into: str = "score__") -> DataFrame:
    """``docs`` with a column ``into`` (0 to 1); an input that has it raises."""
    if into in docs.columns:
        raise ValueError(f"the input has {into}")
    reach_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES and the identity terms
    at = docs.columns.index("text")

    def run(batches):
        own = shared.value
        for batch in batches:
            values = [own.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, into])
        own.cache.clear()  # the worker outlives its task

    schema = StructType([*docs.schema.fields]).add(into, DoubleType())
    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows of a score of ``threshold`` or more."""
    into = unused(docs, "score__")
    return score(docs, train(docs, labels), into).where(F.col(into) < threshold).drop(into)
