"""Personal data by fixed patterns and a linear-chain conditional random field.

Patterns give the base spans: e-mail and IP addresses, card and phone numbers.
A CRF over word shapes, trained from the small labelled table below, adds spans
that the patterns don't cover (phone numbers without a plus sign, numbers of
identity papers, bank accounts, masked addresses, names behind a title). Its sequences are all sentences of the whole text. Sentences where no
path can beat the one that finds nothing, by a bound on the scores of their words
(:class:`Reader`), are settled by that; the others are decoded by Viterbi in numpy,
those of equal length together.

Defined cases: null and empty texts have no spans; an added span that overlaps a
base span is dropped, base spans stay; repeated rows are judged alike; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import reach_workers

KINDS = ("email", "ip", "card", "phone", "account", "ident", "name")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str):
    """As the pattern with its local part before would match, in linear time: a
    match can only start at the first fitting character of the run before an @."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _HOST.match(text, at) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return s.replace(" ", "").replace("-", "")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)``, by kind, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# --- the field

# Words that announce personal data.
CUES = ("tel", "phone", "call", "fax", "mobile", "telefon", "anruf", "téléphone", "teléfono", "ssn", "iban", "account", "konto", "compte", "cuenta",
        "passport", "id", "nr", "no", "number", "mail", "email", "e-mail", "at", "card", "karte", "carte", "tarjeta", "version", "token", "key", "page", "year",
        "mr", "mrs", "ms", "dr", "herr", "frau", "señor", "señora", "madame", "monsieur", "name", "contact",)
_TRIM = ".,;:!?\"'|"
_CUES = frozenset(CUES)


def shape(word: str) -> str:
    """Letters as x or X, digits as d, runs of letters cut to one and of digits to five."""
    out = []
    for c in word:
        k = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        n = 0
        while n < len(out) and out[-1 - n] == k:
            n += 1
        if n < (5 if k == "d" else 1):
            out.append(k)
    return "".join(out)


def own_features(word: str) -> tuple[str, str, list[str]]:
    """Shape, cue (or the empty text) and features of a word by itself."""
    w = word.strip(_TRIM)
    s = "x" if w.isalpha() and w.islower() else shape(w)
    digits = 0 if s == "x" else sum(c.isdigit() for c in w)
    f = ["s=" + s, f"d={min(digits, 20)}", f"a={digits and digits == len(w)}{min(len(w), 20)}"]
    if 13 <= digits <= 19 and digits == len(w) and w.isascii():
        f.append(f"luhn={luhn(w)}")
    low = w.lower()
    cue = low if low in _CUES else ""
    if cue:
        f.append("c=" + cue)
    if not digits and "@" not in w:
        f.append("plain")
    return s, cue, f


def word_features(words: list[str]) -> list[list[str]]:
    """Features of each word of a sequence, those of its neighbours included."""
    own = [own_features(w) for w in words]
    out = []
    for i, (s, _, f) in enumerate(own):
        before = own[i - 1][0] if i else "<"
        after = own[i + 1][0] if i + 1 < len(own) else ">"
        f = [*f, "p=" + before + "|" + s, "n=" + s + "|" + after]
        if i and own[i - 1][1]:
            f.append("c1=" + own[i - 1][1])
        if i > 1 and own[i - 2][1]:
            f.append("c2=" + own[i - 2][1])
        out.append(f)
    return out


def labelled_table(seed: int = 11, rows: int = 900) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: words and their labels (``O``, ``B-kind``,
    ``I-kind``), filled into forms by a fixed rule."""
    rnd = random.Random(seed)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    checked = lambda x: next(x + c for c in "0123456789" if luhn(x + c))
    failing = lambda n: next(x for x in (d(n) for _ in range(99)) if not luhn(x))
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéäñ") for _ in range(n))
    cased = lambda: letters(rnd.randint(3, 9)).capitalize()
    title = lambda: rnd.choice(["Mr", "Mr.", "Mrs", "Mrs.", "Ms.", "Dr.", "Herr", "Frau", "Señor", "Señora", "Madame", "Monsieur"])
    # Forms; {…} is a place that a maker fills, a list of words of one kind.
    found = [
        ("phone", lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"]),
        ("phone", lambda: [f"{d(3)}-{d(3)}-{d(4)}"]),
        ("phone", lambda: [f"({d(3)}){d(3)}-{d(4)}"]),
        ("phone", lambda: [f"{d(3)}.{d(3)}.{d(4)}"]),
        ("phone", lambda: [f"+{d(1)}", f"({d(3)})", f"{d(3)}-{d(4)}"]),
        ("phone", lambda: [f"+{d(2)}", d(3), d(3), d(4)]),
        ("ident", lambda: [f"{d(3)}-{d(2)}-{d(4)}"]),
        ("account", lambda: [rnd.choice(["DE", "FR", "ES", "GB"]) + d(2), d(4), d(4), d(4), d(4), d(2)]),
        ("account", lambda: [rnd.choice(["DE", "FR", "ES"]) + d(20)]),
        ("email", lambda: [f"{letters(5)}{d(1)}[at]{letters(6)}.com"]),
        ("email", lambda: [f"{letters(4)}.{letters(5)}@{letters(6)}.com"]),
        ("ip", lambda: [f"{d(3)}.{d(2)}.{d(2)}.{d(3)}"]),
        ("card", lambda: [checked(d(rnd.choice([12, 14, 15, 15, 15, 18])))]),
        ("name", lambda: [title(), *[cased() for _ in range(rnd.randint(1, 2))]]),
        ("name", lambda: [title(), cased(), f"{letters(1).upper()}.", cased()]),
    ]
    plain = [
        lambda: [d(rnd.randint(1, 3))], lambda: [d(4)], lambda: [f"{d(2)}%"], lambda: [f"{d(1)}.{d(1)}"], lambda: [f"{d(1)}.{d(1)}.{d(1)}"],
        lambda: ["token", "=", f'"{hexa(40)}"'], lambda: [hexa(32)], lambda: [f"{d(4)}-{d(2)}-{d(2)}"], lambda: [f"{d(2)}/{d(2)}/{d(4)}"],
        lambda: [f"{d(2)}:{d(2)}"], lambda: [f"{letters(3)}{d(2)}"], lambda: ["version", f"{d(1)}.0"], lambda: ["CC", "BY-NC", "4.0"],
        lambda: [f"${d(3)}.{d(2)}"], lambda: [f"{d(1)},{d(3)},{d(3)}"], lambda: [f"{letters(4)}@"], lambda: [f"@{letters(6)}"], lambda: [d(rnd.randint(5, 12))],
        lambda: [f"AKIA{hexa(16).upper()}"], lambda: [f"{letters(5)}&&&"], lambda: [d(2), d(2), d(2)], lambda: [d(3), d(4)],
        lambda: [cased(), cased()], lambda: [cased()], lambda: [cased()] * rnd.randint(3, 9), lambda: [cased() for _ in range(rnd.randint(3, 9))], lambda: [d(rnd.randint(1, 4)), cased()], lambda: [rnd.choice(["name", "contact"])],
        lambda: [title(), letters(5)], lambda: [d(2), letters(5), letters(4)], lambda: [failing(16)], lambda: [failing(rnd.randint(13, 19))], lambda: [failing(16), failing(16)],
    ]
    cue = {"phone": ["tel", "phone", "call", "mobile"], "ident": ["ssn", "id", "passport"], "account": ["iban", "konto", "account"], "email": ["mail", "email"], "card": ["card", "karte"], "ip": ["from"], "name": ["name", "contact"]}
    out = []
    for _ in range(rows):
        words, labels = [], []

        def filler(n: int, words=words, labels=labels) -> None:
            for _ in range(n):
                w = letters(rnd.randint(1, 10))
                words.append((w.capitalize() if rnd.random() < 0.15 else w) + rnd.choice(["", "", "", "", ",", "."]))
                labels.append("O")

        filler(rnd.randint(0, 4))
        for _ in range(rnd.randint(1, 2)):
            if rnd.random() < 0.5:
                kind, make = rnd.choice(found)
                if rnd.random() < 0.3:
                    words.append(rnd.choice(cue[kind]) + rnd.choice(["", ":"]))
                    labels.append("O")
                made = make()
                labels += ["B-" + kind] + ["I-" + kind] * (len(made) - 1)
            else:
                made = rnd.choice(plain)()
                labels += ["O"] * len(made)
            words += made[:-1] + [made[-1] + rnd.choice(["", "", ".", ","])]
            filler(rnd.randint(0, 4))
        out.append((words, labels))
    return out


class Field:
    """Linear-chain CRF. ``emit``: features × labels, ``move``: label to label,
    ``enter``: first labels."""

    def __init__(self, names: list[str], labels: list[str], emit, move, enter):
        self.place = {f: i for i, f in enumerate(names)}
        self.names, self.labels, self.emit, self.move, self.enter = names, labels, emit, move, enter

    def scores(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Emission scores, a row per word."""
        get, out = self.place.get, []
        for words in sequences:
            rows, cols = [], []
            for i, fs in enumerate(word_features(words)):
                for f in fs:
                    j = get(f)
                    if j is not None:
                        rows.append(i)
                        cols.append(j)
            e = np.zeros((len(words), len(self.labels)))
            np.add.at(e, rows, self.emit[cols])
            out.append(e)
        return out

    def decode(self, sequences: list[list[str]]) -> list[list[str]]:
        return self.best(self.scores(sequences))

    def best(self, scores: list[np.ndarray]) -> list[list[str]]:
        """Viterbi over emission scores, sequences of equal length together."""
        by = defaultdict(list)
        for k, e in enumerate(scores):
            by[len(e)].append((k, e))
        out: list[list[str]] = [[]] * len(scores)
        for n, group in by.items():
            e = np.stack([x for _, x in group])
            best, back = self.enter + e[:, 0], []
            for t in range(1, n):
                step = best[:, :, None] + self.move
                back.append(step.argmax(1))
                best = step.max(1) + e[:, t]
            path = [best.argmax(1)]
            for b in reversed(back):
                path.append(b[np.arange(len(group)), path[-1]])
            for (k, _), p in zip(group, np.stack(path[::-1], 1)):
                out[k] = [self.labels[i] for i in p]
        return out


def _logsum(x, axis):
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def train(table: list[tuple[list[str], list[str]]], steps: int = 60, l2: float = 1e-3, least: int = 2) -> Field:
    """Maximum likelihood by Adam; gradients from forward and backward sums over
    the padded table."""
    labels = ["O"] + sorted({y for _, ys in table for y in ys if y != "O"})
    feats = [word_features(ws) for ws, _ in table]
    seen = defaultdict(int)
    for s in feats:
        for fs in s:
            for f in fs:
                seen[f] += 1
    names = sorted(f for f, n in seen.items() if n >= least)
    place = {f: i for i, f in enumerate(names)}
    n, top, k = len(table), max(len(ws) for ws, _ in table), len(labels)
    size = np.array([len(ws) for ws, _ in table])
    gold = np.zeros((n, top), int)
    spot, col = [], []
    for i, (fs, (_, ys)) in enumerate(zip(feats, table)):
        for t, (f, y) in enumerate(zip(fs, ys)):
            gold[i, t] = labels.index(y)
            for x in f:
                if x in place:
                    spot.append(i * top + t)
                    col.append(place[x])
    spot, col = np.array(spot), np.array(col)
    live = np.arange(top)[None, :] < size[:, None]
    # an inside label only follows its own kind
    allowed = np.array([[0.0 if y[0] != "I" or x[1:] == y[1:] else -1e4 for y in labels] for x in labels])
    first = np.array([0.0 if y[0] != "I" else -1e4 for y in labels])
    emit, move, enter = np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (emit, move, enter)]
    one = np.eye(k)
    for step in range(1, steps + 1):
        e = np.zeros((n * top, k))
        np.add.at(e, spot, emit[col])
        e = e.reshape(n, top, k)
        m, s = move + allowed, enter + first
        alpha, beta = np.zeros((n, top, k)), np.zeros((n, top, k))
        alpha[:, 0] = s + e[:, 0]
        for t in range(1, top):
            a = _logsum(alpha[:, t - 1, :, None] + m, 1) + e[:, t]
            alpha[:, t] = np.where(live[:, t, None], a, alpha[:, t - 1])
        for t in range(top - 2, -1, -1):
            b = _logsum(m + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], b, 0)
        z = _logsum(alpha[:, -1], 1)
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * live[:, :, None]
        diff = (p - one[gold] * live[:, :, None]).reshape(n * top, k) / n
        ge = np.zeros_like(emit)
        np.add.at(ge, col, diff[spot])
        gm = np.zeros_like(move)
        for t in range(1, top):
            pair = np.exp(alpha[:, t - 1, :, None] + m + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]) * live[:, t, None, None]
            gm += pair.sum(0)
            np.subtract.at(gm, (gold[live[:, t], t - 1], gold[live[:, t], t]), 1)
        gs = diff.reshape(n, top, k)[:, 0].sum(0)
        for x, g, (a, b) in zip((emit, move, enter), (ge, gm / n, gs), state):
            g = g + l2 * x / 10
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= 0.15 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Field(names, labels, emit, move + allowed, enter + first)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


_WORD = re.compile(r"\S+")
#: Different words that a reader remembers.
HELD = 300_000


class Reader:
    """Cuts texts into sentences, scores their words, and says which sentences can
    hold a span.

    A run of labels other than "outside" starts with a beginning label. Against
    outside words it gains at most: the margin of its first word's best beginning
    label, what entering and leaving gain, and for each further word its best margin
    plus the most that a step between two other labels gains. Where even the best
    first word with all gains above 0 of its sentence stays below 0, the plain path
    is the best one."""

    def __init__(self, field: Field):
        self.labels, o, k = field.labels, field.labels.index("O"), len(field.labels)
        self.outside = o
        self.other = [i for i in range(k) if i != o]
        self.begin = [i for i, y in enumerate(field.labels) if y[0] == "B"]
        move, enter = field.move, field.enter
        self.step = float((move[np.ix_(self.other, self.other)] - move[o, o]).max())
        into = max(float((move[o, self.begin] - move[o, o]).max()), float((enter[self.begin] - enter[o]).max()))
        self.edge = into + max(0.0, float((move[self.other, o] - move[o, o]).max()))
        self.rows = dict(zip(field.names, field.emit))
        # other shapes share the first number, which no feature names
        self.shapes = {s: i for i, s in enumerate(["", "<", ">", *sorted(n[2:] for n in field.names if n.startswith("s="))])}
        self.cues = {c: i for i, c in enumerate(["", *CUES])}
        zero = np.zeros(k)
        pair = lambda kind: np.array([[self.rows.get(f"{kind}={a}|{b}", zero) if a and b else zero for b in self.shapes] for a in self.shapes])
        self.before, self.after = pair("p"), pair("n")
        self.cue1, self.cue2 = (np.array([self.rows.get(f"{n}={c}", zero) if c else zero for c in self.cues]) for n in ("c1", "c2"))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.word = np.zeros((HELD, len(self.labels)))
        self.shape, self.cue = np.zeros(HELD, np.int32), np.zeros(HELD, np.int32)
        self.last = np.zeros(HELD, bool)

    def _add(self, word: str) -> int:
        i = self.place[word] = len(self.place)
        if i == len(self.word):
            for name in ("word", "shape", "cue", "last"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        s, cue, f = own_features(word)
        for x in f:
            if (row := self.rows.get(x)) is not None:
                self.word[i] += row
        self.shape[i], self.cue[i] = self.shapes.get(s, 0), self.cues[cue]
        self.last[i] = word[-1] in ".!?" and not cue  # ends a sentence
        return i

    def sequences(self, texts: list[list[str]]) -> list[tuple[int, int, int, np.ndarray | None]]:
        """``(text, first word, end, scores)`` of all sentences of the words of texts;
        no scores where a sentence can't hold a span."""
        if len(self.place) > HELD:
            self._forget()
        get, add = self.place.get, self._add
        ids = np.array([add(w) if (i := get(w)) is None else i for ws in texts for w in ws], np.int64)
        if not len(ids):
            return []
        n = len(ids)
        begins = np.zeros(n, bool)
        lengths = np.array([len(ws) for ws in texts])
        offset = np.cumsum(lengths) - lengths
        begins[offset[lengths > 0]] = True
        begins[1:] |= self.last[ids[:-1]]
        ends = np.append(begins[1:], True)
        shape, cue = self.shape[ids], self.cue[ids]
        prior = np.where(begins, 1, np.roll(shape, 1))
        after = np.where(ends, 2, np.roll(shape, -1))
        one = np.where(begins, 0, np.roll(cue, 1))
        two = np.where(begins | np.roll(begins, 1), 0, np.roll(cue, 2))
        two[:1] = 0
        scores = self.word[ids] + self.before[prior, shape] + self.after[shape, after]
        for cues, rows in ((one, self.cue1), (two, self.cue2)):
            at = np.flatnonzero(cues)
            scores[at] += rows[cues[at]]
        margin = scores - scores[:, [self.outside]]
        starts = np.flatnonzero(begins)
        first = np.maximum.reduceat(margin[:, self.begin].max(1), starts)
        more = np.add.reduceat(np.maximum(margin[:, self.other].max(1) + self.step, 0), starts)
        alive = first + more + self.edge > -1e-6
        of = np.searchsorted(offset, starts, "right") - 1
        rows = zip(of.tolist(), starts.tolist(), np.append(starts[1:], n).tolist(), alive.tolist())
        return [(i, a - offset[i], b - offset[i], scores[a:b] if open_ else None) for i, a, b, open_ in rows]


def added_spans(texts: list[str], field: Field, reader: Reader | None = None) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds in each text, base spans not yet considered."""
    open_ = [s for s in (reader or Reader(field)).sequences([t.split() for t in texts]) if s[3] is not None]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    places: dict[int, list[tuple[int, int]]] = {}
    for (i, first, _, _), labels in zip(open_, field.best([s[3] for s in open_])):
        t = 0
        while t < len(labels):
            if labels[t][0] != "B":
                t += 1
                continue
            u = t + 1
            while u < len(labels) and labels[u] == "I" + labels[t][1:]:
                u += 1
            if i not in places:
                places = {i: [m.span() for m in _WORD.finditer(texts[i])]}
            a, b = places[i][first + t][0], places[i][first + u - 1][1]
            while b > a and texts[i][b - 1] in _TRIM:
                b -= 1
            while a < b and texts[i][a] in _TRIM:
                a += 1
            if a < b:
                out[i].append((labels[t][2:], a, b))
            t = u
    return out


def spans(texts: list[str], field: Field, reader: Reader | None = None) -> list[tuple[list, list]]:
    """``(base, all)`` of each text, both by kind, then start."""
    result = []
    for text, more in zip(texts, added_spans(texts, field, reader)):
        base = base_spans(text)
        held = sorted((a, b) for _, a, b in base)
        ends = list(accumulate((b for _, b in held), max))  # the furthest end up to each
        new = []
        for s in more:
            k = bisect_left(held, (s[2],))  # those before k begin before the span's end
            if not k or ends[k - 1] <= s[1]:
                new.append(s)
        result.append((base, sorted(base + new, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return result


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``;
    the counts are of base spans."""

    shared = docs.sparkSession.sparkContext.broadcast(default_field())  # as large as the labelled table's features

    def run(batches):
        field = shared.value
        reader = Reader(field)
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 256):
                for base, all_ in spans(texts[at : at + 256], field, reader):
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_), len(all_) - len(base)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    reach_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    )
