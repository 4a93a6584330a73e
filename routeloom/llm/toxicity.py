"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel, Nyström landmarks.

Units are words (lower case; runs of three or more single characters are also read as one word, so
spaced-out insults are units; longer words are cut into overlapping windows that cover them). The
kernel of two units sums, over common subsequences of three characters, ``decay`` to the lengths
they span in both, so gapped and inserted-character forms stay close; it is normalised. Landmarks
are chosen units; a unit's features are its kernel values with them times the inverse root of the
landmarks' own kernel matrix; a linear squared-hinge machine is fitted on these.

Labels mark documents, so training is multiple-instance: a toxic document's witnesses are the units
that hold the pieces of five or seven characters (marks of the word's ends counted) which tell toxic
documents from clean ones most significantly. A document has one vote, which its witnesses share; units of clean
documents are negative with one vote for each such document, and later rounds add clean documents' best units. A document's
score is the highest of three logistic curves, of its highest, second and third highest unit: one clear insult or several likely ones.

Scoring uses the same kernel in its explicit form: for fixed landmarks the decision is a sum over a
unit's three-character subsequences of a table, divided by the unit's own norm. No unit is skipped.

Defined results: null and empty texts have no unit and get the score of a document of the least toxic units; scores of
equal texts are equal; without labels, or with one class, every score is the share of toxic
labels (0 if none); an empty table gives no rows. Learning reads at most MAX_LABELLED rows (those with the
smallest crc32 of crc32, a fixed sample) and MAX_CHARS characters of their texts, and no column but text and the label. The input's other columns are not
carried over.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, tidy

MAX_LABELLED = 4000
MAX_CHARS = 16_000_000  # of the labelled rows' texts, whole texts only
DECAY, WIDE = 0.6, 20
LANDMARKS = 256
GRAMS = (5, 7)  # lengths of the pieces that witnesses are first sought by
SIGNIFICANT = 25.0  # likelihood ratio of a piece that chance hardly gives among some 100,000 pieces
ODDS = 2.0  # times as common in toxic documents as in clean ones that a witness is
CLOSE = 0.8  # share of a document's most telling unit's significance that its other witnesses have
RIDGE = 0.002  # pull of the machine's weights to 0, for each toxic document
TOP = 3  # highest units of a document that its score looks at
START = "^"  # stands before each unit, and in pieces behind it
#: The characters with a number of their own; all others share a few numbers.
ALPHABET = "abcdefghijklmnopqrstuvwxyzäöüßéèêçàâîôûñíóáú0123456789"
SIZE = 64
_CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
_SPACED = re.compile(r"(?<!\S)\S(?:[^\S\n]+\S){2,}(?!\S)")
_TRIM = ".,;:!?\"'()[]{}|*#$%&"
_CACHED = 1_000_000


def units(text: str | None) -> set[str]:
    text = (text or "").lower()
    out = {w.strip(_TRIM) for w in set(text.split())}
    out.update("".join(m.split()) for m in _SPACED.findall(text))
    for w in [w for w in out if len(w) > WIDE]:
        out.discard(w)
        out.update(w[i : i + WIDE] for i in range(0, len(w) - WIDE // 2, WIDE // 2))
    out.discard("")
    return out


def _codes(words: list[str], n: int) -> np.ndarray:
    """Rows of character numbers of words of length n."""
    x = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
    return np.where(x <= 0x250, _NUMBER[np.minimum(x, 0x250)], OTHERS + x % (SIZE - OTHERS))


OTHERS = len(ALPHABET) + 1  # the first of the shared numbers
_NUMBER = np.array([_CODE.get(chr(c), OTHERS + c % (SIZE - OTHERS)) for c in range(0x251)], np.int64)


def _triples(n: int):
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def _marked(words: list[str]) -> list[str]:
    return [START + w for w in words]


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The kernel's explicit form: subsequence numbers and weights, of norm 1."""
    out: list = [(np.zeros(0, np.int64), np.zeros(0))] * len(words)
    for n, at in _by_length(words).items():
        if n < 3:
            continue
        x = _codes([words[i] for i in at], n)
        t, w = _triples(n)
        key = (x[:, t[:, 0]] * SIZE + x[:, t[:, 1]]) * SIZE + x[:, t[:, 2]]
        for i, k in zip(at, key):
            u, inverse = np.unique(k, return_inverse=True)
            v = np.bincount(inverse, w)
            out[i] = (u, v / np.sqrt((v * v).sum()))
    return out


def kernel(a: list[str], b: list[str], block: int = 64) -> np.ndarray:
    """Normalised subsequence kernel of all pairs; ``block`` words of b are laid out at a time."""
    left, out = features(a), np.zeros((len(a), len(b)))
    for at in range(0, len(b), block):
        some = features(b[at : at + block])
        dense = np.zeros((SIZE**3, len(some)), np.float32)
        for i, (u, v) in enumerate(some):
            dense[u, i] = v
        for i, (u, v) in enumerate(left):
            if len(u):
                out[i, at : at + block] = v.astype(np.float32) @ dense[u]
    return out


def raw_scores(words: list[str], table: np.ndarray) -> np.ndarray:
    """Sum over each word's subsequences of table, divided by its norm."""
    out = np.zeros(len(words))
    for n, at in _by_length(words).items():
        if n < 3:
            continue
        t, w = _triples(n)
        step = max(1, min(400_000 // len(w), 400_000 // (n * n)))
        for a in range(0, len(at), step):
            some = at[a : a + step]
            x = _codes([words[i] for i in some], n)
            key = (x[:, t[:, 0]] * SIZE + x[:, t[:, 1]]) * SIZE + x[:, t[:, 2]]
            total = table[key] @ w
            out[some] = total / np.sqrt(_own(x))
    return out


def _own(x: np.ndarray) -> np.ndarray:
    """The unnormalised kernel of each row with itself, by dynamic programming over its prefixes."""
    x = np.ascontiguousarray(x.T)
    n, m = x.shape
    same = DECAY * DECAY * (x[:, None] == x[None])
    # paths[i][j]: common subsequences of the length so far that end before i and j, gaps decayed
    paths = None
    for _ in range(2):
        nxt = np.zeros((n + 1, n + 1, m))
        for i in range(n):
            row = np.zeros(m)
            for j in range(n):
                row = DECAY * row + (same[i, j] if paths is None else same[i, j] * paths[i, j])
                np.multiply(nxt[i, j + 1], DECAY, out=nxt[i + 1, j + 1])
                nxt[i + 1, j + 1] += row
        paths = nxt
    return np.maximum((same * paths[:n, :n]).sum((0, 1)), 1e-300)


@dataclass
class Model:
    table: np.ndarray | None  # of subsequence numbers
    bias: float
    curves: list[tuple[float, float]]  # slope and shift for the highest, second highest, ... unit
    share: float  # of toxic labels, where nothing could be learned
    landmarks: list[str]
    least: float = 0.0  # of the learning units' scores; that of missing units and of single characters

    def unit_scores(self, words: list[str]) -> np.ndarray:
        out = raw_scores(_marked(words), self.table) + self.bias
        out[[len(w) < 2 for w in words]] = self.least
        return out

    def highest(self, scores: np.ndarray) -> np.ndarray:
        """The TOP highest scores, highest first, filled up with the least one."""
        some = np.sort(scores)[::-1][:TOP]
        return np.concatenate([some, np.full(TOP - len(some), self.least)])

    def probability(self, highest: np.ndarray) -> np.ndarray:
        """Of documents by rows of their highest scores: one clear insult or several likely ones."""
        if self.table is None:
            return np.full(len(highest), self.share)
        return np.max([1 / (1 + np.exp(-np.clip(a * x + b, -50, 50))) for (a, b), x in zip(self.curves, highest.T)], axis=0)


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Squared-hinge machine with bias, by Newton steps on the active rows."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    reg = np.full(z.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(30):
        on = y * (z @ w) < 1
        if not on.any():
            break
        a = z[on] * weight[on, None]
        new = np.linalg.solve(a.T @ z[on] + np.diag(reg), a.T @ y[on])
        if np.abs(new - w).max() < 1e-7:
            break
        w = 0.5 * w + 0.5 * new if _ > 15 else new
    return w


def _nystroem(landmarks: list[str]) -> np.ndarray:
    k = kernel(_marked(landmarks), _marked(landmarks))
    values, vectors = np.linalg.eigh(k + 1e-4 * np.eye(len(k)))
    return vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T


def _spread(words: list[str], n: int) -> list[str]:
    """n words, each time the one least like those before."""
    words = list(dict.fromkeys(words))
    if len(words) <= n:
        return words
    words = words[:1000]
    k = kernel(_marked(words), _marked(words))
    chosen, near = [0], k[:, 0].copy()
    while len(chosen) < n:
        i = int(np.argmin(near))
        chosen.append(i)
        near = np.maximum(near, k[:, i])
    return [words[i] for i in chosen]


class Bags:
    """Units of documents as numbers; equal units are kept once."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def add(self, text: str | None) -> None:
        number = self.number
        self.rows.append(np.array([number.setdefault(u, len(number)) for u in sorted(units(text)) if len(u) >= 2], np.int32))


def _significance(n_bad: np.ndarray, n_good: np.ndarray, bad: int, good: int) -> np.ndarray:
    """Likelihood ratio statistic of being commoner in toxic documents, 0 where it is not."""
    p, q, r = n_bad / bad, n_good / good, (n_bad + n_good) / (bad + good)

    def log_likelihood(k, n, p):
        return k * np.log(np.maximum(p, 1e-12)) + (n - k) * np.log(np.maximum(1 - p, 1e-12))

    g = 2 * (log_likelihood(n_bad, bad, p) + log_likelihood(n_good, good, q) - log_likelihood(n_bad, bad, r) - log_likelihood(n_good, good, r))
    return np.where(p > q, g, 0.0)


def _grams(word: str) -> set[str]:
    w = START + word + START
    return {w[j : j + n] for n in GRAMS for j in range(len(w) - n + 1)}


def _telling(every: list[str], bad: list[np.ndarray], good: list[np.ndarray]) -> np.ndarray:
    """Of each unit the significance of its most telling piece; 0 for units of no toxic document."""
    in_bad: Counter = Counter()
    for b in bad:
        in_bad.update(set().union(*(_grams(every[i]) for i in b.tolist())))
    known = {g for g, n in in_bad.items() if n >= min(3, len(bad))}  # what fewer toxic documents hold says nothing
    held = {i: _grams(every[i]) & known for i in set().union(*(b.tolist() for b in [*bad, *good]))}
    in_good: Counter = Counter()
    for b in good:
        in_good.update(set().union(*(held[i] for i in b.tolist())))
    pieces = sorted(known)
    g = _significance(np.array([in_bad[x] for x in pieces], float), np.array([in_good[x] for x in pieces], float), len(bad), len(good))
    value, out = dict(zip(pieces, g.tolist())), np.zeros(len(every))
    n_bad, n_good = (np.bincount(np.concatenate(x), minlength=len(every)) for x in (bad, good))
    # a unit that clean documents hold about as often says nothing, whatever its pieces do
    for i in np.flatnonzero((n_bad + 0.5) / (len(bad) + 1) > ODDS * (n_good + 0.5) / (len(good) + 1)).tolist():
        out[i] = max((value[x] for x in held.get(i, ())), default=0.0)
    return out


def fit(made: Bags, toxic: np.ndarray, rounds: int = 3, landmarks: int = LANDMARKS) -> Model:
    share = float(toxic.mean()) if len(toxic) else 0.0
    none = Model(None, 0.0, [], share, [])
    if not len(toxic) or toxic.all() or not toxic.any():
        return none
    bags, every = made.rows, list(made.number)
    bad = [b for b, t in zip(bags, toxic) if t and len(b)]
    good = [b for b, t in zip(bags, toxic) if not t and len(b)]
    if not bad or not good:
        return none
    telling = _telling(every, bad, good)
    # a toxic document's witnesses are its significant units, but not those that only share a piece with a far more telling one
    floor = SIGNIFICANT if telling.max() >= SIGNIFICANT else 1e-9
    witness = [b[telling[b] >= max(floor, CLOSE * telling[b].max())] for b in bad]
    votes = np.zeros(len(every))
    for some in witness:  # a document has one vote, its witnesses share it
        votes[some] += 1 / max(len(some), 1)
    if not votes.any():
        return none
    positives = np.flatnonzero(votes)
    positives = sorted(positives.tolist(), key=lambda i: (-votes[i], every[i]))[:3000]
    n_clean = np.zeros(len(every), np.int64)
    for b in good:
        n_clean[b] += 1
    clean = np.flatnonzero(n_clean)
    common = clean[np.lexsort((clean, -n_clean[clean]))][:600].tolist()
    rare = sorted(clean.tolist(), key=lambda i: zlib.crc32(every[i].encode("utf-8", "surrogatepass")))[:2400]
    chosen = list(dict.fromkeys(common + rare))
    model = none
    for _ in range(rounds):
        negatives = list(dict.fromkeys(chosen))[:6000]
        names, others = [every[i] for i in positives], [every[i] for i in negatives]
        marks = list(dict.fromkeys([*_spread(names, landmarks // 2), *_spread(others, landmarks - landmarks // 2)]))
        root = _nystroem(marks)
        z = kernel(_marked(names + others), _marked(marks)) @ root
        y = np.array([1.0] * len(names) + [-1.0] * len(others))
        weight = np.concatenate([votes[positives], np.maximum(n_clean[negatives], 1)])
        w = _svm(z, y, weight, RIDGE * votes.sum())
        table = np.zeros(SIZE**3)
        for a, (u, v) in zip(root @ w[:-1], features(_marked(marks))):
            np.add.at(table, u, a * v)
        model = Model(table, float(w[-1]), [], share, marks)
        score = model.unit_scores(every)
        # the next round's negatives are clean documents' best units first
        hard = sorted({int(b[np.argmax(score[b])]) for b in good}, key=lambda i: (-score[i], every[i]))[:2000]
        chosen = hard + chosen
    model.least = float(score.min())
    top = np.array([model.highest(score[b]) for b in bags])
    # from the last curve to the first: where clean documents score as high, toxic ones that a later curve finds don't count again
    found = np.zeros(len(top), bool)
    for x in top.T[::-1]:
        use = ~(found & toxic & (x <= np.quantile(x[~toxic], 0.995)))
        curve = _logistic(x[use], toxic[use].astype(float))
        model.curves.insert(0, curve)
        found |= curve[0] * x + curve[1] >= 0
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with a pull of the slope to 0 that keeps it off tiny differences."""
    x, y = np.clip(x, -3, 3), np.clip(y, 0.005, 0.995)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g = np.array([((p - y) * x).sum() + a, (p - y).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 5 / max(np.abs(d).max(), 1e-12))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    if a < 0:  # a higher score never makes toxic less likely: the share of toxic ones, whatever the score
        return 0.0, float(np.log(y.mean() / (1 - y.mean())))
    return float(a), float(b)


def learned_from(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, chars: int = MAX_CHARS) -> Model:
    """Fit on at most ``limit`` labelled rows and ``chars`` characters (whole texts) of docs.

    Both bounds take rows in hash order; a text that no longer fits is passed over, not the rest."""
    crc = F.crc32(F.crc32(F.col("doc_id").cast("string").cast("binary")).cast("string").cast("binary"))
    some = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic is not null and doc_id is not null")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(crc, "doc_id").limit(limit)
    )
    rows = some.collect()  # at most ``limit`` pairs of numbers
    if not rows:
        return fit(Bags(), np.zeros(0, bool))
    few = docs.sparkSession.createDataFrame(rows, some.schema)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    chosen, size = [], 0
    for r in found.where(F.coalesce(F.char_length("text"), F.lit(0)) <= chars).orderBy(crc, "doc_id", "text").toLocalIterator():
        if size + len(r["text"] or "") <= chars:
            size += len(r["text"] or "")
            chosen.append(r)
    bags, toxic = Bags(), []
    for r in sorted(chosen, key=lambda r: (r["doc_id"], r["text"] or "")):
        bags.add(r["text"])
        toxic.append(r["toxic"] == 1)
    return fit(bags, np.array(toxic, bool))


_SCORES: dict = {}


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, unit (the highest-scoring one)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one table of SIZE**3 numbers

    def go(batches):
        model = sent.value
        mark = id(model)
        if _SCORES.get("") != mark:
            _SCORES.clear()
            _SCORES[""] = mark
        cache = _SCORES.setdefault("words", {})
        for b in batches:
            highest, unit = [np.zeros((0, TOP))], []
            for texts in portions(b.column("text")):
                bags = [units(t) for t in texts]
                new = [] if model.table is None else [w for w in set().union(*bags) if w not in cache]
                if len(cache) + len(new) > _CACHED:
                    new = [] if model.table is None else list(set().union(*bags))
                    cache.clear()
                if new:
                    cache.update(zip(new, model.unit_scores(new).tolist()))
                for bag in bags:
                    if model.table is None:
                        bag = set()
                    best = max(bag, key=lambda w: (cache[w], w), default=None)
                    highest.append(model.highest(np.array([cache[w] for w in bag], float))[None])
                    unit.append(best)
            p = model.probability(np.concatenate(highest))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array(unit, pa.string())], names=["doc_id", "score", "predicted", "unit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(go), "doc_id long, score double, predicted int, unit string")
