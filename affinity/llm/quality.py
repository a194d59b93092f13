"""Quality classifier: naive Bayes support vectors.

Texts become indicators of n-grams: words, pairs of words, and runs of word
shapes (capitals, digits, signs, endings, repetition), hashed to a fixed number
of features.  Each indicator is scaled by the log ratio of its rates in the two
classes; over these a linear model with hinge loss is fitted by dual coordinate
descent.  A logistic curve fitted on rows kept back turns margins into scores.

The fit uses a bounded sample of the labelled rows, ``MAX_LABELLED`` of them
chosen by a hash of the id; scoring covers every row and its whole text.

Cases: a null or empty text has no features and gets the score of the bias
alone.  Labels other than 0 and 1, and labels without a document, are ignored;
repeated labels count each time.  Without labels of both classes the score is
the share of label 1 (0.5 without any).  Repeated rows are scored row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit uses at most.
MAX_LABELLED = 4_000
#: Features: words and word pairs, then shape runs, each in its own half.
BITS = 18
KEPT_WORDS = 150_000

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Letters, capitals and digits stand for all of their kind; signs stay as they are.
_KINDS = bytes(ord("a") if k >= 128 or chr(k).islower() else ord("A") if chr(k).isupper() else ord("0") if chr(k).isdigit() else k for k in range(256))


def _shape(pattern: bytes) -> int:
    """A small code of how a word is written: case, size, digits and the signs at its end."""
    s = pattern.decode("latin-1")
    lower, upper, digits = s.count("a"), s.count("A"), s.count("0")
    case = 0 if not lower + upper else 1 if not upper else 2 if not lower and upper > 1 else 3 if s[0] == "A" and upper == 1 else 4
    body = s.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    tail = xxhash.xxh32_intdigest(s[len(body) :][-3:].encode("latin-1"))
    size = 0 if len(s) < 3 else 1 if len(s) < 8 else 2 if len(s) < 16 else 3 if len(s) < 30 else 4
    mixed = 2 if digits == len(s) else 1 if digits else 0
    return (((case * 5 + size) * 3 + mixed) * 2 + bool(body)) << 24 ^ tail >> 1 | 1


class _Shapes(dict):
    def __missing__(self, pattern: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[pattern] = _shape(pattern)
        return found


class _Words(dict):
    """The place of each word in the tables of hashes and shapes."""

    def __init__(self):
        super().__init__()
        self.hashes, self.shapes, self.patterns = np.zeros(KEPT_WORDS, np.uint64), np.zeros(KEPT_WORDS, np.uint64), _Shapes()

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.hashes[at] = xxhash.xxh3_64_intdigest(word.lower())
        self.shapes[at] = self.patterns[word.translate(_KINDS)]
        return at

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) + len(words) > KEPT_WORDS:
            self.clear()
            if len(words) > KEPT_WORDS // 2:  # a very long text goes in parts
                half = len(words) // 2
                (h, s), (g, t) = self.of(words[:half]), self.of(words[half:])
                return np.concatenate([h, g]), np.concatenate([s, t])
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[at], self.shapes[at]


_WORDS = _Words()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct features (below 2**BITS) of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.zeros(0, np.int32)
    h, s = _WORDS.of(words)
    s[1:] += np.uint64(1 << 33) * (h[1:] == h[:-1])  # repeats the word before it
    s[2:] += np.uint64(1 << 34) * (h[2:] == h[:-2])
    half, drop = 1 << (BITS - 1), np.uint64(65 - BITS)
    runs = [h * _MIX >> drop]
    if len(h) > 1:
        runs += [(h[:-1] * _PAIR + h[1:]) * _MIX >> drop]
    shapes, t = [s * _PAIR], s * _PAIR
    for k in (1, 2):
        if len(s) > k:
            t = t[:-1] * _PAIR + s[k:]
            shapes.append(t * _MIX)
    runs += [(x >> drop) + np.uint64(half) for x in shapes]
    return np.unique(np.concatenate(runs)).astype(np.int32)


def _packed(x: np.ndarray) -> bytes:
    """Features as they are, or as one bit for each possible one where that is shorter: 2**BITS bits at most."""
    if len(x) * 4 < 1 << (BITS - 3):
        return x.astype(np.int32).tobytes()
    bits = np.zeros(1 << BITS, np.uint8)
    bits[x] = 1
    return np.packbits(bits).tobytes()


def _unpacked(row: bytes) -> np.ndarray:
    if len(row) < 1 << (BITS - 3):
        return np.frombuffer(row, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8)))


class _Each(Sequence):
    """Arrays that are made when they are read, so that long rows are not held unpacked."""

    def __init__(self, n: int, make: Callable[[int], np.ndarray]):
        self.n, self.make = n, make

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> np.ndarray:
        if i >= self.n:
            raise IndexError(i)
        return self.make(i)


@dataclass
class Model:
    weights: np.ndarray  # by feature: log-count ratio times fitted weight
    squares: np.ndarray  # by feature: log-count ratio squared, for the length of a vector
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        n = float(self.squares[x].sum()) ** 0.5
        return float(self.weights[x].sum()) / n + self.bias if n else self.bias

    def score(self, x: np.ndarray) -> float:
        z = self.slope * self.margin(x) + self.shift
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def _ratios(rows: Iterable[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = [np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)]
    for x, label in zip(rows, y):
        counts[int(label > 0)][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: Sequence[np.ndarray], values: Sequence[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model, by dual coordinate descent.

    Each step solves the dual for one row: its multiplier stays within 0 and cost.
    """
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    norms = np.array([float(v @ v) + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            x, v = rows[i], values[i]
            gradient = y[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins and labels (Newton's method)."""
    t = (y > 0).astype(float)
    up, down = t.sum(), len(t) - t.sum()
    t = np.where(t > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum(), (p - t).sum()]) + 1e-3 * np.array([a, 0])
        q = p * (1 - p) + 1e-9
        hess = np.array([[(q * margins * margins).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum()]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[bytes], labels: np.ndarray, c: float = 1.0) -> Model:
    """rows: packed features.  labels: 0 or 1.  A fifth of the rows is kept back for the logistic curve."""
    size, y = 1 << BITS, np.where(labels > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        share = float((labels > 0).mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))

    def linear(at: np.ndarray) -> Model:
        own, own_y = [rows[i] for i in at], y[at]
        features_of = _Each(len(own), lambda i: _unpacked(own[i]))
        r = _ratios(features_of, own_y)

        def scaled(i: int) -> np.ndarray:
            v = r[features_of[i]]
            return v / max(float(np.sqrt(v @ v)), 1e-12)

        # both classes weigh the same in all
        cost = np.where(own_y > 0, c * len(own_y) / (2 * max((own_y > 0).sum(), 1)), c * len(own_y) / (2 * max((own_y < 0).sum(), 1)))
        w, bias = descend(features_of, _Each(len(own), scaled), own_y, cost, size)
        return Model(r * w, r * r, bias, 1.0, 0.0)

    back = np.arange(len(rows)) % 5 == 4
    if back.sum() >= 20 and len(set(y[back])) == 2 and len(set(y[~back])) == 2:
        part = linear(np.flatnonzero(~back))
        slope, shift = _logistic(np.array([part.margin(_unpacked(rows[i])) for i in np.flatnonzero(back)]), y[back])
    else:
        slope, shift = 2.0, 0.0
    model = linear(np.arange(len(rows)))
    model.slope, model.shift = slope, shift
    return model


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows given, or from ``MAX_LABELLED`` of them."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    chosen = named.orderBy(F.xxhash64("id"), "id", "label").limit(MAX_LABELLED)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def vectors(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "x": [_packed(features(t)) for t in pdf["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.mapInPandas(vectors, f"id {kind}, label int, x binary").toPandas().sort_values(["id", "label"], kind="stable")
    return fit(list(got["x"]), got["label"].to_numpy())


def scorer(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score (0 to 1, higher where label 1 is likelier) of a row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for part in texts:
            yield pd.Series([own.score(features(t)) for t in part], dtype=float)

    return scores(F.col(text_col))
