"""Toxic spans by a linear-chain conditional random field with two states.

Labels are given per document, so tokens are labelled first: in a toxic document, those with a feature
(a word or a beginning of a word) that toxic documents hold significantly more often.  The chain learns
weights of these features and of the state changes from windows of labelled tokens.  Forward-backward
marginals of the tokens then give the offending offsets, and a logistic curve of the marginals' sum and
of the chance that any token is toxic gives the document's score.

A run of tokens without features multiplies the messages by a power of one fixed matrix, which has a
closed form, so a document costs one automaton pass plus work for its tokens with features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many labelled documents of each kind are learned from: those of the least hash of their id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3_000, 6_000
FEATURES = 2_000
WINDOW = 64
WINDOWS = 6_000
_WORD = re.compile(r"\w+")
_LENGTHS = (3, 4, 5, 6, 7, 8)


def token_features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings of 3 to 8 letters with a mark."""
    return [word, *("^" + word[:k] for k in _LENGTHS if len(word) >= k)]


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Crf:
    """States: 0 clean, 1 toxic.  ``move[a][b]`` and ``bias`` are log weights, ``weight`` those of features."""

    weight: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    move: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    curve: tuple[float, float, float] = (-3.0, 1.0, 0.0)

    def __post_init__(self) -> None:
        self._ready()

    def __getstate__(self) -> tuple:
        return self.weight, self.bias, self.move, self.curve

    def __setstate__(self, state: tuple) -> None:
        self.weight, self.bias, self.move, self.curve = state
        self._ready()

    def _ready(self) -> None:
        self.found = ahocorasick.Automaton()
        for f in self.weight:
            self.found.add_word(f.removeprefix("^"), len(f.removeprefix("^")))
        if self.weight:
            self.found.make_automaton()
        self.known: dict[str, float | None] = {}
        (a, b), (c, d) = np.exp(self.move)
        e = float(np.exp(self.bias))
        self.step = ((a, b * e), (c, d * e))  # a change followed by a token without features
        # Eigenvalues of the step; they are real as all entries are positive.
        half, det = (a + d * e) / 2, a * d * e - b * e * c
        root = max(half * half - det, 1e-300) ** 0.5
        self.l1, self.ratio = half + root, (half - root) / (half + root)

    def emission(self, word: str) -> float | None:
        """The toxic state's log weight of a word; None for one without features."""
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) > 200_000:
                self.known.clear()
            some = [self.weight[f] for f in token_features(word) if f in self.weight]
            out = self.known[word] = self.bias + sum(some) if some else None
            return out

    def _power(self, n: int) -> tuple[tuple[float, float], tuple[float, float]]:
        """The n-th power of the step, up to a factor: (M - l2) l1^n - (M - l1) l2^n, scaled by l1^-n."""
        if n == 0:
            return (1.0, 0.0), (0.0, 1.0)
        (a, b), (c, d) = self.step
        l1, l2, r = self.l1, self.l1 * self.ratio, self.ratio**n
        return ((a - l2) - (a - l1) * r, b * (1 - r)), (c * (1 - r), (d - l2) - (d - l1) * r)

    def has_feature(self, lower: str) -> bool:
        if not self.weight:
            return False
        for end, n in self.found.iter(lower):
            begin = end - n + 1
            if not begin or not (lower[begin - 1].isalnum() or lower[begin - 1] == "_"):
                return True
        return False

    def marginals(self, emissions: list[float | None]) -> list[tuple[int, float]]:
        """(position, chance of the toxic state) of the tokens with features, and of short runs between."""
        places = [i for i, e in enumerate(emissions) if e is not None]
        if not places:
            return []
        (m00, m01), (m10, m11) = np.exp(self.move)
        n = len(emissions)
        forward = []
        x, y, at = 1.0, 1.0, 0  # the message into position ``at``, of the two states
        for i in places:
            if i > at:
                if at == 0:  # the first token of all has no change before it
                    y *= float(np.exp(self.bias))
                    gap = i - 1
                else:
                    gap = i - at
                (a, b), (c, d) = self._power(gap)
                x, y = x * a + y * c, x * b + y * d
            if i > 0:
                x, y = x * m00 + y * m10, x * m01 + y * m11
            y *= float(np.exp(min(emissions[i], 50.0)))
            s = x + y
            x, y = x / s, y / s
            forward.append((x, y))
            at = i + 1
        backward = [(1.0, 1.0)] * len(places)
        u, v, end = 1.0, 1.0, n
        for k in range(len(places) - 1, -1, -1):
            i = places[k]
            (a, b), (c, d) = self._power(end - i - 1)
            u, v = a * u + b * v, c * u + d * v
            s = u + v
            u, v = u / s, v / s
            backward[k] = (u, v)
            w = v * float(np.exp(min(emissions[i], 50.0)))
            u, v = m00 * u + m01 * w, m10 * u + m11 * w
            end = i
        out = []
        for k, i in enumerate(places):
            (fx, fy), (bx, by) = forward[k], backward[k]
            out.append((i, fy * by / (fx * bx + fy * by)))
            gap = places[k + 1] - i - 1 if k + 1 < len(places) else 0
            for j in range(1, gap + 1 if gap <= 4 else 1):
                (a, b), (c, d) = self._power(j)
                x, y = fx * a + fy * c, fx * b + fy * d
                (a, b), (c, d) = self._power(gap - j)
                e = float(np.exp(min(emissions[places[k + 1]], 50.0)))
                p, q = backward[k + 1]
                u, v = m00 * p + m01 * q * e, m10 * p + m11 * q * e
                u, v = a * u + b * v, c * u + d * v
                out.append((i + j, y * v / (x * u + y * v)))
        return out

    def read(self, text: str) -> tuple[list[tuple[int, int, float]], float, float]:
        """(begin, end, chance) of tokens that may be toxic, the sum of chances, and that of any."""
        if not text or not self.has_feature(text.lower()):
            return [], 0.0, 0.0
        spans = [m.span() for m in _WORD.finditer(text)]
        found = self.marginals([self.emission(text[a:b].lower()) for a, b in spans])
        none = 1.0
        for _, p in found:
            none *= 1 - min(p, 1 - 1e-12)
        return [(*spans[i], p) for i, p in found if p >= 0.5], sum(p for _, p in found), 1 - none

    def score(self, total: float, any_one: float) -> float:
        a, b, c = self.curve
        return float(_sigmoid(a + b * any_one + c * np.log1p(total)))


def _different(texts: list[str]) -> list[list[str]]:
    """The words of the texts, of near copies only the first, lest their every word look telling."""
    seen, out = set(), []
    for t in texts:
        words = _WORD.findall(t.lower())
        grams = [crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))]
        marks = {min(grams), min(g ^ 0x5BD1E995 for g in grams)}
        if words and not marks & seen:
            out.append(words)
        seen |= marks
    return out


def _telling(toxic: list[list[str]], clean: list[list[str]], features: int = FEATURES) -> dict[str, float]:
    """Features with significantly more toxic documents than by chance, and their log odds."""
    def count(docs: list[list[str]]) -> Counter:
        c: Counter = Counter()
        for words in docs:
            c.update({f for w in set(words) for f in token_features(w)})
        return c

    a, b = count(toxic), count(clean)
    n1, n0 = len(toxic), len(clean)
    share = n1 / max(n1 + n0, 1)
    least = np.log(5.0 * max(len(a), 1))
    out = {}
    for f, x in a.items():
        y = b[f]
        p = x / (x + y)
        likelihood = x * np.log(p / share) + (y * np.log((1 - p) / (1 - share)) if y else 0.0)
        odds = np.log((x + 0.5) / (n1 + 1)) - np.log((y + 0.5) / (n0 + 1))
        if likelihood >= least and odds >= 1.5:
            out[f] = float(odds)
    top = sorted(out, key=lambda f: (-a[f], f))[:features]
    return {f: out[f] for f in top}


def _learn_chain(crf: Crf, windows: list[tuple[list[list[int]], list[int]]], names: list[str], steps: int = 80) -> None:
    """Maximum likelihood with a quadratic penalty, all windows at once, by Adagrad."""
    n, size = len(windows), max(len(y) for _, y in windows)
    y = np.zeros((n, size), int)
    live = np.zeros((n, size), bool)
    rows, cols, feats = [], [], []
    for i, (tokens, labels) in enumerate(windows):
        y[i, : len(labels)] = labels
        live[i, : len(labels)] = True
        for j, fs in enumerate(tokens):
            for f in fs:
                rows.append(i)
                cols.append(j)
                feats.append(f)
    rows, cols, feats = np.array(rows, int), np.array(cols, int), np.array(feats, int)
    w, bias, move = np.zeros(len(names)), -2.0, np.zeros((2, 2))
    seen = [np.full(len(names), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    for _ in range(steps):
        e = np.full((n, size), bias)
        np.add.at(e, (rows, cols), w[feats])
        e = np.exp(np.clip(e, -30, 30))
        t = np.exp(move)
        f = np.empty((size, n, 2))
        b = np.ones((size, n, 2))
        f[0] = np.stack([np.ones(n), e[:, 0]], 1)
        f[0] /= f[0].sum(1, keepdims=True)
        for j in range(1, size):
            g = f[j - 1] @ t
            g[:, 1] *= e[:, j]
            g /= g.sum(1, keepdims=True)
            f[j] = np.where(live[:, j, None], g, f[j - 1])
        for j in range(size - 2, -1, -1):
            g = b[j + 1] * np.stack([np.ones(n), e[:, j + 1]], 1)
            g = g @ t.T
            b[j] = np.where(live[:, j + 1, None], g / g.sum(1, keepdims=True), 1.0)
        p = f * b
        p = (p[:, :, 1] / p.sum(2)).T * live
        gap = (y - p) * live
        grad_w = np.bincount(feats, gap[rows, cols], len(names)) - 0.05 * w
        grad_bias = gap.sum()
        grad_move = -0.05 * move
        for j in range(1, size):
            on = live[:, j]
            if not on.any():
                break
            q = f[j - 1][on][:, :, None] * t * (b[j][on] * np.stack([np.ones(on.sum()), e[on, j]], 1))[:, None, :]
            q /= q.sum((1, 2), keepdims=True)
            grad_move -= q.sum(0)
            np.add.at(grad_move, (y[on, j - 1], y[on, j]), 1.0)
        for k, g in enumerate((grad_w, grad_bias, grad_move)):
            seen[k] = seen[k] + g**2
        w = w + 0.5 * grad_w / np.sqrt(seen[0])
        bias = bias + 0.5 * grad_bias / np.sqrt(seen[1])
        move = move + 0.5 * grad_move / np.sqrt(seen[2])
    crf.weight = dict(zip(names, w.tolist(), strict=True))
    crf.bias, crf.move = float(bias), move.tolist()
    crf._ready()


def _learn_curve(crf: Crf, texts: list[str], y: np.ndarray, weight: np.ndarray) -> None:
    """A logistic curve on the two aggregates, by Newton steps with a slight penalty."""
    read = [crf.read(t)[1:] for t in texts]
    x = np.array([[1.0, a, np.log1p(s)] for s, a in read])
    c = np.zeros(3)
    for _ in range(25):
        p = _sigmoid(x @ c)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        c += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * c)
    crf.curve = tuple(c.tolist())


def fit(toxic: list[str], clean: list[str], clean_weight: float = 1.0, *, features: int = FEATURES, windows: int = WINDOWS) -> Crf:
    """Learn from whole texts of both kinds; without either kind nothing is found toxic.

    ``clean_weight``: how many documents each clean one of the sample stands for, relative to a toxic one.
    The ``features`` most frequent telling ones are kept; of each kind the first documents with ``windows``
    windows in all teach the chain, and all documents the features and the curve of the score.
    """
    crf = Crf()
    if not toxic or not clean:
        return crf
    different = _different(toxic), _different(clean)
    telling = _telling(*different, features)
    if not telling:
        return crf
    names = sorted(telling)
    index = {f: i for i, f in enumerate(names)}
    taught = []
    for label, docs in zip((1, 0), different, strict=True):
        kept = 0
        for words in docs:
            for low in range(0, len(words), WINDOW):
                tokens = [[index[f] for f in token_features(w) if f in index] for w in words[low : low + WINDOW]]
                labels = [int(label == 1 and any(telling[names[f]] >= 3.0 for f in fs)) for fs in tokens]
                if any(tokens) or (low // WINDOW) % 8 == 0:
                    taught.append((tokens, labels))
                    kept += 1
            if kept >= windows:
                break
    _learn_chain(crf, taught, names)
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    _learn_curve(crf, toxic + clean, y, np.where(y > 0, 1.0, clean_weight))
    return crf


def train(docs: DataFrame, labels: DataFrame, *, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, features: int = FEATURES, windows: int = WINDOWS) -> Crf:
    """Learn from ``labels`` (doc_id, toxic) that join ``docs``; null labels are left out.

    The bounds are of documents of each kind in the sample, of features, and of windows that teach the chain.
    """
    rows = labels.where(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    some = None
    for value, bound in ((1, sample_toxic), (0, sample_clean)):
        part = rows.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        some = part if some is None else some.unionAll(part)
    # The samples' bounds make them fit to send to every executor.
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where(F.length("text") > 0).toPandas()
    got = got.sort_values(["doc_id", "text"])
    toxic, clean = (got.loc[got["toxic"] == v, "text"].tolist() for v in (1, 0))
    scale = (counts.get(0, 0) / max(min(counts.get(0, 0), sample_clean), 1)) / max(counts.get(1, 0) / max(min(counts.get(1, 0), sample_toxic), 1), 1e-9)
    return fit(toxic, clean, scale if toxic else 1.0, features=features, windows=windows)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, crf: Crf) -> DataFrame:
    """(doc_id, score, spans) of each row; spans: (begin, end, chance) of offending tokens, as code points."""
    spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, spans = [], []
            for text in batch["text"].to_pylist():
                found, total, any_one = model.read(text or "")
                scores.append(model.score(total, any_one))
                spans.append([{"begin": a, "end": b, "chance": p} for a, b, p in found])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64()), pa.array(spans, spans_type)], ["doc_id", "score", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double, spans array<struct<begin: int, end: int, chance: double>>")


def detect(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of each row of ``docs``.

    Labels of held-out ids are never learned from.  Without labels of both kinds every score is that of
    a text without a finding, as is that of a null or empty text.  Repeated rows are scored each, a null
    id isn't held out, an empty table gives no rows, extra columns are ignored.  ``bounds`` are those of :func:`train`.
    """
    crf = train(docs, labels.where(~held_out()), **bounds)
    return score(docs, crf).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "spans")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and offending spans of every document."""
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
