"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

Two strings are compared by the triples of characters that they share as subsequences of at most SPAN
characters, each weighed by DECAY to the power of its span, so that gaps and inserted characters cost a little
and don't break the likeness. Words are compared in lower case, without what is no letter or digit, between
marks for their start and end; runs of single characters count as a word too. A sentence's likeness to a
landmark is that of its likest word; likenesses below FLOOR count as none. A word or joined run of more than
LONGEST letters and digits is as like a landmark as its likest window: windows begin at every character and are as long
as the landmarks or half as long again (5 characters at least, LONGEST at most), so nothing in a text is left out.

Landmarks are words of at most LONGEST letters and beginnings of words that tell labelled toxic documents from others. The machine learns
from sentences: of a toxic document the worst, of others the hardest; a logistic curve turns the margins
of a document's worst sentence and of all its sentences into a score from 0 to 1. Training uses a bounded sample of labelled
rows (MOST_TOXIC and MOST_OTHER, the least by a hash of doc_id); scoring takes every text as a whole.

An empty table gives an empty result; a column that is called like the score is replaced, others stay. A null or
blank text gets the score of a sentence without any likeness. Labels of ids that several rows share
hold for each; a null doc_id has no label. Without labels of both kinds all scores are the share of toxic ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name

SPAN, DECAY, FLOOR = 6, 0.8, 0.45
LANDMARKS, PREFIX, ALIKE = 64, 6, 0.7
MOST_TOXIC, MOST_OTHER = 1000, 2000
THRESHOLD, LONGEST = 0.3, 24
#: Characters of long words, and windows of them, looked at together.
PART, PIECES = 1 << 15, 20_000
START, END = "\x02", "\x03"
_SENTENCE = re.compile(r"[.!?]+\s|\n")
_JUNK = re.compile(r"[\W_]+")
#: Pairs of offsets of the second and third character of a triple.
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_WEIGHTS = np.array([DECAY ** (b + 1) for _, b in _OFFSETS])


def sentences(text: str) -> Iterator[list[str]]:
    """The words of each sentence, with runs of four or more single characters joined as one more."""
    for part in _SENTENCE.split(text.lower()):
        words = part.split()
        if not words:
            continue
        short = bytes([len(w) == 1 for w in words])
        at = short.find(b"\1\1\1\1")
        while at >= 0:
            end = short.find(b"\0", at)
            end = len(short) if end < 0 else end
            words.append("".join(words[at:end]))
            at = short.find(b"\1\1\1\1", end)
        yield words


def bare(word: str) -> str:
    return START + _JUNK.sub("", word) + END


def _long(word: str) -> bool:
    return len(word) > LONGEST + 2


def _chars(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words in a row, and the word that each belongs to."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    return flat, np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))


#: The norm of a string by its length, taking its triples singly.
_NORMS = np.sqrt([sum(w * w * max(0, n - b) for (_, b), w in zip(_OFFSETS, _WEIGHTS)) for n in range(LONGEST + 3)])


def _profile(word: str) -> Counter:
    """The word's triples with their weights."""
    found: Counter = Counter()
    for i in range(len(word)):
        for (a, b), weight in zip(_OFFSETS, _WEIGHTS):
            if i + b < len(word):
                found[word[i] + word[i + a] + word[i + b]] += weight
    return found


def kernel(x: str, y: str) -> float:
    """The likeness of two strings: the plain definition. It is 1 for equal ones whose triples all differ."""
    p, q = _profile(x), _profile(y)
    norm = _NORMS[len(x)] * _NORMS[len(y)]
    return float(sum(v * q[k] for k, v in p.items()) / norm) if norm else 0.0


class Likeness:
    """Likenesses of many words to all landmarks, by way of the triples that landmarks have."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        classes = {c: k for k, c in enumerate(sorted(set("".join(landmarks))), 1)}
        self.base = len(classes) + 1
        self.table = np.zeros(max([0, *map(ord, classes)]) + 2, dtype=np.int32)
        for c, k in classes.items():
            self.table[ord(c)] = k
        found = [(k, (classes[t[0]] * self.base + classes[t[1]]) * self.base + classes[t[2]], w / _NORMS[len(x)]) for k, x in enumerate(landmarks) for t, w in _profile(x).items()]
        codes = sorted({c for _, c, _ in found})
        #: The row of weights that a triple has; row 0 is empty.
        self.row = np.zeros(self.base**3, dtype=np.int32)
        self.row[codes] = np.arange(1, len(codes) + 1)
        self.weights = np.zeros((len(codes) + 1, len(landmarks)), dtype=np.float32)
        for k, code, w in found:
            self.weights[self.row[code], k] += w
        self.most = self.weights.max(axis=1, initial=0)
        letters = {max(5, len(x.strip(START + END))) for x in landmarks}
        #: Lengths of the windows of long words.
        self.sizes = sorted({min(LONGEST, k) for n in letters for k in (n, n + n // 2)})

    def of(self, words: list[str]) -> np.ndarray:
        """One row per word; words are as bare() gives them. Unknown characters are gaps."""
        out = self._whole(["" if _long(w) else w for w in words])
        long = [i for i, w in enumerate(words) if _long(w)]
        if long and self.landmarks:
            for pieces, which, owner in self._windows([words[i] for i in long]):
                np.maximum.at(out, np.array(long)[owner], self._whole(pieces)[which])
        return out

    def _windows(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """The windows that may be like a landmark: different ones, and of each place its window and its word."""
        text = "\0".join(words)  # no word has this character
        starts = np.cumsum([0, *[len(w) + 1 for w in words[:-1]]])
        for at in range(0, len(text), PART):
            part = text[at : at + PART + LONGEST - 1]
            flat = np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)
            known = self.table[np.minimum(flat, len(self.table) - 1)]
            # Sums over all characters before each one: of its triples at their best landmarks, and of word ends.
            best, ends = np.zeros(len(flat) + 1), np.concatenate([[0], np.cumsum(flat == 0)])
            for (a, b), weight in zip(_OFFSETS, _WEIGHTS):
                if len(flat) > b:
                    best[1 : len(flat) - b + 1] += weight * self.most[self.row[(known[:-b] * self.base + known[a : len(flat) - b + a]) * self.base + known[b:]]]
            best = np.cumsum(best)
            pieces: dict[str, int] = {}
            which: list[int] = []
            owner: list[np.ndarray] = []
            for n in self.sizes:
                k = max(0, len(flat) - n + 1)
                good = np.flatnonzero((best[n - 2 : n - 2 + k] - best[:k] >= FLOOR * _NORMS[n] * 0.999) & (ends[n : n + k] == ends[:k]))
                for i in range(0, len(good), PIECES):
                    some = good[i : i + PIECES]
                    which += [pieces.setdefault(part[j : j + n], len(pieces)) for j in some.tolist()]
                    owner.append(np.searchsorted(starts, some + at, side="right") - 1)
                    if len(which) >= PIECES:
                        yield list(pieces), np.array(which), np.concatenate(owner)
                        pieces, which, owner = {}, [], []
            if which:
                yield list(pieces), np.array(which), np.concatenate(owner)

    def _whole(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        if not words or not self.landmarks:
            return out
        flat, owner = _chars(words)
        known = self.table[np.minimum(flat, len(self.table) - 1)]
        owners, rows, weights = [], [], []
        for (a, b), weight in zip(_OFFSETS, _WEIGHTS):
            if len(flat) > b:
                x = self.row[(known[:-b] * self.base + known[a : len(flat) - b + a]) * self.base + known[b:]]
                good = np.flatnonzero((x > 0) & (owner[:-b] == owner[b:]))
                owners.append(owner[good])
                rows.append(x[good])
                weights.append(np.full(len(good), weight, dtype=np.float32))
        if not owners:
            return out
        owners, rows, weights = map(np.concatenate, (owners, rows, weights))
        norms = np.maximum(_NORMS[np.fromiter(map(len, words), dtype=np.int64, count=len(words))], 1e-9)
        # A word whose triples, each at its best landmark, don't reach FLOOR can't be like any one landmark.
        near = np.bincount(owners, self.most[rows] * weights, len(words)) >= FLOOR * norms * 0.999
        left = np.flatnonzero(near[owners])
        left = left[np.argsort(owners[left], kind="stable")]
        some, first = np.unique(owners[left], return_index=True)
        if len(some):
            ends = [*range(0, len(some), 2000), len(some)]
            for i, j in zip(ends, ends[1:]):
                part = left[first[i] : first[j] if j < len(first) else len(left)]
                out[some[i:j]] = np.add.reduceat(self.weights[rows[part]] * weights[part, None], first[i:j] - first[i], axis=0)
        out /= norms[:, None]
        out[out < FLOOR] = 0
        return out


@dataclass(frozen=True)
class Model:
    likeness: Likeness
    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: the margin of its worst sentence, the logarithms of how far all its sentences together
        lie above a sentence without likeness and of how many there are, and 1."""
        known: dict[str, int] = {}
        docs = [[[known.setdefault(w, len(known)) for w in words] for words in sentences(text or "")] for text in texts]
        rows = self._rows(list(known))
        out = np.zeros((len(texts), 4))
        for k, parts in enumerate(docs):
            worst, above = 0.0, 0.0
            for ids in parts:
                found = [r for i in ids if (r := rows[i]) is not None]
                if found:
                    margin = found[0][1] if len(found) == 1 else float(np.maximum.reduce([r[0] for r in found]) @ self.weights)
                    if margin > 0:
                        above += margin
                        worst = max(worst, margin)
            out[k] = worst, np.log1p(above), np.log1p(len(parts)), 1
        return out

    def _rows(self, words: list[str]) -> list[tuple[np.ndarray, float] | None]:
        """Likenesses and the margin of each word alone, above the bias; None where there is no likeness."""
        out: list[tuple[np.ndarray, float] | None] = [None] * len(words)
        for i in range(0, len(words), 20_000):
            like = self.likeness.of([bare(w) for w in words[i : i + 20_000]])
            for k in np.flatnonzero(like.any(axis=1)).tolist():
                out[i + k] = (like[k], float(like[k] @ self.weights))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.curve, -50, 50)))


def _constant(share: float) -> Model:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return Model(Likeness([]), np.zeros(0), 0.0, np.array([0, 0, 0, np.log(share / (1 - share))]))


def choose_landmarks(docs: list[set[str]], toxic: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Words and beginnings of words by how much oftener toxic documents have them, leaving out any that is much
    like one chosen before; then frequent words of the others, as a contrast."""
    yes, no = Counter(), Counter()
    for words, t in zip(docs, toxic):
        found = {w for w in words if not _long(w)}
        for w in words:
            found.update(w[:n] for n in range(PREFIX, min(len(w) - 1, LONGEST + 1)))
        (yes if t else no).update(found)
    n_yes, n_no = toxic.sum(), (~toxic).sum()

    def gain(w: str) -> float:
        p, q = yes[w] / n_yes, no[w] / n_no
        return float((p - q) / np.sqrt(q * (1 - q) / n_yes + p * (1 - p) / n_yes + 1e-4))

    ranked = sorted((w[:LONGEST] for w, n in yes.items() if n >= 3 and gain(w) > 2), key=lambda w: (-round(gain(w)), -len(w), w))[: most * 30]
    chosen: list[str] = []
    for w in ranked:
        if len(chosen) >= most * 3 // 4:
            break
        if all(kernel(w, x) < ALIKE for x in chosen):
            chosen.append(w)
    contrast = [w for w, _ in sorted(no.items(), key=lambda x: (-x[1], x[0])) if w.endswith(END) and gain(w) <= 1]
    return chosen + contrast[: most - len(chosen)] if chosen else []


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """A linear support vector machine with squared slack, by Newton steps; the last column of x is 1."""
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge * weight.sum()
    penalty[-1, -1] *= 1e-3
    for _ in range(30):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(a.T @ x[inside] + penalty, a.T @ y[inside])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def logistic(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The curve from a document's features to its score, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.eye(x.shape[1]) * 1e-3
        step = np.clip(np.linalg.solve(h, x.T @ (weight * (toxic - p)) - 1e-3 * w), -2, 2)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def with_gaps(word: str, seed: int) -> str:
    """word with one character inserted, for training."""
    inner = word[1:-1] if word.endswith(END) else word[1:]
    at = 1 + seed % max(1, len(inner) - 1)
    return word[:1] + inner[:at] + "xqz0"[seed % 4] + inner[at:] + (END if word.endswith(END) else "")


def train(texts: list[str | None], toxic: np.ndarray, share: float) -> Model:
    """share: of toxic rows among all labelled ones, which the sample need not keep."""
    if not len(texts) or toxic.all() or not toxic.any():
        return _constant(share)
    parts = [[[bare(w) for w in s] for s in sentences(t or "")] for t in texts]
    marks = choose_landmarks([{w for s in p for w in s if len(w) > 4} for p in parts], toxic)
    if not marks:
        return _constant(share)
    likeness = Likeness(marks)
    vocabulary = {w: i for i, w in enumerate(sorted({w for p in parts for s in p for w in s}))}
    words = list(vocabulary)
    found: dict[int, np.ndarray] = {}
    for i in range(0, len(words), 20_000):
        like = likeness.of(words[i : i + 20_000])
        found |= {i + int(k): like[k] for k in np.flatnonzero(like.any(axis=1))}
    owner, rows = [], []
    good = len(marks) * 3 // 4
    for d, p in enumerate(parts):
        own = [np.maximum.reduce(hit) for s in p if (hit := [found[k] for w in s if (k := vocabulary[w]) in found])]
        rows += own or [np.zeros(len(marks), dtype=np.float32)]
        owner += [d] * max(1, len(own))
    k, owner_ = np.array(rows), np.array(owner)
    values, vectors = np.linalg.eigh(likeness.of(marks))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    x = np.column_stack([k @ root, np.ones(len(k))])
    gapped = likeness.of([with_gaps(w, i) for i, w in enumerate(marks[:good])])
    gapped = np.column_stack([gapped[gapped.any(axis=1)] @ root, np.ones(int(gapped.any(axis=1).sum()))])
    margin = k[:, :good].max(axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(6):
        order = np.lexsort((-margin, owner_))
        rank = np.arange(len(order)) - np.searchsorted(owner_[order], owner_[order])
        first, hard = order[rank == 0], order[rank < 6]
        worst, others = first[toxic[owner_[first]]], hard[~toxic[owner_[hard]]]
        data = np.concatenate([x[worst], gapped, x[others]])
        y = np.concatenate([np.ones(len(worst) + len(gapped)), -np.ones(len(others))])
        weight = np.concatenate([np.full(len(worst), 1 / len(worst)), np.full(len(gapped), 0.3 / max(1, len(gapped))), np.full(len(others), 1 / max(1, len(others)))])
        new = squared_hinge(data, y, weight)
        margin = x @ new
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    model = Model(likeness, root @ w[:-1], float(w[-1]), np.zeros(4))
    weight = np.where(toxic, share / toxic.sum(), (1 - share) / (~toxic).sum()) * len(texts)
    return replace(model, curve=logistic(model.features(texts), toxic.astype(float), weight))


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled rows that aren't held out. Only the sample's ids are broadcast, and only its rows
    reach the driver: MOST_TOXIC and MOST_OTHER of them at most, as documents that share an id give one, the
    least text."""
    known = labels.select(F.col(doc_id).alias("id"), (F.col(label) == 1).alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id")))
    count = known.agg(F.count_if("toxic"), F.count("*")).first()
    sample = None
    for value, most in ((True, MOST_TOXIC), (False, MOST_OTHER)):
        some = known.filter(F.col("toxic") == value).orderBy(F.xxhash64("id"), "id").limit(most)
        sample = some if sample is None else sample.unionByName(some)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample.distinct()), "id")
    rows = rows.groupBy("id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r.id, r.toxic, r.text or ""))
    return train([r.text for r in rows], np.array([r.toxic for r in rows], dtype=bool), count[0] / max(1, count[1]))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a column of scores."""
    source, = free_name(docs, "scored_text")
    schema = T.StructType([*docs.drop(into).schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[f.name for f in schema.fields])

    return docs.withColumn(source, F.col(text)).drop(into).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document's score by a model that saw no label of a held-out row."""
    docs = docs.select("doc_id", "text")
    rows = score(docs, fit(docs, labels)).drop("text")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
