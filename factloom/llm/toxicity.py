"""Toxicity: a support vector machine over a subsequence string kernel.

Method: two words are compared by the gap-weighted subsequence kernel of order
three (Lodhi et al. 2002): every common triple of characters, in order but not
necessarily adjacent, counts once, ``DECAY`` to the power of the stretch it spans, so
letters put between those of an insult only weaken the match (a word's triples may
span so much more than a landmark's that a letter in every gap loses none); other signs
between letters are passed over, and digits stand for the letters they look like.  The kernel is taken as a
share of the landmark's kernel with itself and raised to ``POWER`` (a power of a
kernel is a kernel); sentences are compared by the sum over their distinct words.  A
linear squared-hinge SVM is trained on Nystroem features, the kernel values to
``LANDMARKS`` landmarks (words and beginnings of words) whitened by the
landmarks' own kernel matrix.

Because sentences add over words, the trained machine is one number a word: a
task evaluates the kernel once for each distinct word and adds.

Training: at most ``SAMPLE`` labelled documents of each class (in the order of a
hash of the id) are read; near copies among them count once.  Sentences of clean
documents are negatives; of every toxic document the sentence that the machine
scores highest is its positive (multiple-instance training, started from word
log-odds).  A document's score is the logistic calibration of its two highest
sentences.  Only texts and labels take part, and held-out rows are never read.

Defined results: null, empty and wordless texts score like a sentence without
words; tokens of over ``LONGEST`` characters are read as overlapping pieces;
rows are scored each for itself, so repeated rows and null ids are fine; without
labels of both classes every score is 0; an empty table gives an empty table.
Only the id and text columns of documents are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Labelled documents of each class that training reads at most.
SAMPLE = 1000
LANDMARKS = 48
#: Triples of a landmark span at most ``REACH`` characters; those of a word ``SPAN``,
#: which still holds them all with a letter put into every gap.
#: These and ``FLOOR`` are chosen by cross-validation on labels not held out, plain
#: and with letters put into the insults.
DECAY, POWER, REACH, SPAN = 0.97, 6, 5, 9
#: Shares of a landmark's kernel under this count as none.
FLOOR = 0.7
LONGEST, OVERLAP = 32, 8
#: Words a task remembers before it starts afresh, characters of text whose words
#: it holds at once, and words whose triples it holds at once.
MAX_WORDS, STRETCH_CHARS, BLOCK = 400_000, 1_000_000, 1024
THRESHOLD = 0.3

_SENTENCE = re.compile(r"[.!?;]+(?=\s)|\n")
_EDGE = " \t\r\x0b\x0c.,;:!?\"'()[]{}<>*_-"
_LETTERS = 48
#: Digits and signs that stand in for letters.
_STAND_INS = dict(zip("013457@$", "oieasta" + "s"))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: CRC-32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sentences(text: str) -> list[list[str]]:
    """Distinct words of every sentence, long ones in overlapping pieces; a row of
    three or more single letters is read as one word."""
    out = []
    for part in _SENTENCE.split(text.lower()):
        words, singles = [], []
        for w in part.split():
            w = w.strip(_EDGE)
            if len(w) == 1:
                singles.append(w)
                continue
            if singles:
                words += ["".join(singles)] if len(singles) > 2 else []
                singles = []
            if w:
                words.append(w)
        if len(singles) > 2:
            words.append("".join(singles))
        if words:
            out.append(list(dict.fromkeys(p for w in words for p in _cut(w))))
    return out


def _cut(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[a:a + LONGEST] for a in range(0, len(word) - OVERLAP, LONGEST - OVERLAP)]


@cache
def _code(c: str) -> int:
    """Letters a-z 1 to 26, other letters 27 to 47 by code; the rest 0."""
    c = _STAND_INS.get(c, c)
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 21 if c.isalpha() else 0


@cache
def _triples(n: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j < k of a word of n characters that span at most ``span``,
    and their weights."""
    at = np.array([(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + span)) for j in range(i + 1, k)],
                  np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and character codes of words of equal length, without the
    signs put between their letters."""
    coded = [[k for k in map(_code, w) if k] for w in words]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for block in np.array_split(rows, -(-len(rows) // BLOCK)):
            yield block, np.array([coded[r] for r in block], np.int32)


def _features(codes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (triples x words) of a block, and the triples' weights."""
    at, weights = _triples(codes.shape[1], span)
    by_place = np.ascontiguousarray(codes.T)
    a, b, c = (by_place[at[:, i]] for i in range(3))
    return (a * _LETTERS + b) * _LETTERS + c, weights


def kernel_to(words: list[str], landmark_map: np.ndarray) -> np.ndarray:
    """Kernel of words to landmarks, as a share of the landmark's own, to the
    power ``POWER``.  ``landmark_map``: feature x landmark weights."""
    out = np.zeros((len(words), landmark_map.shape[1]), np.float32)
    most = landmark_map.max(1)
    for rows, codes in _by_length(words):
        features, weights = _features(codes, SPAN)
        # No landmark's share is over the sum of the most that any has of each triple.
        within = np.zeros(len(rows), np.float32)
        for t, numbers in enumerate(features):
            within += weights[t] * most[numbers]
        near = np.flatnonzero(within >= FLOOR - 1e-4)
        rows, features = rows[near], features[:, near]
        dots = np.zeros((len(rows), landmark_map.shape[1]), np.float32)
        for t, numbers in enumerate(features):
            dots += weights[t] * landmark_map[numbers]
        # Triples that a word repeats count once, at their tightest stretch: only
        # words that may reach the floor are worth telling repeats apart.
        for i in np.flatnonzero((dots >= FLOOR - 1e-4).any(1)):
            distinct, inverse = np.unique(features[:, i], return_inverse=True)
            tightest = np.zeros(len(distinct), np.float32)
            np.maximum.at(tightest, inverse, weights)
            share = np.minimum(tightest @ landmark_map[distinct], 1)
            out[rows[i]] = np.where(share >= FLOOR, share, 0) ** POWER
    return out


def landmark_matrix(landmarks: list[str]) -> np.ndarray:
    """Feature x landmark weights, divided by the landmark's kernel with itself."""
    out = np.zeros((_LETTERS ** 3, len(landmarks)), np.float32)
    for rows, codes in _by_length(landmarks):
        features, weights = _features(codes, REACH)
        for i, row in enumerate(rows):
            np.maximum.at(out[:, row], features[:, i], weights)
    return out / np.maximum((out ** 2).sum(0), 1e-9)


def landmark_gram(landmark_map: np.ndarray) -> np.ndarray:
    """Normalised kernel between landmarks to the power ``POWER``."""
    unit = landmark_map / np.maximum(np.sqrt((landmark_map ** 2).sum(0)), 1e-12)
    return (unit.T @ unit).astype(float) ** POWER


@dataclass
class Model:
    """Landmarks, their weights in the machine, and the calibration."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    calibration: np.ndarray

    def word_scores(self) -> Callable[[list[str]], np.ndarray]:
        table = landmark_matrix(self.landmarks)

        def score(words: list[str]) -> np.ndarray:
            return kernel_to(words, table) @ self.weights

        return score

    def probability(self, highest: np.ndarray) -> np.ndarray:
        """Of documents, by the values of their two highest sentences."""
        return 1 / (1 + np.exp(-np.clip(highest @ self.calibration[:2] + self.calibration[2], -30, 30)))


def two_highest(values: list[float], bias: float) -> list[float]:
    """Of a document's sentence sums; sentences it lacks have no words."""
    return [v + bias for v in sorted([*values, 0.0, 0.0])[:-3:-1]]


def _distinct_documents(texts: list[str]) -> list[int]:
    """Numbers of the texts without near copies of earlier ones: half of the 16
    smallest hashes of three words in common."""
    seen: dict[int, list[int]] = {}
    keep = []
    for i, text in enumerate(texts):
        words = text.lower().split()
        sketch = sorted({zlib.crc32(" ".join(words[a:a + 3]).encode()) for a in range(len(words))})[:16]
        shared = Counter(j for h in sketch for j in seen.get(h, ()))
        if not shared or max(shared.values()) < max(1, len(sketch) // 2):
            keep.append(i)
            for h in sketch:
                seen.setdefault(h, []).append(i)
    return keep


def _choose_landmarks(docs: list[set[str]], toxic: np.ndarray) -> tuple[list[str], dict[str, float]]:
    """Words and beginnings of words by the log-odds of their document frequency:
    the most telling of toxic documents (found in a hundredth of them), each
    unlike the ones before.  Also the odds of all."""
    def strings(doc: set[str]) -> set[str]:
        return {w[:n] for w in doc for n in (4, 5, 6, 7, len(w)) if 3 <= n <= min(len(w), LONGEST)}

    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    in_toxic = Counter(w for d, t in zip(docs, toxic) if t for w in strings(d))
    in_clean = Counter(w for d, t in zip(docs, toxic) if not t for w in strings(d))
    odds = {w: float(np.log((c + 0.5) / (n_toxic + 1) / ((in_clean[w] + 0.5) / (n_clean + 1))))
            for w, c in in_toxic.items() if c >= max(2, 0.01 * n_toxic)}
    ranked = sorted((w for w in odds if odds[w] > 1),
                    key=lambda w: (-odds[w] * np.sqrt(in_toxic[w]), -len(w), w))[:8 * LANDMARKS]
    alike = kernel_to(ranked, landmark_matrix(ranked)) if ranked else np.zeros((0, 0))
    taken: list[int] = []
    for i in range(len(ranked)):
        if len(taken) < LANDMARKS and max((max(alike[i, j], alike[j, i]) for j in taken), default=0) < 0.3:
            taken.append(i)
    return [ranked[i] for i in taken], odds


def _svm(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear squared-hinge machine with balanced classes, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    c = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * strength / len(y) * 100
    w, ridge = np.zeros(x1.shape[1]), np.r_[np.ones(x.shape[1]), 1e-3]
    for _ in range(30):
        active = y * (x1 @ w) < 1
        xa, ca = x1[active], c[active]
        new = np.linalg.solve(np.diag(ridge) + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _calibration(v: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Slopes and shift of the logistic curve (Platt's targets), by Newton steps."""
    target = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    x, w = np.c_[v, np.ones(len(v))], np.array([1.0, 0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g, h = x.T @ (p - target) + 1e-2 * w, (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    # A second sentence never speaks for a document.
    return w if w[1] >= 0 else np.insert(_calibration(np.c_[v[:, 0], np.zeros(len(v))], toxic)[[0, 2]], 1, 0.0)


def fit(texts: list[str], toxic: list[bool]) -> Model | None:
    """Train on labelled texts; None without both classes or telling words."""
    keep = _distinct_documents(texts)
    labels = np.array([toxic[i] for i in keep], bool)
    docs = [sentences(texts[i]) or [[]] for i in keep]
    if labels.all() or not labels.any():
        return None
    landmarks, odds = _choose_landmarks([{w for s in d for w in s} for d in docs], labels)
    if not landmarks:
        return None
    table = landmark_matrix(landmarks)
    values, vectors = np.linalg.eigh(landmark_gram(table) + 1e-6 * np.eye(len(landmarks)))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T

    words = sorted({w for d in docs for s in d for w in s})
    number = {w: i for i, w in enumerate(words)}
    per_word = kernel_to(words, table) @ whiten if words else np.zeros((0, len(landmarks)))
    rows = [(i, s) for i, d in enumerate(docs) for s in d]
    x = np.array([per_word[[number[w] for w in s]].sum(0) if s else np.zeros(len(landmarks)) for _, s in rows])
    owner = np.array([i for i, _ in rows])
    telling = {w: max((odds.get(w[:n], 0.0) for n in (4, 5, 6, 7, len(w))), default=0.0) for w in words}
    first = np.array([sum(max(0.0, telling[w] - 1) for w in s) for _, s in rows])
    clean = ~labels[owner]
    value = first
    for _ in range(4):
        # The highest sentence of each toxic document.
        order = np.lexsort((-value, owner))
        witness = order[np.r_[True, np.diff(owner[order]) > 0]]
        witness = witness[labels[owner[witness]]]
        use = np.r_[witness, np.flatnonzero(clean)]
        w, bias = _svm(x[use], np.where(clean[use], -1.0, 1.0))
        value = x @ w + bias
    sums: list[list[float]] = [[] for _ in docs]
    for i, v in zip(owner, x @ w):
        sums[i].append(v)
    highest = np.array([two_highest(v, bias) for v in sums])
    return Model(landmarks, whiten @ w, bias, _calibration(highest, labels))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE) -> Model | None:
    """Read the bounded sample of labelled rows that are not held out, and fit."""
    known = (labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("label_id")).agg(F.max("toxic").alias("toxic")))
    order = [F.xxhash64("label_id"), F.col("label_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(sample).unionByName(
        known.filter("toxic = 0").orderBy(*order).limit(sample))
    # At most 2 * sample ids: a broadcast of proven size, so texts are not shuffled.
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
            .select("id", "text", "toxic").orderBy("id", F.xxhash64("text")).toArrow())
    return fit([t or "" for t in rows["text"].to_pylist()], [t == 1 for t in rows["toxic"].to_pylist()])


def _stretches(texts: pa.Array) -> Iterator[list[str]]:
    """All texts in turn, about ``STRETCH_CHARS`` of them (or one text) at once."""
    out, size = [], 0
    for text in texts:
        out.append(text.as_py() or "")
        size += len(out[-1])
        if size >= STRETCH_CHARS:
            yield out
            out, size = [], 0
    if out:
        yield out


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
          score_col: str = "score", keep_text: bool = False) -> DataFrame:
    """The id column (with ``keep_text`` all columns) of every row, and its score."""
    src = docs if keep_text else docs.select(id_col, text_col)
    if model is None:
        return src.withColumn(score_col, F.lit(0.0)).drop(*[] if keep_text else [text_col])
    fields = [f for f in src.schema if keep_text or f.name != text_col]
    at = src.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_scores, known = model.word_scores(), {}
        for batch in batches:
            highest: list[list[float]] = []
            for texts in _stretches(batch.column(at)):
                docs_ = [sentences(t) for t in texts]
                if len(known) > MAX_WORDS:
                    known.clear()
                new = list({w for d in docs_ for s in d for w in s if w not in known})
                known.update(zip(new, word_scores(new).tolist()))
                highest += [two_highest([sum(map(known.__getitem__, s)) for s in d], model.bias) for d in docs_]
            scores = pa.array(model.probability(np.array(highest).reshape(-1, 2)), pa.float64())
            yield pa.record_batch([c for i, c in enumerate(batch.columns) if keep_text or i != at] + [scores],
                                  names=[f.name for f in fields] + [score_col])

    return src.mapInArrow(run, StructType([*fields, StructField(score_col, DoubleType())]))
