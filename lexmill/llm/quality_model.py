"""Quality scores from hashed word n-grams: logistic regression by follow-the-regularised-leader updates.

A text is read as words and runs of other marks, lower-cased; a word that repeats the one before it is
read as a repetition mark, so that repetition itself is a feature whichever word it is. Features are the
unigrams and bigrams of that sequence, hashed into ``BUCKETS`` columns and weighted by count over length.
Training takes one pass after another over a bounded sample (at most ``PER_CLASS`` labelled texts of each
class, whole, the ids with the smallest hashes), with per-coordinate FTRL-proximal steps, whose L1 term keeps
the weights sparse. A score is the logistic of a sparse dot product over the whole text.

Defined results: a null text is an empty one; a text without words is scored by the bias alone; labels of
null or other values than 0 and 1 count for nothing; without both classes every score is the share of
labels 1 (0.5 without labels). Repeated rows stay; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

PER_CLASS = 2_500
BITS = 18
BUCKETS = 1 << BITS
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
SCALE = 25.0
CACHE_WORDS = 200_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Odd multipliers that mix a token number, and a pair of them, into a bucket.
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_REPEAT, _START = np.uint64(0x1B873593), np.uint64(0xCC9E2D51)


class _Numbers(dict):
    """A hash of each token, cached."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        b = token.encode("utf-8", "surrogatepass")
        self[token] = h = zlib.crc32(b) | zlib.adler32(b) << 32
        return h


def features(text: bytes, numbers: _Numbers) -> tuple[np.ndarray, int]:
    """The bucket of every unigram and bigram of a whole text, with repeats, and the number of tokens."""
    tokens = _TOKEN.findall(text.decode("utf-8", "replace").lower())
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), 0
    h = np.fromiter(map(numbers.__getitem__, tokens), np.uint64, n)
    again = np.concatenate([[False], h[1:] == h[:-1]])
    h = np.where(again, _REPEAT, h)
    before = np.concatenate([[_START], h[:-1]])
    shift = np.uint64(64 - BITS)
    one = (h * _MIX) >> shift
    two = ((h * _MIX2) ^ (before * _MIX + np.uint64(1))) * _MIX2 >> shift
    return np.concatenate([one, two]).astype(np.int64), n


@dataclass
class LinearModel:
    weight: np.ndarray
    bias: float


def train(sample: list[tuple[bytes, int]], seed: int = 5, epochs: int = EPOCHS) -> LinearModel:
    """FTRL-proximal over the sample in a fixed random order, both classes weighing the same."""
    share = float(np.mean([y for _, y in sample])) if sample else 0.5
    if not 0 < share < 1:
        p = min(max(share, 1e-9), 1 - 1e-9)
        return LinearModel(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    numbers = _Numbers()
    rows = []
    for text, y in sample:
        b, n = features(text, numbers)
        at, count = np.unique(b, return_counts=True)
        rows.append((np.append(at, BUCKETS), np.append(SCALE * count / max(1, 2 * n), 1.0), y))
    z, n2 = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def solve(zs, ns):
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            w = solve(z[at], n2[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x * (0.5 / share if y else 0.5 / (1 - share))
            sigma = (np.sqrt(n2[at] + g * g) - np.sqrt(n2[at])) / ALPHA
            z[at] += g - sigma * w
            n2[at] += g * g
    w = solve(z, n2)
    return LinearModel(w[:-1], float(w[-1]))


def logit(model: LinearModel, text: bytes, numbers: _Numbers) -> float:
    b, n = features(text, numbers)
    return model.bias + (SCALE * float(model.weight[b].sum()) / (2 * n) if n else 0.0)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> LinearModel:
    """Train on at most ``per_class`` labelled texts of each class among the label rows that ``keep`` picks."""
    return train(labelled_sample(docs, labels, label, keep, per_class, id_col, text_col))


def score(df: DataFrame, model: LinearModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row."""

    def scan(batches):
        numbers = _Numbers()
        for batch in batches:
            z = np.array([logit(model, t.as_py() or b"", numbers) for t in batch.column(1)], np.float64)
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, score double")
