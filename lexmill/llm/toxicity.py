"""Toxicity scores from subword-bag embeddings.

Words are runs of ``\\w``; a run of more than ``PIECE`` characters counts as words of that length that overlap
by ``OVERLAP``. A word is a bag of its character n-grams (``GRAMS`` characters with word-end marks) and itself, each hashed
to a row of an embedding table; a word's vector is the average of its n-grams', a
passage's the average over its ``WINDOW`` places (a repeated word counts once, an empty place as zero) times ``GAIN``, and
a linear softmax over two classes scores it. Table and softmax are trained jointly in numpy. A text is
toxic if any passage is: its logit is that of its highest passage, so a few words count as much in a text of
20,000 words as in one of twenty; an average over the whole text would bury them.

Misspelt or inflected forms never seen in training share n-grams with known ones. To make the model rely on all of them,
training drops n-grams at random, and misspells: in each epoch a share ``TYPOS`` of the words has a character replaced by one
that no n-gram knows, so that those across it are gone.

The training texts are a bounded sample: at most ``PER_CLASS`` labelled texts of each class, whole, the ids
with the smallest hashes. Scoring reads every word of every text. A softmax over an average is linear in
the n-grams, so the two class scores of every bucket are worked out once, and a word costs one look-up.

Defined results: a null text is an empty one; a text without words is scored by the bias alone; labels of
null or other values than 0 and 1 count for nothing; without both classes in the sample every score is the
share of toxic labels (0.0 without any). Repeated rows stay; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

PER_CLASS = 1_500
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 8
WINDOW, GAIN = 2, 2.0
PIECE, OVERLAP = 64, 16
EPOCHS = 80
RATE, DECAY, DROP, TYPOS, HEAT, EPS = 0.1, 1e-5, 0.3, 0.65, 8.0, 1e-5
#: Where in the range of thresholds that err least on the sample the one taken lies.
CUT = 0.1
#: Fits from different starts whose average scores.
MODELS = 3
#: N-grams that one step of the training works on.
GRAM_BLOCK = 1 << 19
CACHE_WORDS = 200_000

_WORD = re.compile(r"\w+")


def words_of(text: bytes) -> list[str]:
    """A text's words; runs of more than ``PIECE`` characters as pieces that overlap, so that all of a run counts."""
    words = _WORD.findall(text.decode("utf-8", "replace").lower())
    if all(len(w) <= PIECE for w in words):
        return words
    step = PIECE - OVERLAP
    return [w[i : i + PIECE] for w in words for i in range(0, max(1, len(w) - OVERLAP), step)]


def buckets_of(word: str) -> list[int]:
    """The table rows of a word's n-grams and of the word itself."""
    w = f"<{word}>".encode("utf-16-le", "surrogatepass")  # two bytes for a character
    grams = [w[i : i + 2 * n] for n in GRAMS for i in range(0, len(w) - 2 * n + 1, 2)]
    grams.append(word.encode())
    return [h % BUCKETS for h in map(zlib.crc32, grams)]


@dataclass
class SubwordModel:
    """``gram``: log-odds of each bucket; a passage's logit is their average times ``GAIN``, plus ``bias``."""

    gram: np.ndarray
    bias: float


class _Scores(dict):
    """Caches the score of each word: the average of its n-grams."""

    def __init__(self, model: SubwordModel):
        super().__init__()
        self.gram = model.gram.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        b = buckets_of(word)
        self[word] = got = sum(map(self.gram.__getitem__, b)) / len(b)
        return got


def _passages(values: np.ndarray) -> np.ndarray:
    """Rows of WINDOW values, one every half passage; the last ones end in nan where the text ends."""
    step = WINDOW // 2
    rows = max(1, -(-(len(values) - step) // step))
    padded = np.full(step * (rows + 1), np.nan)
    padded[: len(values)] = values
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


def _once(passages: np.ndarray) -> np.ndarray:
    """Sorts each passage and sets all but one of equal values to nan: a repeated word counts once."""
    rows = np.sort(passages, axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = np.nan
    return rows


def logit(model: SubwordModel, text: bytes, scores: _Scores) -> float:
    """The log-odds of a text: those of its highest passage. Every word of the text is read."""
    words = words_of(text)
    if not words:
        return model.bias
    values = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    return float(np.nansum(_once(_passages(values)), axis=1).max() * GAIN / WINDOW) + model.bias


def train(sample: list[tuple[bytes, int]], seed: int = 11, epochs: int = EPOCHS, models: int = MODELS) -> SubwordModel:
    """The average of ``models`` fits from different starts, which is a model of the same kind, and its threshold."""
    share = float(np.mean([y for _, y in sample])) if sample else 0.0
    if not 0 < share < 1:
        p = min(max(share, 1e-9), 1 - 1e-9)
        return SubwordModel(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    model = SubwordModel(np.zeros(BUCKETS), 0.0)
    y = np.array([label for _, label in sample], np.float64)
    data = _Prepared(sample)
    for k in range(models):
        model.gram += _fit_once(data, y, seed + k, epochs) / models
    del data
    # Move the threshold to where it errs least on the sample.
    scores = _Scores(model)
    top = np.array([logit(model, text, scores) for text, _ in sample])
    order = np.unique(top)
    cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]])
    up, down = np.sort(top[y == 1]), np.sort(top[y == 0])
    wrong = np.searchsorted(up, cuts) + len(down) - np.searchsorted(down, cuts)
    best = cuts[wrong == wrong.min()]
    model.bias = -float(best[0] + CUT * (best[-1] - best[0]))
    return model


class _Prepared:
    """The sample as numbers, for all fits: passages as numbers of their words, words as numbers of their buckets."""

    def __init__(self, sample: list[tuple[bytes, int]]):
        known: dict[str, int] = {}
        rows, doc_first = [], [0]
        for text, _ in sample:
            ids = np.array([known.setdefault(w, len(known)) for w in words_of(text)], np.float64)
            rows.append(np.nan_to_num(_once(_passages(ids)), nan=-1).astype(np.int32))
            doc_first.append(doc_first[-1] + len(rows[-1]))
        self.windows = np.concatenate(rows)  # word numbers; -1 for none
        del rows
        self.doc_of = np.repeat(np.arange(len(sample), dtype=np.int32), np.diff(doc_first))
        self.doc_first = np.array(doc_first[:-1])
        grams, sizes, lens = (array("i") for _ in range(3))
        starts, ends = array("B"), array("B")  # a word has PIECE characters at most
        for w in known or {"": 0}:
            b = buckets_of(w)
            grams.extend(b)
            sizes.append(len(b))
            lens.append(max(1, len(w)))
            for n in GRAMS:  # which characters a gram covers, in the order of buckets_of
                starts.extend(range(0, len(w) + 3 - n))
                ends.extend(range(n, len(w) + 3))
            starts.append(0)
            ends.append(len(w) + 2)
        del known
        self.sizes, self.lens = np.array(sizes), np.array(lens)
        self.starts, self.ends = np.frombuffer(starts, np.uint8), np.frombuffer(ends, np.uint8)
        grams = np.frombuffer(grams, np.int32)
        self.used = np.flatnonzero(np.bincount(grams, minlength=BUCKETS))
        place = np.zeros(BUCKETS, np.int32)
        place[self.used] = np.arange(len(self.used), dtype=np.int32)
        self.flat = place[grams]
        self.owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def blocks(self):
        """The n-grams in parts, so that what is worked out for each of them is never all in memory."""
        for at in range(0, len(self.flat), GRAM_BLOCK):
            yield slice(at, at + GRAM_BLOCK)

    def by_word(self, of_gram) -> np.ndarray:
        """Sums over each word's n-grams of what ``of_gram`` gives for a part of them."""
        out = np.zeros(len(self.sizes))
        for part in self.blocks():
            owner = self.owner[part]
            out[owner[0] : owner[-1] + 1] += np.bincount(owner - owner[0], of_gram(part))
        return out


def _fit_once(data: _Prepared, y: np.ndarray, seed: int, epochs: int) -> np.ndarray:
    """The log-odds of the buckets: embedding table and softmax fitted jointly, by Adam on whole passes over the sample.

    Passages share their text's label by weight, all alike at first, then more and more the highest. As the
    softmax is linear, a pass needs one number for each bucket, its vector times the difference of the two
    class vectors; the exact gradients of the vectors follow from the gradient of that number.
    """
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)  # both classes alike
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (len(data.used), DIM))
    soft = rng.normal(0, 0.5, (2, DIM))
    bias = np.zeros(2)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, soft, bias)]
    n_words = len(data.sizes)
    for epoch in range(epochs):
        keep = rng.random(len(data.flat), np.float32) > DROP
        live = np.maximum(data.by_word(lambda part, keep=keep: keep[part]), 1)
        typo = np.where(rng.random(n_words) < TYPOS, 1 + (rng.random(n_words) * data.lens).astype(np.uint8), 255).astype(np.uint8)
        for part in data.blocks():  # a misspelt word has as many grams as before, but these say nothing
            at = typo[data.owner[part]]
            keep[part] &= (data.starts[part] > at) | (data.ends[part] <= at)
        number = emb @ (soft[1] - soft[0])
        word = np.append(data.by_word(lambda part, number=number, keep=keep: number[data.flat[part]] * keep[part]) / live, 0.0)
        word = (word * GAIN / WINDOW).astype(np.float32)
        odds = sum(word[data.windows[:, k]] for k in range(WINDOW)) + np.float32(bias[1] - bias[0])
        w = odds - np.maximum.reduceat(odds, data.doc_first)[data.doc_of]
        w *= np.float32(HEAT * epoch / epochs)
        np.exp(w, out=w)
        w /= np.add.reduceat(w, data.doc_first)[data.doc_of]
        pooled = np.add.reduceat(w * odds, data.doc_first)
        err = (1 / (1 + np.exp(-np.clip(pooled, -30, 30))) - y) * weight
        g = w * err.astype(np.float32)[data.doc_of]
        del odds, w
        per_word = sum(np.bincount(data.windows[:, k] + 1, g, n_words + 1) for k in range(WINDOW))[1:] * GAIN / WINDOW / live
        slope = np.zeros(len(data.used))
        for part in data.blocks():
            slope += np.bincount(data.flat[part], per_word[data.owner[part]] * keep[part], len(data.used))
        d_emb = slope[:, None] * (soft[1] - soft[0]) + DECAY * emb
        d_soft = np.stack([-(slope @ emb), slope @ emb])
        d_bias = np.array([-g.sum(), g.sum()])
        for p, grad, m in zip((emb, soft, bias), (d_emb, d_soft, d_bias), moments, strict=True):
            m[0] += 0.1 * (grad - m[0])
            m[1] += 0.01 * (grad * grad - m[1])
            p -= RATE * (m[0] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(m[1] / (1 - 0.99 ** (epoch + 1))) + EPS)
    gram = np.zeros(BUCKETS)
    gram[data.used] = emb @ (soft[1] - soft[0])
    return gram


def fit(docs: DataFrame, labels: DataFrame, keep: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> SubwordModel:
    """Train on at most ``per_class`` labelled texts of each class among the label rows that ``keep`` picks."""
    return train(labelled_sample(docs, labels, label, keep, per_class, id_col, text_col))


def score(df: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row."""

    def scan(batches):
        scores = _Scores(model)
        for batch in batches:
            z = np.array([logit(model, t.as_py() or b"", scores) for t in batch.column(1)], np.float64)
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, score double")


def drop_toxic(df: DataFrame, model: SubwordModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text scores below ``threshold``."""
    at = df.columns.index(text_col)

    def scan(batches):
        scores = _Scores(model)
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            z = np.array([logit(model, t.as_py() or b"", scores) for t in texts], np.float64)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))

    return df.mapInArrow(scan, df.schema)
