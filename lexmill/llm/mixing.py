"""Mixing sources to target weights through soft domain membership.

A document's domain isn't taken from its record but predicted: a multinomial classifier over hashed words,
fitted on a bounded sample of a labelled table, gives every document posteriors over the domains. A document
then has a rate r >= 0, its expected number of copies, and the expected tokens of a domain are the sum of
rate * tokens * posterior. Rates are fitted to the target totals by distributed projected-gradient least
squares: a round sums the domain totals over all documents, turns the misfit e (measured in the norm of
the inverse Gram matrix of the posteriors, so that steps of size one converge) into the gradient
posterior . e of each document, and projects its new rate to zero or more. Only the domain totals and the Gram
matrix, a few numbers, come to the driver. A rate depends on a document's posteriors and the list of
misfits alone, so it is worked out from them wherever it is needed, and a lost executor loses nothing.

Rounds go on until the misfit (the sum of absolute differences between weights) is below ``TOLERANCE``, or until a round
takes less than a thousandth off it: with rates of zero or more, targets can be out of reach. ``misfit`` of the fitted model says what is
left, and a warning if that is more than ``WORTH_SAYING``.

A text counts as ``EVIDENCE`` independent words at most when its posterior is worked out, so long texts aren't taken
for surer than they are; its tokens all count.

``total`` says how many tokens the mixture has: "same" as the input, or "grow": the least total at which no
domain needs less than it has, so that nothing is thinned out.

Defined results: a null or empty text has no tokens, prior posteriors, and no part in the totals; domains
absent from the labelled sample can't be met and their weight goes to the others in proportion; with no
domain at all, every rate is one. Without stated domains all of the labelled table's count (``MOST_DOMAINS`` at most, more are an error). Repeated rows count each; null ids are kept; other columns are ignored by
:func:`rates` and passed through by :func:`apply_rates`; empty tables give empty tables.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

PER_DOMAIN = 600
BITS = 16
TOLERANCE, WORTH_SAYING = 1e-6, 1e-3
#: Domains that a model can tell apart: its table has 2 ** BITS numbers for each.
MOST_DOMAINS = 256
#: Rows of a batch that rows are repeated into.
ROWS = 1_024
CACHE_WORDS = 200_000
#: Posteriors are tempered: a text counts as this many independent words at most.
EVIDENCE = 12.0


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = b = zlib.crc32(word) & ((1 << BITS) - 1)
        return b


@dataclass
class DomainModel:
    """Log-probabilities of hashed words for each domain, the fitted history of misfits, and the misfit that is left."""

    domains: list[str]
    log_word: np.ndarray
    log_prior: np.ndarray
    history: list[list[float]] = field(default_factory=list)
    misfit: float = 0.0

    def posterior(self, text: bytes, buckets: _Buckets) -> tuple[int, np.ndarray]:
        """Number of tokens, and the posterior of each domain."""
        words = text.lower().split()
        z = self.log_prior.copy()
        if words:
            b = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
            z += min(len(words), EVIDENCE) * self.log_word[b].mean(axis=0)
        p = np.exp(z - z.max())
        return len(words), p / p.sum()

    def rate(self, p: np.ndarray) -> float:
        r = 1.0
        for e in self.history:
            r = max(0.0, r - float(p @ np.array(e)))
        return r


def train(sample: list[tuple[bytes, str]]) -> DomainModel:
    """Multinomial naive Bayes over hashed words, smoothed by half a count."""
    domains = sorted({d for _, d in sample})
    counts = np.full((1 << BITS, len(domains)), 0.5)
    docs = np.zeros(len(domains))
    buckets = _Buckets()
    for text, d in sample:
        k = domains.index(d)
        docs[k] += 1
        b = np.fromiter(map(buckets.__getitem__, text.lower().split()), np.int64)
        np.add.at(counts[:, k], b, 1.0)
    prior = np.log(docs / docs.sum()) if domains else docs
    return DomainModel(domains, np.log(counts / counts.sum(axis=0)), prior)


def fit(labelled: DataFrame, per_domain: int = PER_DOMAIN, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", domains: list[str] | None = None) -> DomainModel:
    """Fit on at most ``per_domain`` whole texts of each of the stated domains, the ids with the smallest hashes."""
    rows = labelled.where(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(domain_col).cast("string").alias("_d"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    if domains is None:
        domains = sorted(r["_d"] for r in rows.select("_d").distinct().limit(MOST_DOMAINS + 1).collect())
        if len(domains) > MOST_DOMAINS:
            raise ValueError(f"more than {MOST_DOMAINS} domains; state which ones count")
    chosen = None
    for d in domains:
        part = rows.where(F.col("_d") == d).select("_id", "_d").distinct().orderBy(F.xxhash64("_id"), "_id").limit(per_domain)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return train([])
    # per_domain rows of an id and a name for each of the stated domains: a proven bound for the broadcast.
    got = rows.join(F.broadcast(chosen), ["_id", "_d"]).groupBy("_id", "_d").agg(F.min("_t").cast("binary").alias("_t")).collect()
    got.sort(key=lambda r: (r["_d"], r["_id"]))
    return train([(bytes(r["_t"]), r["_d"]) for r in got])


def posteriors(df: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``tokens`` and ``posterior`` (in the order of the model's domains) of every row."""

    def scan(batches):
        buckets = _Buckets()
        for batch in batches:
            got = [model.posterior(t.as_py() or b"", buckets) for t in batch.column(1)]
            yield pa.record_batch({"doc_id": batch.column(0), "tokens": pa.array([n for n, _ in got], pa.int64()), "posterior": pa.array([p for _, p in got], pa.list_(pa.float64()))})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, tokens long, posterior array<double>")


def _rate(history: list[list[float]]) -> Column:
    """The rate of a row's ``posterior`` after the projected steps so far."""
    steps = F.array(*(F.array(*(F.lit(float(x)) for x in e)) for e in history)) if history else F.array().cast("array<array<double>>")

    def dot(e: Column) -> Column:
        return F.aggregate(F.zip_with("posterior", e, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    return F.aggregate(steps, F.lit(1.0), lambda r, e: F.greatest(F.lit(0.0), r - dot(e)))


def fit_rates(table: DataFrame, model: DomainModel, targets: dict[str, float], total: str = "same", tolerance: float = TOLERANCE) -> DomainModel:
    """``model`` with the history of misfits that takes the totals of ``table`` to the target weights."""
    names = model.domains
    k = len(names)
    have = table.where("tokens > 0")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(F.col("tokens") * F.get("posterior", F.lit(i))).alias(f"s{i}") for i in range(k)]
    gram = [F.sum(F.col("tokens") * F.get("posterior", F.lit(i)) * F.get("posterior", F.lit(j))).alias(f"g{i}_{j}") for i, j in pairs]
    got = have.agg(F.sum("tokens").alias("n"), *sums, *gram).first()
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in names])
    if not got["n"] or not weights.sum():
        return DomainModel(names, model.log_word, model.log_prior, [])
    weights /= weights.sum()
    start = np.array([got[f"s{i}"] for i in range(k)])
    size = float(got["n"])
    if total == "grow":
        size = max(float(s / w) for s, w in zip(start, weights, strict=True) if w > 0)
    g = np.zeros((k, k))
    for i, j in pairs:
        g[i, j] = g[j, i] = got[f"g{i}_{j}"] / size
    norm = np.linalg.pinv(g + 1e-9 * np.eye(k))
    history: list[list[float]] = []
    now, before = start, float("inf")
    while True:
        e = now / size - weights
        misfit = float(np.abs(e).sum())
        if misfit < tolerance or misfit > 0.999 * before:
            break
        before = misfit
        history.append([float(f"{x:.9g}") for x in norm @ e])
        moved = have.withColumn("r", _rate(history)).agg(*(F.sum(F.col("r") * F.col("tokens") * F.get("posterior", F.lit(i))).alias(f"s{i}") for i in range(k))).first()
        now = np.array([moved[f"s{i}"] for i in range(k)])
    if misfit > before:  # the last step made it worse
        history.pop()
        misfit = before
    if misfit > WORTH_SAYING:
        warnings.warn(f"the target weights are out of reach: the misfit left is {misfit:.4f}", stacklevel=2)
    return DomainModel(names, model.log_word, model.log_prior, history, misfit)


def rates(df: DataFrame, model: DomainModel, targets: dict[str, float], total: str = "same", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DomainModel]:
    """``doc_id``, ``tokens``, ``posterior`` and ``rate`` of every row, and the model with its history."""
    table = materialize(posteriors(df, model, id_col, text_col))
    fitted = fit_rates(table, model, targets, total)
    return table.withColumn("rate", _rate(fitted.history)), fitted


def copies(rate: float, key: int, at_least: int = 0) -> int:
    """A whole number of copies with the rate as its mean over keys (32-bit hashes)."""
    return max(at_least, int(rate + (key & 0xFFFFFFFF) / 2**32))


def apply_rates(df: DataFrame, model: DomainModel, at_least: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df``, all columns, with each row as many times as its rate says, rounded by a hash of id and text.

    ``at_least``: 1 keeps every row. Posteriors are worked out again from the text, where it is read: looking rates up would
    take a shuffle of all texts, and ids may repeat.
    """
    at_text, at_id = df.columns.index(text_col), df.columns.index(id_col)

    def scan(batches):
        buckets = _Buckets()
        for batch in batches:
            times = []
            for doc, t in zip(batch.column(at_id).to_pylist(), batch.column(at_text).cast(pa.binary()), strict=True):
                b = t.as_py() or b""
                p = model.posterior(b, buckets)[1]
                times.append(copies(model.rate(p), zlib.crc32(b, zlib.crc32(str(doc).encode())), at_least))
            at = np.repeat(np.arange(len(times)), times)
            for lo in range(0, len(at), ROWS):
                yield batch.take(pa.array(at[lo : lo + ROWS]))

    return df.mapInArrow(scan, df.schema)
