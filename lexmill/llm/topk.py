"""Exact top-k search by inner product over impact-ordered indexes, score at a time.

Vectors are dealt into shards of about ``SHARD`` by the hash of their id. A shard's index cuts each
dimension's values into ``LEVELS`` quantised impacts; a segment is the posting list of one dimension and
level. For a query, segments are processed by descending impact (the query's component times the level),
each adding its impact to its vectors' accumulators. An accumulator bounds a score from below; what the
unprocessed segments and the quantisation may still add bounds it from above. Processing stops only on
proof: when the vectors whose upper bound reaches the k-th largest lower bound, the possible members, are
few, or no segment is left. All possible members are then rescored exactly, in integers, and a query's
candidates from all shards are merged. Results are exact whatever the stopping point.

Queries meet the shards in blocks: a task holds one shard and at most about ``BLOCK`` queries.

Defined results: a vector takes no part if it, its id or a component is null, or a component isn't finite;
vectors of different length don't meet; rows that repeat an id count once (the smallest vector); no
candidates give no rows. Ties go to the smaller id. Components are expected to keep scores within 63
bits. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 8192
BLOCK = 2048
LEVELS = 16
#: The possible members are checked after each of so many parts of the segments.
CHECKS = 8


def quantise(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``x``: floor(scale * component) of each valid vector, one row for each id."""
    v = F.transform(vec_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    sound = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).where(sound)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))


class ImpactIndex:
    """The impact-ordered segments of one shard: ``x`` is a matrix of integers, a row for each vector."""

    def __init__(self, x: np.ndarray, levels: int = LEVELS):
        self.x = x
        self.low = x.min(axis=0)
        self.step = (x.max(axis=0) - self.low) // levels + 1
        level = (x - self.low) // self.step
        self.levels = levels
        self.top = self.low + self.step * levels - 1
        self.order = np.argsort(level, axis=0, kind="stable").astype(np.int32)
        self.ends = np.stack([np.searchsorted(level[self.order[:, d], d], np.arange(levels), "right") for d in range(x.shape[1])])

    def possible(self, q: np.ndarray, k: int) -> np.ndarray:
        """Positions of all vectors that may be among the k highest, ties included."""
        n = len(self.x)
        if n <= 4 * k:
            return np.arange(n)
        size = np.abs(q) * self.step
        slack = int((np.abs(q) * (self.step - 1)).sum())
        rank = np.arange(self.levels)
        worth = np.where(q[:, None] > 0, rank, self.levels - 1 - rank) * size[:, None]  # dimension x level
        dims, levels = np.nonzero(worth)
        impacts = worth[dims, levels]
        by = np.argsort(-impacts, kind="stable")
        dims, levels, impacts = dims[by].tolist(), levels[by].tolist(), impacts[by].tolist()
        left = np.where(q != 0, (self.levels - 1) * size, 0)  # what a dimension may still add
        score = np.zeros(n, np.int64)
        every = max(1, -(-len(dims) // CHECKS))
        for at in range(0, len(dims), every):
            for d, u, w in zip(dims[at : at + every], levels[at : at + every], impacts[at : at + every], strict=True):
                ends = self.ends[d]
                score[self.order[ends[u - 1] if u else 0 : ends[u], d]] += w
                left[d] = w - size[d]
            bound = np.partition(score, n - k)[n - k] - slack - int(np.maximum(left, 0).sum())
            members = np.flatnonzero(score >= bound)
            if len(members) <= 4 * k:
                break
        else:
            if not dims:
                members = np.arange(n)
        return members


def _search(k: int):
    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if vectors.num_rows and queries.num_rows:
            of_v = [(c.to_numpy(), x) for c, x in _matrices(vectors)]
            for q_ids, q_rows in _matrices(queries):
                for ids, x in of_v:
                    if x.shape[1] != q_rows.shape[1]:
                        continue
                    index = ImpactIndex(x)
                    for q_id, q in zip(q_ids.to_numpy().tolist(), q_rows, strict=True):
                        # One more than k: the query's own vector may be among them.
                        members = index.possible(q, min(k + 1, len(x)))
                        members = members[ids[members] != q_id]
                        scores = x[members] @ q
                        best = np.lexsort((ids[members], -scores))[:k]
                        out.append((np.full(len(best), q_id), ids[members[best]], scores[best]))
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return search


def _matrices(t: pa.Table):
    """(ids, matrix) for each length of vector in a table of ``vec_id`` and ``x``."""
    t = t.combine_chunks()
    lens = t.column("x").combine_chunks().value_lengths().to_numpy() if t.num_rows else np.zeros(0, np.int64)
    for n in np.unique(lens).tolist():
        part = t.filter(pa.array(lens == n)).combine_chunks()
        yield part.column("vec_id"), part.column("x").combine_chunks().flatten().to_numpy().reshape(-1, n)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's k highest other vectors.

    ``vectors``: ``vec_id`` and ``x``, as :func:`quantise` gives them; ``is_query`` picks the queries.
    """
    queries = vectors.where(is_query)
    sizes = vectors.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    shards, blocks = max(1, -(-sizes["n"] // SHARD)), max(1, -(-sizes["q"] // BLOCK))
    # A shard goes to each block of queries, a query to each shard: blocks of a stated query set against all rows.
    left = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "x")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "x")
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
