"""Repeated passages across documents: seeds, collinear chains and alignment.

1. Seeds. A text's words (runs of other than ASCII white space, A-Z lower-cased) give k-mers of ``K`` words; a
   k-mer is a seed if its hash is among the lowest 1 in ``SPARSE``, whatever stands around it, or the lowest of
   ``WINDOW`` neighbours. An exact run of K + WINDOW - 1 words that two texts share always holds a common seed.
2. Star join. Every seed is joined to its first occurrence (the smallest doc_id that has it). Texts are packed
   into chunks of about ``CHUNK`` seeds; a chunk sends each of its distinct seeds once, with its first place in the
   chunk, to the bucket of its hash, and gets the first place of all back for those that two documents have. A passage that
   thousands of texts share so costs a chunk one entry, not one for each pair of texts.
3. Chains. Per document and source, matches that continue each other make fragments, and fragments are chained in
   order on both sides: a chain gains the words of a fragment and pays ``GAP`` for each word skipped on either
   side. The best predecessor comes from a Fenwick tree of prefix maxima over positions, n log n for n
   fragments. A chain whose matches span fewer than ``LEAST_SPAN`` words is dropped.
4. Alignment. The words of both sides are fetched, gaps between matches are aligned by edit distance, both
   ends are extended word by word across small edits, and chains are cut where a gap doesn't align. Pieces of
   at least ``MIN_WORDS`` words and ``SIMILARITY`` matching words are passages.

The first occurrences of a passage's seeds can lie in several documents, none of which has the whole passage.
So there is a second star join on whole runs of ``MIN_WORDS`` words, at every place whose seeds all occur in two
documents or more (others can't repeat), but for those whose seeds all occur first right there, and those that
the alignment has found verbatim. The first document that has a run so either is the first place of all its seeds, which
every other document then finds, or takes part in the second join: two documents that share a run of
``MIN_WORDS`` words always have a source that shares it, whatever its parts are. Passages of the second join are exact.

A fuzzy passage has no such run, and if its seeds first occurred in several documents, none of their chains is the passage. So there is a
third join, on pairs of shared seeds that follow each other (or with one between) while their first places don't: those where one
source ends and another begins. Where a pair has at most ``FEW_PLACES`` places each is matched with those of all earlier
documents, otherwise with its first one. These matches are chained and aligned as those of single seeds;
what they find is left out where a passage on an earlier source has all of its words.

A passage is reported on the document that has it later (the larger doc_id), with the place it repeats.

Defined results: null and empty texts have no passages; rows with a null id can't be named and are left
out (and left alone by :func:`cut_passages`); rows that repeat an id and a text count as one; other columns
are ignored; an empty table gives an empty table. Repeats within one document don't count.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, partitions, release, text_bytes
from .packing import pack, pack_bits, pack_ids, squeeze, unpack, unpack_bits, unpack_ids, unsqueeze

K = 4
SPARSE, WINDOW = 3, 16
GAP = 0.05
#: Words between two matches of one passage, at most: a wider gap without any common seed cuts the chain.
SPREAD = 128
#: Words from a chain's first match to its last one, at least: shorter chains are common phrases, next to never passages.
LEAST_SPAN = 16
#: Places up to which all of a seed pair's are matched with each other.
FEW_PLACES = 8
MIN_WORDS = 40
SIMILARITY = 0.8
#: Seeds of a chunk, and bytes of packed seeds in a bucket, about.
CHUNK, BUCKET = 800_000, 16 << 20
#: Words after an edit that tell whether two texts agree again.
AHEAD = 8
#: Words fetched beyond a chain's ends for the alignment, and the raster that fetched slices keep to, so that
#: chains on one passage share slices.
MARGIN, RASTER = 48, 64
#: Slices of a text that one Arrow batch holds.
SLICES = 256
#: Rows of an Arrow batch of runs or seed pairs, about.
ROWS = 65_536
CACHE_WORDS = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FEW = np.uint64(2**64 // SPARSE)
_SPACED = re.compile(rb"[^\x20\x09-\x0D]+")


class _Hashes(dict):
    """A 64-bit hash of each word, cached."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: bytes, hashes: _Hashes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Hashes of a text's words, or of those from ``lo`` to ``hi``."""
    words = text.lower().split()[lo:hi]
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; ``h`` has the hashes of a text's words."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _MIX + h[j : j + n]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def seeds(h: np.ndarray, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's seeds; ``h`` has the hashes of its words."""
    g = grams(h, k)
    n = len(g)
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    chosen = g < _FEW
    at = np.flatnonzero(chosen)
    # Windows without a seed are few; only there the lowest hash has to be looked up.
    edges = np.concatenate([[-1], at, [n]])
    for i in np.flatnonzero(np.diff(edges) > w).tolist():
        lo, hi = int(edges[i]) + 1, int(edges[i + 1])
        chosen[lo + np.lib.stride_tricks.sliding_window_view(g[lo:hi], w).argmin(axis=1) + np.arange(hi - lo - w + 1)] = True
    if not chosen.any():
        chosen[int(g.argmin())] = True
    at = np.flatnonzero(chosen)
    return at, g[at]


_CHUNKS = "chunk long, bucket int, ids binary, a binary, b binary, c binary"


def _split(n_buckets: int, least: int):
    """Texts of ``least`` words or more (doc_id, text) as chunks: one row for a chunk's texts, one for each of its buckets."""

    def scan(batches):
        task, seq = TaskContext.get().partitionId(), 0
        hashes = _Hashes()
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = word_hashes(text.as_py(), hashes)
                if len(h) < least:
                    continue
                held.append((doc, len(h), *seeds(h)))
                size += len(held[-1][2])
                if size >= CHUNK:
                    yield from _chunk_rows(held, task * 2**24 + seq, n_buckets)
                    held, size, seq = [], 0, seq + 1
        if held:
            yield from _chunk_rows(held, task * 2**24 + seq, n_buckets)

    return scan


def _chunk_rows(held: list[tuple], chunk: int, n_buckets: int):
    held.sort(key=lambda x: x[0])
    ids, lens = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held])
    counts = np.array([len(x[2]) for x in held])
    pos, g = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
    u, rank = np.unique(g, return_inverse=True)
    doc = ids[np.repeat(np.arange(len(ids)), counts)]
    first, last = np.empty(len(u), np.int64), np.empty(len(u), np.int64)
    last[rank] = np.arange(len(rank))
    first[rank[::-1]] = np.arange(len(rank))[::-1]

    def row(bucket, ids, a, b, c):
        return pa.record_batch({"chunk": pa.array([chunk], pa.int64()), "bucket": pa.array([bucket], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in (("ids", ids), ("a", a), ("b", b), ("c", c))}})

    # Positions as differences within a text: its first one, then the steps.
    step = np.diff(pos, prepend=0)
    step[np.cumsum(counts)[:-1]] = pos[np.cumsum(counts)[:-1]]
    yield row(-1, pack_ids(ids), pack(np.concatenate([[np.searchsorted(u, _FEW)], lens, counts])), pack(step), pack(rank))
    many = doc[last] != doc[first]
    of = ((u >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    short = u >> np.uint64(16)  # 48 bits tell seeds apart
    ends = np.searchsorted(of, np.arange(n_buckets), "right")
    for k in np.unique(of).tolist():
        part = slice(int(ends[k - 1]) if k else 0, int(ends[k]))
        place = first[part]
        yield row(k, pack_ids(doc[place]), pack(np.diff(short[part], prepend=np.uint64(0))), pack(pos[place]), pack_bits(many[part]))


def _first_places(t: pa.Table) -> pa.Table:
    """A bucket's entries with, for the seeds that two documents have, the first place of all."""
    rows = [[t.column(c)[i].as_py() for c in ("ids", "a", "b", "c")] for i in range(t.num_rows)]
    docs = [unpack_ids(r[0]) for r in rows]
    sizes = [len(x) for x in docs]
    doc = np.concatenate(docs)
    key = np.concatenate([np.cumsum(unpack(r[1]), dtype=np.uint64) for r in rows])
    pos = np.concatenate([unpack(r[2]).astype(np.int64) for r in rows])
    many = np.concatenate([unpack_bits(r[3], n) for r, n in zip(rows, sizes, strict=True)])
    order = np.argsort(key, kind="stable")
    change = np.concatenate([[True], np.diff(key[order]) != 0])
    starts, group = np.flatnonzero(change), np.cumsum(change) - 1
    by = doc[order]
    source = np.minimum.reduceat(by, starts)
    shared = np.logical_or.reduceat(many[order], starts) | (source != np.maximum.reduceat(by, starts))
    at = np.minimum.reduceat(np.where(by == source[group], pos[order], np.iinfo(np.int64).max), starts)
    of = np.empty(len(order), np.int64)
    of[order] = group
    out, lo = [], 0
    for n in sizes:
        g = of[lo : lo + n]
        told = shared[g]
        out.append((n, pack_bits(told), pack_ids(source[g][told]), pack(at[g][told])))
        lo += n
    cols = list(zip(*out, strict=True))
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "n": pa.array(cols[0], pa.int32()), "told": pa.array(cols[1], pa.binary()), "source": pa.array(cols[2], pa.binary()), "at": pa.array(cols[3], pa.binary())})


_PASSAGES = "doc_id long, start long, end long, source long, source_start long, source_end long, matches long"
_COLUMNS = ["doc_id", "start", "end", "source", "source_start", "source_end", "matches"]
_MATCHED = pa.schema([("doc_id", pa.int64()), ("source", pa.int64()), ("marks", pa.list_(pa.int64())), ("pairs", pa.list_(pa.int64()))])


def _matcher(min_words: int):
    """A chunk's texts and what its buckets say, as chains (doc_id, source, marks), and open places and pairs (source null)."""

    def match(texts: pa.Table, found: pa.Table) -> pa.Table:
        ids = unpack_ids(texts.column("ids")[0].as_py())
        head = unpack(texts.column("a")[0].as_py()).astype(np.int64)
        few, lens, counts = int(head[0]), head[1 : 1 + len(ids)], head[1 + len(ids) :]
        ends = np.cumsum(counts)
        starts = ends - counts
        step, rank = (unpack(texts.column(c)[0].as_py()).astype(np.int64) for c in "bc")
        pos = np.cumsum(step)
        pos -= np.repeat(pos[starts] - step[starts], counts)
        by = sorted(range(found.num_rows), key=lambda i: found.column("bucket")[i].as_py())
        told = np.concatenate([unpack_bits(found.column("told")[i].as_py(), found.column("n")[i].as_py()) for i in by])
        source, at = np.zeros(len(told), np.int64), np.zeros(len(told), np.int64)
        source[told] = np.concatenate([unpack_ids(found.column("source")[i].as_py()) for i in by])
        at[told] = np.concatenate([unpack(found.column("at")[i].as_py()).astype(np.int64) for i in by])
        told, source, at, sparse = told[rank], source[rank], at[rank], rank < few
        doc = np.repeat(ids, counts)
        here = told & (source == doc) & (at == pos)
        busy = np.logical_or.reduceat(told & ~here, starts)
        rows = []
        for i in np.flatnonzero(busy).tolist():
            part = slice(int(starts[i]), int(ends[i]))
            p, s, x, t = pos[part], source[part], at[part], told[part]
            other = t & (s != ids[i])
            for one, chain in _chains(p[other], s[other], x[other]):
                if chain[-1][1] - chain[0][0] >= LEAST_SPAN:
                    rows.append((int(ids[i]), one, [m for f in chain for m in f[:3]], None))
            places = open_places(int(lens[i]), p[~t & sparse[part]], p[t & ~here[part]], min_words)
            pairs = scattered_pairs(p[t], s[t], x[t])
            if places or len(pairs):
                rows.append((int(ids[i]), None, places, pairs.ravel().tolist()))
        return pa.Table.from_pylist([dict(zip(_MATCHED.names, r, strict=True)) for r in rows], _MATCHED)

    return match


def scattered_pairs(y: np.ndarray, source: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Pairs of seeds at places ``y`` whose first places (source, x) don't follow each other, as rows of a key and both places.

    A seed has one first place, so the key, made of both, is the same wherever the two seeds stand.
    """
    out = [np.zeros((0, 3), np.int64)]
    for step in (1, 2):
        (ya, sa, xa), (yb, sb, xb) = ((c[:-step] for c in (y, source, x)), (c[step:] for c in (y, source, x)))
        apart = (yb - ya <= SPREAD) & ((sa != sb) | (xb <= xa) | (xb - xa > SPREAD))
        key = np.zeros(int(apart.sum()), np.uint64)
        for c in (sa, xa, sb, xb):
            key = (key ^ c[apart].astype(np.int64).view(np.uint64)) * _MIX
            key ^= key >> np.uint64(31)
        out.append(np.stack([key.view(np.int64), ya[apart], yb[apart]], axis=1))
    return np.concatenate(out)


def open_places(n_words: int, single: np.ndarray, elsewhere: np.ndarray, words: int, k: int = K) -> list[int]:
    """Places whose runs of ``words`` words may repeat without the seeds' star join showing it, as from, to, from, to...

    ``single``: the places of seeds that no other document has. ``elsewhere``: those of seeds that others have, and
    whose first place isn't this one. A run with a single seed can't repeat; one whose seeds all have their first
    place here is found from everywhere else.
    """
    size = n_words - words + 1
    if size < 1:
        return []

    def clear(at: np.ndarray) -> np.ndarray:
        """The places of runs that hold none of the seeds."""
        lo, hi = np.concatenate([[0], at + 1]), np.minimum(np.concatenate([at + k - words, [size]]), size)
        ok = hi > lo
        marks = np.zeros(size + 1, np.int64)
        np.add.at(marks, lo[ok], 1)
        np.add.at(marks, hi[ok], -1)
        return np.cumsum(marks[:-1]) > 0

    left = clear(single) & ~clear(elsewhere)
    return np.flatnonzero(np.diff(np.concatenate([[False], left, [False]]).astype(np.int8))).tolist()


class _Fenwick:
    """Prefix maxima of (value, index) over ranks 1 to n."""

    def __init__(self, n: int):
        self.n = n
        self.best = [(-1e300, -1)] * (n + 1)

    def put(self, rank: int, value: float, index: int) -> None:
        while rank <= self.n:
            if value > self.best[rank][0]:
                self.best[rank] = (value, index)
            rank += rank & -rank

    def max_to(self, rank: int) -> tuple[float, int]:
        got = (-1e300, -1)
        while rank > 0:
            if self.best[rank][0] > got[0]:
                got = self.best[rank]
            rank -= rank & -rank
        return got


def fragments(y: np.ndarray, x: np.ndarray, k: int = K) -> list[tuple[int, int, int, int]]:
    """Matches (y ascending) that continue each other as (first y, last y, first x, number)."""
    cut = np.flatnonzero((np.diff(x - y) != 0) | (np.diff(y) > SPREAD)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(y)]])
    return list(zip(y[lo].tolist(), y[hi - 1].tolist(), x[lo].tolist(), (hi - lo).tolist(), strict=True))


def chains(parts: list[tuple[int, int, int, int]], k: int = K, gap: float = GAP) -> list[list[int]]:
    """Collinear chains of fragments, best first, as lists of their numbers; each fragment is in one chain."""
    ends = [(y1 + k, x0 + y1 - y0 + k) for y0, y1, x0, _ in parts]
    ranks = sorted({x for _, x in ends})
    tree = _Fenwick(len(ranks))
    rank_of = {x: r + 1 for r, x in enumerate(ranks)}
    upto = np.searchsorted(ranks, [x0 for _, _, x0, _ in parts], "right").tolist()
    by_start = sorted(range(len(parts)), key=lambda i: parts[i][0])
    by_end = sorted(range(len(parts)), key=lambda i: ends[i][0])
    score, back, done = [0.0] * len(parts), [-1] * len(parts), 0
    for i in by_start:
        y0, y1, x0, _ = parts[i]
        while done < len(by_end) and ends[by_end[done]][0] <= y0:
            j = by_end[done]
            tree.put(rank_of[ends[j][1]], score[j] + gap * sum(ends[j]), j)
            done += 1
        value, j = tree.max_to(upto[i])
        gained = value - gap * (y0 + x0)
        score[i] = y1 - y0 + k + max(0.0, gained)
        back[i] = j if gained > 0 else -1
    out, used = [], [False] * len(parts)
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _far(dy: int, dx: int) -> bool:
    """Whether a gap of dy and dx words is too wide, or too unequal, to lie inside a passage."""
    return max(dy, dx) > SPREAD or abs(dy - dx) > _slack(dy, dx)


def _slack(dy: int, dx: int) -> float:
    """Words that a gap may leave unmatched."""
    return max(8, 0.5 * max(dy, dx))


def _chains(y: np.ndarray, source: np.ndarray, x: np.ndarray, k: int = K):
    """(source, fragments) of one document's chains, cut at gaps that no passage has inside."""
    order = np.argsort(source, kind="stable")  # places stay in order
    y, source, x = y[order], source[order], x[order]
    cut = np.flatnonzero(np.diff(source)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(y)], strict=True):
        if hi - lo < 2:
            continue
        parts = fragments(y[lo:hi], x[lo:hi])
        for chain in chains(parts) if len(parts) > 1 else [[0]]:
            piece = [parts[chain[0]]]
            for i in chain[1:]:
                y0, _, x0, _ = parts[i]
                last = piece[-1]
                if _far(y0 - last[1] - k, x0 - last[2] - last[1] + last[0] - k):
                    yield int(source[lo]), piece
                    piece = []
                piece.append(parts[i])
            yield int(source[lo]), piece


def _edit(a: np.ndarray, b: np.ndarray) -> int:
    """Matching words of two short pieces under an alignment of least edits (the longest common subsequence)."""
    if len(a) == len(b) and bool((a == b).all()):
        return len(a)
    row = np.zeros(len(b) + 1, np.int32)
    for word in a:
        got = np.maximum(row[1:], row[:-1] + (b == word))
        row[1:] = np.maximum.accumulate(got)
    return int(row[-1])


def _extend(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """How far a and b agree from their starts, across edits of up to two words.

    An edit is crossed where a third of the next words agree, or two words in a row for each word of the edit.
    All stops on the way, as words of a, words of b and matching words: the start, then the end of each equal run.
    """
    i = j = same = 0
    stops = [(0, 0, 0)]
    while True:
        n = min(len(a) - i, len(b) - j)
        equal = a[i : i + n] == b[j : j + n]
        run = n if bool(equal.all()) else int(equal.argmin())
        if run:
            i, j, same = i + run, j + run, same + run
            stops.append((i, j, same))
        best = (0, 0, 0)
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2)):
            n = min(AHEAD, len(a) - i - di, len(b) - j - dj)
            if n <= 0:
                continue
            equal = a[i + di : i + di + n] == b[j + dj : j + dj + n]
            got, row = int(np.count_nonzero(equal)), n if bool(equal.all()) else int(equal.argmin())
            if got > best[0] and (3 * got >= max(n, 6) or row >= 2 * max(di, dj)):
                best = (got, di, dj)
        if not best[0]:
            return stops
        i, j = i + best[1], j + best[2]


def _fits(ya: int, yb: int, xa: int, xb: int, same: int, min_words: int, similarity: float) -> bool:
    return yb - ya >= min_words and same >= similarity * max(yb - ya, xb - xa)


def equal_runs(a: np.ndarray, b: np.ndarray, ys: list[int], xs: list[int], k: int = K) -> tuple[list[list[int]], list[int]]:
    """Exact runs along a chain of matches a[y] = b[x] of ``k`` words, and what lies between each and the one before.

    Runs are start and end in a, start and end in b. Of a gap it's the number of matching words, -1 if it doesn't align.
    """
    runs: list[list[int]] = []
    gaps: list[int] = []

    def put(y: int, x: int, n: int) -> None:
        if runs:
            last = runs[-1]
            dy, dx = y - last[1], x - last[3]
            if dy == dx <= 0:
                last[1], last[3] = max(last[1], y + n), max(last[3], x + n)
                return
            if dy < 0 or dx < 0:  # the match overlaps the run before: it counts from where both sides go on
                cut = max(-dy, -dx)
                if cut >= n:
                    return
                y, x, n = y + cut, x + cut, n - cut
                dy, dx = y - last[1], x - last[3]
            if _far(dy, dx):
                gaps.append(-1)
            else:
                same = _edit(a[last[1] : y], b[last[3] : x]) if dy and dx else 0
                gaps.append(same if max(dy, dx) - same <= _slack(dy, dx) else -1)
        runs.append([y, y + n, x, x + n])

    for y, x in zip(ys, xs, strict=True):
        dy = y - runs[-1][1] if runs else 0
        if dy > 0 and dy == x - runs[-1][3]:  # the same diagonal goes on
            at, to = runs[-1][1], runs[-1][3]
            equal = np.concatenate([[False], a[at:y] == b[to:x], [False]]).astype(np.int8)
            edges = np.flatnonzero(np.diff(equal)).tolist()
            for lo, hi in zip(edges[::2], edges[1::2], strict=True):
                put(at + lo, to + lo, hi - lo)
        put(y, x, k)
    return runs, gaps


def align(a: np.ndarray, b: np.ndarray, ys: list[int], xs: list[int], k: int = K, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, int]]:
    """Passages (start and end in a, start and end in b, matching words) along a chain of matches a[y] = b[x].

    A block of matches that is too dissimilar with both ends extended is tried with the longest extension that
    is similar enough, then split where most words differ, down to runs without differences.
    """
    return passages_along(a, b, *equal_runs(a, b, ys, xs, k), min_words, similarity)


def passages_along(a: np.ndarray, b: np.ndarray, runs: list[list[int]], gaps: list[int], min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, int]]:
    out = []
    todo, first = [], 0
    for n in range(len(runs)):
        if n == len(gaps) or gaps[n] < 0:
            todo.append((first, n))
            first = n + 1
    todo.reverse()
    while todo:  # blocks of runs, in order; what lies beside a block's ends bounds its extension
        lo, hi = todo.pop()
        ya, xa, yb, xb = runs[lo][0], runs[lo][2], runs[hi][1], runs[hi][3]
        same = sum(r[1] - r[0] for r in runs[lo : hi + 1]) + sum(gaps[lo:hi])
        low = (runs[lo - 1][1], runs[lo - 1][3]) if lo else (0, 0)
        high = (runs[hi + 1][0], runs[hi + 1][2]) if hi + 1 < len(runs) else (len(a), len(b))
        left = _extend(a[low[0] : ya][::-1], b[low[1] : xa][::-1])
        right = _extend(a[yb : high[0]], b[xb : high[1]])
        widest = [(ya - left[-1][0], yb + right[-1][0], xa - left[-1][1], xb + right[-1][1], same + left[-1][2] + right[-1][2])]
        long = widest[0][1] - widest[0][0] >= min_words
        if long and not _fits(*widest[0], min_words, similarity):
            widest = [(ya - i, yb + p, xa - j, xb + q, same + m + n) for i, j, m in left for p, q, n in right]
        fit = [w for w in widest if _fits(*w, min_words, similarity)]
        if fit:
            out.append(max(fit, key=lambda w: (w[1] - w[0], w[4])))
        elif lo < hi and long:
            lost = [max(runs[n + 1][0] - runs[n][1], runs[n + 1][2] - runs[n][3]) - gaps[n] for n in range(lo, hi)]
            at = lo + int(np.argmax(lost))
            todo += [(at + 1, hi), (lo, at)]
    return out


def _verbatim(a: np.ndarray, b: np.ndarray, runs: list[list[int]], min_words: int) -> list[tuple[int, int]]:
    """The exact runs, made as long as they are, of ``min_words`` words or more: start and end in a."""
    out = set()
    for ya, yb, xa, xb in runs:
        n = min(ya, xa)
        before = (a[ya - n : ya] == b[xa - n : xa])[::-1]
        m = min(len(a) - yb, len(b) - xb)
        after = a[yb : yb + m] == b[xb : xb + m]
        lo, hi = ya - (n if before.all() else int(before.argmin())), yb + (m if after.all() else int(after.argmin()))
        if hi - lo >= min_words:
            out.add((lo, hi))
    return sorted(out)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def seed_matches(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Chains of seed matches of ``rows`` (doc_id, text) with their source, and open places (source null), in ``marks``; with these the scattered ``pairs``."""
    least = int(min_words * SIMILARITY)
    # A packed seed takes some seven bytes, and there is about one seed for each 18 bytes of text.
    n_buckets = max(partitions(rows.sparkSession), -(-text_bytes(rows) * 7 // (18 * BUCKET)))
    split = materialize(rows.mapInArrow(_split(n_buckets, least), _CHUNKS))
    found = split.where("bucket >= 0").groupBy("bucket").applyInArrow(_first_places, "chunk long, bucket int, n int, told binary, source binary, at binary")
    texts = split.where("bucket < 0").groupBy("chunk")
    return texts.cogroup(found.groupBy("chunk")).applyInArrow(_matcher(min_words), "doc_id long, source long, marks array<long>, pairs array<long>")


def _unfold_pairs(batches):
    for batch in batches:
        t = batch.column(1).flatten().to_numpy().reshape(-1, 3)
        doc = np.repeat(batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy() // 3)
        for at in range(0, len(t), ROWS):
            part = slice(at, at + ROWS)
            yield pa.record_batch([pa.array(c) for c in (t[part, 0].copy(), doc[part], t[part, 1].copy(), t[part, 2].copy())], ["key", "doc_id", "a", "b"])


def _pair_chains(batches):
    """Chains along a partition's matching pairs, which come sorted by doc_id."""
    for t in _whole_documents(batches):
        rows = []
        doc, source, a, b, at_a, at_b = (t[c].to_numpy(np.int64) for c in ("doc_id", "source", "a", "b", "at_a", "at_b"))
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(source) != 0)]))
        ends = np.append(starts[1:], len(t))
        for i in np.flatnonzero(np.maximum.reduceat(b, starts) - np.minimum.reduceat(a, starts) >= LEAST_SPAN).tolist():
            part = slice(int(starts[i]), int(ends[i]))
            at = np.unique(np.stack([np.concatenate([a[part], b[part]]), np.concatenate([at_a[part], at_b[part]])], axis=1), axis=0)
            for one, chain in _chains(at[:, 0], np.full(len(at), source[starts[i]], np.int64), at[:, 1]):
                if chain[-1][1] - chain[0][0] >= LEAST_SPAN:
                    rows.append({"doc_id": int(doc[starts[i]]), "source": one, "marks": [m for f in chain for m in f[:3]]})
        schema = pa.schema(list(_MATCHED)[:3])
        yield from pa.Table.from_pylist(rows, schema).to_batches() or [pa.record_batch([[], [], []], schema=schema)]


def pair_matches(matched: DataFrame) -> DataFrame:
    """Chains (doc_id, source, marks) along the scattered pairs that two documents of :func:`seed_matches` have."""
    found = matched.where("source is null and size(pairs) > 0").select("doc_id", "pairs")
    places = materialize(found.mapInArrow(_unfold_pairs, "key long, doc_id long, a long, b long"))
    origin = places.groupBy("key").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.min(F.struct("doc_id", "a", "b")).alias("at")).where("source != last")
    join = F.col("key").bitwiseXOR(F.lit(1)).alias("key")  # as in run_passages: a key of its own
    places = materialize(places.select(join, "doc_id", "a", "b").join(origin.select(join, "n", "at"), "key"))
    star = places.where((F.col("n") > FEW_PLACES) & (F.col("doc_id") != F.col("at.doc_id"))).select("doc_id", F.col("at.doc_id").alias("source"), "a", "b", F.col("at.a").alias("at_a"), F.col("at.b").alias("at_b"))
    few = places.where(F.col("n") <= FEW_PLACES).select("key", "doc_id", "a", "b")
    earlier = few.select("key", F.col("doc_id").alias("source"), F.col("a").alias("at_a"), F.col("b").alias("at_b"))
    every = few.join(earlier, "key").where("source < doc_id").select(star.columns)
    rows = star.unionByName(every).repartition("doc_id").sortWithinPartitions("doc_id", "source", "a")
    return rows.mapInArrow(_pair_chains, "doc_id long, source long, marks array<long>")


def run_table(rows: DataFrame, ranges: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``hash``, ``doc_id`` and ``pos`` of the runs of ``min_words`` words that start in ``ranges`` (doc_id, marks)."""

    def scan(batches):
        hashes = _Hashes()
        held: list[tuple] = []
        size = 0

        def table():
            return pa.record_batch([np.concatenate(c) for c in zip(*held, strict=True)], ["hash", "doc_id", "pos"])

        for batch in batches:
            for doc, text, some in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                first = min(some[::2])
                h = word_hashes(text.as_py(), hashes, first, max(some[1::2]) - 1 + min_words)
                for lo, hi in zip(some[::2], some[1::2], strict=True):
                    g = grams(h[lo - first : hi - first - 1 + min_words], min_words)
                    held.append((g.view(np.int64), np.full(len(g), doc, np.int64), np.arange(lo, lo + len(g), dtype=np.int32)))
                    size += len(g)
                if size >= ROWS:
                    yield table()
                    held, size = [], 0
        if size:
            yield table()

    return rows.join(ranges, "doc_id").select("doc_id", "text", "marks").mapInArrow(scan, "hash long, doc_id long, pos int")


def _whole_documents(batches):
    """A partition's rows, which come sorted by doc_id, as frames that no document is divided between."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        t = batch.to_pandas()
        if not len(t):
            continue
        # The last document of a batch may go on in the next one.
        last = t["doc_id"] == t["doc_id"].iloc[-1]
        if bool(last.all()) and (not held or held[-1]["doc_id"].iloc[-1] == t["doc_id"].iloc[-1]):
            held.append(t)
            continue
        yield pd.concat([*held, t[~last]])
        held = [t[last]]
    if held:
        yield pd.concat(held)


def exact_cover(y: np.ndarray, x: np.ndarray, words: int) -> list[tuple[int, int, int]]:
    """Exact passages (start, end, start in the source) that cover all words of matching runs of ``words`` words.

    ``y`` ascending, ``x``: a place of the source that has the run. A text that repeats itself matches one place of the source
    over and over; each passage then goes on where the one before has ended, so they are as few as its words allow.
    """
    # The last place of each stretch of matches that continue each other on both sides.
    ends = np.append(np.flatnonzero((np.diff(y) != 1) | (np.diff(x) != 1)), len(y) - 1)
    out, i = [], 0
    while i < len(y):
        last = int(ends[np.searchsorted(ends, i)])
        stop = int(y[last]) + words
        out.append((int(y[i]), stop, int(x[i])))
        # The next place that has words beyond, but starts no later than here ends if there is one.
        i = max(last + 1, int(np.searchsorted(y, stop, "right")) - 1)
    return out


def _exact_rows(batches, words: int):
    """Exact passages of a partition's matching runs of ``words`` words, which come sorted by (doc_id, source, pos)."""
    for t in _whole_documents(batches):
        out = []
        for (doc, source), part in t.groupby(["doc_id", "source"]):
            y, first = np.unique(part["pos"].to_numpy(np.int64), return_index=True)
            x = part["at"].to_numpy(np.int64)[first]
            out += [(int(doc), lo, hi, int(source), at, at + hi - lo, hi - lo) for lo, hi, at in exact_cover(y, x, words)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "end", "source", "source_start", "source_end", "matches"])


def run_passages(rows: DataFrame, ranges: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Exact passages from the runs that :func:`run_table` gives, each joined to the first of these places."""
    runs = materialize(run_table(rows, ranges, min_words))
    origin = runs.groupBy("hash").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by("pos", F.struct("doc_id", "pos")).alias("at"))
    origin = origin.where("source != last")
    # The join has a key of its own, so that both sides are exchanged for it alone: Spark then splits a hot run's
    # partition, which it can't where the join shares the exchange of the aggregation.
    key = F.col("hash").bitwiseXOR(F.lit(1)).alias("key")
    matches = runs.select(key, "doc_id", "pos").join(origin.select(key, "source", "at"), "key").where("doc_id != source").select("doc_id", "source", "pos", "at")
    matches = matches.repartition("doc_id").sortWithinPartitions("doc_id", "source", "pos")
    return matches.mapInArrow(functools.partial(_exact_rows, words=min_words), _PASSAGES)


def _cut_slices(batches):
    hashes = _Hashes()
    for batch in batches:
        for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            first = min(s["lo"] for s in asked)
            words = word_hashes(text.as_py(), hashes, first, max(s["hi"] for s in asked)).astype("<u4")
            for at in range(0, len(asked), SLICES):
                part = asked[at : at + SLICES]
                bodies = [squeeze(words[s["lo"] - first : s["hi"] - first].tobytes()) for s in part]
                yield pa.record_batch({"doc_id": pa.array([doc] * len(part), pa.int64()), "lo": pa.array([s["lo"] for s in part], pa.int64()), "hi": pa.array([s["hi"] for s in part], pa.int64()), "words": pa.array(bodies, pa.binary())})


def _aligner(min_words: int):
    """Passages along chains, and the exact runs of the document in its source (source null)."""

    def aligned(batches):
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                doc, source, marks, y0, x0, a, b, paired = (c[r].as_py() for c in batch.columns)
                a, b = (np.frombuffer(unsqueeze(z), "<u4") for z in (a, b))
                ys = [y - y0 for first, last, _ in zip(marks[::3], marks[1::3], marks[2::3], strict=True) for y in (first, last)]
                xs = [x - x0 for first, last, at in zip(marks[::3], marks[1::3], marks[2::3], strict=True) for x in (at, at + last - first)]
                runs, gaps = equal_runs(a, b, ys, xs)
                out += [(doc, ya + y0, yb + y0, source, xa + x0, xb + x0, same, paired) for ya, yb, xa, xb, same in passages_along(a, b, runs, gaps, min_words)]
                out += [(doc, lo + y0, hi + y0, None, None, None, None, paired) for lo, hi in _verbatim(a, b, runs, min_words)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.bool_())], [*_COLUMNS, "paired"])

    return aligned


def aligned_passages(rows: DataFrame, found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages along the chains of ``found`` (doc_id, source, marks, paired), and (source null) the document's exact runs in its source."""
    def low(c):
        return F.floor(F.greatest(c - MARGIN, F.lit(0)) / RASTER) * RASTER

    def high(c):
        return F.floor((c + K + MARGIN) / RASTER) * RASTER + RASTER

    n = F.size("marks")
    first, last, at = F.get("marks", F.lit(0)), F.get("marks", n - 2), F.get("marks", F.lit(2))
    end = F.get("marks", n - 1) + last - F.get("marks", n - 3)
    found = found.select("doc_id", "source", "marks", "paired", low(first).alias("y0"), high(last).alias("y1"), low(at).alias("x0"), high(end).alias("x1"))
    # Each slice once, however many chains need it; a text goes to its task once, with all of its slices (pairs of
    # raster points of that text, so its length bounds the list).
    mine, theirs = F.struct(F.col("y0").alias("lo"), F.col("y1").alias("hi")), F.struct(F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    wanted = found.select("doc_id", mine.alias("slice")).unionByName(found.select(F.col("source").alias("doc_id"), theirs.alias("slice")))
    wanted = wanted.groupBy("doc_id").agg(F.collect_set("slice").alias("slices"))
    slices = rows.join(wanted, "doc_id").select("doc_id", "text", "slices").mapInArrow(_cut_slices, "doc_id long, lo long, hi long, words binary")
    slices = materialize(slices.dropDuplicates())  # rows may repeat an id and a text
    release(rows.sparkSession)
    mine = slices.select("doc_id", F.col("lo").alias("y0"), F.col("hi").alias("y1"), F.col("words").alias("a"))
    theirs = slices.select(F.col("doc_id").alias("source"), F.col("lo").alias("x0"), F.col("hi").alias("x1"), F.col("words").alias("b"))
    both = found.join(mine, ["doc_id", "y0", "y1"]).join(theirs, ["source", "x0", "x1"]).select("doc_id", "source", "marks", "y0", "x0", "a", "b", "paired")
    return both.mapInArrow(_aligner(min_words), f"{_PASSAGES}, paired boolean").groupBy(_COLUMNS).agg(F.min("paired").alias("paired"))


def _uncovered(batches):
    """A partition's passages, sorted by doc_id, without the paired ones whose words a passage on an earlier source has."""
    for t in _whole_documents(batches):
        keep = np.ones(len(t), bool)
        lo, hi, source, doc = (t[c].to_numpy(np.int64) for c in ("start", "end", "source", "doc_id"))
        starts, ends = np.searchsorted(doc, doc, "left"), np.searchsorted(doc, doc, "right")
        for i in np.flatnonzero(t["paired"].to_numpy(bool)).tolist():
            d = slice(starts[i], ends[i])
            keep[i] = not ((lo[d] <= lo[i]) & (hi[d] >= hi[i]) & (source[d] < source[i])).any()
        yield pa.RecordBatch.from_pandas(t.loc[keep, _COLUMNS], preserve_index=False)


def _still_open(min_words: int):
    """Open places (marks) without those whose runs lie in an exact run (``runs``)."""

    def scan(batches):
        for batch in batches:
            docs, out = [], []
            for doc, marks, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left = []
                for lo, hi in zip(marks[::2], marks[1::2], strict=True):
                    for r in sorted((r["start"], r["end"] - min_words + 1) for r in runs or []):
                        if lo < r[0] < hi:
                            left += [lo, r[0]]
                        if r[0] < hi and r[1] > lo:
                            lo = max(lo, r[1])
                    if lo < hi:
                        left += [lo, hi]
                if left:
                    docs.append(doc)
                    out.append(left)
            yield pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "marks": pa.array(out, pa.list_(pa.int64()))})

    return scan


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``start``, ``end`` (word positions), ``source``, ``source_start``, ``source_end`` and ``matches``."""
    rows = _texts(df, id_col, text_col)
    matched = materialize(seed_matches(rows, min_words))
    release(df.sparkSession)
    found = matched.where("source is not null").select("doc_id", "source", "marks", F.lit(False).alias("paired")).unionByName(pair_matches(matched).withColumn("paired", F.lit(True)))
    # Both sides of the alignment need the chains: made once, without the steps that led to them.
    found = materialize(found.groupBy("doc_id", "source", "marks").agg(F.min("paired").alias("paired")))
    release(df.sparkSession)
    got = materialize(aligned_passages(rows, found, min_words))
    release(df.sparkSession)
    # Runs that only pairs have found stay open: the second join names their first place.
    exact = got.where("source is null and not paired").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    left = matched.where("source is null").select("doc_id", "marks").join(exact, "doc_id", "left").select("doc_id", "marks", "runs")
    left = materialize(left.mapInArrow(_still_open(min_words), "doc_id long, marks array<long>"))
    out = got.where("source is not null").repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_uncovered, _PASSAGES)
    if not left.isEmpty():
        out = out.unionByName(run_passages(rows, left, min_words)).dropDuplicates()
    return out


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of the spans; the space around the rest stays as it is."""
    at = [m.span() for m in _SPACED.finditer(text)]
    out, done = [], 0
    for lo, hi in sorted(spans):
        lo, hi = min(lo, len(at)), min(hi, len(at))
        if hi <= lo:
            continue
        a, b = at[lo][0], at[hi - 1][1]
        if a > done:
            out.append(text[done:a])
        done = max(done, b)
    return b"".join([*out, text[done:]])


def cut_passages(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df``, all rows and columns, with the passages of :func:`repeated_passages` cut from the texts."""
    key, cuts = fresh(df, "cut_id", "cut_spans")
    # A document's spans are at most its words.
    per_doc = spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("start", "end")).alias(cuts))
    joined = df.join(per_doc, F.col(id_col).cast("long") == F.col(key), "left").select(*df.columns, cuts)
    at = df.columns.index(text_col)

    def edit(batches):
        for batch in batches:
            kept = batch.select(range(len(batch.columns) - 1))
            texts = [
                cut_words(t.encode(), [(s["start"], s["end"]) for s in spans]).decode("utf-8", "replace") if spans and t else t
                for t, spans in zip(batch.column(at).to_pylist(), batch.columns[-1].to_pylist(), strict=True)
            ]
            yield kept.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return joined.mapInArrow(edit, df.schema)
