"""SimHash near-duplicates: exact Hamming links through a vantage-point tree of shards.

Fingerprints. A text's words are the runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; each shingle of
``n`` words (repeats included; all words if there are fewer) is hashed with XXH64, seed 42; a bit of the
fingerprint is set if it is set in more than half of the hashes. Texts without words get zero.

Links. Copies collapse into distinct fingerprints first. Two fingerprints that differ in at most r = 3 bits
differ in at most floor(r / 2) = 1 bit of their low or of their high half, and the Hamming distance of one
half is a metric. So there are two trees, one for each half, searched with radius 1. An inner node of a
tree has a vantage point p and a radius mu: fingerprints with d(x, p) <= mu live inside, the others outside.
Every fingerprint lives in one leaf, a shard. It is sent to all shards that its ball may reach: the
triangle bound prunes the inside if d(x, p) - radius > mu and the outside if d(x, p) + radius <= mu, and a
ball on the boundary goes both ways. Each shard compares those who live there with those who were sent,
on all 64 bits, so the pairs found are exactly the links. Where a half can't divide a node any more (many
fingerprints share it) the node measures all 64 bits instead, with radius r.

The trees are fitted on a bounded sample of distinct fingerprints (``SAMPLE``); every fingerprint is then
routed. A tree only decides where comparisons take place, never which links exist. Where a corpus has more than ``SAMPLE`` shards'
worth of fingerprints, shards grow; a shard's task then grows trees of its own over those who live there, and compares
leaf by leaf. A shard emits a spanning forest of its links, not its pairs, and components are found by distributed rounds.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_spread, materialize
from .components import connected_components

BITS = 3
SHINGLE = 3
#: Fingerprints that the trees are fitted on, about; a broadcast tree has at most that many nodes.
SAMPLE = 32_768
#: Fingerprints that live in a shard, about.
SHARD = 2_000
_LOW, _HIGH, _ALL = (np.uint64(x) for x in (0xFFFFFFFF, 0xFFFFFFFF00000000, 0xFFFFFFFFFFFFFFFF))


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """The fingerprint of one text, an unsigned 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    buf = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(buf, 42)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    digest = functools.partial(xxhash.xxh64_intdigest, seed=42)
    total = len(words) - n + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        a, b = starts[at : min(total, at + (1 << 16))], ends[at + n - 1 : min(total, at + (1 << 16)) + n - 1]
        hashes = np.fromiter(map(digest, (buf[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True))), np.uint64, len(a))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every row. A null text is an empty one."""

    def scan(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or b"", n) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fps)})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, fp long")


class VantageTree:
    """A vantage-point tree over one half of the fingerprints, as arrays of nodes."""

    def __init__(self, points: np.ndarray, mask: np.uint64, leaf: int, bits: int = BITS, seed: int = 7):
        self.mask, self.bits = mask, bits
        self.vp: list[int] = []
        self.of: list[int] = []  # the mask that the node measures
        self.mu: list[int] = []  # -1: a leaf
        self.radius: list[int] = []
        self.inside: list[int] = []
        self.outside: list[int] = []
        self._rng = np.random.default_rng(seed)
        self._grow(points, max(1, leaf))
        for name in ("mu", "radius", "inside", "outside"):
            setattr(self, name, np.array(getattr(self, name), np.int64))
        self.vp, self.of = np.array(self.vp, np.uint64), np.array(self.of, np.uint64)

    def _split(self, points: np.ndarray) -> tuple | None:
        """The vantage point of eight at random whose median divides the points most evenly."""
        for mask, radius in ((self.mask, self.bits // 2), (_ALL, self.bits)):
            best = None
            for p in self._rng.choice(points, min(8, len(points)), replace=False):
                d = np.bitwise_count((points ^ p) & mask)
                mu = int(np.sort(d)[(len(d) - 1) // 2])
                inside = int((d <= mu).sum())
                if inside == len(d) and mu > 0:
                    mu -= 1
                    inside = int((d <= mu).sum())
                even = min(inside, len(d) - inside)
                if even and (best is None or even > best[0]):
                    best = (even, p, mask, mu, radius, d <= mu)
            if best and best[0] * 20 >= len(points):
                return best[1:]
        return None

    def _grow(self, points: np.ndarray, leaf: int) -> None:
        stack = [(points, None)]
        while stack:
            pts, link = stack.pop()
            k = len(self.mu)
            for a, v in ((self.vp, 0), (self.of, 0), (self.mu, -1), (self.radius, 0), (self.inside, -1), (self.outside, -1)):
                a.append(v)
            if link is not None:
                link[0][link[1]] = k
            if len(pts) <= leaf or (best := self._split(pts)) is None:
                continue
            p, mask, mu, radius, inner = best
            self.vp[k], self.of[k], self.mu[k], self.radius[k] = int(p), int(mask), mu, radius
            stack += [(pts[inner], (self.inside, k)), (pts[~inner], (self.outside, k))]

    def home(self, fps: np.ndarray) -> np.ndarray:
        """The leaf that each fingerprint lives in."""
        node = np.zeros(len(fps), np.int64)
        while len(open_ := np.flatnonzero(self.mu[node] >= 0)):
            k = node[open_]
            d = np.bitwise_count((fps[open_] ^ self.vp[k]) & self.of[k])
            node[open_] = np.where(d <= self.mu[k], self.inside[k], self.outside[k])
        return node

    def reach(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position, leaf) that the triangle bounds don't rule out."""
        at, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        done = []
        while len(at):
            leaf = self.mu[node] < 0
            done.append((at[leaf], node[leaf]))
            at, node = at[~leaf], node[~leaf]
            d = np.bitwise_count((fps[at] ^ self.vp[node]) & self.of[node]).astype(np.int64)
            inside = d - self.radius[node] <= self.mu[node]
            outside = d + self.radius[node] > self.mu[node]
            at, node = np.concatenate([at[inside], at[outside]]), np.concatenate([self.inside[node[inside]], self.outside[node[outside]]])
        return np.concatenate([a for a, _ in done]), np.concatenate([n for _, n in done])


def forest(fps: np.ndarray, lives: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as stars, of the links between those who live in a shard and all who were sent.

    ``fps``: distinct and sorted; ``lives``: which of them live in the shard. Returns positions (member, root).
    """
    label = np.arange(len(fps))
    home = np.flatnonzero(lives)
    step = max(1, 4_000_000 // max(1, len(fps)))
    for at in range(0, len(home), step):
        rows = home[at : at + step]
        near = np.bitwise_count(fps[rows][:, None] ^ fps[None, :]) <= bits
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            roots = np.unique(label[np.flatnonzero(near[i])])
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    member = np.flatnonzero(label != np.arange(len(fps)))
    return member, label[member]


def shard_links(fps: np.ndarray, lives: np.ndarray, mask: np.uint64, bits: int = BITS, size: int = 4 * SHARD) -> list[tuple[np.ndarray, np.ndarray]]:
    """The links of a shard as (member, root) pairs of fingerprints; ``fps`` distinct and sorted."""
    if int(lives.sum()) <= size:
        a, b = forest(fps, lives, bits)
        return [(fps[a], fps[b])]
    tree = VantageTree(fps[lives], mask, SHARD, bits)
    home = tree.home(fps)
    at, leaf = tree.reach(fps)
    order = np.lexsort((at, leaf))
    at, leaf = at[order], leaf[order]
    cut = np.flatnonzero(np.diff(leaf)) + 1
    out = []
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
        part = at[lo:hi]
        a, b = forest(fps[part], lives[part] & (home[part] == leaf[lo]), bits)
        out.append((fps[part][a], fps[part][b]))
    return out


def near_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fps`` (fp long, distinct) at ``bits`` or fewer."""
    total = fps.count()
    every = max(1, -(-total // SAMPLE))
    sample = fps.where(F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.lit(every)) == 0).limit(2 * SAMPLE).toPandas()["fp"]
    points = np.sort(sample.to_numpy(np.int64)).view(np.uint64)
    leaf = max(1, int(SHARD * len(points) / max(1, total)))
    trees = [VantageTree(points, m, leaf, bits) for m in (_LOW, _HIGH)]  # at most 2 * SAMPLE nodes each

    def route(batches):
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for k, tree in enumerate(trees):
                lives = tree.home(x)
                at, node = tree.reach(x)
                shard = node * 2 + k
                yield pa.record_batch({"shard": shard, "fp": x[at].view(np.int64), "home": pa.array(node == lives[at])})

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(x := pdf["fp"].to_numpy(np.int64).view(np.uint64))
        mask = _HIGH if pdf["shard"].iloc[0] % 2 else _LOW
        a, b = (np.concatenate(c) for c in zip(*shard_links(x[order], pdf["home"].to_numpy(bool)[order], mask, bits), strict=True))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.mapInArrow(route, "shard long, fp long, home boolean").groupBy("shard").applyInPandas(link, "a long, b long")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, n: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` (long) and ``component_id`` of every row: the smallest doc_id it is linked to, itself included.

    Null and empty texts and texts of white space have fingerprint zero and are linked like any other.
    Rows whose id is null get a row too, and count in no minimum; a component of such rows only has a null
    id. Repeated rows stay repeated. Other columns are ignored. An empty table gives an empty table.
    """
    rows = materialize(fingerprints(df, id_col, text_col, n))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = connected_components(near_links(distinct.select("fp"), bits))
    near = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = near.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = near.join(least, "root").select("fp", "component_id")
    of = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return join_spread(rows, of, "fp", distinct.select("fp", "n")).select("doc_id", "fp", "component_id")


def hex16(col: str) -> F.Column:
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=near_components) -> DataFrame:
    """The rows of ``df`` with one document of each near-duplicate component of ``groups``: the smallest id.

    Of rows that repeat that id one stays, the one with the smallest hash of its text. Rows whose id is null
    can't be told apart and all stay.
    """
    key, n, hashed, row = fresh(df, "kept_id", "kept_n", "kept_hash", "kept_row")
    chosen = groups(df.where(F.col(id_col).isNotNull()), id_col, text_col).where("doc_id = component_id")
    chosen = chosen.groupBy(F.col("component_id").alias(key)).agg(F.count("*").alias(n))
    kept = df.join(chosen, F.col(id_col) == F.col(key), "inner")
    # Only ids that occur more than once pass through the aggregate; they are few, and each keeps one row.
    once = kept.where(F.col(n) == 1).select(*df.columns)
    many = kept.where(F.col(n) > 1).select(F.xxhash64(F.col(text_col)).alias(hashed), F.struct(*df.columns).alias(row), key)
    many = many.groupBy(key).agg(F.min_by(row, hashed).alias(row)).select(f"{row}.*")
    return once.unionByName(many).unionByName(df.where(F.col(id_col).isNull()))
