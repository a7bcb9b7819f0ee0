"""Near-duplicate groups of the pipeline: documents whose word shingles have a Jaccard similarity of 0.8 or more.

Shingles. The set of a text's runs of ``SHINGLE`` words (words as in :mod:`simhash`; all words if there are
fewer), each as a 64-bit hash. Texts with the same set collapse first; texts without words have the empty set.

SimHash. Each set has a fingerprint (a bit is 1 if it is set in over half of its hashes); the vantage-point trees of :mod:`simhash`
give the links at 3 or fewer differing bits, and those are tested as all others. What they join needs no further test.

Candidates. 3 bits reach few of the pairs at 0.8, so ``BANDS`` bands of ``ROWS`` minimum hashes give the rest: two sets that share a
band are candidates. A pair at similarity s is one with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9999 at 0.8, more above.

Links. Every candidate pair that can be similar enough is tested by the exact similarity of the two sets; only those of
at least ``SIMILARITY`` are links, and groups are the components of the links. Pairs of a band shared by at most
``SMALL`` sets are all candidates. In larger ones each set is first tested against one, the set whose bands most others
share: the text that a group's copies come from, if there is one. Whatever that leaves in another group than most of its band is then held
against all others of that hub's bands: blocks of about ``BLOCK`` shingles meet two by two, and a task counts the common shingles of their
sets in place and gives a spanning forest of the links, so that no pair becomes a row. A pair is passed over only where both are in one group already, which its link
can't change, or where it can't be similar enough: two sets have at most min(|a| - own(a), |b| - own(b)) shingles in common, own(x) being those that no
other set of any large band has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialize, release
from .components import connected_components
from .passages import _Hashes, grams, word_hashes
from .simhash import near_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SMALL = 16
#: Shingles that one step of the minimum hashes reads.
STEP = 4_096
#: Shingles of a block of sets, about.
BLOCK = 500_000

_MASKS = np.random.default_rng(13).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, hashes: _Hashes, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = word_hashes(text, hashes)
    return np.unique(grams(h, min(n, len(h)))) if len(h) else h


def bands(x: np.ndarray) -> list[int]:
    """The band keys of a shingle set, as signed 64-bit integers; none for the empty set."""
    if not len(x):
        return []
    least = np.min([((x[at : at + STEP] ^ _MASKS) * _MIX).min(axis=1) for at in range(0, len(x), STEP)], axis=0)
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - 2**63 for k, b in enumerate(least.reshape(BANDS, ROWS))]


def signature(x: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(x.tobytes()) - 2**63


def fingerprint(x: np.ndarray) -> int:
    """The SimHash fingerprint of a shingle set, as a signed integer; zero for the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(x), STEP):
        ones += np.unpackbits(x[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(x), bitorder="little").view(np.int64)[0])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def _signatures(rows: DataFrame) -> DataFrame:
    def scan(batches):
        hashes = _Hashes()
        for batch in batches:
            sets = [shingles(t.as_py() or b"", hashes) for t in batch.column(1)]
            yield pa.record_batch({
                "doc_id": batch.column(0), "sig": pa.array([signature(x) for x in sets], pa.int64()), "size": pa.array(map(len, sets), pa.int64()),
                "bands": pa.array(map(bands, sets), pa.list_(pa.int64())), "fp": pa.array(map(fingerprint, sets), pa.int64()),
            })

    return rows.mapInArrow(scan, "doc_id long, sig long, size long, bands array<long>, fp long")


def _sets(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """``sig`` and ``shingles`` of the texts that ``needed`` (sig, doc_id) names."""
    texts = rows.join(needed, "doc_id").select("sig", "text")

    def scan(batches):
        hashes = _Hashes()
        for batch in batches:
            # An id can have several texts: only the one of this signature counts.
            got = [(s, x.tobytes()) for s, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if signature(x := shingles(t.as_py() or b"", hashes)) == s]
            yield pa.record_batch({"sig": pa.array([s for s, _ in got], pa.int64()), "shingles": pa.array([x for _, x in got], pa.binary())})

    return texts.mapInArrow(scan, "sig long, shingles binary").dropDuplicates(["sig"])


def _own(sets: DataFrame) -> DataFrame:
    """``sig`` and ``own``: how many of its shingles no other set of ``sets`` has (sets without any have no row)."""
    def scan(batches):
        for batch in batches:
            for sig, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.frombuffer(x.as_py(), np.int64)
                yield pa.record_batch({"sig": np.full(len(h), sig, np.int64), "hash": h})

    held = sets.mapInArrow(scan, "sig long, hash long").groupBy("hash").agg(F.count("*").alias("n"), F.min("sig").alias("sig"))
    return held.where("n = 1").groupBy("sig").agg(F.count("*").alias("own"))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of signatures whose sets are similar enough."""
    def test(batches):
        for batch in batches:
            keep = [jaccard(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) >= SIMILARITY for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("sig").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    return materialize(pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long"))


def _possible(common: Column, na: Column, nb: Column) -> Column:
    """Whether sets of these sizes can be similar enough with ``common`` shingles in common. (A margin covers rounding.)"""
    return common >= SIMILARITY * (na + nb - common) - 1e-6


class _Counter:
    """How many shingles each of some sets has in common with another: by bits for shingles that many have, by lists for the others."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        of = np.repeat(np.arange(self.n), [len(x) for x in sets])
        self.known, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.of = of[np.argsort(at, kind="stable")]
        self.ends = np.cumsum(counts)
        self.counts = counts
        # A shingle in one of 64 sets takes no more room as a bit of every set than as a list.
        often = counts * 64 > self.n
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.words = int(often.sum()) // 64 + 1
        self.bits = np.zeros((self.n, self.words), np.uint64)
        c = self.column[at]
        self.put(self.bits, of[c >= 0], c[c >= 0])

    @staticmethod
    def put(bits: np.ndarray, row: np.ndarray, c: np.ndarray) -> None:
        np.bitwise_or.at(bits, (row, c // 64), np.uint64(1) << (c % 64).astype(np.uint64))

    def common(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """With each set of ``rows``."""
        at = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
        at = at[self.known[at] == x]
        c = self.column[at]
        mine = np.zeros((1, self.words), np.uint64)
        self.put(mine, np.zeros(int((c >= 0).sum()), np.int64), c[c >= 0])
        out = np.bitwise_count(self.bits[rows] & mine).sum(axis=1, dtype=np.int64)
        few = [self.of[self.ends[i] - self.counts[i] : self.ends[i]] for i in at[c < 0].tolist()]
        return out + np.bincount(np.concatenate(few), minlength=self.n)[rows] if few else out


def _block_links(t: pa.Table) -> pa.Table:
    """A spanning forest of the links between the sets of ``rest`` and the others of a block pair, given the groups (root) they are in."""
    sigs, roots, size, fit = (t.column(c).to_numpy() for c in ("sig", "root", "size", "fit"))
    rest = t.column("rest").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles")]
    mine, other = np.flatnonzero(rest), np.flatnonzero(~rest)
    a, b = [], []
    if len(mine) and len(other):
        label = np.unique(roots, return_inverse=True)[1]
        count = _Counter([sets[i] for i in other])
        for i in mine.tolist():
            most = np.minimum(fit[i], fit[other])
            near = np.flatnonzero((label[other] != label[i]) & (most >= SIMILARITY * (size[i] + size[other] - most) - 1e-6))
            if not len(near):
                continue
            same = count.common(sets[i], near)
            for k in other[near[same / (size[i] + size[other[near]] - same) >= SIMILARITY]].tolist():
                if label[k] != label[i]:
                    a.append(sigs[i])
                    b.append(sigs[k])
                    label[label == label[k]] = label[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _rest_links(of: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the sets that are ``rest`` with all others of the same ``hub``; ``of`` has hub, sig, root, size, fit and rest."""
    blocks = of.groupBy("hub").agg(
        *(F.greatest(F.lit(1), F.ceil(F.sum(F.when(c, F.col("size")).otherwise(0)) / BLOCK)).cast("int").alias(n) for c, n in ((F.col("rest"), "n_rest"), (F.lit(True), "n_all"))), F.max("rest").alias("any")
    ).where("any").drop("any")
    of = of.join(blocks, "hub")

    def own(n: str):
        return F.array(F.pmod(F.xxhash64("sig"), F.col(n)).cast("int"))

    def every(n: str):
        return F.sequence(F.lit(0), F.col(n) - 1)

    cols = ("sig", "root", "size", "fit")
    one = of.where("rest").select("hub", *cols, F.lit(True).alias("rest"), F.explode(own("n_rest")).alias("i"), "n_all").select("hub", *cols, "rest", "i", F.explode(every("n_all")).alias("j"))
    two = of.select("hub", *cols, F.lit(False).alias("rest"), F.explode(every("n_rest")).alias("i"), "n_all", "n_rest").select("hub", *cols, "rest", "i", F.explode(own("n_all")).alias("j"))
    rows = one.unionByName(two).join(sets, "sig")
    return materialize(rows.groupBy("hub", "i", "j").applyInArrow(_block_links, "a long, b long"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``sig`` (of the shingle set) and ``component_id`` of every row: the smallest doc_id of its group.

    Null and empty texts and texts of white space are one group. Rows whose id is null get a row too and are
    linked by equal sets only. Repeated rows stay repeated. An empty table gives an empty table.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = materialize(_signatures(rows))
    nodes = materialize(signed.groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("fp").alias("fp")))
    member = nodes.select(F.explode("bands").alias("band"), "sig", "size")
    shared = member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    member = materialize(member.join(shared, "band"))
    prints = materialize(nodes.where("size > 0").groupBy("fp").agg(F.min("sig").alias("of")))
    copies = nodes.where("size > 0").join(prints, "fp").where("sig != of").select(F.col("of").alias("a"), F.col("sig").alias("b"))
    one, two = (prints.select(F.col("fp").alias(f"fp_{c}"), F.col("of").alias(c)) for c in "ab")
    alike = near_links(prints.select("fp")).toDF("fp_a", "fp_b").join(one, "fp_a").join(two, "fp_b").select("a", "b")
    alike = materialize(alike.unionByName(copies))
    wanted = member.select("sig").union(alike.select("a")).union(alike.select("b")).distinct()
    sets = materialize(_sets(rows, wanted.join(nodes.select("sig", F.col("first").alias("doc_id")), "sig")))
    release(spark)
    alike = _links(alike, sets)
    known = connected_components(alike).toDF("sig", "known")

    member = materialize(member.join(known, "sig", "left").withColumn("known", F.coalesce("known", "sig")))
    small = member.where(F.col("n") <= SMALL).select("band", "sig", "size", "known")
    one, two = (small.select("band", F.col("sig").alias(c), F.col("size").alias(f"n{c}"), F.col("known").alias(f"known_{c}")) for c in "ab")
    pairs = one.join(two, (one["band"] == two["band"]) & (F.col("a") < F.col("b")) & (F.col("known_a") != F.col("known_b")) & _possible(F.least("na", "nb"), F.col("na"), F.col("nb"))).select("a", "b")
    large = member.where(F.col("n") > SMALL)
    wide = large.groupBy("sig").agg(F.sum("n").alias("wide"))
    large = materialize(large.join(wide, "sig").select("band", "sig", "size", "wide"))
    hub = large.groupBy("band").agg(F.max(F.struct("wide", "sig", "size")).alias("hub"), F.min("size").alias("least"))
    star = large.join(hub, "band").select("band", "sig", "size", "least", F.col("hub.sig").alias("hub"), F.col("hub.size").alias("hub_size")).where("sig != hub")
    star = star.where(_possible(F.least("size", "hub_size"), F.col("size"), F.col("hub_size"))).select(F.col("hub").alias("a"), F.col("sig").alias("b"))
    links = materialize(_links(pairs.unionByName(star), sets).unionByName(alike))
    roots = connected_components(links)

    of = large.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    counts = of.groupBy("band", "root").agg(F.count("*").alias("n"))
    most = counts.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    own = _own(sets.join(large.select("sig").distinct(), "sig", "left_semi"))
    of = of.join(most, "band").join(own, "sig", "left").join(hub.select("band", F.col("hub.sig").alias("hub"), "least"), "band")
    # ``fit``: how many shingles others can have too. ``size`` and ``least`` bound what any partner in the band can reach.
    of = of.select("hub", "sig", "root", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("fit"), (F.col("root") != F.col("most")).alias("rest"), "least")
    of = of.where(_possible(F.col("fit"), F.col("size"), F.greatest("least", "fit")))
    of = materialize(of.groupBy("hub", "sig").agg(*(F.first(c).alias(c) for c in ("root", "size", "fit")), F.max("rest").alias("rest")))
    release(spark)
    if not of.where("rest").isEmpty():
        roots = connected_components(links.unionByName(_rest_links(of, sets)))

    near = nodes.select("sig", "first").join(roots.withColumnRenamed("node", "sig"), "sig")
    least = near.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = near.join(least, "root").select("sig", "component_id")
    of = nodes.select("sig", "first").join(linked, "sig", "left").select("sig", F.coalesce("component_id", "first").alias("component_id"))
    return join_spread(signed.select("doc_id", "sig"), of, "sig", nodes.select("sig", "n")).select("doc_id", "sig", "component_id")
