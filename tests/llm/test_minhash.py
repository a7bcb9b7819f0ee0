import numpy as np

import corpus_pipeline
from lexmill.llm import minhash

DOCS = "doc_id long, text string"


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def similar(a, b):
    return not a and not b or len(a & b) >= 0.8 * len(a | b) and bool(a & b)


def brute_groups(texts):
    s = sets(texts)
    root = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if root[i] != root[j] and similar(s[i], s[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def test_near_dedup_same_groups_as_brute_force(spark):
    rng = np.random.default_rng(3)

    def edit(words, n):
        out = list(words)
        for at in rng.choice(len(out), n, replace=False):
            out[at] = f"e{rng.integers(10**6)}"
        return out

    texts = [None, "", "a b", "A  b", "a b c"]
    for size, edits in ((500, (0, 1, 5, 10, 40)), (200, (1, 2, 4, 12)), (60, (1, 2, 3))):
        for _ in range(6):
            base = [f"w{rng.integers(10**6)}" for _ in range(size)]
            texts += [" ".join(base)] + [" ".join(edit(base, n)) for n in edits]
    base = [f"h{rng.integers(10**6)}" for _ in range(120)]  # a band of more than SMALL sets, with some links not to its smallest
    texts += [" ".join(edit(base, int(n))) for n in rng.integers(1, 4, 60)]
    want = brute_groups(texts)
    df = spark.createDataFrame([*enumerate(texts), (None, texts[9])], DOCS)
    got = {r.doc_id: r.component_id for r in minhash.near_groups(df.where("doc_id is not null")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = corpus_pipeline.near_dedup_stage(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want)) and len(kept) == len(set(want)) + 1
    assert minhash.near_groups(df.limit(0)).count() == 0


def test_large_groups_without_a_row_for_each_pair(spark, monkeypatch):
    """Copies that differ from their hub by more than 0.8 allows are linked by what they share, in blocks, and SimHash links count."""
    rng = np.random.default_rng(5)
    hub = [f"h{rng.integers(10**6)}" for _ in range(150)]
    texts = [" ".join(hub)]
    for _ in range(12):
        base = list(hub)
        for at in rng.choice(150, int(rng.integers(2, 8)), replace=False):
            base[at] = f"b{rng.integers(10**6)}"
        for _ in range(10):
            copy = list(base)
            for at in rng.choice(150, int(rng.integers(0, 4)), replace=False):
                copy[at] = f"c{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    want = brute_groups(texts)
    asked = []
    real = minhash.near_links
    monkeypatch.setattr(minhash, "near_links", lambda fps: asked.append(1) or real(fps))
    monkeypatch.setattr(minhash, "BLOCK", 4_000)
    monkeypatch.setattr(minhash, "SMALL", 4)
    got = {r.doc_id: r.component_id for r in minhash.near_groups(spark.createDataFrame([*enumerate(texts)], DOCS)).collect()}
    assert [got[i] for i in range(len(texts))] == want and asked


def test_counts_of_common_shingles():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 3000, int(n)).astype(np.uint64)) for n in rng.integers(1, 200, 150)]
    sets += [np.unique(np.concatenate([np.arange(50, dtype=np.uint64), x])) for x in sets[:90]]
    count = minhash._Counter(sets)
    for x in [*sets[:20], np.array([10**6], np.uint64), np.arange(70, dtype=np.uint64)]:
        rows = np.flatnonzero(rng.random(len(sets)) < 0.5)
        assert count.common(x, rows).tolist() == [len(np.intersect1d(x, sets[r])) for r in rows]
