import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from lexmill.llm import passages

DOCS = "doc_id long, text string"


def prose(rng, n):
    return [f"w{rng.integers(10**6)}" for _ in range(n)]


def found(spark, docs):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], DOCS)
    return sorted((r.doc_id, r.start, r.end, r.source) for r in passages.repeated_passages(df).collect())


def test_exact_cover_covers_every_run():
    rng = np.random.default_rng(7)
    for _ in range(300):
        source = rng.integers(0, 3, 90)
        text = np.concatenate([source[a : a + n] for a, n in zip(rng.integers(0, 60, 5), rng.integers(1, 30, 5), strict=True)])
        places = {tuple(source[x : x + 8]): x for x in range(82, -1, -1)}
        hits = [(y, places[tuple(text[y : y + 8])]) for y in range(len(text) - 7) if tuple(text[y : y + 8]) in places]
        if hits:
            got = passages.exact_cover(*np.array(hits).T, 8)
            assert all((text[lo:hi] == source[x : x + hi - lo]).all() and hi - lo >= 8 for lo, hi, x in got)
            assert {w for lo, hi, _ in got for w in range(lo, hi)} == {w for y, _ in hits for w in range(y, y + 8)}
    assert len(passages.exact_cover(np.arange(4961), np.zeros(4961, np.int64), 40)) <= 5000 // 40 + 1


def test_passage_whose_parts_occurred_before(spark):
    rng = np.random.default_rng(8)
    whole = prose(rng, 70)
    parts = [whole[at : at + 30] for at in (0, 20, 40)]  # they overlap, so that every seed of the whole occurred before
    docs = [(i, prose(rng, 50) + part + prose(rng, 50)) for i, part in enumerate(parts)]
    docs += [(10, prose(rng, 30) + whole + prose(rng, 30)), (11, prose(rng, 7) + whole + prose(rng, 30)), (12, whole[15:55] + prose(rng, 9))]
    assert found(spark, docs) == [(11, 7, 77, 10), (12, 0, 40, 10)]


def test_fuzzy_passage_whose_parts_occurred_before(spark):
    rng = np.random.default_rng(14)
    docs = []
    for n in range(20):
        whole = prose(rng, 75)
        parts = [whole[at : at + 20] for at in range(0, 60, 15)] + [whole[60:]]  # they overlap, so that every seed of the whole occurred before
        docs += [(100 * n + i, prose(rng, 50) + part + prose(rng, 50)) for i, part in enumerate(parts)]
        edited = list(whole)
        for at in (7, 22, 37, 52, 67):
            edited[at] = f"e{rng.integers(10**6)}"
        docs += [(100 * n + 10, prose(rng, 30) + whole + prose(rng, 30)), (100 * n + 11, prose(rng, 7) + edited + prose(rng, 30))]
    got = found(spark, docs)
    assert {d for d, *_ in got} <= {100 * n + 11 for n in range(20)} and all(s == d - 1 for d, *_, s in got)
    assert sum(a <= 8 and b >= 81 for _, a, b, _ in got) >= 18


def test_pair_chains_are_made_once(spark, tmp_path, monkeypatch):
    made = passages._pair_chains

    def counted(batches):
        (tmp_path / uuid.uuid4().hex).write_text(str(TaskContext.get().partitionId()))
        yield from made(batches)

    monkeypatch.setattr(passages, "_pair_chains", counted)
    rng = np.random.default_rng(15)
    whole = prose(rng, 75)
    edited = [f"e{i}" if i in (7, 22, 37, 52, 67) else w for i, w in enumerate(whole)]
    docs = [(i, prose(rng, 50) + whole[at : at + 20] + prose(rng, 50)) for i, at in enumerate((0, 15, 30, 45, 55))]
    assert [(d, s) for d, _, _, s in found(spark, [*docs, (10, prose(rng, 30) + whole), (11, prose(rng, 7) + edited)])] == [(11, 10)]
    runs = Counter(p.read_text() for p in tmp_path.iterdir())
    assert runs and max(runs.values()) == 1, runs


def test_pairs_of_many_documents_in_batches():
    rng = np.random.default_rng(16)
    docs = [rng.integers(-(2**60), 2**60, (int(n), 3)) for n in (1, passages.ROWS, 70_000, 5)]
    batch = pa.record_batch([pa.array([9, 7, -3, 8, 6]), pa.array([[1, 2, 3], *(d.ravel() for d in docs)], pa.list_(pa.int64()))], ["doc_id", "pairs"])
    got = list(passages._unfold_pairs([batch.slice(1)]))
    assert max(b.num_rows for b in got) == passages.ROWS
    columns = [np.concatenate([b.column(c).to_numpy() for b in got]) for c in range(4)]
    rows = [(k, doc, a, b) for doc, d in zip((7, -3, 8, 6), docs, strict=True) for k, a, b in d.tolist()]
    assert list(zip(*(c.tolist() for c in columns), strict=True)) == rows


def test_verbatim_passage_before_a_loosely_similar_region(spark):
    rng = np.random.default_rng(9)
    for equal, different in ((8, 4), (10, 4), (8, 3), (4, 2)):
        verbatim = prose(rng, 60)
        parts = [prose(rng, equal) for _ in range(20)]
        docs = [(i, verbatim + [w for p in parts for w in [*p, *prose(rng, different)]]) for i in (1, 2)]
        got = found(spark, docs)
        assert any(d == 2 and a == 0 and b >= 60 for d, a, b, _ in got), (equal, different, got)


def test_align_keeps_every_exact_run():
    rng = np.random.default_rng(10)
    for _ in range(50):
        words = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = (np.concatenate([words, *(x for f in fields for x in (f, rng.integers(0, 2**63, 4).astype(np.uint64)))]) for fields in [[rng.integers(0, 2**63, 8).astype(np.uint64) for _ in range(20)]] for _ in range(2))
        at = [y for y in range(len(a) - passages.K + 1) if (a[y : y + passages.K] == b[y : y + passages.K]).all()]
        got = passages.align(a, b, at, at)
        covered = {y for ya, yb, *_ in got for y in range(ya, yb)}
        assert covered >= set(range(60))
        for ya, yb, xa, xb, same in got:
            assert yb - ya >= 40 and same >= 0.8 * max(yb - ya, xb - xa) and same == (a[ya:yb] == b[xa:xb]).sum()


def test_fuzzy_passages_by_length_and_edits(spark):
    """Replaced, dropped and inserted words; what is left must be a passage: 40 words, 0.8 of them matching."""
    rng = np.random.default_rng(11)
    docs, cells, n = [], {}, 0
    for words in (50, 60, 120):
        for share in (0, 0.05, 0.1, 0.15):
            for _ in range(20):
                passage = prose(rng, words)
                edited = list(passage)
                inner = 4 + rng.permutation(words - 8)[: round(share * words)]  # what is left of an end that is cut off may be too short
                for k, at in enumerate(sorted(inner.tolist(), reverse=True)):
                    edited[at : at + 1] = [[f"e{rng.integers(10**6)}"], [], [edited[at], f"e{rng.integers(10**6)}"]][0 if k % 4 else k // 4 % 3]
                docs += [(2 * n, prose(rng, 40) + passage + prose(rng, 30)), (2 * n + 1, prose(rng, 55) + edited + prose(rng, 20))]
                cells.setdefault((words, share), []).append(n)
                n += 1
    got = {d: s for d, _, _, s in found(spark, docs)}
    assert all(s == d - 1 for d, s in got.items())
    recall = {cell: sum(2 * i + 1 in got for i in ids) / len(ids) for cell, ids in cells.items()}
    assert min(recall.values()) >= 0.9, str(recall)


def test_long_text_ties_clashing_columns_and_repeated_rows(spark):
    rng = np.random.default_rng(13)
    long = prose(rng, 200_000)
    rows = [(1, " ".join(long)), (2, " ".join(long[100_000:100_300])), (2, " ".join(long[100_000:100_300])), (3, "x " * 5000), (4, "x " * 5000), (5, None), (None, " ".join(long[:60])), (6, "")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], DOCS + ", source int, cut_id string")
    spans = passages.repeated_passages(df)
    got = sorted((r.doc_id, r.start, r.end, r.source, r.source_start) for r in spans.collect())
    assert (2, 0, 300, 1, 100_000) in got
    covered = {y for d, a, b, *_ in got if d == 4 for y in range(a, b)}
    assert covered == set(range(5000)) and {d for d, *_ in got} == {2, 4}
    kept = passages.cut_passages(df, spans).collect()
    assert len(kept) == len(rows) and {r.doc_id: r.text for r in kept}[1] == rows[0][1] and all(r.text.strip() == "" for r in kept if r.doc_id in (2, 4))


def test_exact_runs_same_as_brute_force(spark):
    rng = np.random.default_rng(12)
    phrases = [prose(rng, int(n)) for n in rng.integers(5, 30, 25)]
    docs = [(i, [w for k in rng.integers(0, len(phrases), 7) for w in [*phrases[k], *(prose(rng, 3) if rng.random() < 0.3 else [])]]) for i in range(60)]
    covered = {d: set() for d, _ in docs}
    for d, a, b, _ in found(spark, docs):
        covered[d] |= set(range(a, b))
    seen = {}
    for d, words in docs:
        for p in range(len(words) - 39):
            if seen.setdefault(tuple(words[p : p + 40]), d) != d:
                assert covered[d] >= set(range(p, p + 40)), (d, p)
