"""Nulls, empty and long inputs, ties, repeated rows, clashing columns: operators that have no test file of their own."""

import warnings

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import common, mixing, passages, quality_model, simhash, topk

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, k=10):
    q = {i: np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) for i, v in rows}
    out = {}
    for i, x in q.items():
        if i % 100 == 0:
            best = sorted((-int(x @ y), j) for j, y in q.items() if j != i and len(y) == len(x))[:k]
            out |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(best)}
    return out


def found(spark, rows, k=10, schema=VECTORS):
    v = topk.quantise(spark.createDataFrame(rows, schema))
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id") % 100 == 0, k).collect()}


def test_topk_long_vectors_that_prune(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.05, (3000, 64)) + np.eye(64)[rng.integers(0, 64, 3000)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(spark, rows) == brute(rows)


def test_topk_ties_go_to_the_smaller_id(spark):
    rows = [(i, [float(i % 2), 1.0]) for i in range(250)]
    assert found(spark, rows, 7) == brute(rows, 7)


def test_topk_empty_repeated_and_odd_rows(spark):
    assert found(spark, []) == {}
    assert found(spark, [(100, [0.5])]) == {}
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [float("inf"), 0.0]), (5, [None, 1.0]), (None, [1.0, 1.0])]
    clash = [(i, v, 1, "s") for i, v in rows]
    assert found(spark, clash, schema=VECTORS + ", score int, shard string") == {(100, 1): (1, 512 * 1024)}


def test_quality_model_empty_long_and_null(spark):
    docs = spark.createDataFrame([(1, None, 5, "a"), (2, "", 5, "a"), (None, "x y", 5, "a"), (3, "good words " * 40_000, 5, "a"), (4, "bad bad bad", 5, "a"), (4, "bad bad bad", 5, "a")], "doc_id long, text string, score int, label string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    model = quality_model.fit(docs, labels, F.lit(True))
    got = quality_model.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id == 3} > {r.score for r in got if r.doc_id == 4} or max(r.score for r in got if r.doc_id == 3) > max(r.score for r in got if r.doc_id == 4)
    assert quality_model.score(docs.limit(0), model).count() == 0
    assert quality_model.fit(docs.limit(0), labels, F.lit(True)).bias == 0


def test_mixing_same_as_numpy_and_says_what_is_out_of_reach(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{'abc'[i % 3]}{rng.integers(30)}" for _ in range(int(rng.integers(1, 60)))), "abc"[i % 3]) for i in range(300)] + [(900, None, None), (901, "", "a"), (902, "a1 " * 50_000, "a")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, domain string, rate double")
    model = mixing.fit(df)
    assert model.domains == ["a", "b", "c"]
    table, fitted = mixing.rates(df, model, {"a": 0.2, "b": 0.3, "c": 0.5})
    got = table.collect()
    p, n = np.array([r.posterior for r in got]), np.array([r.tokens for r in got], float)
    # projected-gradient least squares in numpy, over all documents
    size, target = n.sum(), np.array([0.2, 0.3, 0.5])
    norm = np.linalg.pinv((p * n[:, None]).T @ p / size + 1e-9 * np.eye(3))
    r = np.ones(len(n))
    for _ in range(500):
        r = np.maximum(0, r - p @ (norm @ ((r * n) @ p / size - target)))
    assert np.abs(r - np.array([x.rate for x in got])).max() < 1e-3 and fitted.misfit < 1e-3
    assert mixing.apply_rates(df, fitted, at_least=1).count() >= len(rows)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        one = df.where("domain = 'a'")
        got = mixing.rates(one, mixing.train([(b"a1 a2", "a"), (b"zz yy", "b")]), {"a": 0.0001, "b": 0.9999})[1]
    assert got.misfit < 1e-3 or any("out of reach" in str(w.message) for w in said)
    assert mixing.apply_rates(df.limit(0), fitted).count() == 0


def test_join_spread_splits_hot_keys(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 9000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    of = rows.groupBy("k").agg(F.max("v").alias("m"))
    got = common.join_spread(rows, of, "k", rows.groupBy("k").agg(F.count("*").alias("n"))).agg(F.count("*"), F.sum("m")).first()
    want = rows.join(of, "k").agg(F.count("*"), F.sum("m")).first()
    assert tuple(got) == tuple(want)


def test_shard_links_with_trees_of_its_own():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x[:1500] ^ (np.uint64(1) << rng.integers(0, 32, 1500).astype(np.uint64))]))
    lives = rng.random(len(x)) < 0.8

    def roots(pairs):
        root = {int(v): int(v) for v in x}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            root[find(int(a))] = find(int(b))
        groups = {}
        for v in root:
            groups.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, groups.values()))

    at = {int(v): i for i, v in enumerate(x)}
    near = [(a, a ^ (1 << k)) for a in at for k in range(32) if (a ^ (1 << k)) in at and (lives[at[a]] or lives[at[a ^ (1 << k)]])]
    got = [pair for a, b in simhash.shard_links(x, lives, np.uint64(0xFFFFFFFF), 3, size=50) for pair in zip(a, b, strict=True)]
    assert roots(got) == roots(near)


def test_keep_one_and_cut_passages_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 1, 2, "x"), (2, "a b c d", 1, 2, "x"), (2, "a b c d", 1, 2, "x"), (None, None, 1, 2, "x")], "doc_id long, text string, _id int, _n int, _spans string")
    kept = simhash.keep_one(df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"] and kept.columns == df.columns
    cut = passages.cut_passages(df, spark.createDataFrame([(1, 0, 2)], "doc_id long, start long, end long"))
    assert sorted((str(r.doc_id), r.text) for r in cut.collect())[0] == ("1", " c d") and cut.columns == df.columns
