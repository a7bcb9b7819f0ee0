import gzip
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import asof, bpe, chat, components, mixing, passages, quality_model, quality_rules, queries, simhash, topk, toxicity, warc

EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 3000), (5, "a b c"), (5, "a b c"), (None, "x y"), (6, "Él, x²½ <|endoftext|> I'll we're.")]
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, 9, "clash") for r in EDGE], DOCS + ", ids int, words string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_same_as_library(spark, edge, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    got = bpe.bpe_decode(bpe.bpe_encode(edge, path, n_buckets=3), path).collect()
    assert len(got) == len(EDGE)
    want = [tok.encode(t or "", add_special_tokens=False).ids for _, t in EDGE]
    assert sorted((str(r.doc_id), np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in got) == sorted((str(d), ids, tok.decode(ids, skip_special_tokens=False)) for (d, _), ids in zip(EDGE, want, strict=True))
    assert bpe.bpe_encode(empty, path).count() == 0


def test_bpe_round_trip_in_one_worker(spark, edge, empty):
    path = queries.tokenizer_path()
    got = bpe.bpe_round_trip(edge, path, n_buckets=3)
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert sorted(map(str, got.collect())) == sorted(map(str, bpe.bpe_decode(bpe.bpe_encode(edge, path), path).collect()))
    assert bpe.bpe_round_trip(empty, path).count() == 0
    plan = queries.op1_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan  # a second Python worker beside the join's in each task


def test_topk_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 0.3, (400, 8)), 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [float("nan")] * 8), (502, [None] * 8), (None, [0.1] * 8), (600, [1.0])]
    v = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id") % 100 == 0, 5).collect()}
    q = np.floor(1024 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    for i in (0, 100, 200, 300):
        best = sorted((-int(s), j) for j, s in enumerate(q @ q[i]) if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in best]
    assert (600, 1) not in got


def test_passages_planted(spark, empty):
    rng = np.random.default_rng(2)
    def prose(n):
        return [f"w{rng.integers(10**6)}" for _ in range(n)]
    shared, fuzzy = prose(60), prose(80)
    edited = [*fuzzy[:30], "new", *fuzzy[31:55], *fuzzy[56:]]
    docs = [(1, prose(90) + shared + prose(20)), (2, prose(10) + shared + prose(50)), (3, shared), (4, fuzzy + prose(9)), (5, prose(33) + edited), (6, prose(300))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [(7, None), (None, " ".join(shared)), (8, "")], DOCS)
    got = sorted((r.doc_id, r.start, r.end, r.source) for r in passages.repeated_passages(df).collect())
    assert got == [(2, 10, 70, 1), (3, 0, 60, 1), (5, 33, 112, 4)]
    kept = {r.doc_id: r.text for r in passages.cut_passages(df, passages.repeated_passages(df)).where("doc_id is not null").collect()}
    assert kept[3] == "" and len(kept[2].split()) == 60 and kept[6] == " ".join(docs[5][1]) and kept[7] is None
    assert passages.repeated_passages(empty).count() == 0


def test_simhash_components_brute_force(spark, edge, empty):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(3, 9))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(300 + i, t + " " + t) for i, t in enumerate(texts[:50])]
    got = {r.doc_id: r.component_id for r in simhash.near_components(spark.createDataFrame(docs, DOCS)).collect()}
    fp = {i: simhash.fingerprint(t.encode()) for i, t in docs}
    root = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            m = min(root[b] for b in fp if (fp[a] ^ fp[b]).bit_count() <= 3)
            if m < root[a]:
                root[a], changed = m, True
    assert got == root
    out = simhash.near_components(edge).collect()
    assert len(out) == len(EDGE) and {r.component_id for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_components(empty).count() == 0
    assert simhash.keep_one(edge).count() == len({r.component_id for r in out if r.doc_id is not None}) + 1


def test_tree_routes_every_near_pair():
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    near = x ^ (np.uint64(1) << rng.integers(0, 32, len(x)).astype(np.uint64))
    tree = simhash.VantageTree(x, np.uint64(0xFFFFFFFF), 20)
    at, leaf = tree.reach(near)
    homes = tree.home(x)
    assert {(int(a), int(n)) for a, n in zip(at, leaf, strict=True)} >= {(i, int(h)) for i, h in enumerate(homes)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def held_out(spark, label, mod, keep):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == keep).select("doc_id", label)


def test_toxicity_held_out(spark, edge, empty):
    docs, labels, held = held_out(spark, "toxic", 5, 0)
    model = toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = toxicity.score(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").withColumn("hit", ((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int")).agg(F.avg("hit"), F.count("*")).first()
    assert got[1] > 300 and got[0] >= 0.97  # measured 0.985: this table has some 350 toxic labels to learn from
    assert toxicity.score(edge, model).count() == len(EDGE) and toxicity.drop_toxic(empty, model).count() == 0


def test_quality_model_held_out(spark, edge):
    docs, labels, held = held_out(spark, "quality", 4, 2)
    model = quality_model.fit(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    got = quality_model.score(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").withColumn("hit", ((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("int")).agg(F.avg("hit")).first()
    assert got[0] >= 0.97
    assert quality_model.score(edge, model).count() == len(EDGE)
    assert toxicity.train([]).bias < 0 and quality_model.train([]).bias == 0


def test_quality_counts_brute_force(spark, edge, empty):
    texts = ["a b c a b c x", "x\nx\n \nx\ny", "#a% b", "q q q q q", "z " * 200, None, "one two"]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        rep = {p for k, x in enumerate(windows) if windows.count(x) > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_dup_lines, got[i].n_symbols, got[i].word_chars) == (len(w), len(rep), len(lines) - len(set(lines)), sum(c in "#*$%&|<>" for c in t or ""), sum(map(len, w)))
    assert quality_rules.judge(edge).count() == len(EDGE) and quality_rules.judge(empty).count() == 0


def test_mixing_meets_targets(spark, empty):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{d}{rng.integers(30)}" for _ in range(20)), d) for i in range(400) for d in ["ab"[i % 4 == 0]]]
    df = spark.createDataFrame([*rows, (900, None, None), (901, "", "a")], DOCS + ", domain string")
    model = mixing.fit(df, domains=["a", "b"])
    got, fitted = mixing.rates(df, model, {"a": 0.5, "b": 0.5})
    sums = got.agg(*(F.sum(F.col("rate") * F.col("tokens") * F.get("posterior", F.lit(i))) for i in range(2))).first()
    assert abs(sums[0] - sums[1]) < 0.01 * sum(sums) and abs(sum(sums) - 8000) < 10
    assert mixing.apply_rates(df, fitted, at_least=1).count() >= 402
    assert mixing.posteriors(empty, model).count() == 0


def test_asof_buckets(spark):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(3)), int(t), bool(rng.integers(2)), i) for i, t in enumerate(rng.integers(0, 100, 200))] + [(None, 3, True, 900), (1, None, False, 901)]
    df = spark.createDataFrame(rows, "k long, t long, base boolean, v long")
    for span in (7, 1000):
        got = {r.v: r.latest for r in asof.latest_before(df, ["k"], "t", F.col("base"), F.col("v"), span).collect()}
        for k, t, _, v in rows:
            before = [(u, w) for j, u, b, w in rows if b and j == k and k is not None and t is not None and u is not None and u < t]
            assert got[v] == (max(before)[1] if before else None)


def test_warc(spark, tmp_path):
    def record(kind, uri, date, http):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{kind}-{date}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\nContent-Type: application/http\r\nContent-Length: {len(http)}\r\n\r\n"
        return head.encode() + http + b"\r\n\r\n"

    data = record("response", "http://A.example:80/x?b=2&a=1", "2024-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\nContent-Length: 5\r\n\r\nhello")
    data += record("revisit", "http://a.example/x?a=1&b=2&utm_source=z#f", "2024-01-02T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\nETag: W/\"1\"\r\nContent-Length: 0\r\nExpires: never\r\n\r\n")
    data += record("revisit", "http://a.example/x?a=1&b=2", "2024-01-03T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\nETag: \"2\"\r\n\r\n")
    data += record("revisit", "http://a.example/none", "2024-01-03T01:00:00Z", b"HTTP/1.1 304 Not Modified\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    rows = warc.read_warc(spark, str(tmp_path))
    got = {str(r.time)[:13]: r for r in warc.resolve_revisits(rows).collect()}
    first = got["2024-01-02 00"]
    assert first.outcome == "resolved" and bytes(first.body) == b"hello" and first.headers == {"etag": 'W/"1"', "content-length": "5", "expires": "never"}
    assert got["2024-01-03 00"].outcome == "mismatch" and got["2024-01-03 01"].outcome == "no_base"
    assert warc.resolve_revisits(rows.limit(0)).count() == 0


def test_chat_links_and_order(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "Fine, thanks."), (1, 2, "user", "> how ARE you\nNot bad, and:"), (1, 3, "assistant", "Good."),
        (1, 4, "user", "Ann wrote:\n> > Hello there\n> Fine, thanks.\nReally?"), (2, 0, "user", None), (2, 0, "user", None), (None, 1, "user", "> x"), (3, 0, None, "> quoted from nowhere"),
    ]
    got = chat.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 8
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.path)
    assert {r.turn: r.reply_to for r in one} == {0: None, 1: None, 2: 0, 3: None, 4: 1}
    assert [r.turn for r in one] == [0, 1, 4, 2, 3]
    assert {r.turn: r.text for r in one}[4] == "Really?"
    assert chat.reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.toPandas(), docs.schema)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(ids) > 150 and zlib.crc32(b"") == 0
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf).count() == kept.count()
