import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import mixing, passages, queries, toxicity
from test_minhash import brute_groups

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_toxicity_rejects_what_the_model_scores_high(spark, docs):
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    got, all_texts = texts(STAGES["toxicity"](spark, docs, SF)), texts(docs)

    def brute(text):
        values = []
        for run in re.findall(r"\w+", text.lower()):
            for at in range(0, max(1, len(run) - toxicity.OVERLAP), toxicity.PIECE - toxicity.OVERLAP):
                w = run[at : at + toxicity.PIECE]
                grams = [f"<{w}>"[i : i + n].encode("utf-16-le", "surrogatepass") for n in toxicity.GRAMS for i in range(len(w) + 3 - n)] + [w.encode()]
                values.append((w, np.mean([model.gram[zlib.crc32(g) % toxicity.BUCKETS] for g in grams])))
        n, step = toxicity.WINDOW, toxicity.WINDOW // 2
        best = max((sum(dict(values[at : at + n]).values()) for at in range(0, max(1, len(values) - step), step)), default=0.0)
        return best * toxicity.GAIN / n + model.bias

    z = {d: brute(t) for d, t in all_texts.items()}
    assert all(v < 0 for d, v in z.items() if d in got and abs(v) > 1e-9) and all(v > 0 for d, v in z.items() if d not in got and abs(v) > 1e-9)
    assert 0 < len(got) < len(all_texts)


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    rows = sorted(texts(docs).items())
    roots = brute_groups([t for _, t in rows])
    assert set(texts(STAGES["near_dedup"](spark, docs, SF))) == {rows[r][0] for r in roots}


def test_substring_dedup_cuts_every_exact_run(spark, docs):
    kept, before = texts(STAGES["substring_dedup"](spark, docs, SF)), texts(docs)
    spans = {}
    for r in passages.repeated_passages(docs).collect():
        assert r.source < r.doc_id and r.end - r.start >= 40
        a, b = before[r.doc_id].encode().lower().split()[r.start : r.end], before[r.source].encode().lower().split()[r.source_start : r.source_end]
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert row[-1] >= r.matches >= 0.8 * max(len(a), len(b))
        spans.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    seen = {}
    for d, t in sorted(before.items()):
        words = t.encode().split()
        for p in range(len(words) - 39):
            if seen.setdefault(b" ".join(words[p : p + 40]).lower(), d) != d:
                assert spans.get(d, set()) >= set(range(p, p + 40)), (d, p)
        assert kept[d].encode().split() == [w for i, w in enumerate(words) if i not in spans.get(d, ())]
    assert spans


def test_mixing_repeats_rows_as_the_rates_say(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = mixing.fit(queries.labelled_domains(docs, labels), domains=sorted(queries.TARGETS))
    table, _ = mixing.rates(docs, model, queries.TARGETS, total="grow")
    table = table.collect()
    got = Counter(r.doc_id for r in STAGES["mixing"](spark, docs, SF).collect())
    for r in table:
        assert max(1, int(r.rate)) <= got[r.doc_id] <= max(1, int(r.rate) + 1)
    assert len(table) == len(got)
    sums = np.array([sum(r.rate * r.tokens * r.posterior[i] for r in table) for i in range(len(queries.TARGETS))])
    want = np.array([queries.TARGETS[k] for k in sorted(queries.TARGETS)])
    assert np.abs(sums / sums.sum() - want / want.sum()).max() < 0.01
    wanted, rows = sum(max(1, r.rate) * r.tokens for r in table), sum(got[r.doc_id] * r.tokens for r in table)
    assert abs(rows - wanted) < 0.1 * wanted


def test_bpe_ids_same_as_library(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = {d: tok.encode(t, add_special_tokens=False).ids for d, t in texts(docs).items()}
    got = {r.doc_id: r for r in STAGES["bpe"](spark, docs, SF).collect()}
    assert {d: np.frombuffer(bytes(r.ids), "<u4").tolist() for d, r in got.items()} == want
    assert all(r.n_tokens == len(want[d]) for d, r in got.items())
