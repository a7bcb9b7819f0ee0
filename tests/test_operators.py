import math
import random

import duckdb
import pytest

from lexmill.functions.dialect import SPARK
from lexmill.operators.names import author_scores
from lexmill.operators.query_language import Bool, Near, Phrase, parse, scored, tokens
from lexmill.plans import registry
from lexmill.sources.corpus import BASE, Corpus

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "search_bm25_and", "search_phrase", "search_near", "search_fallback_phrase", "search_blank", "search_or_not", "search_prefix", "index_postings", "split_passages", "first_pages", "best_record", "decisions", "field_diffs", "field_scores",
    "author_scores", "property_year", "stratified_sample", "library_counts", "db_stats", "folder_tree", "page_slice", "paper_detail", "upsert_items", "items_built", "attachment_insert", "merge_stale", "additive_patch", "override_patch", "merged_apply",
    "update_payloads", "split_names", "citation_by_script", "creators_of_names", "model_records", "authors_json", "notes_folded", "ocr_valid", "ocr_resume_plan", "ocr_job_pages", "baseline_extract", "queue_depth", "poll_outcomes", "stream_latest_per_key",
]


def plain(v):
    return "~" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_duckdb(spark, duck, name):
    got = [r.asDict() for r in registry.queries()[name](spark, SF).collect()]
    cur = duck.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = [dict(zip(cols, r, strict=True)) for r in cur.fetchall()]
    assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in got) == sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in want)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_query_language():
    assert tokens("Café NAÏVE foo_bar-baz") == ["cafe", "naive", "foo", "bar", "baz"]
    assert parse("a b") == Bool("and", Phrase(("a",)), Phrase(("b",)))
    assert parse("a OR b AND c").op == "or"
    assert parse("foo-bar") == Phrase(("foo", "bar"))
    assert parse("alpha AND") == Phrase(("alpha", "and"))
    assert parse("alpha (b OR c)") == Phrase(("alpha", "b", "or", "c"))
    assert parse("  ") is None
    assert parse('odd " quote x"y"z') is None or scored(parse('odd " quote x"y"z'))
    assert parse("title: x").columns == ("title",)
    assert isinstance(parse("NEAR(a b, 3)"), Near)
    assert scored(parse("a NOT b")) == [Phrase(("a",))]


def test_random_queries_always_parse():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(['a ', 'b', '"', '(', ')', ' AND ', ' OR ', '*', '^', ':', '{', '}', '+', '-', ',']) for _ in range(rng.randint(1, 9)))
        node = parse(text)
        assert node is None or isinstance(scored(node), list)


def test_author_scores_brute_force(spark):
    def form(x):
        last, _, rest = (" ".join(x.split())).partition(",")
        x = f"{rest.strip()} {last.strip()}" if rest.strip() else " ".join(x.split())
        return " ".join("".join(c for c in x.lower() if c.isalnum() or c in "_ -").split())

    def same(a, b):
        return a != "" and (a == b or any(len(t) > 2 and t in b.split() for t in a.split()))

    def score(p, r):
        if not p or not r:
            return float(not p and not r)
        firsts = [next((i for i, y in enumerate(r) if same(x, y)), None) for x in p]
        firsts = [i for i in firsts if i is not None]
        rising = []
        for k, i in enumerate(firsts):
            rising.append(1 + max((rising[j] for j in range(k) if firsts[j] < i), default=0))
        return (0.5 * len(firsts) + 0.3 * max(rising, default=0)) / len(p) + 0.2 * (1 - abs(len(p) - len(r)) / max(len(p), len(r)))

    rng = random.Random(3)
    people = ["Ann Lee", "Lee, Ann", "Bo Li", "Müller, Jörg", "Jörg  Müller", "A. B. Cohen", "Cohen", "Wu", "***", "Eve O'Neil", "Smith-Jones, Al", "Al,"]
    lists = [([rng.choice(people) for _ in range(rng.randrange(6))], [rng.choice(people) for _ in range(rng.randrange(6))]) for _ in range(200)]
    authors = spark.createDataFrame([(k, i, x) for k, (p, _) in enumerate(lists) for i, x in enumerate(p)], "paper_id long, ord int, name string")
    records = spark.createDataFrame([(k, k, "; ".join(r)) for k, (_, r) in enumerate(lists)], "id long, paper_id long, authors string")
    got = {r["id"]: r["score"] for r in Corpus(spark, {"author": authors, "paperbiblio": records}).sql(author_scores(SPARK)).collect()}
    assert got == {k: pytest.approx(score([form(x) for x in p], [form(x) for x in r]), abs=1e-8) for k, (p, r) in enumerate(lists)}
