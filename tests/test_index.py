import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexmill.operators import index, people, records, stats
from lexmill.operators.metrics import unified
from lexmill.sources.corpus import Corpus

PASSAGES = [(1, 1, 1, "Alpha beta gamma beta"), (2, 1, 2, "delta alpha"), (3, 2, 1, "Café naïve foo_bar-baz alpha"), (4, 3, 1, "beta beta beta"), (5, 3, 2, ""), (6, 4, 1, "alphabet soup, the alpha of it")]
PAPERS = [(1, "On trilobites"), (2, "Alpha"), (3, ""), (4, None)]
AUTHORS = [(1, 1, 0, "Lee, Ann"), (2, 1, 1, "Li, Bo"), (3, 2, 0, "Beta, Carl")]


def corpus(spark, passages=PASSAGES, papers=PAPERS, authors=AUTHORS):
    return Corpus(spark, {"passage": spark.createDataFrame(passages, "id long, paper_id long, page int, text string"), "paper": spark.createDataFrame(papers, "id long, title string"), "author": spark.createDataFrame(authors, "id long, paper_id long, ord long, name string")})


def rows(idx, query):
    return sorted((r.id, round(r.score, 7)) for r in index.ranked_passages(idx, query).collect())


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(title, authors, text, id unindexed, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    for i, p, _, text in PASSAGES:
        con.execute("insert into f values (?, ?, ?, ?)", [dict(PAPERS)[p] or "", ", ".join(n for _, q, _, n in AUTHORS if q == p), text, i])
    return con


@pytest.mark.parametrize("query", ["alpha", "alpha beta", "beta OR delta", "alpha NOT beta", '"beta gamma"', "alph*", "^alpha", "title:alpha", "{title authors}: beta", "NEAR(alpha gamma, 1)", "NEAR(alpha gamma, 0)", "alpha + beta", "foo-bar", "cafe NAIVE", "(alpha OR soup) AND beta", "nothing", "alpha AND", "lee"])
def test_same_as_a_full_text_engine(spark, tmp_path_factory, fts, query):
    idx = _built(spark, tmp_path_factory)
    try:
        want = fts.execute("select id, bm25(f, 10.0, 5.0, 1.0) from f where f match ?", [query]).fetchall()
    except sqlite3.OperationalError:
        want = fts.execute("select id, bm25(f, 10.0, 5.0, 1.0) from f where f match ?", [f'"{query}"']).fetchall()
    assert rows(idx, query) == sorted((i, pytest.approx(s, abs=1e-6)) for i, s in want)


_INDEX = {}


def _built(spark, tmp_path_factory):
    if "x" not in _INDEX:
        _INDEX["x"] = index.build_index(corpus(spark), str(tmp_path_factory.mktemp("index") / "a"))
    return _INDEX["x"]


def test_replacing_papers_equals_building_anew(spark, tmp_path):
    old = index.build_index(corpus(spark), str(tmp_path / "old"))
    # paper 1 has a new text, paper 4 is merged into 2 and gone, paper 2 has a new title
    passages = [(1, 1, 1, "omega"), (3, 2, 1, "Café naïve foo_bar-baz alpha"), (4, 3, 1, "beta beta beta"), (5, 3, 2, ""), (6, 2, 1, "alphabet soup, the alpha of it")]
    papers = [(1, "On trilobites"), (2, "Omega"), (3, "")]
    now = corpus(spark, passages, papers)
    changed = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    got = index.replace_papers(old, now, changed, str(tmp_path / "new"))
    want = index.build_index(now, str(tmp_path / "want"))
    for table in ("postings", "passages", "stats"):
        assert sorted(map(str, getattr(got, table).select(*getattr(want, table).columns).collect())) == sorted(map(str, getattr(want, table).collect()))
    again = index.replace_papers(got, now, changed, str(tmp_path / "again"))
    assert rows(again, "omega OR alpha") == rows(want, "omega OR alpha") and len(rows(want, "omega")) == 3


def test_a_query_reads_the_ranges_of_its_terms(spark, tmp_path):
    idx = index.build_index(corpus(spark), str(tmp_path / "i"))
    plan = index.ranked_passages(idx, "beta")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(term,beta)" in plan


def test_empty_corpus(spark, tmp_path):
    idx = index.build_index(corpus(spark, [], [], []), str(tmp_path / "e"))
    assert idx.n == 0 and rows(idx, "alpha") == [] and index.search(idx, "alpha").count() == 0


def test_index_specs():
    assert stats.parse_indices("1,3,5-8", 6) == [0, 2, 4, 5]
    assert stats.parse_indices("8-5, 2 ,", 9) == [1, 4, 5, 6, 7]
    assert stats.parse_indices("0,99", 9) is None and stats.parse_indices("x", 9) is None and stats.parse_indices("", 9) is None


def test_names_one_by_one(spark):
    cases = {"堀部純男": ("純男", "堀部"), "김진섭": ("진섭", "김"), "Smith, John": ("John", "Smith"), "John Q Smith": ("John Q", "Smith"), "Smith,": ("", "Smith"), "Plato": ("", "Plato"), "": ("", ""), " 　 ": ("", ""), "최덕": ("", "최덕"), "a,b,c": ("b,c", "a")}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "n string")
    got = {r.n: (r.s.first, r.s.last) for r in df.select("n", people.split_name(F.col("n")).alias("s")).collect()}
    assert got == cases | {None: ("", "")}


def test_citations(spark):
    lists = [([], ""), (["Lee, Ann"], "Lee"), (["Ann Lee", "Li, Bo"], "Lee and Li"), (["A B", "C D", "E F"], "B et al."), (["정직한", "최덕근"], "정직한과 최덕근"), (["정직한", "Ann Lee", "x"], "정직한 외"), (None, "")]
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(lists)], "i int, n array<string>")
    assert {r.i: r.c for r in df.select("i", people.citation(F.col("n")).alias("c")).collect()} == {i: c for i, (_, c) in enumerate(lists)}


def test_authors_json_and_output_odds(spark):
    cases = {'["a", {"name": "b"}, {"full_name": " c "}, 3, "", null]': ["a", "b", "c"], "[1, 2]": [], "{}": [], "nonsense": [], "": []}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "j string")
    assert {r.j: list(r.a) for r in df.select("j", records.authors_of(F.col("j")).alias("a")).collect()} == cases | {None: []}
    outs = {'x {"a": 1} y': '{"a": 1}', "<think>{no}</think>{\"b\": 2}": '{"b": 2}', "none": None, "{broken": None, '```json\n{"c": 3}\n``` {"d": 4}': '{"c": 3}', None: None}
    df = spark.createDataFrame([(k,) for k in outs], "o string")
    assert {r.o: r.j for r in df.select("o", records.recovered_json(F.col("o")).alias("j")).collect()} == outs


def test_compatibility_forms_are_unified(spark):
    df = spark.createDataFrame([("ﬁne Ⅳ ½",), ("plain",), (None,), ("Ａ",)], "t string")
    assert [r.u for r in df.select(unified(F.col("t")).alias("u")).collect()] == ["fine IV 1⁄2", "plain", None, "A"]


def test_random_queries_same_as_scanning(spark, tmp_path):
    """Boolean trees of random words, against a plain reading of the texts."""
    rng = random.Random(4)
    words = ["ab", "abc", "b", "cd", "e"]
    passages = [(i, i % 7, 1, " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    idx = index.build_index(corpus(spark, passages, [(i, "") for i in range(7)], []), str(tmp_path / "r"))

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            w = rng.choice(words)
            return w, (lambda t, w=w: w in t)
        (a, f), (b, g) = tree(depth - 1), tree(depth - 1)
        op = rng.choice(["AND", "OR", "NOT"])
        return f"({a}) {op} ({b})", {"AND": lambda t: f(t) and g(t), "OR": lambda t: f(t) or g(t), "NOT": lambda t: f(t) and not g(t)}[op]

    for _ in range(12):
        query, holds = tree(3)
        assert [i for i, _ in rows(idx, query)] == [i for i, _, _, t in passages if holds(t.split())], query


def test_snippets(spark):
    from lexmill.functions.dialect import SPARK
    from lexmill.operators.search import snippet

    text = " ".join(f"w{i}" for i in range(40)) + " alpha x beta " + " ".join(f"v{i}" for i in range(40)) + " alpha"
    c = corpus(spark, [(1, 1, 1, "Alpha, then beta"), (2, 1, 2, text), (3, 2, 1, "nothing here"), (4, 3, 1, "beta")])
    got = {r.passage_id: r.snippet for r in c.sql(snippet(SPARK, "alpha OR beta")).collect()}
    assert got[1] == "**alpha** then **beta**" and got[3] == "nothing here" and got[4] == "**beta**"
    assert got[2].startswith("...w11 w12") and got[2].endswith("**alpha** x **beta**...") and len(got[2].replace("...", "").split()) == 32
