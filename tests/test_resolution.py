"""Record resolution against a plain-Python reading of the rules, on made-up rows with nulls and ties, and on the sample."""

import random

import pytest

from lexmill.functions.dialect import SPARK
from lexmill.operators import resolve
from lexmill.sources.corpus import Corpus, sample_corpus

PAPER = "id long, title string, year int, journal string, doi string"
AUTHOR = "id long, paper_id long, ord long, name string"
RECORD = "id long, paper_id long, title string, year int, journal string, doi string, doc_type string, confidence string, needs_visual_review boolean, source string, status string, extracted_at long, authors string, file_hash string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    titles, journals, dois = [None, "", " ", "A", " A ", "B"], [None, "", "J", "K"], [None, "", "10.1/x"]
    papers = [(i, rng.choice(titles), rng.choice([None, 1999, 2001]), rng.choice(journals), rng.choice(dois)) for i in range(300)]
    people = ["Lee, Ann", "Ann Lee", "Bo Li", "Li, Bo", "ann  lee", "Wu", "堀部純男", "Smith, J, Jr"]
    authors = [(i * 10 + k, i, k // 2, rng.choice(people)) for i in range(300) for k in range(rng.choice([0, 0, 1, 2]))]
    records = []
    for n in range(900):
        names = "; ".join(rng.choice([*people, "", " "]) for _ in range(rng.choice([0, 1, 1, 2, 3])))
        records.append((n, rng.randrange(300), rng.choice([*titles, "A", "A"]), rng.choice([None, 1999, 1999, 2001]), rng.choice(journals), rng.choice(dois), rng.choice(["article", "article", "book", "journal_issue", "unknown", "", None]), rng.choice(["high", "high", "high", "medium", "", None]),
                        rng.choice([False, False, False, True, None]), rng.choice(["haiku", "sonnet", "sonnet-vision", "other", None]), rng.choice(["extracted", "extracted", "needs_review", "applied", "auto_committed", "rejected", None]), rng.choice([None, 1, 2, 3]), rng.choice([names, names, None]), "h"))
    return Corpus(spark, {"paper": spark.createDataFrame(papers, PAPER), "author": spark.createDataFrame(authors, AUTHOR), "paperbiblio": spark.createDataFrame(records, RECORD)})


def strip(x):
    return (x or "").strip()


def names_of(x):
    return [n.strip() for n in (x or "").split("; ") if n.strip()]


def key(name):
    if "," in name:
        last, _, first = name.partition(",")
        name = f"{last.strip()} {first.strip()}"
    else:
        parts = name.split()
        name = " ".join([parts[-1], *parts[:-1]])
    return " ".join(name.lower().split())


def shown(name):
    if "," in name:
        last, _, first = name.partition(",")
        return f"{last.strip()}, {first.strip()}" if first.strip() else last.strip()
    parts = name.split()
    if len(parts) > 1:
        return f"{parts[-1]}, {' '.join(parts[:-1])}"
    return {4: f"{name[:2]}, {name[2:]}", 3: f"{name[:1]}, {name[1:]}"}.get(len(name), name) if all(ord(c) > 0x3000 for c in name) else name


def rule(b, p, names):
    mine = names_of(b.authors)
    for status, reason in (("auto_committed", "already_committed"), ("applied", "already_applied"), ("rejected", "rejected")):
        if b.status == status:
            return reason
    checks = [
        (b.doc_type == "journal_issue", "journal_issue"), (not strip(b.title), "missing_title"), (not mine, "missing_authors"), (b.year is None and b.doc_type not in ("book", "chapter", "report"), "missing_year"),
        ((b.doc_type or "") in ("unknown", ""), "unknown_doctype"), (bool(b.needs_visual_review), "visual_review_flag"), ((b.confidence or "") != "high", "low_confidence"), (p.year is None and not names, ""),
        (0 < len(names) < len(mine), "curated_author_shortfall"),
        (any(not strip(x) and strip(y) for x, y in ((p.title, b.title), (p.journal, b.journal), (p.doi, b.doi))) or (p.year is None and b.year is not None) or not names, ""),
        (all(not strip(y) or strip(x) == strip(y) for x, y in ((p.title, b.title), (p.journal, b.journal), (p.doi, b.doi))) and b.year in (None, p.year) and [key(n) for n in mine] == [key(n) for n in names], "already_complete"),
    ]
    return next((reason for met, reason in checks if met), "override_conflict")


def action(reason):
    return "skip" if reason in ("already_committed", "already_applied", "rejected", "journal_issue", "already_complete") else "auto_commit" if reason == "" else "needs_review"


def tables(c):
    papers = {r.id: r for r in c.paper.select("id", "title", "year", "journal", "doi").collect()}
    names = {i: [] for i in papers}
    for r in sorted(c.author.collect(), key=lambda r: (r.ord, r.id)):
        names[r.paper_id].append(r.name)
    records = {r.id: r for r in c.paperbiblio.collect()}
    best = {}
    for r in sorted(records.values(), key=lambda r: r.id):
        if (r.status or "extracted") != "rejected":
            rank = (r.status == "applied", resolve.SOURCE_RANK.get(r.source, 0), resolve.CONFIDENCE_RANK.get(r.confidence, 0), r.extracted_at or 0)
            if r.paper_id not in best or rank > best[r.paper_id][0]:
                best[r.paper_id] = (rank, r)
    return papers, names, records, {i: r for i, (_, r) in best.items()}


@pytest.fixture(scope="module", params=["made", "sample"])
def both(request, spark):
    c = request.getfixturevalue("corpus") if request.param == "made" else sample_corpus(spark, "/root/testdata/sf0.001")
    return c, *tables(c)


def run(c, name):
    return c.sql(resolve.TEMPLATES[name](SPARK)).collect()


def test_best_record_and_decisions(both):
    c, papers, names, records, best = both
    assert {r.paper_id: r.id for r in run(c, "best_record")} == {i: r.id for i, r in best.items()}
    want = {i: rule(r, papers[i], names[i]) for i, r in best.items()}
    assert {r.paper_id: (r.action, r.reason) for r in run(c, "decisions")} == {i: (action(x), x) for i, x in want.items()}
    assert {r.record_id: r.reason for r in run(c, "decide_any_record")} == {i: rule(r, papers[r.paper_id], names[r.paper_id]) for i, r in records.items()}


def test_field_diffs(both):
    c, papers, names, _, best = both

    def kind(mine, theirs):
        return "match" if mine == theirs or not theirs else "conflict" if mine else "fill"

    want = {}
    for i, r in best.items():
        p = papers[i]
        pairs = {"title": (strip(p.title), strip(r.title)), "journal": (strip(p.journal), strip(r.journal)), "doi": (strip(p.doi), strip(r.doi)), "year": (str(p.year or ""), str(r.year or "")), "authors": ("\n".join(map(shown, names[i])), "\n".join(map(shown, names_of(r.authors))))}
        want |= {(i, f): kind(*pair) for f, pair in pairs.items()}
    assert {(r.paper_id, r.field): r.kind for r in run(c, "field_diffs")} == want


def test_applied_papers(both):
    c, papers, names, _, best = both
    got = {r.id: r for r in run(c, "local_apply_papers")}
    people = {}
    for r in run(c, "local_apply_authors"):
        people.setdefault(r.paper_id, []).append(r.name)
    changed = set()
    for i, p in papers.items():
        r = best.get(i)
        take = r is not None and action(rule(r, p, names[i])) == "auto_commit"
        stub = p.year is None and not names[i]
        want = {f: strip(getattr(r, f)) if take and strip(getattr(r, f)) and (stub or not strip(getattr(p, f))) else getattr(p, f) for f in ("title", "journal", "doi")}
        want["year"] = r.year if take and r.year is not None and (stub or p.year is None) else p.year
        assert {f: getattr(got[i], f) for f in want} == want
        assert people.get(i, []) == (names_of(r.authors) if take and names_of(r.authors) and not names[i] else names[i])
        if take and (any((want[f] or "") != (getattr(p, f) or "") for f in ("title", "journal", "doi")) or want["year"] != p.year or (stub and names_of(r.authors))):
            changed.add(i)
    assert {r.id for r in run(c, "would_change")} == changed


def test_record_states(both):
    c, papers, names, records, best = both
    chosen = {r.id: rule(r, papers[i], names[i]) for i, r in best.items()}
    for r in run(c, "local_apply_records"):
        did = action(chosen[r.id]) if r.id in chosen else "skip"
        assert r.status == {"auto_commit": "auto_committed", "needs_review": "needs_review", "skip": records[r.id].status}[did]
        assert r.review_reason == (chosen[r.id] if did == "needs_review" else "")
    assert sum(r.n for r in run(c, "decision_stats")) == len(best)
