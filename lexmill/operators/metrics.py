"""Extraction metrics: similarities, field scores, sampling."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.dialect import Spark
from .names import author_scores
from .resolve import CJK

#: Weights of the fields in the overall score.
WEIGHTS = {"title": 0.35, "authors": 0.30, "year": 0.15, "journal": 0.10, "doi": 0.10}
#: Shares of the strata of a sample; the rest has a journal.
STRATA = {"cjk": 0.10, "old": 0.10, "no_journal": 0.15}


def normal(d: Spark, x: str) -> str:
    """Lower case, all dashes alike, other marks as spaces, single spaces. Compatibility forms are unified before, by :func:`unified`."""
    kept = d.replace(d.replace(f"lower(coalesce({x}, ''))", "[\u2010-\u2015]", "-"), "[^\\pL\\pN_\\s\\pZ-]", " ")
    return d.strip(d.replace(kept, "[\\s\\pZ]+", " "))


def unified(c: Column) -> Column:
    """NFKC, which Spark has no function for: an Arrow function, for texts that have anything beyond ASCII."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(_nfkc(c))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def similarity(d: Spark, a: str, b: str) -> str:
    return f"case when {a} = '' and {b} = '' then 1e0 when {a} = '' or {b} = '' then 0e0 else 1e0 - cast({d.distance(a, b)} as double) / greatest(length({a}), length({b})) end"


def field_scores(d: Spark) -> str:
    """Records against their papers, field by field."""
    ta, tb = d.split("ja", " "), d.split("jb", " ")
    contained = f"cast({d.size(d.common(d.distinct(ta), d.distinct(tb)))} as double) / least({d.size(d.distinct(ta))}, {d.size(d.distinct(tb))})"
    return f"""with x as (select b.id, {normal(d, 'b.title')} as a, {normal(d, 'p.title')} as b, {normal(d, 'b.journal')} as ja, {normal(d, 'p.journal')} as jb,
          b.year as ya, p.year as yb, lower({d.plain('b.doi')}) as da, lower({d.plain('p.doi')}) as db from {{paperbiblio}} b join {{paper}} p on p.id = b.paper_id)
      select id, {similarity(d, 'a', 'b')} as title, case when ya is not null and ya = yb then 1e0 else 0e0 end as year,
        case when ja = '' and jb = '' then 1e0 when ja = '' or jb = '' then 0e0 else greatest({similarity(d, 'ja', 'jb')}, 0.5 + 0.5 * {contained}) end as journal,
        case when da = db then 1e0 else 0e0 end as doi from x"""


def overall_score(d: Spark) -> str:
    """Records' field scores, authors included, and their weighted sum."""
    total = " + ".join(f"{w}e0 * {k}" for k, w in WEIGHTS.items())
    return f"""select id, round(title, 9) as title, authors, year, round(journal, 9) as journal, doi, round({total}, 9) as overall
      from (select f.*, a.score as authors from ({field_scores(d)}) f join ({author_scores(d)}) a on a.id = f.id) x"""


def stratified(d: Spark, n: int = 60, seed: int = 42) -> str:
    """A stratified sample in hash order, short strata filled up from what is left."""
    want = {k: int(v * n) for k, v in STRATA.items()}
    want["with_journal"] = n - sum(want.values())
    quota = "case stratum " + " ".join(f"when '{k}' then {v}" for k, v in want.items()) + " end"
    return f"""with c as (select id, case when {d.like('title', f'[{CJK}]')} then 'cjk' when year < 1960 then 'old' when journal = '' then 'no_journal' else 'with_journal' end as stratum,
          md5(concat('{seed}:', id)) as h from {{paper}} where title <> '' and year is not null),
        r as (select *, row_number() over (partition by stratum order by h, id) as rn from c),
        f as (select *, rn <= {quota} as picked from r),
        l as (select id, stratum, h from f where not picked order by h, id limit {n}),
        m as (select id, stratum, row_number() over (order by h, id) as rn from l)
      select id, stratum from f where picked union all select m.id, m.stratum from m join (select count(*) as got from f where picked) g on m.rn <= {n} - g.got"""


TEMPLATES = {
    "levenshtein_pairs": lambda d: f"""select id, paper_id, {d.distance('a', 'b')} as distance, round({similarity(d, 'a', 'b')}, 9) as similarity from (
        select r.id, r.paper_id, {normal(d, 'r.title')} as a, {normal(d, 'p.title')} as b from {{paperbiblio}} r join {{paper}} p on p.id = r.paper_id) x""",
    "field_scores": lambda d: f"select id, round(title, 9) as title, year, round(journal, 9) as journal, doi from ({field_scores(d)}) x",
    "overall_score": overall_score,
    "score_means": lambda d: f"select count(*) as n, " + ", ".join(f"round(avg({k}), 6) as {k}" for k in (*WEIGHTS, "overall")) + f", round(avg(case when title >= 0.8 then 1e0 else 0e0 end), 6) as title_hits from ({overall_score(d)}) x",
    "stratified_sample": stratified,
    "eval_candidates": lambda d: "select distinct p.id from {paper} p join {paperfile} f on f.paper_id = p.id join {folder} o on o.id = p.folder_id join {source} s on s.id = o.source_id join {author} a on a.paper_id = p.id where s.source_type = 'zotero' and f.status = 'processed' and f.hash <> '' and p.title <> '' and p.year is not null",
    "normalize_text": lambda d: f"select id, {normal(d, 'title')} as title from {{paper}}",
}
