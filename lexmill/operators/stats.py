"""Snapshot counts of a corpus: one aggregate for each table, however many metrics, and the lists that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import Corpus, sample_corpus
from .catalog import AS_OF

STATUSES = ("pending", "processed", "failed")
RECORD_STATUSES = ("extracted", "needs_review", "auto_committed", "applied", "rejected")


def count_if(name: str, condition: Column) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


def long(*parts: DataFrame) -> DataFrame:
    """One-row tables as ``metric`` and ``value``."""
    out = None
    for part in parts:
        pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value")) for c in part.columns))
        rows = part.select(F.explode(pairs).alias("p")).select("p.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _is_json() -> Column:
    return F.lower("path").endswith(".json")


def _papers_of_files(paperfile: DataFrame) -> DataFrame:
    """A row for each paper that has a file: PDFs, and whether any file, or any PDF, has each status."""
    flags = [F.max((F.col("status") == s).cast("int")).alias(s) for s in STATUSES]
    return paperfile.groupBy("paper_id").agg(count_if("pdfs", ~_is_json()), F.max((~_is_json() & (F.col("status") == "processed")).cast("int")).alias("pdf_done"), *flags)


def _papers_of_records(paperbiblio: DataFrame) -> DataFrame:
    return paperbiblio.groupBy("paper_id").agg(*(F.max((F.col("status") == s).cast("int")).alias(s) for s in RECORD_STATUSES))


def library_counts(c: Corpus) -> DataFrame:
    """The six folders of the library: papers, and papers by the state of their files and records."""
    files = _papers_of_files(c.paperfile).agg(*(F.sum(s).alias(s) for s in STATUSES))
    records = _papers_of_records(c.paperbiblio).agg(F.sum("needs_review").alias("needs_review"))
    papers = c.paper.agg(F.count("*").alias("all"), count_if("recent", F.col("created_at") >= F.expr(f"{AS_OF} - interval 30 day")))
    return long(papers, files, records)


def db_stats(c: Corpus) -> DataFrame:
    """All metrics of a corpus, as ``metric`` and ``value``."""
    writers = c.author.select(F.col("paper_id").alias("writer_of")).distinct()
    held = _papers_of_files(c.paperfile)
    papers = c.paper.join(writers, F.col("id") == F.col("writer_of"), "left").join(held.select(F.col("paper_id").alias("file_of")), F.col("id") == F.col("file_of"), "left").agg(
        F.count("*").alias("papers"), count_if("papers_of_library", F.col("zotero_key") != ""), count_if("papers_local", F.col("zotero_key") == ""),
        count_if("stubs", ((F.trim("title") == "") | F.col("year").isNull()) & F.col("writer_of").isNull()), count_if("papers_without_file", F.col("file_of").isNull()), count_if("papers_with_file", F.col("file_of").isNotNull()),
    )
    pdf = ~_is_json()
    files = c.paperfile.agg(
        F.count("*").alias("files"), count_if("pdfs", pdf), count_if("json_files", ~pdf), *(count_if(f"pdf_{s}", pdf & (F.col("status") == s)) for s in STATUSES),
        count_if("pdf_with_hash", pdf & (F.col("hash") != "")), count_if("pdf_with_key", pdf & (F.col("zotero_key") != "")),
    )
    own = c.paper.where("zotero_key <> ''").select(F.col("id").alias("of"), F.col("zotero_key").alias("own_key"))
    alone = c.paperfile.where(pdf).join(own, (F.col("paper_id") == F.col("of")) & (F.col("zotero_key") == F.col("own_key")))
    alone = alone.agg(F.count("*").alias("standalone"), *(count_if(f"standalone_{s}", F.col("status") == s) for s in STATUSES))
    many = held.agg(count_if("multi_pdf_papers", F.col("pdfs") >= 2), F.max(F.when(F.col("pdfs") >= 2, F.col("pdfs"))).alias("most_pdfs"), F.sum(F.when(F.col("pdfs") >= 2, F.col("pdfs") - 1)).alias("extra_pdfs"), F.sum("pdf_done").alias("papers_processed"))
    records = c.paperbiblio.agg(F.count("*").alias("records"), *(count_if(f"records_{s}", F.col("status") == s) for s in RECORD_STATUSES))
    resolved = _papers_of_records(c.paperbiblio).agg(F.count("*").alias("papers_with_records"), F.sum("applied").alias("papers_applied"), F.sum("auto_committed").alias("papers_auto_committed"), (F.sum("applied") + F.sum("auto_committed")).alias("papers_applied_or_committed"))
    passages = c.passage.groupBy("paper_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("passages"), F.sum("n").alias("index_rows"), F.count("*").alias("papers_with_passages"))
    places = c.folder.agg(F.count("*").alias("folders"), count_if("folders_with_key", F.col("zotero_key") != ""))
    return long(c.source.agg(F.count("*").alias("sources")), places, papers, files, alone, many, records, resolved, passages)


def in_scope(c: Corpus, paper_ids: list[int] | None = None, folder_id: int | None = None, source_id: int | None = None) -> DataFrame:
    """Papers that have records: of the given ids, or else the folder, or else the source, or else all; an empty list counts as none given."""
    papers = c.paper
    if paper_ids:
        papers = papers.where(F.col("id").isin(list(paper_ids)))
    elif folder_id is not None:
        papers = papers.where(F.col("folder_id") == folder_id)
    elif source_id is not None:
        papers = papers.join(c.folder.where(F.col("source_id") == source_id).select(F.col("id").alias("folder_id")), "folder_id", "left_semi")
    return papers.join(c.paperbiblio.select(F.col("paper_id").alias("id")), "id", "left_semi").select("id")


def parse_indices(text: str, most: int) -> list[int] | None:
    """Places (from 0) that '1,3,5-8' picks of ``most``: ranges either way round, those out of range dropped; None if there is none, or a part isn't a number."""
    picked: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        try:
            ends = sorted(int(x) for x in part.split("-", 1))
        except ValueError:
            return None
        picked.update(range(max(1, ends[0]) - 1, min(most, ends[-1])))
    return sorted(picked) or None


def newest(c: Corpus) -> DataFrame:
    """Papers with the status of their first file that is no JSON, newest first (``place``)."""
    from pyspark.sql import Window

    first = c.paperfile.where(~_is_json()).groupBy(F.col("paper_id").alias("of")).agg(F.min_by("status", "id").alias("status"))
    rows = c.paper.join(first, F.col("id") == F.col("of"), "left")
    return rows.select("id", "title", "year", F.coalesce("status", F.lit("no PDF")).alias("status"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("created_at"), "id")).alias("place"))


def _q(make):
    return lambda spark, sf_dir: make(sample_corpus(spark, sf_dir))


QUERIES = {
    "library_counts": _q(library_counts),
    "db_stats": _q(db_stats),
    "scope_of_ids": _q(lambda c: in_scope(c, [3, 4, 5, 6, 7, 8], 205, 2)),
    "scope_of_folder": _q(lambda c: in_scope(c, [], 205, 2)),
    "scope_of_source": _q(lambda c: in_scope(c, None, None, 2)),
    "scope_of_all": _q(lambda c: in_scope(c)),
    "papers_newest": _q(newest),
    "papers_with_files_newest": _q(lambda c: c.paper.join(c.paperfile.select(F.col("paper_id").alias("of"), F.col("id").alias("file_id")), F.col("id") == F.col("of")).select("id", "file_id", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("at"))),
}

_PDF = "not path ilike '%.json'"
_COUNTS = {
    "all": "{paper}", "pending": "(select distinct paper_id from {paperfile} where status = 'pending') x", "processed": "(select distinct paper_id from {paperfile} where status = 'processed') x",
    "failed": "(select distinct paper_id from {paperfile} where status = 'failed') x", "needs_review": "(select distinct paper_id from {paperbiblio} where status = 'needs_review') x", "recent": f"{{paper}} where created_at >= {AS_OF} - interval 30 day",
}
_ALONE = "{paperfile} f join {paper} p on p.id = f.paper_id and p.zotero_key = f.zotero_key where p.zotero_key <> '' and not f.path ilike '%.json'"
_MANY = f"(select paper_id, count(*) as n from {{paperfile}} where {_PDF} group by 1 having count(*) >= 2) x"
_STATS = {
    "sources": "{source}", "folders": "{folder}", "folders_with_key": "{folder} where zotero_key <> ''", "papers": "{paper}", "papers_of_library": "{paper} where zotero_key <> ''", "papers_local": "{paper} where zotero_key = ''",
    "stubs": "{paper} where (trim(title) = '' or year is null) and id not in (select paper_id from {author})", "papers_without_file": "{paper} where id not in (select paper_id from {paperfile})", "papers_with_file": "{paper} where id in (select paper_id from {paperfile})",
    "files": "{paperfile}", "pdfs": f"{{paperfile}} where {_PDF}", "json_files": "{paperfile} where path ilike '%.json'", **{f"pdf_{s}": f"{{paperfile}} where {_PDF} and status = '{s}'" for s in STATUSES},
    "pdf_with_hash": f"{{paperfile}} where {_PDF} and hash <> ''", "pdf_with_key": f"{{paperfile}} where {_PDF} and zotero_key <> ''", "standalone": _ALONE, **{f"standalone_{s}": f"{_ALONE} and f.status = '{s}'" for s in STATUSES},
    "multi_pdf_papers": _MANY, "papers_processed": f"(select distinct paper_id from {{paperfile}} where {_PDF} and status = 'processed') x", "records": "{paperbiblio}", **{f"records_{s}": f"{{paperbiblio}} where status = '{s}'" for s in RECORD_STATUSES},
    "papers_with_records": "(select distinct paper_id from {paperbiblio}) x", "papers_applied": "(select distinct paper_id from {paperbiblio} where status = 'applied') x", "papers_auto_committed": "(select distinct paper_id from {paperbiblio} where status = 'auto_committed') x",
    "papers_applied_or_committed": "(select distinct paper_id, status from {paperbiblio} where status in ('applied', 'auto_committed')) x", "passages": "{passage}", "index_rows": "{passage}", "papers_with_passages": "(select distinct paper_id from {passage}) x",
}


def _union(counts: dict[str, str]) -> str:
    return " union all ".join(f"select '{k}' as metric, count(*) as value from {v}" for k, v in counts.items())


_SCOPED = "and id in (select paper_id from {paperbiblio})"
ORACLES = {
    "library_counts": _union(_COUNTS),
    "db_stats": _union(_STATS) + f" union all select 'most_pdfs', coalesce(max(n), 0) from {_MANY} union all select 'extra_pdfs', cast(coalesce(sum(n) - count(*), 0) as bigint) from {_MANY}",
    "scope_of_ids": f"select id from {{paper}} where id in (3, 4, 5, 6, 7, 8) {_SCOPED}",
    "scope_of_folder": f"select id from {{paper}} where folder_id = 205 {_SCOPED}",
    "scope_of_source": f"select id from {{paper}} where folder_id in (select id from {{folder}} where source_id = 2) {_SCOPED}",
    "scope_of_all": f"select id from {{paper}} where true {_SCOPED}",
    "papers_newest": f"select id, title, year, coalesce((select arg_min(status, f.id) from {{paperfile}} f where f.paper_id = p.id and {_PDF}), 'no PDF') as status, cast(row_number() over (order by created_at desc, id) as int) as place from {{paper}} p",
    "papers_with_files_newest": "select p.id, f.id as file_id, cast(floor(epoch(p.created_at)) as bigint) as at from {paper} p join {paperfile} f on f.paper_id = p.id",
}
