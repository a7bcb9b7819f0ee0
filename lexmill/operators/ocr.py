"""OCR results: whether one is whole, which pages to try again, what a finished job gives, and a text's first regular finds.

A result is ``hash``, ``total_pages``, ``done_pages``, ``failed_pages``, ``failed_page_numbers`` (from 1), ``pages`` (structs
with ``page`` from 0, ``markdown``, ``text``) and perhaps ``meta``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .people import strip

RESULT = "total_pages int, done_pages int, failed_pages int, failed_page_numbers array<int>, pages array<struct<page:int,markdown:string,text:string>>, meta struct<schema_version:int,biblio_state:string,biblio_source:string,biblio_applied_at:string>"
META_VERSION = 1
DOI = r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+"
_EDGE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """``hash`` and the result in each ``<hash>.json`` of a folder, with the meta that was stamped on it; malformed files are left out."""
    rows = spark.read.schema(RESULT + ", broken string").option("columnNameOfCorruptRecord", "broken").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.where("broken is null").select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("hash"), *(c for c in rows.columns if c != "broken"))


def _whole_count(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(F.col(n) >= 0, F.lit(False))
    return out


def is_valid() -> Column:
    """All pages are there and none has failed; a missing or negative count is never valid."""
    sums = (F.size("pages") == F.col("total_pages")) & (F.col("done_pages") + F.col("failed_pages") == F.col("total_pages")) & (F.col("failed_pages") == 0)
    return _whole_count("total_pages", "done_pages", "failed_pages") & F.coalesce(sums, F.lit(False))


def retry_pages() -> Column:
    """The pages (from 0, sorted) that a partial result lists as failed; null if it isn't sound, or nothing has failed.

    Sound: the counts add up, every page is there once, and the distinct failed numbers are as many as the count says, all of
    them in range.
    """
    numbers = F.array_distinct("failed_page_numbers")
    total = F.col("total_pages")
    pages = F.transform("pages", lambda p: p["page"])
    sound = (
        _whole_count("total_pages", "done_pages", "failed_pages") & F.col("failed_page_numbers").isNotNull() & F.col("pages").isNotNull()
        & (F.size("pages") == total) & (F.col("done_pages") + F.col("failed_pages") == total)
        & ~F.exists(pages, lambda p: p.isNull()) & (F.size(F.array_distinct(pages)) == total)
        & ~F.exists(numbers, lambda n: n.isNull() | (n < 1) | (n > total)) & (F.size(numbers) == F.col("failed_pages")) & (F.col("failed_pages") > 0)
    )
    return F.when(F.coalesce(sound, F.lit(False)), F.array_sort(F.transform(numbers, lambda n: n - 1)))


def job_pages(pages: Column) -> Column:
    """A finished job's pages that went well, one for each number (the last one), in order."""
    plain = F.transform(pages, lambda p: F.struct(p["page"].cast("int").alias("page"), p["status"].alias("status"), p["markdown"].alias("markdown")))
    fine = F.filter(plain, lambda p: F.coalesce(p["status"] == "ok", F.lit(False)))
    last = F.filter(fine, lambda p, i: ~F.exists(F.slice(fine, i + 2, F.size(fine)), lambda q: q["page"] == p["page"]))
    return F.array_sort(F.transform(last, lambda p: F.struct(p["page"].alias("page"), F.coalesce(p["markdown"], F.lit("")).alias("markdown"))))


def stamp(results: DataFrame, records: DataFrame, at: Column) -> DataFrame:
    """``results`` with the state of the record (``file_hash``, ``status``, ``source``) that was applied to each; one record for a file."""
    known = records.where(F.coalesce(strip(F.col("file_hash")), F.lit("")) != "").select(strip(F.col("file_hash")).alias("of_hash"), "status", F.coalesce("source", F.lit("")).alias("of_source"))
    meta = F.struct(F.lit(META_VERSION).alias("schema_version"), F.col("status").alias("biblio_state"), F.col("of_source").alias("biblio_source"), at.cast("string").alias("biblio_applied_at"))
    joined = results.join(known, F.col("hash") == F.col("of_hash"), "left")
    return joined.select(*(F.when(F.col("of_hash").isNotNull(), meta).otherwise(F.col(c)).alias(c) if c == "meta" else c for c in results.columns))


def first_doi(x: Column) -> Column:
    return F.rtrim(F.regexp_extract(F.coalesce(x, F.lit("")), DOI, 0), F.lit(".,;)"))


def first_heading(x: Column) -> Column:
    """The text of the first Markdown heading of level one to three."""
    return strip(F.regexp_extract(F.coalesce(x, F.lit("")), r"(?m)^#{1,3}\s+(.+?)\s*$", 1))


def common_year(x: Column) -> Column:
    """The year from 1900 to 2029 that a text names most often, of equal ones the first."""
    years = F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(f"{_EDGE}(19[0-9]{{2}}|20[0-2][0-9]){_AFTER}"), 1), lambda y: y.cast("int"))
    counted = F.transform(F.array_distinct(years), lambda y: F.struct(F.size(F.filter(years, lambda z: z == y)).alias("n"), (-F.array_position(years, y)).alias("at"), y.alias("y")))
    return F.array_max(counted)["y"]


def date_year(x: Column) -> Column:
    """The first year from 1500 to 2099 in a free date."""
    found = F.regexp_extract(F.coalesce(x, F.lit("")), f"{_EDGE}(1[5-9][0-9]{{2}}|20[0-9]{{2}}){_AFTER}", 1)
    return F.when(found != "", found.cast("int"))


#: OCR results, jobs and page texts made of the sample's documents by arithmetic on doc_id; ``pages`` is built beside it.
RESULTS = """select doc_id as id, case when doc_id % 11 = 4 then null else cast(1 + doc_id % 6 as int) end as total_pages, cast(doc_id % 6 + case when doc_id % 13 = 5 then 1 when doc_id % 3 = 1 then 0 else 1 end as int) as done_pages,
    cast(case when doc_id % 17 = 8 then -1 when doc_id % 3 = 1 then 1 else 0 end as int) as failed_pages, cast(1 + doc_id % 6 as int) as n, cast(case when doc_id % 19 = 1 then 99 else 1 + doc_id % 6 end as int) as bad from {documents}"""
TEXTS = """select doc_id as id, concat(case doc_id % 4 when 0 then '' when 1 then '## ' when 2 then '#### ' else concat('intro', chr(10), '#   ') end, split_part(text, chr(10), 1), chr(10), 'page ', doc_id % 30, ' of ', doc_id % 30, '; 19', 10 + doc_id % 80, ' and ', 1990 + doc_id % 45,
    case when doc_id % 3 = 0 then concat(', again 19', 10 + doc_id % 80) else '' end, case when doc_id % 5 < 3 then concat(' see 10.', 100 + doc_id * 7, '/a(b).c', doc_id, ');') else ' none' end, case doc_id % 6 when 0 then ' x2017y' when 1 then ' 2018년' else ' 08/2017' end) as t from {documents}"""


def _q(build):
    from ..sources.corpus import sample_corpus

    return lambda spark, sf_dir: build(sample_corpus(spark, sf_dir))


def _results(c) -> DataFrame:
    rows = c.sql(RESULTS)
    pages = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.struct(F.when((F.col("id") % 23 == 2) & (p > 0), F.lit(0)).otherwise(p).alias("page"), F.concat(F.lit("# "), p.cast("string")).alias("markdown"), F.lit("t").alias("text"), F.when((F.col("id") + p) % 4 == 0, "error").otherwise("ok").alias("status")))
    failed = F.when(F.col("failed_pages") == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("bad"), F.col("bad")))
    return rows.select("id", "total_pages", "done_pages", "failed_pages", failed.alias("failed_page_numbers"), pages.alias("pages"))


def _joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


QUERIES = {
    "ocr_valid": _q(lambda c: _results(c).select("id", is_valid().alias("valid"))),
    "ocr_resume_plan": _q(lambda c: _results(c).select("id", _joined(retry_pages()).alias("pages")).where("pages is not null")),
    "ocr_job_pages": _q(lambda c: _results(c).select("id", job_pages(F.col("pages")).alias("p")).select("id", F.size("p").alias("done"), F.array_join(F.transform("p", lambda x: F.concat(x["page"].cast("string"), F.lit(":"), x["markdown"])), ",").alias("pages"))),
    "ocr_meta_stamp": _q(lambda c: stamp(c.paperfile.select("hash", F.lit(None).cast("struct<schema_version:int,biblio_state:string,biblio_source:string,biblio_applied_at:string>").alias("meta")), c.paperbiblio.where("status in ('applied', 'auto_committed')").groupBy("file_hash").agg(F.max(F.struct("extracted_at", "status", "source")).alias("r")).select("file_hash", "r.status", "r.source"), F.lit("2024-01-31")).select("hash", "meta.schema_version", "meta.biblio_state", "meta.biblio_source", "meta.biblio_applied_at")),
    "baseline_extract": _q(lambda c: c.sql(TEXTS).select("id", first_doi(F.col("t")).alias("doi"), first_heading(F.col("t")).alias("title"), common_year(F.col("t")).alias("year"))),
    "date_years": _q(lambda c: c.sql(TEXTS).select("id", date_year(F.col("t")).alias("year"))),
}
ORACLES = {
    "ocr_valid": f"select id, coalesce(total_pages >= 0 and done_pages >= 0 and failed_pages >= 0 and n = total_pages and done_pages + failed_pages = total_pages and failed_pages = 0, false) as valid from ({RESULTS}) r",
    "ocr_resume_plan": f"select id, cast(bad - 1 as varchar) as pages from ({RESULTS}) r where total_pages is not null and failed_pages = 1 and done_pages + failed_pages = total_pages and (id % 23 <> 2 or n = 1) and bad between 1 and total_pages",
    "ocr_job_pages": f"""select id, count(p) as done, coalesce(string_agg(p || ':# ' || m, ',' order by p), '') as pages from (
        select r.id, case when r.id % 23 = 2 and m > 0 then 0 else m end as p, m, row_number() over (partition by r.id, case when r.id % 23 = 2 and m > 0 then 0 else m end order by m desc) as rn
        from (select id, unnest(generate_series(0, n - 1)) as m from ({RESULTS}) x) r where (r.id + m) % 4 <> 0) y where rn = 1 group by id
      union all select id, 0, '' from ({RESULTS}) z where n = 1 and id % 4 = 0""",
    "ocr_meta_stamp": """select f.hash, case when r.status is not null then 1 end as schema_version, r.status as biblio_state, r.source as biblio_source, case when r.status is not null then '2024-01-31' end as biblio_applied_at
      from {paperfile} f left join (select * from (select *, row_number() over (partition by file_hash order by extracted_at desc, status desc, source desc) as rn from {paperbiblio} where status in ('applied', 'auto_committed')) x where rn = 1) r on r.file_hash = f.hash""",
    "baseline_extract": f"""select id, rtrim(regexp_extract(t, '10\\.[0-9]{{{{4,9}}}}/[-._;()/:A-Za-z0-9]+'), '.,;)') as doi, trim(regexp_extract(t, '(?m)^#{{{{1,3}}}}[ \\t\\n]+(.+?)[ \\t]*$', 1)) as title,
        (select y from (select y, count(*) as n, min(i) as i from (select cast(unnest(ys) as int) as y, unnest(generate_series(1, len(ys))) as i) a group by y order by n desc, i limit 1) b) as year
      from (select id, t, list_filter(string_split_regex(t, '[^\\pL\\pN_]+'), lambda w: regexp_full_match(w, '19[0-9]{{{{2}}}}|20[0-2][0-9]')) as ys from ({TEXTS}) x) y""",
    "date_years": f"select id, cast(nullif(coalesce(list_filter(string_split_regex(t, '[^\\pL\\pN_]+'), lambda w: regexp_full_match(w, '1[5-9][0-9]{{{{2}}}}|20[0-9]{{{{2}}}}'))[1], ''), '') as int) as year from ({TEXTS}) x",
}
