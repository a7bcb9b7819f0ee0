"""The corpus tables (sources, folders, papers, authors, files, memberships, records, passages, jobs).

A :class:`Corpus` holds one DataFrame for each table; operators take a corpus and return DataFrames. Real
corpora are read with :func:`read_corpus`; :func:`sample_corpus` derives one from the driver's tables by
arithmetic on keys, so that the same views can be written for a second engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import SPARK, Spark

TABLES = ("source", "folder", "paper", "author", "paperfile", "paperfolder", "paperbiblio", "page", "passage", "job", "feed")
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def views(d: Spark) -> dict[str, str]:
    """The sample corpus as SELECTs over the driver's tables and each other."""
    from ..operators.shaping import split_passages

    clean = d.split(d.replace("text", "[^\\pL\\pN \\n]", ""), "[ \\n]+")
    years = "1850 + doc_id % 170"
    return {
        "source": """select cast(r_regionkey + 1 as bigint) as id, r_name as name,
            case when r_regionkey % 2 = 0 then 'zotero' else 'directory' end as source_type, lower(r_name) as path from {region}""",
        "folder": """select cast(r_regionkey + 1 as bigint) as id, cast(r_regionkey + 1 as bigint) as source_id, r_name as name,
              cast(null as bigint) as parent_id, concat('C', r_regionkey + 1) as zotero_key from {region}
            union all select cast(100 + n_nationkey as bigint), cast(n_regionkey + 1 as bigint), n_name,
              cast(n_regionkey + 1 as bigint), concat('C', 100 + n_nationkey) from {nation}
            union all select cast(200 + n_nationkey as bigint), cast(n_regionkey + 1 as bigint), concat(n_name, ' II'),
              cast(100 + n_nationkey as bigint), concat('C', 200 + n_nationkey) from {nation}""",
        "paper": f"""select doc_id as id,
            case when doc_id % 11 = 0 then '' else substr(split_part(text, chr(10), 1), 1, 80) end as title,
            case doc_id % 4 when 0 then '' when 1 then cast({years} as varchar(9)) when 2 then concat('08/', {years}) else concat({years}, '-12-16') end as date,
            case when doc_id % 4 = 0 then null else cast({years} as int) end as year,
            case when doc_id % 3 = 0 then '' else source end as journal,
            case when doc_id % 5 = 0 then concat('10.', 1000 + doc_id % 9000, '/x.', doc_id) else '' end as doi,
            case when doc_id % 17 = 0 then null else 200 + doc_id % 25 end as folder_id,
            case when doc_id % 6 = 0 then '' else concat('K', doc_id) end as zotero_key, e.ts as created_at
            from {{documents}} join {{events}} e on e.event_id = doc_id""",
        "author": f"""select doc_id * 10 + k as id, doc_id as paper_id, k as ord, concat({d.get('w', '2 * k + 1')}, ', ', {d.get('w', '2 * k')}) as name from (
            select doc_id, w, {d.rows(d.upto('0', 'n - 1'))} as k from (
              select doc_id, {clean} as w, cast(case when doc_id % 7 = 0 then 0 else doc_id % 5 end as int) as n from {{documents}}) a where n > 0) b
            where 2 * k + 1 < {d.size('w')} and {d.get('w', '2 * k')} <> '' and {d.get('w', '2 * k + 1')} <> ''""",
        "paperfile": f"""with h as (select doc_id, {d.sha256('text')} as hash, case when doc_id % 6 = 0 then '' else concat('K', doc_id) end as pk,
              case when doc_id % 10 < 2 then 'pending' when doc_id % 10 = 2 then 'failed' else 'processed' end as status from {{documents}} where doc_id % 53 <> 7)
            select doc_id * 4 as id, doc_id as paper_id, concat('f', doc_id, '.pdf') as path, hash, status, case when doc_id % 13 = 0 then pk else concat('A', doc_id) end as zotero_key from h
            union all select doc_id * 4 + 1, doc_id, concat(hash, '.json'), hash, 'processed', concat('J', doc_id) from h where doc_id % 3 = 0
            union all select doc_id * 4 + 2, doc_id, concat('f', doc_id, 'b.pdf'), concat(hash, 'b'), 'pending', concat('B', doc_id) from h where doc_id % 19 = 0""",
        "paperfolder": """select id as paper_id, folder_id from {paper} where folder_id is not null
            union select id, 200 + (id + 7) % 25 from {paper} where id % 2 = 0""",
        "paperbiblio": f"""select p.id * 4 + v as id, p.id as paper_id, case when p.id % 8 = 5 then {d.sha256("concat(p.id, 'f')")} else o.hash end as file_hash,
              case when p.id % 43 = 0 then '' when p.id % 2 = 0 then p.title else concat('T ', p.id) end as title,
              case when p.id % 12 = 1 then null else coalesce(p.year, 2000) end as year,
              case when p.id % 3 = 0 then '' when p.id % 10 = 1 then 'Other' else p.journal end as journal, p.doi,
              case when p.id % 23 = 0 then 'journal_issue' when p.id % 29 = 0 then 'unknown' when p.id % 9 = 0 then 'book' else 'article' end as doc_type,
              case when l.quality = 1 then 'high' when p.id % 2 = 0 then 'medium' else 'low' end as confidence,
              l.toxic = 1 as needs_visual_review,
              case v when 0 then 'haiku' when 1 then 'sonnet' else 'sonnet-vision' end as source,
              case when p.id % 31 = 0 then 'rejected' when p.id % 37 = 0 then 'applied' when p.id % 41 = 0 then 'auto_committed' when p.id % 19 = 0 then 'needs_review' else 'extracted' end as status,
              p.id * 100 + v as extracted_at,
              case when p.id % 47 = 0 then '' else coalesce(a.names, 'Solo Writer') end as authors
            from (select x.*, {d.rows(d.upto('0', 'cast(x.id % 3 as int)'))} as v from {{paper}} x) p join {{labels}} l on l.doc_id = p.id
            join (select doc_id, {d.sha256('text')} as hash from {{documents}}) o on o.doc_id = p.id
            left join (select paper_id, {d.gather("concat(split_part(name, ', ', 2), ' ', split_part(name, ', ', 1))", "'; '", 'ord')} as names from {{author}} group by paper_id) a on a.paper_id = p.id""",
        "page": f"""select doc_id as paper_id, p as page, replace(substr(text, 1500 * p + 1, 1500), chr(10), concat(chr(10), chr(10))) as text from (
            select doc_id, text, {d.rows(d.upto('0', 'cast(floor((length(text) - 1) / 1500.0) as int)'))} as p from {{documents}} where length(text) > 0) x""",
        "passage": f"select (paper_id * 1000 + page) * 10000 + place as id, paper_id, page, text from ({split_passages(d)}) s",
        "job": """select o.o_orderkey as job_id, o.o_custkey % 3 as client_id,
              case o.o_orderstatus when 'O' then 'queued' when 'P' then 'processing' else 'done' end as status,
              coalesce(l.n, 0) as total_pages, coalesce(l.done, 0) as done_pages
            from {orders} o left join (select l_orderkey, count(*) as n, count(case when l_linestatus = 'F' then 1 end) as done from {lineitem} group by l_orderkey) l on l.l_orderkey = o.o_orderkey""",
        "feed": f"select event_id as version, user_id as item_key, event_type, value, {d.json('props', 'k')} as k, ts from {{events}}",
    }


class Corpus:
    """Named DataFrames; ``sql`` runs an operator's template over them."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise AttributeError(name) from None

    def sql(self, template: str) -> DataFrame:
        used = {n: t for n, t in self.tables.items() if "{" + n + "}" in template}
        return self.spark.sql(template, **used)


def read_corpus(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> Corpus:
    """A corpus stored as one Parquet table for each name."""
    return Corpus(spark, {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in tables})


def sample_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    corpus = Corpus(spark, {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in BASE})
    for name, template in views(SPARK).items():
        corpus.tables[name] = corpus.sql(template)
    return corpus
