"""Catalogue lists, counts and trees."""

from __future__ import annotations

from ..functions.dialect import Spark

AS_OF = "timestamp '2024-01-31 00:00:00'"
PRIMARY = "select paper_id, id, path, status from (select f.*, row_number() over (partition by paper_id order by case when path ilike '%.json' then 1 else 0 end, id) as rn from {paperfile} f) x where rn = 1"


def names(d: Spark) -> str:
    return f"select paper_id, {d.gather('name', chr(39) + '; ' + chr(39), 'ord, id')} as names, count(*) as n from {{author}} group by paper_id"


def cite(d: Spark) -> str:
    """One author's surname; two joined; more with et al."""
    last = d.each(d.split("names", "; "), "n", "split_part(n, ', ', 1)")
    return f"select paper_id, case n when 1 then {d.get(last, '0')} when 2 then concat({d.get(last, '0')}, ' and ', {d.get(last, '1')}) else concat({d.get(last, '0')}, ' et al.') end as cite from ({names(d)}) a"


def listing(d: Spark, where: str = "true") -> str:
    """List rows: title, year, journal, citation, status of the primary file and of applied records."""
    return f"""select p.id, case when p.title = '' then '(untitled)' else p.title end as title, p.year, p.journal, coalesce(c.cite, '') as cite, s.name as source_name,
        case when f.status is null then 'none' when f.status = 'processed' and a.paper_id is not null then 'done' else f.status end as status,
        (trim(p.title) = '' or p.year is null) and c.paper_id is null as stub
      from {{paper}} p left join {{folder}} o on o.id = p.folder_id left join {{source}} s on s.id = o.source_id left join ({cite(d)}) c on c.paper_id = p.id
      left join ({PRIMARY}) f on f.paper_id = p.id left join (select distinct paper_id from {{paperbiblio}} where status = 'applied') a on a.paper_id = p.id where {where}"""


#: A folder whose parent lies in another source, or nowhere, is a root. There is no cap on the depth: what is deeper than the engine's
#: limit of recursion is an error, not left out. Folders that are their own ancestors hang on no root and have no row.
TREE = """with recursive t as (select f.id, f.source_id, f.name, 0 as depth, f.name as path from {folder} f left join {folder} p on p.id = f.parent_id and p.source_id = f.source_id where p.id is null
  union all select f.id, f.source_id, f.name, t.depth + 1, concat(t.path, ' › ', f.name) from {folder} f join t on f.parent_id = t.id and f.source_id = t.source_id) select * from t"""


def below(root: int) -> str:
    return f"with recursive t as (select id, 0 as depth from {{folder}} where id = {root} union all select f.id, t.depth + 1 from {{folder}} f join t on f.parent_id = t.id) select id, depth from t"


def page_slice(page: int, size: int = 10) -> str:
    """One page of a folder's papers by title; a page below the first or beyond the last is the first or the last."""
    at = f"least(greatest({page}, 1), greatest(1, ceil(cast(n as double) / {size})))"
    return f"""select id, title from (select id, title, row_number() over (partition by folder_id order by title, id) as rn, count(*) over (partition by folder_id) as n from {{paper}} where folder_id = 203) x
      where rn > ({at} - 1) * {size} and rn <= {at} * {size}"""


TEMPLATES = {
    "corpus_counts": lambda d: "select (select count(*) from {source}) as sources, (select count(*) from {paper}) as papers, (select count(*) from {paperfile}) as files",
    "list_all": lambda d: f"select * from ({listing(d)}) x order by id desc limit 500",
    "list_pending": lambda d: listing(d, "p.id in (select paper_id from {paperfile} where status = 'pending')"),
    "list_needs_review": lambda d: listing(d, "p.id in (select paper_id from {paperbiblio} where status = 'needs_review')"),
    "list_recent": lambda d: listing(d, f"p.created_at >= {AS_OF} - interval 30 day"),
    "list_by_folder": lambda d: listing(d, "p.id in (select paper_id from {paperfolder} where folder_id = 205)"),
    "list_by_source": lambda d: listing(d, "o.source_id = 2"),
    "paper_detail": lambda d: f"select l.*, t.path as folder_path, p.doi, p.date from ({listing(d)}) l join {{paper}} p on p.id = l.id left join ({TREE}) t on t.id = p.folder_id",
    "author_cite": cite,
    "author_summary": lambda d: f"select paper_id, case when n > 3 then concat({d.join(d.part(d.split('names', '; '), '1', '2'), chr(39) + '; ' + chr(39))}, ' et al.') else names end as summary from ({names(d)}) a",
    "authors_joined": names,
    "primary_file": lambda d: PRIMARY,
    "row_status": lambda d: f"select id, status from ({listing(d)}) x",
    "folder_tree": lambda d: TREE,
    "folder_descendants": lambda d: below(2),
    "folder_roots": lambda d: "select id, name, source_id, count(*) over (partition by source_id) as roots from {folder} where parent_id is null",
    "folder_status_matrix": lambda d: "select o.id, o.name, coalesce(p.n, 0) as papers, coalesce(f.pending, 0) as pending, coalesce(f.processed, 0) as processed, coalesce(f.failed, 0) as failed from {folder} o left join (select folder_id, count(*) as n from {paper} group by folder_id) p on p.folder_id = o.id left join (select p.folder_id, count(case when f.status = 'pending' then 1 end) as pending, count(case when f.status = 'processed' then 1 end) as processed, count(case when f.status = 'failed' then 1 end) as failed from {paper} p join {paperfile} f on f.paper_id = p.id group by p.folder_id) f on f.folder_id = o.id",
    "page_slice": lambda d: page_slice(99),
    "folder_totals": lambda d: "select count(*) as folders, sum(coalesce(p.n, 0)) as papers, sum(coalesce(f.n, 0)) as files from {folder} o left join (select folder_id, count(*) as n from {paper} group by folder_id) p on p.folder_id = o.id left join (select p.folder_id, count(*) as n from {paper} p join {paperfile} f on f.paper_id = p.id group by p.folder_id) f on f.folder_id = o.id",
    "multi_file_papers": lambda d: "select count(*) as papers, max(n) as most, sum(n) - count(*) as extra from (select paper_id, count(*) as n from {paperfile} where not path ilike '%.json' group by paper_id having count(*) >= 2) x",
    "records_by_source": lambda d: "select source, count(*) as n from {paperbiblio} group by source",
    "papers_without_files": lambda d: "select p.id from {paper} p where not exists (select 1 from {paperfile} f where f.paper_id = p.id)",
    "stub_policy": lambda d: "select p.id from {paper} p where p.year is null and not exists (select 1 from {author} a where a.paper_id = p.id)",
    "stub_listing": lambda d: "select p.id from {paper} p where (trim(p.title) = '' or p.year is null) and not exists (select 1 from {author} a where a.paper_id = p.id)",
    "standalone": lambda d: "select p.id, f.id as file_id from {paper} p join {paperfile} f on f.paper_id = p.id where p.zotero_key <> '' and p.zotero_key = f.zotero_key",
    "status_summary": lambda d: "select count(*) as files, count(case when status = 'pending' then 1 end) as pending, count(case when status = 'processed' then 1 end) as processed, count(case when status = 'failed' then 1 end) as failed from {paperfile}",
    "key_or_name_lookup": lambda d: "with w as (select 'C105' as wanted union all select 'FRANCE' union all select 'nothing'), m as (select w.wanted, f.id, 0 as tier from w join {folder} f on f.zotero_key = w.wanted union all select w.wanted, f.id, 1 from w join {folder} f on f.name = w.wanted) select wanted, id from (select wanted, id, row_number() over (partition by wanted order by tier, id) as rn from m) x where rn = 1",
    "papers_per_source": lambda d: "select s.id, count(p.id) as papers from {source} s left join {folder} o on o.source_id = s.id left join {paper} p on p.folder_id = o.id group by s.id",
    "papers_with_files": lambda d: "select p.id, f.id as file_id from {paper} p left join {paperfile} f on f.paper_id = p.id",
    "status_share": lambda d: "select status, n, share, concat(lpad(cast(cast(round(share, 1) as decimal(5, 1)) as varchar(9)), 5, ' '), '%') as shown from (select status, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by 1), 6) as share from {paperfile} group by status) x",
    "missing_metadata": lambda d: "select id from {paper} where title = '' or year is null",
    "title_contains": lambda d: "select id from {paper} where title ilike '%the%' and journal ilike '%src1%'",
    "sources_sorted": lambda d: "select id, name, row_number() over (partition by 1 order by source_type, name) as place from {source}",
    "needs_review_ids": lambda d: "select distinct paper_id from {paperbiblio} where status = 'needs_review'",
    "bridge_join": lambda d: "select m.folder_id, count(distinct m.paper_id) as papers from {paperfolder} m join {paper} p on p.id = m.paper_id group by m.folder_id",
}
