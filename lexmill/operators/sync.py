"""Mutations as snapshot transforms: upserts, merges, deletes and change plans, all idempotent."""

from __future__ import annotations

from ..functions.dialect import Spark

#: Changes of the sample feed, the last version of each key.
LATEST = "select * from (select f.*, row_number() over (partition by item_key order by version desc) as rn from {feed} f) x where rn = 1"
ITEMS = f"select concat('K', item_key) as key, item_key, version, concat('Title ', k) as title, event_type, case when item_key % 3 = 0 then concat('K', item_key % 100) else '' end as parent from ({LATEST}) l"



TEMPLATES = {
    "upsert_collections": lambda d: "with r as (select concat('C', id) as key, upper(name) as name from {folder} where id % 2 = 0 union all select concat('N', id), name from {folder} where id < 4) select coalesce(f.zotero_key, r.key) as key, coalesce(r.name, f.name) as name, f.id, p.id as parent_id from {folder} f full outer join r on r.key = f.zotero_key left join {folder} p on p.id = f.parent_id and p.source_id = f.source_id",
    "title_fallback_match": lambda d: f"with i as (select key, item_key, title from ({ITEMS}) l) select i.key, coalesce(k.id, t.id) as paper_id from i left join {{paper}} k on k.zotero_key = i.key left join (select title, folder_id, min(id) as id from {{paper}} where zotero_key = '' group by title, folder_id) t on t.title = i.title and t.folder_id = 200 + i.item_key % 25",
    "hash_dedup": lambda d: "select id, hash from (select f.*, row_number() over (partition by hash order by path, id) as rn from {paperfile} f) x where rn = 1",
    "cache_reconcile": lambda d: "select f.id, case when j.hash is not null then 'processed' when f.status = 'processed' then 'pending' else f.status end as status from {paperfile} f left join (select distinct hash from {paperfile} where path ilike '%.json') j on j.hash = f.hash where not f.path ilike '%.json'",
    "upload_targets": lambda d: "select f.paper_id, f.hash from {paperfile} f where f.status = 'processed' and not f.path ilike '%.json' and not exists (select 1 from {paperfile} j where j.paper_id = f.paper_id and j.path = concat(f.hash, '.json'))",
    "skip_existing": lambda d: "select f.paper_id, f.hash from {paperfile} f where f.status = 'processed' and f.hash <> '' and not f.path ilike '%.json' and not exists (select 1 from {paperbiblio} b where b.paper_id = f.paper_id and b.file_hash = f.hash and b.source = 'haiku')",
    "cascade_delete": lambda d: "select p.id from {paper} p where not exists (select 1 from {folder} o where o.id = p.folder_id and o.source_id = 2)",
    "process_folder_targets": lambda d: "with recursive t as (select id, 0 as depth from {folder} where id = 2 union all select f.id, t.depth + 1 from {folder} f join t on f.parent_id = t.id) select f.id, m.folder_id from t join {paperfolder} m on m.folder_id = t.id join {paperfile} f on f.paper_id = m.paper_id where f.status in ('pending', 'failed') and not f.path ilike '%.json'",
    "status_transitions": lambda d: "select id, case when status = 'failed' then 'pending' else status end as status from {paperfile}",
    "queue_depth": lambda d: "select client_id, sum(greatest(0, total_pages - done_pages)) as remaining, count(case when status in ('queued', 'processing') then 1 end) as active from {job} group by client_id",
    "retry_newest_attempt": lambda d: "select job_id, status from (select job_id, status, row_number() over (partition by job_id order by attempt desc) as rn from (select job_id, status, 0 as attempt from {job} union all select job_id, 'done' as status, 1 as attempt from {job} where status = 'processing') a) x where rn = 1",
}
