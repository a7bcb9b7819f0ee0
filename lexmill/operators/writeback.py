"""What a record changes upstream: patches, payloads of new and changed items, the mirror afterwards. No network: rows in, rows out.

Upstream items have the columns of :mod:`lexmill.operators.items`, with ``creators`` as structs and the container's title in ``journal``
where their type has one. A patch has null in what it leaves alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..sources.corpus import Corpus, sample_corpus
from . import items, resolve
from .people import creators, display_names, paper_names, parse_display, same_creators, strip


def container_of(item_type: Column) -> Column:
    """The field that holds an item's container title; null if its type has none."""
    return _lookup(item_type, resolve.CONTAINER)


def _lookup(key: Column, names: dict[str, str], other: str | None = None) -> Column:
    out = F.lit(other).cast("string")
    for k, v in names.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _made(names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"), n.alias("name")))


def own_authors(c: Column) -> Column:
    """The authors among upstream creators, as first, last and name."""
    return F.transform(F.filter(c, lambda x: x["kind"] == "author"), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["name"].alias("name")))


def additive_patch(rows: DataFrame, force: bool = False) -> DataFrame:
    """Upstream items (``rows``, with the record in ``rec_*`` and its names in ``rec_names``) and what fills their gaps.

    Authors are written where there are none, or (``force``) where the record has more.
    """
    def gap(now: str, new: Column) -> Column:
        return F.when((strip(F.col(now)) == "") & (new != ""), new)

    held = F.coalesce(F.size(own_authors(F.col("creators"))), F.lit(0))
    sent = F.coalesce(F.size("rec_names"), F.lit(0))
    write = (sent > 0) & ((held <= 0) | (F.lit(force) & (sent > held)))
    return rows.select(
        "key", gap("title", strip(F.col("rec_title"))).alias("title"), gap("date", F.coalesce(F.col("rec_year").cast("string"), F.lit(""))).alias("date"), container_of(F.col("item_type")).alias("container_field"),
        F.when(container_of(F.col("item_type")).isNotNull(), gap("journal", strip(F.col("rec_journal")))).alias("container"), gap("doi", strip(F.col("rec_doi"))).alias("doi"), F.when(write, _made(F.col("rec_names"))).alias("creators"),
    )


def override_patch(rows: DataFrame) -> DataFrame:
    """Upstream items with what a user chose (``new_*``; null: leave it) and differs; authors are display lines, after all other creators."""
    def other(now: str, new: str) -> Column:
        return F.when(F.col(new).isNotNull() & (strip(F.col(new)) != strip(F.col(now))), strip(F.col(new)))

    chosen = creators(F.filter(F.transform(F.split("new_authors", "\n"), strip), lambda x: x != ""))
    rest = F.transform(F.filter("creators", lambda x: x["kind"] != "author"), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["name"].alias("name")))
    return rows.select(
        "key", other("title", "new_title").alias("title"), other("date", "new_year").alias("date"), F.when(container_of(F.col("item_type")).isNotNull(), other("journal", "new_journal")).alias("container"), other("doi", "new_doi").alias("doi"),
        F.when(F.col("new_authors").isNotNull() & ~same_creators(own_authors(F.col("creators")), chosen), F.concat(rest, chosen)).alias("creators"),
    )


def merged(rows: DataFrame) -> DataFrame:
    """Papers (``id``, fields, ``names``) with chosen values (``new_*``; null: keep) taken over; ``changed`` and the record's ``status``.

    A year that isn't a number becomes null; chosen authors, display lines, always count as a change.
    """
    def taken(now: str, new: str) -> Column:
        return F.when(F.col(new).isNotNull() & (strip(F.col(new)) != strip(F.col(now))), strip(F.col(new))).otherwise(F.col(now))

    year = F.when(F.col("new_year").isNull(), F.col("year")).otherwise(F.try_to_number(F.nullif(strip(F.col("new_year")), F.lit("")), F.lit("999999999")).cast("int"))
    out = rows.select("id", *(taken(f, f"new_{f}").alias(f) for f in ("title", "journal", "doi")), year.alias("year"), F.when(F.col("new_authors").isNull(), F.col("names")).otherwise(parse_display(F.col("new_authors"))).alias("names"),
                      F.struct("title", "journal", "doi", "year").alias("was"), F.col("new_authors").isNotNull().alias("authored"))
    changed = F.col("authored") | ~F.struct("title", "journal", "doi", "year").eqNullSafe(F.col("was"))
    return out.select("id", "title", "journal", "doi", "year", "names", changed.alias("changed"), F.lit("applied").alias("status"))


def promoted(rows: DataFrame) -> DataFrame:
    """The payload of a new parent for each candidate record: type, fields, and the field that its type keeps the journal in."""
    kind = F.when(F.col("doc_type") == "unknown", "document").otherwise(_lookup(F.col("doc_type"), resolve.ITEM_TYPE, "document"))
    return rows.select(
        "file_id", "paper_id", kind.alias("item_type"), F.coalesce("title", F.lit("")).alias("title"), F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string")).otherwise("").alias("date"), F.coalesce("doi", F.lit("")).alias("doi"),
        F.when(kind != "document", _lookup(kind, resolve.PUBLISHED_IN)).alias("published_in"), F.when(kind != "document", F.coalesce("journal", F.lit(""))).alias("published"),
    )


def updated(rows: DataFrame) -> DataFrame:
    """The payload that turns an existing item into what its record (``rec_*``, ``doc_type``, ``rec_notes``) says; what the record lacks stays.

    The journal goes to the field of the new type, empty too; an issue's type and the notes up to their first bar go to ``extra``.
    """
    kind = _lookup(F.col("doc_type"), resolve.ITEM_TYPE, "document")
    notes = F.when(F.coalesce("rec_notes", F.lit("")) != "", F.concat(F.lit("Notes: "), F.when(F.contains("rec_notes", F.lit("|")), strip(F.substring_index("rec_notes", "|", 1))).otherwise(F.col("rec_notes"))))
    extra = F.array_join(F.array_compact(F.array(F.when(F.col("doc_type") == "journal_issue", "Type: journalIssue"), notes)), "\n")

    def kept(new: Column, now: str) -> Column:
        return F.coalesce(F.nullif(new, F.lit("")), F.col(now), F.lit(""))

    return rows.select(
        "key", kind.alias("item_type"), kept(F.col("rec_title"), "title").alias("title"), kept(F.nullif(F.col("rec_year"), F.lit(0)).cast("string"), "date").alias("date"), kept(F.col("rec_doi"), "doi").alias("doi"),
        _lookup(kind, resolve.PUBLISHED_IN).alias("published_in"), F.coalesce("rec_journal", F.lit("")).alias("published"), F.nullif(extra, F.lit("")).alias("extra"),
    )


def refreshed(paper: DataFrame, parsed: DataFrame) -> DataFrame:
    """Papers as their upstream items say, all fields and authors overwritten; others as they are, with null authors."""
    new = parsed.select(F.col("key").alias("item_key"), *(F.col(f).alias(f"new_{f}") for f in items.FIELDS), "authors")
    joined = paper.join(new, (F.col("zotero_key") == F.col("item_key")) & (F.col("zotero_key") != ""), "left")
    return joined.select("id", *(F.when(F.col("item_key").isNotNull(), F.col(f"new_{f}")).otherwise(F.col(f)).alias(f) for f in items.FIELDS), "authors")


def standing_alone(c: Corpus, folder_has: str = "", file_has: str = "") -> DataFrame:
    """Processed PDFs whose paper stands for the file, in a folder and under a path that contain the given text, whatever its case."""
    own = c.paper.where("zotero_key <> ''").select(F.col("id").alias("of"), F.col("zotero_key").alias("own_key"), "title")
    rows = c.paperfile.where("status = 'processed' and not lower(path) like '%.json'").join(own, (F.col("paper_id") == F.col("of")) & (F.col("zotero_key") == F.col("own_key")))
    if folder_has:
        named = c.folder.where(F.contains(F.lower("name"), F.lit(folder_has.lower()))).select(F.col("id").alias("folder_id"))
        rows = rows.join(c.paperfolder.join(named, "folder_id", "left_semi").select("paper_id").distinct(), "paper_id", "left_semi")
    if file_has:
        rows = rows.where(F.contains(F.lower("path"), F.lit(file_has.lower())))
    return rows.select(F.col("id").alias("file_id"), "paper_id", "path", "title")


def promote_files(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Papers of :func:`standing_alone` under their new parents' keys (``file_id``, ``parent_key``): titled by their file if they have none."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return rows.join(keys, "file_id").select("file_id", "paper_id", F.col("parent_key").alias("zotero_key"), F.coalesce(F.nullif("title", F.lit("")), stem).alias("title"))


#: What a user chose in a comparison, by arithmetic on the paper's id; the same text for both engines.
CHOICES = """select id as of, case when id % 3 = 0 then concat(' New title ', id, ' ') when id % 3 = 1 then title end as new_title, case id % 5 when 0 then '1999' when 1 then 'MMX' when 2 then '' end as new_year,
    case when id % 4 = 0 then 'A Journal' end as new_journal, case when id % 7 = 0 then '' end as new_doi, case id % 6 when 0 then concat('Lee, Ann', chr(10), chr(10), ' Bo Li ') when 1 then '' end as new_authors from {paper}"""


def _q(make):
    return lambda spark, sf_dir: make(sample_corpus(spark, sf_dir))


def _upstream(c: Corpus) -> DataFrame:
    """Upstream parents beside the best record of their paper."""
    best = c.sql(f"select paper_id, title as rec_title, year as rec_year, journal as rec_journal, doi as rec_doi, authors as rec_authors, doc_type, case when id % 3 = 0 then concat(status, ' | x') else '' end as rec_notes from ({resolve.best(SPARK)}) b")
    keyed = c.paper.where("zotero_key <> ''").select(F.col("id").alias("paper_id"), F.col("zotero_key").alias("key")).join(best, "paper_id")
    names = F.filter(F.split(F.coalesce("rec_authors", F.lit("")), "; "), lambda n: n != "")
    return items.of_kind(items._raw(c), "parent").join(keyed, "key").withColumn("rec_names", names)


def _chosen(c: Corpus) -> DataFrame:
    return c.sql(CHOICES)


def _list(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda p: F.concat_ws("|", F.coalesce(p["first"], F.lit("-")), F.coalesce(p["last"], F.lit("-")), F.coalesce(p["name"], F.lit("-")))), ";")


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("creators", _list(F.col("creators")))


def _merge_rows(c: Corpus) -> DataFrame:
    names = paper_names(c.author).withColumnRenamed("paper_id", "named")
    return c.paper.join(_chosen(c), F.col("id") == F.col("of")).join(names, F.col("id") == F.col("named"), "left")


QUERIES = {
    "additive_patch": _q(lambda c: _flat(additive_patch(_upstream(c)))),
    "additive_patch_forced": _q(lambda c: _flat(additive_patch(_upstream(c), force=True))),
    "override_patch": _q(lambda c: _flat(override_patch(items.of_kind(items._raw(c), "parent").join(c.paper.select("id", F.col("zotero_key").alias("key")), "key").join(_chosen(c), F.col("id") == F.col("of"))))),
    "merged_apply": _q(lambda c: merged(_merge_rows(c)).select("id", "title", "journal", "doi", "year", F.array_join(F.coalesce("names", F.array().cast("array<string>")), "|").alias("authors"), "changed", "status")),
    "promote_payloads": _q(lambda c: promoted(c.sql(resolve.candidates(SPARK)))),
    "update_payloads": _q(lambda c: updated(_upstream(c))),
    "upstream_refresh": _q(lambda c: refreshed(c.paper, items.parse(items.of_kind(items._raw(c), "parent"))).select("id", *items.FIELDS, F.array_join("authors", "|").alias("authors"))),
    "standing_alone": _q(lambda c: standing_alone(c, "a", "F1").select("file_id", "paper_id")),
    "promoted_files": _q(lambda c: promote_files(standing_alone(c), c.paperfile.select(F.col("id").alias("file_id"), F.concat(F.lit("NEW"), F.col("id")).alias("parent_key")))),
}

_ITEM = items._WITH.split("item as (")[0].rstrip().rstrip(",")
_BEST = f"select * from (select b.*, row_number() over (partition by paper_id order by (status = 'applied') desc, case source when 'sonnet-vision' then 50 when 'sonnet' then 30 when 'haiku' then 20 else 0 end desc, case confidence when 'high' then 30 when 'medium' then 20 when 'low' then 10 else 0 end desc, extracted_at desc, id) as rn from {{paperbiblio}} b where status <> 'rejected') x where rn = 1"
_UP = f"""{_ITEM}, best as ({_BEST}), up as (select par.*, b.title as rt, b.year as ry, b.journal as rj, b.doi as rd, list_filter(string_split(b.authors, '; '), lambda n: n <> '') as rn_, b.doc_type, case when b.id % 3 = 0 then b.status || ' | x' else '' end as notes,
      (select count(*) from cre where cre.key = par.key and p[1] = 'author') as held from par join {{paper}} p on p.zotero_key = par.key join best b on b.paper_id = p.id)"""
_SENT = "array_to_string(list_transform(rn_, lambda n: '-|-|' || n), ';')"
_TYPE = "case doc_type when 'article' then 'journalArticle' when 'book' then 'book' when 'chapter' then 'bookSection' when 'thesis' then 'thesis' when 'report' then 'report' else 'document' end"


def _additive(force: str) -> str:
    return f"""with {_UP} select key, case when title = '' and trim(rt) <> '' then trim(rt) end as title, case when date = '' then cast(ry as varchar) end as date, case item_type when 'journalArticle' then 'publicationTitle' end as container_field,
      case when item_type = 'journalArticle' and journal = '' and trim(rj) <> '' then trim(rj) end as container, case when doi = '' and trim(rd) <> '' then trim(rd) end as doi, case when len(rn_) > 0 and (held = 0 {force}) then {_SENT} end as creators from up"""


ORACLES = {
    "additive_patch": _additive(""),
    "additive_patch_forced": _additive("or len(rn_) > held"),
    "override_patch": f"""with {_ITEM}, ch as ({CHOICES}), rest as (select key, string_agg(case when trim(p[3]) = '' then p[3] else p[3] end || '|' || p[4] || '|' || p[2], ';' order by i) as r from cre where p[1] <> 'author' group by key),
        mine as (select key, string_agg(trim(p[3]) || '|' || trim(p[4]) || '|' || trim(p[2]), ';' order by i) as m from cre where p[1] = 'author' group by key)
      select par.key, case when trim(new_title) <> trim(par.title) then trim(new_title) end as title, case when new_year <> par.date then new_year end as date, case when item_type = 'journalArticle' and new_journal <> par.journal then new_journal end as container,
        case when new_doi <> par.doi then new_doi end as doi, case when new_authors = '' and m is not null then coalesce(r, '') when new_authors <> '' and coalesce(m, '') <> 'Ann|Lee|;Bo|Li|' then concat_ws(';', r, 'Ann|Lee|-;Bo|Li|-') end as creators
      from par join {{paper}} p on p.zotero_key = par.key join ch on ch.of = p.id left join rest on rest.key = par.key left join mine on mine.key = par.key""",
    "merged_apply": f"""select p.id, case when new_title is not null and trim(new_title) <> trim(title) then trim(new_title) else title end as title, case when new_journal is not null and new_journal <> journal then new_journal else journal end as journal,
        case when new_doi is not null then new_doi else doi end as doi, case when new_year is null then year else try_cast(new_year as int) end as year, case when new_authors is null then coalesce(a.names, '') when new_authors = '' then '' else 'Ann Lee|Bo Li' end as authors,
        new_authors is not null or coalesce(trim(new_title) <> trim(title), false) or coalesce(new_journal <> journal, false) or coalesce(new_doi <> doi, false) or (new_year is not null and try_cast(new_year as int) is distinct from year) as changed, 'applied' as status
      from {{paper}} p join ({CHOICES}) c on c.of = p.id left join (select paper_id, string_agg(name, '|' order by ord, id) as names from {{author}} group by 1) a on a.paper_id = p.id""",
    "promote_payloads": f"""select file_id, paper_id, t as item_type, title, date, doi, case t when 'journalArticle' then 'publicationTitle' when 'book' then 'publisher' when 'bookSection' then 'bookTitle' when 'report' then 'institution' when 'thesis' then 'university' end as published_in,
        case when t <> 'document' then journal end as published from (select f.id as file_id, p.id as paper_id, {_TYPE} as t, b.title, coalesce(cast(b.year as varchar), '') as date, b.doi, b.journal from {{paperfile}} f join {{paper}} p on p.id = f.paper_id and p.zotero_key = f.zotero_key
        join (select * from (select *, row_number() over (partition by paper_id, file_hash order by extracted_at desc, id) as rn from {{paperbiblio}}) r where rn = 1) b on b.paper_id = p.id and b.file_hash = f.hash
        where f.status = 'processed' and f.hash <> '' and not f.path ilike '%.json' and b.confidence = 'high' and b.title <> '') x""",
    "update_payloads": f"""with {_UP} select key, {_TYPE} as item_type, case when rt <> '' then rt else title end as title, coalesce(cast(ry as varchar), date) as date, case when rd <> '' then rd else doi end as doi,
        case {_TYPE} when 'journalArticle' then 'publicationTitle' when 'bookSection' then 'bookTitle' when 'report' then 'institution' when 'thesis' then 'university' else 'publisher' end as published_in, rj as published,
        nullif(concat_ws(chr(10), case when doc_type = 'journal_issue' then 'Type: journalIssue' end, case when notes <> '' then 'Notes: ' || trim(split_part(notes, '|', 1)) end), '') as extra from up""",
    "upstream_refresh": f"""with {items._WITH} select p.id, coalesce(i.title, p.title) as title, coalesce(i.date, p.date) as date, cast(case when i.key is null then p.year else i.year end as int) as year, coalesce(i.journal, p.journal) as journal, coalesce(i.doi, p.doi) as doi, i.authors
      from {{paper}} p left join (select item.* from item join par on par.key = item.key) i on i.key = p.zotero_key and p.zotero_key <> ''""",
    "standing_alone": "select f.id as file_id, p.id as paper_id from {paperfile} f join {paper} p on p.id = f.paper_id and p.zotero_key = f.zotero_key where p.zotero_key <> '' and f.status = 'processed' and not f.path ilike '%.json' and f.path ilike '%f1%' and p.id in (select m.paper_id from {paperfolder} m join {folder} o on o.id = m.folder_id where o.name ilike '%a%')",
    "promoted_files": "select f.id as file_id, p.id as paper_id, 'NEW' || f.id as zotero_key, case when p.title = '' then regexp_replace(f.path, '\\.pdf$', '') else p.title end as title from {paperfile} f join {paper} p on p.id = f.paper_id and p.zotero_key = f.zotero_key where p.zotero_key <> '' and f.status = 'processed' and not f.path ilike '%.json'",
}
