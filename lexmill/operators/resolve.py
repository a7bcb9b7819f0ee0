"""Record resolution: which extracted record speaks for a paper, and what to do with it.

A null text counts as empty, a null status as extracted, a null flag as not set; names are "; " lists.
"""

from __future__ import annotations

from ..functions.dialect import Spark

#: Ranks of record sources and confidences; others rank 0.
SOURCE_RANK = {"sonnet-vision": 50, "haiku-vision": 40, "sonnet": 30, "qwen": 25, "haiku-v2": 22, "haiku": 20}
CONFIDENCE_RANK = {"high": 30, "medium": 20, "low": 10}
#: Document types without a year of their own, item types, and the fields that name an item's container.
YEARLESS = ("book", "chapter", "report")
ITEM_TYPE = {"article": "journalArticle", "book": "book", "chapter": "bookSection", "thesis": "thesis", "report": "report"}
CONTAINER = {
    "journalArticle": "publicationTitle", "magazineArticle": "publicationTitle", "newspaperArticle": "publicationTitle", "bookSection": "bookTitle",
    "conferencePaper": "proceedingsTitle", "encyclopediaArticle": "encyclopediaTitle", "dictionaryEntry": "dictionaryTitle",
}
#: The field that a new item of each type keeps the journal's or publisher's name in.
PUBLISHED_IN = {"journalArticle": "publicationTitle", "bookSection": "bookTitle", "book": "publisher", "report": "institution", "thesis": "university", "document": "publisher"}
#: What a preview says of each reason.
SKIPS = ("already_committed", "already_applied", "rejected", "journal_issue", "already_complete")
#: Hiragana and Katakana, CJK ideographs, Hangul syllables.
CJK = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"


def ranking(column: str, ranks: dict[str, int]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in ranks.items()) + " else 0 end"


def lookup(column: str, names: dict[str, str], other: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + f" else {other} end"


def names_of(d: Spark, x: str) -> str:
    """The names of a "; " list, blanks dropped."""
    return d.where(d.each(d.split(f"coalesce({x}, '')", "; "), "n", d.strip("n")), "n", "n <> ''")


def name_key(d: Spark, n: str) -> str:
    """'Last, First' and 'First Last' in one comparable form, "last first" in lower case."""
    head, rest = d.strip(f"split_part({n}, ',', 1)"), d.strip(d.after(n, ","))
    spaced = d.replace(n, "[\\s\\pZ]+", " ")
    turned = f"concat({d.extract(spaced, '([^ ]+)$', 1)}, ' ', {d.extract(spaced, '^(.*) [^ ]+$', 1)})"
    return d.strip(d.replace(f"lower(case when {n} like '%,%' then concat({head}, ' ', {rest}) else {turned} end)", "[\\s\\pZ]+", " "))


def names_key(d: Spark, x: str) -> str:
    return d.join(d.each(names_of(d, x), "n", name_key(d, "n")), "'|'")


def display_name(d: Spark, n: str) -> str:
    """A name as 'Last, First'; unspaced names of three or four CJK characters are split after the first one or two."""
    head, rest = d.strip(f"split_part({n}, ',', 1)"), d.strip(d.after(n, ","))
    spaced = d.replace(n, "[\\s\\pZ]+", " ")
    return f"""case when {n} like '%,%' then case when {rest} <> '' then concat({head}, ', ', {rest}) else {head} end
        when {d.like(spaced, '.* .*')} then concat({d.extract(spaced, '([^ ]+)$', 1)}, ', ', {d.extract(spaced, '^(.*) [^ ]+$', 1)})
        when {d.like(n, f'^[{CJK}]{{{{4}}}}$')} then concat(substr({n}, 1, 2), ', ', substr({n}, 3))
        when {d.like(n, f'^[{CJK}]{{{{3}}}}$')} then concat(substr({n}, 1, 1), ', ', substr({n}, 2)) else {n} end"""


def names_shown(d: Spark, x: str) -> str:
    return d.join(d.each(names_of(d, x), "n", display_name(d, "n")), "chr(10)")


def best(d: Spark) -> str:
    return f"""select * from (select b.*, row_number() over (partition by paper_id order by case when status = 'applied' then 1 else 0 end desc,
        {ranking('source', SOURCE_RANK)} desc, {ranking('confidence', CONFIDENCE_RANK)} desc, coalesce(extracted_at, 0) desc, id) as rn
      from {{paperbiblio}} b where coalesce(status, 'extracted') <> 'rejected') x where rn = 1"""


def judged(d: Spark, records: str) -> str:
    """Records beside their paper, with the reason of the first rule that applies."""
    fields = ("title", "journal", "doi")
    fillable = " or ".join([*(f"p.{f} = '' and b.{f} <> ''" for f in fields), "p.year is null and b.year is not null", "p.n = 0"])
    same = " and ".join([*(f"(b.{f} = '' or b.{f} = p.{f})" for f in fields), "(b.year is null or b.year = p.year)", f"{names_key(d, 'b.authors')} = {names_key(d, 'p.names')}"])
    texts = ", ".join(f"{d.plain(f)} as {f}" for f in fields)
    return f"""select b.id as record_id, b.paper_id, b.title as rec_title, b.year as rec_year, b.journal as rec_journal, b.doi as rec_doi, b.authors as rec_authors, b.n_rec,
        b.doc_type, b.source, b.confidence, b.status, p.title, p.year, p.journal, p.doi, p.names, p.n as n_authors, p.year is null and p.n = 0 as stub,
        case when b.status = 'auto_committed' then 'already_committed' when b.status = 'applied' then 'already_applied' when b.status = 'rejected' then 'rejected'
          when b.doc_type = 'journal_issue' then 'journal_issue' when b.title = '' then 'missing_title' when n_rec = 0 then 'missing_authors'
          when b.year is null and b.doc_type not in {YEARLESS} then 'missing_year' when b.doc_type in ('unknown', '') then 'unknown_doctype'
          when b.needs_visual_review then 'visual_review_flag' when b.confidence <> 'high' then 'low_confidence'
          when p.year is null and p.n = 0 then '' when p.n > 0 and p.n < n_rec then 'curated_author_shortfall'
          when {fillable} then '' when {same} then 'already_complete' else 'override_conflict' end as reason
      from (select id, paper_id, {texts}, year, coalesce(authors, '') as authors, coalesce(doc_type, '') as doc_type, coalesce(source, '') as source,
          coalesce(confidence, '') as confidence, coalesce(status, 'extracted') as status, coalesce(needs_visual_review, false) as needs_visual_review,
          cast({d.size(names_of(d, 'authors'))} as bigint) as n_rec from ({records}) r) b
      join (select r.id, {texts}, r.year, coalesce(a.names, '') as names, coalesce(a.n, 0) as n from {{paper}} r
        left join (select paper_id, {d.gather('name', "'; '", 'ord, id')} as names, count(*) as n from {{author}} group by paper_id) a on a.paper_id = r.id) p on p.id = b.paper_id"""


def acted(d: Spark, records: str) -> str:
    return f"""select *, case when reason in {SKIPS} then 'skip' when reason = '' then 'auto_commit' else 'needs_review' end as action from ({judged(d, records)}) j"""


def decisions(d: Spark) -> str:
    return acted(d, best(d))


def applied(d: Spark, when: str = "x.action = 'auto_commit'") -> str:
    """Papers after the decisions: a stub takes what its record has, a curated paper has only its gaps filled."""
    def field(f):
        return f"case when {when} and x.rec_{f} <> '' and (x.stub or {d.plain(f'p.{f}')} = '') then x.rec_{f} else p.{f} end as {f}"

    return f"""select p.id, {field('title')}, case when {when} and x.rec_year is not null and (x.stub or p.year is null) then x.rec_year else p.year end as year,
        {field('journal')}, {field('doi')}, case when {when} and x.n_rec > 0 and x.n_authors = 0 then x.rec_authors else coalesce(a.names, '') end as authors,
        coalesce({when}, false) as taken, coalesce(x.stub and x.n_rec > 0, false) as new_authors
      from {{paper}} p left join ({decisions(d)}) x on x.paper_id = p.id
        left join (select paper_id, {d.gather('name', "'; '", 'ord, id')} as names from {{author}} group by paper_id) a on a.paper_id = p.id"""


def diffs(d: Spark) -> str:
    """One row for each record and field: match, fill or conflict; one pass over the decisions."""
    pairs = {"title": ("title", "rec_title"), "journal": ("journal", "rec_journal"), "doi": ("doi", "rec_doi"), "authors": (names_shown(d, "names"), names_shown(d, "rec_authors")),
             "year": ("coalesce(cast(year as varchar(9)), '')", "coalesce(cast(rec_year as varchar(9)), '')")}
    parts = d.list(*(d.struct(field=f"'{f}'", mine=a, theirs=b) for f, (a, b) in pairs.items()))
    return f"""select paper_id, f.field as field, case when f.mine = f.theirs or f.theirs = '' then 'match' when f.mine = '' then 'fill' else 'conflict' end as kind
      from (select paper_id, {d.rows(parts)} as f from ({decisions(d)}) x) y"""


def latest(by: str) -> str:
    return f"select * from (select b.*, row_number() over (partition by {by} order by coalesce(extracted_at, 0) desc, id) as rn from {{paperbiblio}} b) x where rn = 1"


def candidates(d: Spark) -> str:
    """Processed standalone PDFs beside the latest record of the same paper and file, if that is certain and has a title."""
    return f"""select f.id as file_id, p.id as paper_id, b.id as record_id, b.title, b.year, coalesce(b.journal, '') as journal, coalesce(b.doi, '') as doi, coalesce(b.doc_type, 'unknown') as doc_type
      from {{paper}} p join {{paperfile}} f on f.paper_id = p.id join ({latest('paper_id, file_hash')}) b on b.paper_id = p.id and b.file_hash = f.hash
      where p.zotero_key = f.zotero_key and f.status = 'processed' and f.hash <> '' and not f.path ilike '%.json' and b.confidence = 'high' and b.title <> ''"""


RECORD = "id, paper_id, source, title, year, status"

TEMPLATES = {
    "best_record": lambda d: f"select {RECORD} from ({best(d)}) x",
    "decisions": lambda d: f"select record_id, paper_id, action, reason from ({decisions(d)}) x",
    "decision_stats": lambda d: f"select action, reason, count(*) as n from ({decisions(d)}) x group by action, reason",
    "decide_any_record": lambda d: f"select record_id, reason from ({judged(d, 'select * from {paperbiblio}')}) x",
    "local_apply_papers": lambda d: f"select id, title, year, journal, doi from ({applied(d)}) x",
    "local_apply_authors": lambda d: f"select id as paper_id, {d.rows(names_of(d, 'authors'))} as name from ({applied(d)}) x where authors <> ''",
    "local_apply_records": lambda d: f"select b.id, case when x.action = 'auto_commit' then 'auto_committed' when x.action = 'needs_review' then 'needs_review' else b.status end as status, case when x.action = 'needs_review' then x.reason else '' end as review_reason from {{paperbiblio}} b left join ({decisions(d)}) x on x.record_id = b.id",
    "would_change": lambda d: f"select p.id from {{paper}} p join ({applied(d)}) x on x.id = p.id where x.taken and (coalesce(p.title, '') <> coalesce(x.title, '') or coalesce(p.year, -1) <> coalesce(x.year, -1) or coalesce(p.journal, '') <> coalesce(x.journal, '') or coalesce(p.doi, '') <> coalesce(x.doi, '') or x.new_authors)",
    "apply_single": lambda d: f"select x.paper_id, x.record_id, x.action, x.reason, a.title, a.year, a.journal, a.doi, a.authors, case when x.action = 'skip' then x.status else 'applied' end as status from ({decisions(d)}) x join ({applied(d, WANTED)}) a on a.id = x.paper_id",
    "field_diffs": diffs,
    "apply_preview": lambda d: f"""select x.paper_id, x.action, x.reason, case x.status when 'applied' then 'Applied' when 'auto_committed' then 'Auto-committed' else 'Apply Biblio' end as label, x.action <> 'skip' as enabled, f.n_fill, f.n_conflict
      from ({decisions(d)}) x join (select paper_id, count(case when kind = 'fill' then 1 end) as n_fill, count(case when kind = 'conflict' then 1 end) as n_conflict from ({diffs(d)}) y group by paper_id) f on f.paper_id = x.paper_id""",
    "latest_record": lambda d: f"select {RECORD} from ({latest('paper_id')}) x",
    "latest_per_source": lambda d: f"select {RECORD} from ({latest('paper_id, source')}) x",
    "latest_per_file": lambda d: f"select {RECORD} from ({latest('paper_id, file_hash')}) x",
    "promote_candidates": lambda d: f"select file_id, paper_id, record_id, title, {lookup('doc_type', ITEM_TYPE, chr(39) + 'document' + chr(39))} as item_type from ({candidates(d)}) c",
    "source_confidence_rank": lambda d: f"select id, {ranking('source', SOURCE_RANK)} as source_rank, {ranking('confidence', CONFIDENCE_RANK)} as confidence_rank from {{paperbiblio}}",
    "already_applied": lambda d: "select id from {paperbiblio} where status in ('applied', 'auto_committed')",
}
#: A user's choice to apply a record counts for all but the skipped ones.
WANTED = "x.action <> 'skip'"
