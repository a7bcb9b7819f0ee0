"""Corpus shaping: passages, first pages, OCR page tables, sanitised markdown, regex extraction."""

from __future__ import annotations

from ..functions.dialect import Spark

MIN_CHARS, TAIL_CHARS = 50, 10
FIRST_CHARS, FIRST_CUT = 1500, 6000
#: A blank line, as an SQL text.
BLANK = "'\n\n'"
#: The sample's index, in which every third paper is missing.
INDEXED = "select paper_id from {passage} where paper_id % 6 <> 0"


def trimmed(d: Spark, x: str) -> str:
    return d.replace(x, "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "")


def split_passages(d: Spark, min_chars: int = MIN_CHARS) -> str:
    """Paragraphs packed in order until a passage has ``min_chars``; a tail of over ten characters stays."""
    paragraphs = d.where(d.each(d.split("text", "\\n\\n"), "x", trimmed(d, "x")), "x", "x <> ''")
    # cur: the running buffer; out: what is finished, joined by a mark that texts don't hold.
    joined = "case when s.cur = '' then x.cur else concat(s.cur, chr(10), x.cur) end"
    if d.name == "duck":
        items, start = d.each("ps", "x", "{{'cur': x, 'out': ''}}"), "{{'cur': '', 'out': ''}}"
        step = f"{{{{'cur': case when length({joined}) >= {min_chars} then '' else {joined} end, 'out': case when length({joined}) >= {min_chars} then concat(s.out, chr(1), {joined}) else s.out end}}}}"
    else:
        items, start = d.each("ps", "x", "named_struct('cur', x, 'out', '')"), "named_struct('cur', '', 'out', '')"
        step = f"named_struct('cur', case when length({joined}) >= {min_chars} then '' else {joined} end, 'out', case when length({joined}) >= {min_chars} then concat(s.out, chr(1), {joined}) else s.out end)"
    return f"""with a as (select paper_id, page, text, {paragraphs} as ps from {{page}}),
        b as (select paper_id, page, text, {d.fold(items, start, 's', 'x', step)} as r from a),
        c as (select paper_id, page, text, concat(r.out, case when length(r.cur) > {TAIL_CHARS} then concat(chr(1), r.cur) else '' end) as packed from b),
        e as (select paper_id, page, case when packed = '' then case when length(text) > {TAIL_CHARS} then concat(chr(1), text) else '' end else packed end as packed from c)
      select paper_id, cast(page + 1 as int) as page, cast(i as int) as place, split_part(packed, chr(1), i + 1) as text
      from (select paper_id, page, packed, {d.rows(d.upto('1', d.size(d.split('packed', chr(1))) + ' - 1'))} as i from e) x"""


def first_pages(d: Spark) -> str:
    """Leading pages until 1500 characters and two pages, cut at 6000, with page headers."""
    return f"""with a as (select paper_id, page, {trimmed(d, 'text')} as text from {{page}}),
        b as (select *, row_number() over (partition by paper_id order by page) as rn, sum(length(text)) over (partition by paper_id order by page) as cum from a where text <> ''),
        c as (select *, lag(cum) over (partition by paper_id order by page) as before from b),
        k as (select paper_id, {d.gather("concat('--- Page ', page + 1, ' ---', chr(10), text)", BLANK, 'page')} as t from c where rn <= 2 or before < {FIRST_CHARS} group by paper_id)
      select paper_id, case when length(t) > {FIRST_CUT} then concat(substr(t, 1, {FIRST_CUT}), chr(10), '[...truncated]') else t end as head from k"""


def sanitize(d: Spark, x: str = "text") -> str:
    """Lines without leading space, list numbers escaped, at most one blank line in a row, ends trimmed."""
    out = d.replace(x, "(?m)^[ \\t]+", "")
    out = d.escape_list_numbers(out)
    out = d.replace(out, "\\n\\n\\n+", chr(10) * 2)
    return trimmed(d, out)


def join_pages(d: Spark) -> str:
    """A paper's pages as one document: sanitised, blank ones left out, each under the number of its place among all pages."""
    rule = "'\n\n---\n\n'"
    return f"""select paper_id, {d.gather("concat('*— page ', place, ' —*', chr(10), chr(10), text)", rule, 'place')} as markdown
      from (select paper_id, {sanitize(d)} as text, row_number() over (partition by paper_id order by page) as place from {{page}}) p where text <> '' group by paper_id"""


TEMPLATES = {
    "split_passages": split_passages,
    "first_pages": first_pages,
    "ocr_pages": lambda d: f"select paper_id, cast(page + 1 as int) as page, {trimmed(d, 'text')} as text from {{page}} where {trimmed(d, 'text')} <> ''",
    "sanitize_markdown": lambda d: f"select paper_id, page, {sanitize(d)} as text from {{page}}",
    "join_pages": join_pages,
    "page_break_headers": lambda d: "select id, paper_id, page, case when lag(page) over (partition by paper_id order by page, id) = page then 0 else 1 end as header from {passage}",
    "reindex_targets": lambda d: f"select f.id from {{paperfile}} f where not f.path ilike '%.json' and exists (select 1 from {{paperfile}} j where j.hash = f.hash and j.path ilike '%.json') and not exists (select 1 from ({INDEXED}) s where s.paper_id = f.paper_id)",
    "content_hash": lambda d: f"select doc_id, {d.sha256('text')} as hash from {{documents}}",
}
