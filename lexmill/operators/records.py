"""Extracted records as they come from a model: the JSON in its output, the authors in theirs, defaults and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .people import strip

#: Text fields of a record; a missing one is empty, a missing document type unknown.
TEXTS = ("title", "journal", "doi", "abstract", "language", "confidence", "notes")
#: Entries of a table of contents that notes keep.
CONTENTS = 20


def recovered_json(x: Column) -> Column:
    """The JSON object in a model's output: thinking left out, then a fenced one, all of it, or from the first brace to the last.

    Null if there is none, or if what was found isn't JSON.
    """
    text = strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    loose = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    found = F.when(fenced != "", fenced).when(F.startswith(text, F.lit("{")), text).otherwise(loose)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID")).startswith(kind)


def _texts_in(v: Column) -> Column:
    """The names in a variant: texts, and ``name`` or else ``full_name`` of objects; blank and other entries are dropped."""
    entries = F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))

    def text(e: Column, path: str) -> Column:
        inner = F.try_variant_get(e, path, "variant")
        return F.when(_is(inner, "STRING"), strip(F.try_variant_get(inner, "$", "string")))

    def name(e: Column) -> Column:
        return F.when(_is(e, "STRING"), text(e, "$")).when(_is(e, "OBJECT"), F.coalesce(F.nullif(text(e, "$.name"), F.lit("")), text(e, "$.full_name")))

    return F.filter(F.transform(entries, name), lambda n: n.isNotNull() & (n != ""))


def authors_of(x: Column) -> Column:
    """The names in an authors field: JSON lists of names or of objects; anything else gives none."""
    return F.coalesce(_texts_in(F.try_parse_json(F.coalesce(x, F.lit("")))), F.array().cast("array<string>"))


def record_fields(json: Column) -> dict[str, Column]:
    """The fields of a record's JSON object with their defaults; a year that isn't a whole number is null."""
    v = F.try_parse_json(json)

    def at(name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "variant")

    def text(name: str, other: str = "") -> Column:
        return F.coalesce(F.nullif(F.when(_is(at(name), "STRING"), F.try_variant_get(v, f"$.{name}", "string")), F.lit("")), F.lit(other))

    year = F.when(_is(at("year"), "BIGINT"), F.try_variant_get(v, "$.year", "int"))
    flag = at("needs_visual_review")
    seen = F.when(_is(flag, "BOOLEAN"), F.try_variant_get(v, "$.needs_visual_review", "boolean")).when(_is(flag, "BIGINT"), F.try_variant_get(v, "$.needs_visual_review", "bigint") != 0)
    seen = seen.when(_is(flag, "STRING"), F.try_variant_get(v, "$.needs_visual_review", "string") != "")
    return {n: text(n) for n in TEXTS} | {"doc_type": text("doc_type", "unknown"), "authors": _texts_in(at("authors")), "year": year, "needs_visual_review": F.coalesce(seen, F.lit(False))}


def records(outputs: DataFrame, output_col: str = "output") -> DataFrame:
    """``outputs`` with ``failed`` (no JSON in it) and the fields of its record."""
    found = outputs.withColumn("record_json", recovered_json(F.col(output_col)))
    fields = record_fields(F.col("record_json"))
    return found.select(*outputs.columns, F.col("record_json").isNull().alias("failed"), *(c.alias(n) for n, c in fields.items()))


def folded_notes(notes: Column, issue: Column, date: Column, contents: Column) -> Column:
    """Notes with issue, date and the first entries of the contents behind a bar."""
    def given(c: Column) -> Column:
        return c.isNotNull() & (c != "")

    listed = F.size(F.coalesce(contents, F.array().cast("array<string>"))) > 0
    parts = F.array_compact(F.array(
        F.when(given(issue), F.concat(F.lit("issue="), issue)), F.when(given(date), F.concat(F.lit("date="), date)),
        F.when(listed, F.concat(F.lit("toc=["), F.array_join(F.slice(contents, 1, CONTENTS), "; "), F.lit("]"))),
    ))
    notes = F.coalesce(notes, F.lit(""))
    joined = F.concat(notes, F.lit(" | "), F.array_join(parts, " "))
    return F.when(F.size(parts) == 0, notes).otherwise(F.regexp_replace(joined, r"^[ |]+|[ |]+$", ""))


#: Model outputs made of the sample's records, by arithmetic on the record's id; the same text for both engines.
_JSON = """concat('{{"title": "', replace(replace(title, '"', ''), chr(92), ''), ' ', id, '", "authors": ', case id % 5 when 0 then '["Ann Lee", " Bo Li ", ""]'
    when 1 then '[{{"name": "Cy Wu"}}, {{"full_name": "Di Xu"}}, {{"other": 1}}]' when 2 then '[1, "Eve", null, true]' when 3 then 'null' else '"Fay"' end, ', "year": ',
    case id % 4 when 0 then '1999' when 1 then '"1999"' when 2 then 'null' else '2001' end, ', "doc_type": ', case when id % 3 = 0 then '""' else '"book"' end,
    ', "needs_visual_review": ', case id % 6 when 0 then 'true' when 1 then '1' when 2 then '""' else 'false' end, '}}')"""
OUTPUTS = f"""select id, case id % 7 when 0 then concat('<think>a {{{{b}}}} c</think>  ', {_JSON}) when 1 then concat('Here:', chr(10), '```json', chr(10), {_JSON}, chr(10), '```', chr(10), 'done')
    when 2 then {_JSON} when 3 then concat('It is ', {_JSON}, ' as asked.') when 4 then 'There is nothing.' when 5 then '{{{{"title": broken' else concat('```', {_JSON}, '```') end as output from {{paperbiblio}}"""
AUTHORS = """select id, case id % 8 when 0 then '["Ann Lee", " Bo Li ", "", "  "]' when 1 then '[{{"name": "Cy"}}, {{"full_name": " Di "}}, {{"name": "", "full_name": "Ed"}}, {{"x": 1}}]'
    when 2 then '[1, "Eve", null, true, 2.5]' when 3 then '' when 4 then '["a"' when 5 then '{{"name": "Cy"}}' when 6 then '[]' else null end as authors_json from {paperbiblio}"""
NOTES = """select id, case when id % 2 = 0 then '' else title end as notes, case when id % 3 = 0 then concat('No. ', id) end as issue, case when id % 5 = 0 then '' else '1999' end as date, id % 30 as n from {paperbiblio}"""


def _q(build):
    from ..sources.corpus import sample_corpus

    return lambda spark, sf_dir: build(sample_corpus(spark, sf_dir))


def _noted(c) -> DataFrame:
    rows = c.sql(NOTES).withColumn("toc", F.when(F.col("id") % 4 != 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("n") + 1), lambda i: F.concat(F.lit("Part "), i.cast("string")))))
    return rows.select("id", folded_notes(F.col("notes"), F.col("issue"), F.col("date"), F.col("toc")).alias("notes"))


QUERIES = {
    "model_output_json": _q(lambda c: c.sql(OUTPUTS).select("id", recovered_json(F.col("output")).alias("json"))),
    "model_records": _q(lambda c: records(c.sql(OUTPUTS)).select("id", "failed", "title", "year", "doc_type", "journal", "confidence", "needs_visual_review", F.array_join("authors", "|").alias("authors"))),
    "authors_json": _q(lambda c: c.sql(AUTHORS).select("id", F.array_join(authors_of(F.col("authors_json")), "|").alias("authors"))),
    "notes_folded": _q(_noted),
}

_FOUND = r"""select id, case when not json_valid(j) then null when j = '' then null else j end as json from (
    select id, case when f <> '' then f when t like '{{%' then t else regexp_extract(t, '(?s)\{{.*\}}') end as j from (
      select id, t, regexp_extract(t, '(?s)```(?:json)?\s*(\{{.*?\}})\s*```', 1) as f from (
        select id, trim(regexp_replace(output, '(?s)<think>.*?</think>', '', 'g'), ' ' || chr(10)) as t from (""" + OUTPUTS + r""") o) a) b) c"""


def _names(json: str) -> str:
    one = "case json_type(e) when 'VARCHAR' then trim(e ->> '$') when 'OBJECT' then coalesce(nullif(trim(e ->> '$.name'), ''), trim(e ->> '$.full_name')) end"
    return f"coalesce(array_to_string(list_filter(list_transform(case when json_type({json}) = 'ARRAY' then json_extract({json}, '$[*]') else [] end, lambda e: {one}), lambda n: n is not null and n <> ''), '|'), '')"


ORACLES = {
    "model_output_json": _FOUND,
    "model_records": f"""select id, json is null as failed, coalesce(case when json_type(json, '$.title') = 'VARCHAR' then json ->> '$.title' end, '') as title,
        case when json_type(json, '$.year') in ('UBIGINT', 'BIGINT') then cast(json ->> '$.year' as int) end as year, coalesce(nullif(json ->> '$.doc_type', ''), 'unknown') as doc_type, '' as journal, '' as confidence,
        coalesce((json ->> '$.needs_visual_review') in ('true', '1'), false) as needs_visual_review, {_names("json_extract(json, '$.authors')")} as authors from ({_FOUND}) x""",
    "authors_json": f"select id, {_names('authors_json')} as authors from (select id, case when json_valid(authors_json) then authors_json else '[]' end as authors_json from ({AUTHORS}) a) x",
    "notes_folded": """select id, case when issue is null and date = '' and id % 4 = 0 then notes else trim(notes || ' | ' || array_to_string(list_filter([
        case when issue is not null then 'issue=' || issue end, case when date <> '' then 'date=' || date end,
        case when id % 4 <> 0 then 'toc=[' || array_to_string(list_transform(generate_series(1, least(n + 1, 20)), lambda i: 'Part ' || i), '; ') || ']' end], lambda p: p is not null), ' '), ' |') end as notes
      from (""" + NOTES + """) x""",
}
