"""Personal names: split, display and its inverse, citations, creators, migrations. Column functions; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hiragana and Katakana, CJK ideographs, Hangul syllables.
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(x: Column) -> Column:
    """Without Unicode white space around it."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _pair(first: Column, last: Column) -> Column:
    return F.struct(first.alias("first"), last.alias("last"))


def split_name(x: Column) -> Column:
    """``first`` and ``last``: around the first comma, else the last word; CJK names without spaces after one or two characters."""
    name = strip(x)
    comma = F.instr(name, ",")
    before, after = strip(F.substring_index(name, ",", 1)), strip(F.substr(name, comma + 1))
    tokens = F.split(name, r"(?U)\s+")
    words = F.size(tokens)
    front = F.array_join(F.slice(tokens, 1, F.greatest(words - 1, F.lit(0))), " ")
    cjk = name.rlike(f"^{CJK}+$")
    return (
        F.when(comma > 0, F.when(after != "", _pair(after, before)).otherwise(_pair(F.lit(""), before)))
        .when(words > 1, _pair(front, F.get(tokens, words - 1)))
        .when(cjk & (F.length(name) == 4), _pair(F.substr(name, F.lit(3)), F.substring(name, 1, 2)))
        .when(cjk & (F.length(name) == 3), _pair(F.substr(name, F.lit(2)), F.substring(name, 1, 1)))
        .otherwise(_pair(F.lit(""), name))
    )


def display_name(x: Column) -> Column:
    """'Last, First', or the last name alone."""
    parts = split_name(x)
    return F.when(parts["first"] == "", parts["last"]).otherwise(F.concat(parts["last"], F.lit(", "), parts["first"]))


def display_names(names: Column) -> Column:
    """A list of names, one a line."""
    return F.array_join(F.transform(F.coalesce(names, F.array().cast("array<string>")), display_name), "\n")


def parse_display(text: Column) -> Column:
    """The names of display lines: 'Last, First' turned round, others as they are, blank lines dropped."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), _LINES), strip), lambda x: x != "")

    def turned(x: Column) -> Column:
        before, after = strip(F.substring_index(x, ",", 1)), strip(F.substr(x, F.instr(x, ",") + 1))
        return F.when(F.instr(x, ",") == 0, x).when(after != "", F.concat(after, F.lit(" "), before)).otherwise(before)

    return F.transform(lines, turned)


def is_cjk_name(x: Column) -> Column:
    """Whether more than half of the letters are CJK."""
    x = F.coalesce(x, F.lit(""))
    letters, cjk = F.regexp_count(x, F.lit(r"\p{L}")), F.regexp_count(x, F.lit(CJK))
    return (letters > 0) & (2 * cjk > letters)


def contains_cjk(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(CJK)


def cite_name(x: Column) -> Column:
    return F.when(is_cjk_name(x), strip(x)).otherwise(split_name(x)["last"])


def citation(names: Column) -> Column:
    """One name; two joined; the first of more. The first author's script picks the words. No names: empty."""
    first, second = cite_name(F.get(names, F.lit(0))), cite_name(F.get(names, F.lit(1)))
    cjk = is_cjk_name(F.get(names, F.lit(0)))
    both = F.concat(first, F.when(cjk, "과 ").otherwise(" and "), second)
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, "").when(F.size(names) == 1, first).when(F.size(names) == 2, both).otherwise(F.concat(first, F.when(cjk, " 외").otherwise(" et al.")))


def creator(x: Column) -> Column:
    """``first``, ``last``, ``name`` of one author: two fields where a comma or a space divides the name, else ``name``; blank: null."""
    name = strip(x)
    comma = F.instr(name, ",")
    before, after = strip(F.substring_index(name, ",", 1)), strip(F.substr(name, comma + 1))
    tokens = F.split(name, r"(?U)\s+")
    none = F.lit(None).cast("string")

    def made(first, last, whole):
        return F.struct(first.alias("first"), last.alias("last"), whole.alias("name"))

    return (
        F.when(name == "", None)
        .when(comma > 0, F.when((before != "") & (after != ""), made(after, before, none)).otherwise(made(none, none, name)))
        .when(F.size(tokens) > 1, made(F.array_join(F.slice(tokens, 1, F.size(tokens) - 1), " "), F.get(tokens, F.size(tokens) - 1), none))
        .otherwise(made(none, none, name))
    )


def creators(names: Column) -> Column:
    return F.array_compact(F.transform(F.coalesce(names, F.array().cast("array<string>")), creator))


def same_creators(a: Column, b: Column) -> Column:
    """Whether two lists have the same creators in the same order; space around a field and null don't count."""
    def plain(c: Column) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<struct<first:string,last:string,name:string>>")), lambda x: F.array(strip(x["first"]), strip(x["last"]), strip(x["name"])))

    return plain(a) == plain(b)


def with_comma(name: Column, curated: Column) -> Column:
    """Names once stored as 'Last First' as 'Last, First', in papers that come from a library; others as they are."""
    space = F.instr(name, " ")
    rest = F.substr(name, space + 1)
    return F.when(curated & ~F.contains(name, F.lit(",")) & (space > 0) & (rest != ""), F.concat(F.substring_index(name, " ", 1), F.lit(", "), rest)).otherwise(name)


def property_authors(x: Column) -> Column:
    """The authors of a document's property, divided by semicolons."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ";"), strip), lambda n: n != "")


def html_escape(x: Column) -> Column:
    out = x
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def paper_names(author: DataFrame) -> DataFrame:
    """``paper_id`` and ``names``, in order."""
    rows = F.sort_array(F.collect_list(F.struct("ord", "id", "name")))
    return author.groupBy("paper_id").agg(F.transform(rows, lambda x: x["name"]).alias("names"))


def _variants(corpus) -> DataFrame:
    """The sample's author names in several spellings, some of them CJK."""
    return corpus.sql(SPELLINGS)


#: Spellings of the sample's names, by arithmetic on the author's id; the same text for both engines.
SPELLINGS = """select id, paper_id, ord, case id % 9 when 0 then name when 1 then concat(split_part(name, ', ', 2), ' ', split_part(name, ', ', 1))
    when 2 then split_part(name, ', ', 1) when 3 then '堀部純男' when 4 then '김진섭' when 5 then concat('  ', name, ',  Jr ') when 6 then concat(split_part(name, ', ', 1), ',')
    when 7 then 'Ana Maria  de Souza' else '최덕근' end as name from {author}"""


def _q(build):
    from ..sources.corpus import sample_corpus

    return lambda spark, sf_dir: build(sample_corpus(spark, sf_dir))


def _flat(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws("|", F.coalesce(x["first"], F.lit("-")), F.coalesce(x["last"], F.lit("-")), F.coalesce(x["name"], F.lit("-")))), ";")


def _lists(corpus) -> DataFrame:
    return paper_names(_variants(corpus))


QUERIES = {
    "split_names": _q(lambda c: _variants(c).select("id", split_name(F.col("name")).alias("n"), display_name(F.col("name")).alias("shown")).select("id", "n.first", "n.last", "shown")),
    "display_authors": _q(lambda c: _lists(c).select("paper_id", display_names(F.col("names")).alias("shown"), F.array_join(parse_display(display_names(F.col("names"))), "|").alias("parsed"))),
    "cjk_names": _q(lambda c: _variants(c).select("id", is_cjk_name(F.col("name")).alias("cjk"), contains_cjk(F.col("name")).alias("some"))),
    "citation_by_script": _q(lambda c: _lists(c).select("paper_id", citation(F.col("names")).alias("cite"))),
    "creators_of_names": _q(lambda c: _lists(c).select("paper_id", _flat(creators(F.col("names"))).alias("creators"))),
    "creators_equal": _q(lambda c: _lists(c).select("paper_id", creators(F.col("names")).alias("a"), creators(F.transform("names", lambda n: F.regexp_replace(n, "Jr", "Sr"))).alias("b")).select("paper_id", same_creators(F.col("a"), F.col("b")).alias("same"))),
    "names_with_comma": _q(lambda c: _variants(c).join(c.paper.select(F.col("id").alias("pid"), "zotero_key"), F.col("paper_id") == F.col("pid")).select("id", with_comma(F.col("name"), F.col("zotero_key") != "").alias("name"))),
    "property_authors": _q(lambda c: c.sql("select id, concat(' A', id, ' ; ;B ', title, ';') as prop from {paper}").select("id", F.posexplode(property_authors(F.col("prop"))).alias("place", "name"))),
    "html_escaped": _q(lambda c: c.sql("select id, concat('<b>\"', title, '\" & ''', journal, '''</b>') as t from {paper}").select("id", html_escape(F.col("t")).alias("html"))),
}

_CJK = r"[\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}]"
_SPLIT = rf"""select *, case when n like '%,%' then trim(substr(n, strpos(n, ',') + 1)) when regexp_matches(n, ' ') then regexp_extract(n, '^(.*) [^ ]+$', 1)
      when regexp_full_match(n, '{_CJK}{{{{4}}}}') then substr(n, 3) when regexp_full_match(n, '{_CJK}{{{{3}}}}') then substr(n, 2) else '' end as first,
    case when n like '%,%' then trim(split_part(n, ',', 1)) when regexp_matches(n, ' ') then regexp_extract(n, '([^ ]+)$', 1)
      when regexp_full_match(n, '{_CJK}{{{{4}}}}') then substr(n, 1, 2) when regexp_full_match(n, '{_CJK}{{{{3}}}}') then substr(n, 1, 1) else n end as last
  from (select id, paper_id, ord, trim(name) as raw, case when name like '%,%' then trim(name) else regexp_replace(trim(name), ' +', ' ', 'g') end as n from ({SPELLINGS}) v) w"""
_SHOWN = f"select *, case when first = '' then last else last || ', ' || first end as shown from ({_SPLIT}) s"
_CITED = rf"""select *, len(regexp_extract_all(raw, '\pL')) > 0 and 2 * len(regexp_extract_all(raw, '{_CJK}')) > len(regexp_extract_all(raw, '\pL')) as cjk from ({_SPLIT}) s"""
_CREATOR = """case when n like '%,%' and first <> '' and last <> '' then first || '|' || last || '|-' when n not like '%,%' and regexp_matches(n, ' ') then first || '|' || last || '|-' else '-|-|' || n end"""
ORACLES = {
    "split_names": f"select id, first, last, shown from ({_SHOWN}) x",
    "display_authors": f"""select paper_id, string_agg(shown, chr(10) order by ord, id) as shown,
        string_agg(case when strpos(shown, ',') = 0 then shown when trim(substr(shown, strpos(shown, ',') + 1)) <> '' then trim(substr(shown, strpos(shown, ',') + 1)) || ' ' || trim(split_part(shown, ',', 1)) else trim(split_part(shown, ',', 1)) end, '|' order by ord, id) filter (trim(shown) <> '') as parsed
      from ({_SHOWN}) x group by paper_id""",
    "cjk_names": f"select id, cjk, regexp_matches(raw, '{_CJK}') as some from ({_CITED}) x",
    "citation_by_script": f"""select paper_id, case when n = 1 then c[1] when n = 2 then c[1] || case when k[1] then '과 ' else ' and ' end || c[2] else c[1] || case when k[1] then ' 외' else ' et al.' end end as cite
      from (select paper_id, count(*) as n, list(case when cjk then raw else last end order by ord, id) as c, list(cjk order by ord, id) as k from ({_CITED}) x group by paper_id) y""",
    "creators_of_names": f"select paper_id, string_agg({_CREATOR}, ';' order by ord, id) as creators from ({_SPLIT}) x group by paper_id",
    "creators_equal": f"select paper_id, not bool_or(regexp_matches(n, 'Jr')) as same from ({_SPLIT}) x group by paper_id",
    "names_with_comma": f"select v.id, case when p.zotero_key <> '' and v.name not like '%,%' and v.name like '% _%' then split_part(v.name, ' ', 1) || ', ' || substr(v.name, strpos(v.name, ' ') + 1) else v.name end as name from ({SPELLINGS}) v join {{paper}} p on p.id = v.paper_id",
    "property_authors": "select id, 0 as place, 'A' || id as name from {paper} union all select id, 1, trim('B ' || title) from {paper}",
    "html_escaped": """select id, '&lt;b&gt;&quot;' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '&quot; &amp; &#x27;' || journal || '&#x27;&lt;/b&gt;' as html from {paper}""",
}
