"""Author lists held against each other, and years from document properties."""

from __future__ import annotations

from ..functions.dialect import Spark

#: What an author found, the order of those found, and the number of authors count for.
PRESENCE, ORDER, COUNT = 0.5, 0.3, 0.2
SHORTEST_TOKEN = 3


def name_form(d: Spark, x: str) -> str:
    """'Last, First' and 'First Last' in one form: lower case, letters, digits, underscores and hyphens."""
    one = f"trim({d.replace(x, '[ \\t\\n\\r]+', ' ')})"
    rest = f"trim(substr({one}, strpos({one}, ',') + 1))" if d.name == "duck" else f"trim(substr({one}, instr({one}, ',') + 1))"
    flipped = f"case when {one} like '%,%' and {rest} <> '' then concat({rest}, ' ', trim(split_part({one}, ',', 1))) else {one} end"
    kept = d.replace(f"lower({flipped})", "[^\\pL\\pN_ -]", "")
    return f"trim({d.replace(kept, ' +', ' ')})"


def author_scores(d: Spark) -> str:
    """Records' authors against their papers': how many are found, how many of them in order, and how many there are.

    Names match if they are equal or share a token of three characters. The order counts the longest run of strictly
    rising places among the first matches. A name without letters or digits counts but never matches. Two empty lists score 1, one empty list 0.
    """
    forms = {c: d.each(d.where(d.split(f"coalesce({c}, '')", "; "), "n", "trim(n) <> ''"), "n", name_form(d, "n")) for c in ("p", "r")}

    def long_tokens(x):
        return d.where(d.split(x, " "), "t", f"length(t) >= {SHORTEST_TOKEN}")

    found = d.where(d.upto("0", f"cast({d.size('r')} - 1 as int)"), "i", f"g <> '' and (g = {d.get('r', 'i')} or {d.size(d.common(long_tokens('g'), long_tokens(d.get('r', 'i'))))} > 0)")
    places = d.where(d.each("p", "g", d.get(found, "0")), "x", "x is not null")
    start = "cast([] as bigint[])" if d.name == "duck" else "cast(array() as array<int>)"
    # The least last place of a rising run of each length: a new place takes the first one that isn't below it.
    first = d.get("x", "0")
    tails = d.fold(d.each("q", "v", d.list("v")), start, "s", "x", f"concat({d.where('s', 'y', f'y < {first}')}, x, {d.part(d.where('s', 'y', f'y >= {first}'), 2, 1_000_000)})")
    n, m = d.size("p"), d.size("r")
    return f"""with a as (select paper_id, {d.gather('name', "'; '", 'ord')} as p from {{author}} group by paper_id),
        b as (select b.id, {forms['p']} as p, {forms['r']} as r from (select b.id, a.p, b.authors as r from {{paperbiblio}} b left join a on a.paper_id = b.paper_id) b),
        c as (select id, p, r, {places} as q from b),
        e as (select id, {n} as n, {m} as m, {d.size('q')} as found, {d.size(tails)} as rising from c)
      select id, case when n = 0 and m = 0 then 1e0 when n = 0 or m = 0 then 0e0
        else round({PRESENCE}e0 * found / n + {ORDER}e0 * rising / n + {COUNT}e0 * (1e0 - cast(abs(n - m) as double) / greatest(n, m)), 9) end as score from e"""


def property_year(d: Spark, created: str, modified: str) -> str:
    """The year of a PDF date ('D:2004...'): the creation date's, or else the change date's, if it is in 1900 to 2100."""
    def year(x):
        y = d.try_int(f"substr(replace({x}, 'D:', ''), 1, 4)")
        return f"case when length({x}) >= 6 and {y} between 1900 and 2100 then {y} end"

    return f"coalesce({year(created)}, {year(modified)})"


TEMPLATES = {
    "author_scores": author_scores,
    "property_year": lambda d: f"""select id, {property_year(d, 'created', 'modified')} as year from (
        select id, case id % 4 when 0 then '' when 1 then concat('D:', 1850 + id % 300, '0101120000Z') when 2 then 'D:none' else concat(1990 + id % 30, '05') end as created,
          case id % 5 when 0 then '' else concat('D:', coalesce(year, 2150), '0102') end as modified from {{paper}}) x""",
}
