"""Writers of SQL expressions.

Operators are SQL templates over named tables (``{paper}``), written once through a writer. :class:`Spark`
is the engine's; :class:`Duck` writes the same plan for DuckDB, which checks results. Array positions count
from 0 in ``get`` and from 1 in ``part``.
"""

from __future__ import annotations


#: The letters beyond ASCII in the sample's texts, and a capital for each.
_BEYOND, _CAPITALS = "ßàáâäçèéêëíîïñóôöùúûü", "ABCDEFGHIJKLMNOPQRSTU"


class Spark:
    name = "spark"

    def sha256(self, x): return f"sha2({x}, 256)"
    def like(self, x, p): return f"{x} rlike r'{p}'"
    def extract(self, x, p, g=0): return f"regexp_extract({x}, r'{p}', {g})"
    def extract_all(self, x, p, g=0): return f"regexp_extract_all({x}, r'{p}', {g})"
    def replace(self, x, p, r): return f"regexp_replace({x}, r'{p}', '{r}')"
    def split(self, x, p): return f"split({x}, r'{p}')"
    def where(self, a, v, e): return f"filter({a}, {v} -> {e})"
    def each(self, a, v, e): return f"transform({a}, {v} -> {e})"
    def any(self, a, v, e): return f"exists({a}, {v} -> {e})"
    def fold(self, a, start, acc, v, e): return f"aggregate({a}, {start}, ({acc}, {v}) -> {e})"
    def join(self, a, sep): return f"array_join({a}, {sep})"
    def size(self, a): return f"size({a})"
    def get(self, a, i): return f"get({a}, {i})"
    def part(self, a, at, n): return f"slice({a}, {at}, {n})"
    def list(self, *x): return f"array({', '.join(x)})"
    def has(self, a, x): return f"array_contains({a}, {x})"
    def common(self, a, b): return f"array_intersect({a}, {b})"
    def distinct(self, a): return f"array_distinct({a})"
    def most(self, a): return f"array_max({a})"
    def rows(self, a): return f"explode({a})"
    def upto(self, a, b): return f"if({a} > {b}, array(), sequence({a}, {b}))"
    def gather(self, x, sep, order): return f"listagg({x}, {sep}) within group (order by {order})"
    def epoch(self, x): return f"unix_seconds({x})"
    def json(self, x, k): return f"get_json_object({x}, '$.{k}')"
    def day(self, x): return f"date_format({x}, 'yyyy-MM-dd')"
    def maxby(self, v, o): return f"max_by({v}, {o})"
    def try_int(self, x): return f"try_cast({x} as int)"
    def strip(self, x): return f"regexp_replace({x}, r'^[\\s\\pZ]+|[\\s\\pZ]+$', '')"
    def plain(self, x): return self.strip(f"coalesce({x}, '')")
    def after(self, x, c): return f"substr({x}, instr({x}, '{c}') + 1)"
    def struct(self, **parts): return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + ")"
    def distance(self, a, b): return f"levenshtein({a}, {b})"
    def escape_list_numbers(self, x): return f"regexp_replace({x}, r'(?m)^([0-9]+)[.]', r'$1\\\\.')"

    def once(self, x):
        """A whole number that the optimiser can't see through: what is projected beside it is computed once, not
        again for every filter and every element of a lambda above."""
        return f"{x} + (monotonically_increasing_id() & 0L)"


class Duck(Spark):
    name = "duck"

    def sha256(self, x): return f"sha256({x})"
    def like(self, x, p): return f"regexp_matches({x}, '{p}')"
    def extract(self, x, p, g=0): return f"regexp_extract({x}, '{p}', {g})"
    def extract_all(self, x, p, g=0): return f"regexp_extract_all({x}, '{p}', {g})"
    def replace(self, x, p, r): return f"regexp_replace({x}, '{p}', '{r}', 'g')"
    def split(self, x, p): return f"string_split_regex({x}, '{p}')"
    def where(self, a, v, e): return f"list_filter({a}, lambda {v}: {e})"
    def each(self, a, v, e): return f"list_transform({a}, lambda {v}: {e})"
    def any(self, a, v, e): return f"len(list_filter({a}, lambda {v}: {e})) > 0"
    def fold(self, a, start, acc, v, e): return f"list_reduce({a}, lambda {acc}, {v}: {e}, {start})"
    def join(self, a, sep): return f"array_to_string({a}, {sep})"
    def size(self, a): return f"len({a})"
    def get(self, a, i): return f"{a}[({i}) + 1]"
    def part(self, a, at, n): return f"{a}[{at}:{at} + {n} - 1]"
    def list(self, *x): return f"[{', '.join(x)}]"
    def has(self, a, x): return f"list_contains({a}, {x})"
    def common(self, a, b): return f"list_intersect({a}, {b})"
    def distinct(self, a): return f"list_distinct({a})"
    def most(self, a): return f"list_max({a})"
    def rows(self, a): return f"unnest({a})"
    def upto(self, a, b): return f"generate_series({a}, {b})"
    def gather(self, x, sep, order): return f"string_agg({x}, {sep} order by {order})"
    def epoch(self, x): return f"cast(epoch({x}) as bigint)"
    def json(self, x, k): return f"json_extract_string({x}, '$.{k}')"
    def day(self, x): return f"strftime({x}, '%Y-%m-%d')"
    def maxby(self, v, o): return f"arg_max({v}, {o})"
    def try_int(self, x): return f"try_cast({x} as integer)"
    def strip(self, x): return f"regexp_replace({x}, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')"
    def after(self, x, c): return f"substr({x}, strpos({x}, '{c}') + 1)"
    def struct(self, **parts): return "{{" + ", ".join(f"'{k}': {v}" for k, v in parts.items()) + "}}"
    def once(self, x): return x

    def escape_list_numbers(self, x): return f"regexp_replace({x}, '(?m)^([0-9]+)[.]', '\\1\\\\.', 'g')"

    def distance(self, a, b):
        """DuckDB counts bytes: in lower-case texts the sample's letters beyond ASCII are first written as capitals, one for one."""
        return f"levenshtein(translate({a}, '{_BEYOND}', '{_CAPITALS}'), translate({b}, '{_BEYOND}', '{_CAPITALS}'))"


SPARK, DUCK = Spark(), Duck()
