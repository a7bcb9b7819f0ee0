"""All operators by name, with the templates a second engine can run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK, Spark
from ..sources.corpus import sample_corpus, views

Template = Callable[[Spark], str]


def duck_sql(template: str) -> str:
    """A template over the sample corpus as one statement over the driver's tables."""
    defined = views(DUCK)
    order = list(defined)
    need: set[str] = set()
    todo = [template]
    while todo:
        for name in re.findall(r"\{(\w+)\}", todo.pop()):
            if name in defined and name not in need:
                need.add(name)
                todo.append(defined[name])
    def plain(t):
        return re.sub(r"\{(\w+)\}", r"\1", t).replace("{{", "{").replace("}}", "}")

    ctes = [f"{n} as ({plain(defined[n])})" for n in order if n in need]
    body = plain(template).strip()
    # A template with its own WITH is wrapped, so that both lists of names hold.
    head = "with recursive " + ", ".join(ctes) + " " if ctes else ""
    return f"{head}select * from ({body}) result" if ctes else body


def runner(template: Template) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sample_corpus(spark, sf_dir).sql(template(SPARK))


def all_templates() -> dict[str, Template]:
    from ..operators import catalog, metrics, names, resolve, search, shaping, sync

    out: dict[str, Template] = {}
    for module in (search, shaping, resolve, metrics, names, catalog, sync):
        out |= module.TEMPLATES
    return out


def hand_written() -> tuple[dict, dict[str, Template]]:
    """Operators written with DataFrames, and the DuckDB SQL that was written beside them."""
    from ..operators import index, items, ocr, people, records, stats, writeback

    queries, oracles = {}, {}
    for module in (people, records, ocr, items, index, stats, writeback):
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from ..streaming import feeds

    return {n: runner(t) for n, t in all_templates().items()} | hand_written()[0] | feeds.QUERIES


def oracle_sql() -> dict[str, str]:
    from ..streaming import feeds

    return {n: duck_sql(t(DUCK)) for n, t in all_templates().items()} | {n: duck_sql(t) for n, t in (hand_written()[1] | feeds.ORACLES).items()}
