"""As-of join in DataFrame functions, split by time so that no key has to fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_before(rows: DataFrame, keys: list[str], at: str, is_base: Column, value: Column, span: int) -> DataFrame:
    """``rows`` with ``latest``: the value of the latest base row of the same keys with a smaller ``at``.

    ``at`` is a long. A key's rows are cut into buckets of ``span`` units of ``at``; a window runs within each
    bucket, and what earlier buckets end with comes from a second window over one row for each key and
    bucket. So a key that holds any share of all rows is spread over as many tasks as it has buckets.
    Base rows of equal ``at`` are told apart by ``value``, the largest wins. No base row gives null; rows
    with a null key or null ``at`` get null.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    made = rows.select("*", *(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.floor(F.col(at) / span).alias("_b"), F.when(is_base, F.struct(F.col(at).alias("at"), value.alias("value"))).alias("_base"))
    whole = F.col("_b").isNotNull()
    for n in names:
        whole = whole & F.col(n).isNotNull()
    ended = made.where(whole & is_base).groupBy(*names, "_b").agg(F.max("_base").alias("_end"))
    wanted = made.where(whole).select(*names, "_b").distinct().join(ended, [*names, "_b"], "left")
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = wanted.select(*names, "_b", F.max("_end").over(before).alias("_carry"))
    inside = Window.partitionBy(*names, "_b").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    out = made.where(whole).withColumn("_own", F.max("_base").over(inside)).join(carried, [*names, "_b"])
    out = out.select(*rows.columns, F.coalesce("_own", "_carry")["value"].alias("latest"))
    kind = out.schema["latest"].dataType
    return out.unionByName(made.where(~whole).select(*rows.columns, F.lit(None).cast(kind).alias("latest")))
