"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (a long, b long): root is the component's smallest node.

    A node's neighbours are never gathered: each round takes their minimum (combined before the shuffle)
    and joins it back, so a hub of any degree costs one row for each of its links. Links, nodes and labels
    stay distributed; only a count and a checksum come to the driver. Each round is checkpointed. Links
    to itself, repeated links and links with a null end are ignored; no links give no rows.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges)
    state = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if not now["n"] or (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.where("u != v").distinct())
    else:
        raise RuntimeError("the components didn't settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
