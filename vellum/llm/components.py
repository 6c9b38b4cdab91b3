"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import join_hot, settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v longs) but the smallest of each component, its root.

    Minima are pre-aggregated before their shuffle and joined back; those of hubs, of which the number
    of edges bounds the number, are broadcast, so a hub's edges are never gathered in one task. Each
    round is written, and one row of counts tells when nothing changes.
    """
    now = settle(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        # a row per node, read three times below
        least = settle(
            both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least"
        )
        large = join_hot(both, least, ["u"], "n", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.distinct(), "large-star")
        down = settle(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "down")
        small = join_hot(large, down, ["u"], "n", 2 * state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(down.select("u", F.col("m").alias("v")).union(small).distinct(), "small-star")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select("u", F.col("v").alias("root"))
