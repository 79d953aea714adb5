"""Distributed graph steps for pages too large for one array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pagelattice.session import cut_lineage


def connected_components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, u, v) edges -> (keys, id, label), label = least id of the component.

    Alternates the large-star and small-star steps until the edge set is a forest of stars.
    Each step is a min per vertex (combined map side) joined back to the edges.
    """
    keys = list(keys)
    edges = cut_lineage(edges.where("u <> v").select(*keys, "u", "v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(least, keys + ["u"])
                 .select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = large.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        lowest = down.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = down.join(lowest, keys + ["u"])
        edges = cut_lineage(
            small.where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select(*keys, "u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    members = edges.select(*keys, F.col("u").alias("id"), F.col("v").alias("label"))
    roots = edges.select(*keys, F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return members.unionByName(roots)


def greedy_losers(conflicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, hi, lo) conflicts, hi ranked above lo -> (keys, id) dropped by the greedy scan.

    A row nobody undecided outranks is kept and drops its rivals; repeat on what is left.
    This is the sequential greedy result, whatever the rank order.
    """
    keys = list(keys)
    live = cut_lineage(conflicts.select(*keys, "hi", "lo").distinct())
    lost = None
    while not live.isEmpty():
        winners = (live.select(*keys, F.col("hi").alias("id")).distinct()
                   .join(live.select(*keys, F.col("lo").alias("id")).distinct(), keys + ["id"], "left_anti"))
        out = cut_lineage(live.join(winners.withColumnRenamed("id", "hi"), keys + ["hi"], "left_semi")
                          .select(*keys, F.col("lo").alias("id")).distinct())
        lost = out if lost is None else lost.unionByName(out)
        live = cut_lineage(
            live.join(winners.withColumnRenamed("id", "hi"), keys + ["hi"], "left_anti")
            .join(out.withColumnRenamed("id", "hi"), keys + ["hi"], "left_anti")
            .join(out.withColumnRenamed("id", "lo"), keys + ["lo"], "left_anti"))
    return lost if lost is not None else live.select(*keys, F.col("lo").alias("id"))
