"""Connected components of a table of links, as joins and groupings (union-find within a task, star steps across tasks)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import stash


#: Nodes that a task holds before it sends what it knows and starts anew (about 200 MB).
HELD = 1_000_000


def _forest(batches):
    """The links of a task as (node, smallest node of its tree): at most one row for each node it holds."""
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def known():
        pairs = [(x, root(x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) >= HELD:
            yield known()
            parent.clear()
    yield known()


def _joined(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Links united within each task, dealt anew to as many tasks as their number asks for and united again; whether one task saw all."""
    united = stash(edges.mapInArrow(_forest, "a long, b long"))
    tasks = max(1, math.ceil(united.count() / (HELD // 2)))  # the ends of so many links are held at once
    return stash(united.repartition(tasks).mapInArrow(_forest, "a long, b long")), tasks == 1


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none. Both ends of an edge are pre-aggregated, a hub is one row."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("up")).union(edges.select("b", F.lit(None).cast("long"))) \
        .groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.bool_or(F.col("up").isNull()).alias("top"))
    return ends.where("low <> high or (low is not null and top)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of 64-bit ids -> ``(node, component)``: the smallest id that a node reaches. Nodes without links are absent.

    Tasks unite their links, and are dealt what others found, at most ``HELD // 2`` links a task. Until all trees are stars, as they
    are where one task holds them all, each round hangs every larger
    neighbour on the smallest one (large star) and then every node's smaller neighbours on the smallest of them (small
    star). Minima are pre-aggregated and written before they are joined, so that both sides of the join are plain exchanges
    and adaptive execution can split a hub. Rounds grow with the logarithm of the longest chain. Links with a null end are
    ignored; an empty table gives an empty one.
    """
    edges, whole = _joined(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"))
    while not (whole or _are_stars(edges)):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = stash(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = stash(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges, whole = _joined(small.where("a <> b"))
    return edges.distinct().select(F.col("a").alias("node"), F.col("b").alias("component"))
