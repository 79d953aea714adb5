"""Per-page suppression and clustering in two exact plans.

Ordinary pages become one sorted array per page, folded by a Catalyst ``aggregate``
without leaving the JVM. Pages above ``pagelattice.pageRowLimit`` rows never form an array:
they run as tiled edge joins with iterated aggregates, or are first cut into blocks whose
rectangles can not influence each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from pagelattice.operators.graph import connected_components, greedy_losers
from pagelattice.operators.spatial import near_pairs, touch
from pagelattice.session import cut_lineage, page_row_limit


#: Rows of a page up to which a search or rounds over its pairs run in its array.
IN_ARRAY = 100


def hot_pages(df: DataFrame, keys: Sequence[str] = ("page_id",), limit: int | None = None) -> DataFrame | None:
    """Keys above the row limit (or ``limit``, if that is lower), or None. Reads only the key columns."""
    sizes = df.groupBy(*keys).count()
    most = page_row_limit(df.sparkSession)
    hot = sizes.where(F.col("count") > (most if limit is None else min(most, limit))).select(*keys)
    return None if hot.isEmpty() else cut_lineage(hot)


def split(df, keys, hot):
    """Rows of ordinary and of hot keys (None without any)."""
    if hot == "find":
        hot = hot_pages(df, keys)
    if hot is None:
        return df, None
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")


def page_arrays(df: DataFrame, keys: Sequence[str], order: dict[str, Column], name: str = "items") -> DataFrame:
    """One row per key with its rows as an array sorted by ``order`` (name -> expression)."""
    cols = [c for c in df.columns if c not in keys]
    item = F.struct(*[e.alias(n) for n, e in order.items()], *[F.col(c) for c in cols])
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias(name))


def fold(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Scan an array left to right; the state starts as the empty array."""
    return F.aggregate(items, F.slice(items, 1, 0), step)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``: lambda bodies have no common
    subexpression elimination, and a repeated search per element would square the work."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_first(items: Column, clash: Callable[[Column, Column], Column]) -> Column:
    """Keep an element unless it clashes with a kept one."""
    return fold(items, lambda kept, x: F.when(F.exists(kept, lambda k: clash(k, x)), kept)
                .otherwise(F.concat(kept, F.array(x))))


def greedy_keep(df: DataFrame, clash, *, order: dict[str, Column], row_id: str,
                keys: Sequence[str] = ("page_id",), pad: int | Column = 0, hot="find") -> DataFrame:
    """Scan each page in ``order``; a row is dropped if it clashes with a kept one.

    ``clash(kept, row)`` may hold only for rectangles that meet when both grow by ``pad``.
    """
    keys = list(keys)
    small, big = split(df, keys, hot)
    meets = (lambda k, x: touch(k, x) & clash(k, x)) if isinstance(pad, int) and pad == 0 else clash  # most pairs of a page are apart
    cols = [F.col("k")[c].alias(c) for c in df.columns if c not in keys]
    kept = (page_arrays(small, keys, order)
            .select(*keys, F.explode(keep_first(F.col("items"), meets)).alias("k"))
            .select(*keys, *cols).select(*df.columns))
    if big is None:
        return kept
    ranks = list(order)
    big = big.select("*", F.struct(*order.values()).alias("_rank"))
    pairs = near_pairs(big, big, lambda a, b: (a["_rank"] < b["_rank"]) & clash(a, b), keys=keys, pad=pad, pad_right=pad)
    lost = greedy_losers(pairs.select(*keys, F.col(f"a.{row_id}").alias("hi"), F.col(f"b.{row_id}").alias("lo")), keys)
    rest = big.drop("_rank").join(lost.withColumnRenamed("id", row_id), keys + [row_id], "left_anti")
    return kept.unionByName(rest.select(*df.columns))


def _merge_neighbours(items: Column) -> Column:
    """Groups of ids from elements (id, earlier neighbour ids): each element unites all groups that
    hold one of its neighbours."""
    start = F.slice(F.transform(items, lambda x: x["near"]), 1, 0)

    def step(groups, x):
        flagged = F.transform(groups, lambda g: F.struct(F.arrays_overlap(g, x["near"]).alias("hit"), g.alias("g")))
        ids = lambda fs, hit: F.transform(F.filter(fs, lambda f: f["hit"] if hit else ~f["hit"]), lambda f: f["g"])
        return let(flagged, lambda fs: F.concat(ids(fs, False), F.array(
            F.array_union(F.flatten(ids(fs, True)), F.concat(x["near"], F.array(x["id"]))))))

    return F.aggregate(items, start, step)


def cluster(df: DataFrame, near, *, row_id: str, pad: int | Column, keys: Sequence[str] = ("page_id",),
            label: str = "cluster_id", hot="find") -> DataFrame:
    """Label rows with the least ``row_id`` of their connected component under the symmetric
    relation ``near(a, b)``, which must imply that the rectangles meet when both grow by ``pad``.

    Pages of ``IN_ARRAY`` rows or less are searched in their array. For fuller ones the relation is tested in one join; only rows with a
    neighbour go on: to a fold over id lists per ordinary page, to iterated aggregates for hot ones."""
    keys = list(keys)
    df = cut_lineage(df)  # read twice below
    full = hot_pages(df, keys, IN_ARRAY)
    few = df if full is None else df.join(full, keys, "left_anti")
    grow = pad if isinstance(pad, Column) else F.lit(pad)

    def reaches(a, b):
        room = a["_pad"] + b["_pad"]
        return ((a["l"] - room <= F.greatest(b["l"], b["r"])) & (b["l"] - room <= F.greatest(a["l"], a["r"]))
                & (a["t"] - room <= F.greatest(b["t"], b["b"])) & (b["t"] - room <= F.greatest(a["t"], a["b"])) & near(a, b))

    out = searched(few.withColumn("_pad", grow), reaches, row_id=row_id, keys=keys, label=label).select(*df.columns, label)
    if full is None:
        return out
    return out.unionByName(_clustered_by_edges(df.join(full, keys, "left_semi").select(*df.columns), near, row_id, pad, keys, label, hot))


def searched(df: DataFrame, reaches, *, row_id: str, keys: Sequence[str], label: str) -> DataFrame:
    """The rows with ``label``: inside each page's array, the lowest id from which a way over ``reaches(a, b)`` leads to the row. Each row
    is taken once; the state holds what is labelled, the rows reached last and those not reached yet."""
    rest_of = [c for c in df.columns if c not in (*keys, row_id)]
    arrays = page_arrays(df.select(*keys, *rest_of, F.col(row_id).alias("_id"), row_id), keys, {"_o": F.col("_id")})
    none = lambda xs: F.slice(xs, 1, 0)
    labelled = lambda xs, to: F.transform(xs, lambda x: F.struct(x.alias("x"), to.alias("label")))

    def turn(state, _):
        last, rest, done = state["last"], state["rest"], state["done"]
        flagged = F.transform(rest, lambda y: F.struct(y.alias("y"), F.coalesce(F.exists(last, lambda x: reaches(x, y)), F.lit(False)).alias("hit")))
        only = lambda fs, yes: F.transform(F.filter(fs, lambda f: f["hit"] if yes else ~f["hit"]), lambda f: f["y"])
        onward = let(flagged, lambda fs: F.struct(state["seed"].alias("seed"), F.concat(done, labelled(only(fs, True), state["seed"])).alias("done"),
                                                  only(fs, True).alias("last"), only(fs, False).alias("rest")))
        first = F.slice(rest, 1, 1)
        seeded = F.struct(rest[0]["_id"].alias("seed"), F.concat(done, labelled(first, rest[0]["_id"])).alias("done"), first.alias("last"), F.slice(rest, 2, F.size(rest)).alias("rest"))
        return F.when(F.size(rest) == 0, state).when(F.size(last) == 0, seeded).otherwise(onward)

    start = lambda xs: F.struct(xs[0]["_id"].alias("seed"), labelled(none(xs), xs[0]["_id"]).alias("done"), none(xs).alias("last"), xs.alias("rest"))
    done = let(F.col("items"), lambda xs: F.aggregate(F.sequence(F.lit(1), F.size(xs) * 2), start(xs), turn))["done"]
    return arrays.select(*keys, F.explode(done).alias("d")).select(*keys, *[F.col("d.x")[c].alias(c) for c in (row_id, *rest_of)], F.col("d.label").alias(label))


def _clustered_by_edges(df, near, row_id, pad, keys, label, hot) -> DataFrame:
    pairs = near_pairs(df, df, lambda a, b: (a[row_id] < b[row_id]) & near(a, b), keys=keys, pad=pad, pad_right=pad)
    edges = pairs.select(*keys, F.col(f"a.{row_id}").alias("u"), F.col(f"b.{row_id}").alias("v"))
    if hot == "find":
        hot = hot_pages(df, keys)
    small, big = split(edges, keys, hot)
    lists = small.groupBy(*keys, F.col("v").alias("id")).agg(F.collect_list("u").alias("near"))
    groups = page_arrays(lists, keys, {"_o": F.col("id")}).select(*keys, F.explode(_merge_neighbours(F.col("items"))).alias("g"))
    found = groups.select(*keys, F.array_min("g").alias("_l"), F.explode("g").alias(row_id))
    if big is not None:
        comp = connected_components(big, keys)
        found = found.unionByName(comp.select(*keys, F.col("label").alias("_l"), F.col("id").alias(row_id)))
    return df.join(found, keys + [row_id], "left").select(*df.columns, F.coalesce("_l", row_id).alias(label))


def independent_blocks(df: DataFrame, *, row_id: str, pad: int = 0, keys: Sequence[str] = ("page_id",),
                       flat: bool = False) -> DataFrame:
    """Add ``_block``: rows of different blocks stay more than ``pad`` pixels apart even after
    every block is replaced by its enclosing rectangle, so unions never reach across blocks.
    ``flat`` ignores the vertical position."""
    keys = list(keys)
    boxes = df.select(*keys, F.col(row_id).alias("_block"), "l", "t", "r", "b")
    if flat:
        boxes = boxes.withColumns({"t": F.lit(0), "b": F.lit(0)})
    labels = cut_lineage(df.select(*keys, F.col(row_id), F.col(row_id).alias("_block")))
    while True:
        edges = cut_lineage(
            near_pairs(boxes, boxes, lambda a, b: a["_block"] < b["_block"], keys=keys, pad=pad)
            .select(*keys, F.col("a._block").alias("u"), F.col("b._block").alias("v")))
        if edges.isEmpty():
            return df.join(labels, keys + [row_id]).select(*df.columns, "_block")
        comp = connected_components(edges, keys)
        step = comp.select(*keys, F.col("id").alias("_block"), F.col("label").alias("_to"))
        labels = cut_lineage(labels.join(step, keys + ["_block"], "left")
                             .select(*keys, row_id, F.coalesce("_to", "_block").alias("_block")))
        boxes = cut_lineage(
            boxes.join(step, keys + ["_block"], "left")
            .select(*keys, F.coalesce("_to", "_block").alias("_block"), "l", "t", "r", "b")
            .groupBy(*keys, "_block").agg(F.min("l").alias("l"), F.min("t").alias("t"),
                                          F.max("r").alias("r"), F.max("b").alias("b")))


def fold_pages(df: DataFrame, transform: Callable[[DataFrame, list[str]], DataFrame], *, row_id: str,
               pad: int = 0, keys: Sequence[str] = ("page_id",), flat: bool = False, hot="find") -> DataFrame:
    """Run an order-dependent per-page ``transform(rows, keys)``. Hot pages are first cut into
    independent blocks and grouped by (page, block) instead."""
    keys = list(keys)
    small, big = split(df, keys, hot)
    out = transform(small, keys)
    if big is None:
        return out
    blocks = independent_blocks(big, row_id=row_id, pad=pad, keys=keys, flat=flat)
    return out.unionByName(transform(blocks, keys + ["_block"]).select(*out.columns))

