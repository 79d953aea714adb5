"""Page-keyed spatial joins.

Rectangles of ordinary pages meet on the page key: each row is shuffled once, as it is. Matching joins
collect the right side of a page in one array, which the left rows look through.
Pages with more than ``pagelattice.pageRowLimit`` rows are spread over tiles: both sides stand in the tiles they
cover and are joined on (page, tile), so such a page is split over many tasks and only neighbours ever meet.
A pair that shares several tiles is kept in exactly one: the tile of the corner where
the two rectangles start to overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.functions.geometry import center_x, center_y, floor_div
from pagelattice.session import cut_lineage, page_row_limit

TILE = 256


#: Added to the tile column of a row that stands for itself; no rectangle lies there.
APART = 1 << 24


def _on_tiles(df: DataFrame, keys: Sequence[str], name: str, pad, tile: int, itself: bool = False) -> DataFrame:
    """One row per tile the rectangle covers once grown by ``pad``; corners kept beside the row. A row with a null side
    stands in no tile but stays, for left joins. With ``itself`` each row also has one beside all tiles, which meets nothing."""
    grow = pad if isinstance(pad, Column) else F.lit(pad)
    ends = {"l": F.col("l") - grow, "t": F.col("t") - grow,
            "r": F.greatest("l", "r") + grow, "b": F.greatest("t", "b") + grow}
    first = {s: floor_div(ends[s], tile) for s in ends}
    across, down = F.sequence(first["l"], first["r"]), F.sequence(first["t"], first["b"])
    if itself:
        across = F.concat(across, F.array(first["l"] + APART))
        down = F.when(F.col("_tx") >= APART // 2, F.array(first["t"])).when(F.col("_tx").isNotNull(), down)  # without a tile across: one row
    return (
        df.select("*", F.explode_outer(across).alias("_tx")).select("*", F.explode_outer(down).alias("_ty"))
        .select(*[F.col(k).alias(f"_{name}_{k}") for k in keys],
                F.col("_tx").alias(f"_{name}_tx"), F.col("_ty").alias(f"_{name}_ty"),
                *[e.alias(f"_{name}_{s}") for s, e in ends.items()], F.struct(*df.columns).alias(name))
    )


def crowded(keys: Sequence[str], *frames: DataFrame) -> DataFrame | None:
    """Keys with more rows than the page row limit in one of ``frames``, or None. Reads only the key columns."""
    keys, found = list(keys), []
    for df in frames:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > page_row_limit(df.sparkSession)).select(*keys)
        if not sizes.isEmpty():
            found.append(sizes)
    if not found:
        return None
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct()
    return cut_lineage(both)


def apart(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary and of crowded pages."""
    return df.join(hot, list(keys), "left_anti").select(*df.columns), df.join(hot, list(keys), "left_semi").select(*df.columns)


def _meet(a, b, pad, pad_right) -> Column:
    """Do the rectangles meet once ``a`` grows by ``pad`` and ``b`` by ``pad_right``? One without a left or upper side meets nothing."""
    grow = pad + pad_right
    known = a["l"].isNotNull() & a["t"].isNotNull() & b["l"].isNotNull() & b["t"].isNotNull() & grow.isNotNull()  # greatest skips nulls
    return known & ((F.greatest(a["l"] - grow, b["l"]) <= F.least(F.greatest(a["l"], a["r"]) + grow, F.greatest(b["l"], b["r"])))
            & (F.greatest(a["t"] - grow, b["t"]) <= F.least(F.greatest(a["t"], a["b"]) + grow, F.greatest(b["t"], b["b"]))))


def _on_pages(left: DataFrame, right: DataFrame, on, keys, pad, pad_right, how) -> DataFrame:
    """Pairs of ordinary pages. The columns of both sides travel flat, so what nobody asks for is left behind."""
    sides = []
    for df, n, grow in ((left, "a", pad), (right, "b", pad_right)):
        more = [grow.alias(f"_{n}__pad")] if isinstance(grow, Column) else []
        sides.append(df.select(*[F.col(c).alias(f"_{n}_{c}") for c in df.columns], *more))
    a, b = ({c: F.col(f"_{n}_{c}") for c in df.columns} for df, n in ((left, "a"), (right, "b")))
    grown = [F.col(f"_{n}__pad") if isinstance(g, Column) else F.lit(g) for n, g in (("a", pad), ("b", pad_right))]
    cond = _meet(a, b, *grown) & on(a, b)
    for k in keys:
        cond = cond & (a[k] == b[k])
    whole = lambda side: F.struct(*[c.alias(name) for name, c in side.items()])
    other = whole(b) if how == "inner" else F.when(b[keys[0]].isNotNull(), whole(b))
    return sides[0].join(sides[1], cond, how).select(*[a[k].alias(k) for k in keys], whole(a).alias("a"), other.alias("b"))


def touch(a, b) -> Column:
    """``_meet`` without growth, in as few steps as an array search needs. A missing left or upper side meets nothing."""
    return ((a["l"] <= F.greatest(b["l"], b["r"])) & (b["l"] <= F.greatest(a["l"], a["r"]))
            & (a["t"] <= F.greatest(b["t"], b["b"])) & (b["t"] <= F.greatest(a["t"], a["b"])))


def near_pairs(left: DataFrame, right: DataFrame, on: Callable[[Column, Column], Column], *,
               keys: Sequence[str] = ("page_id",), pad: int | Column = 0, pad_right: int | Column = 0,
               how: str = "inner", tile: int = TILE) -> DataFrame:
    """Pairs ``a`` (left row) and ``b`` (right row) on one page whose rectangles meet when they
    are grown by ``pad`` and ``pad_right`` pixels, and that satisfy ``on(a, b)``.

    With ``how="left"`` a left row shows up at least once, with null ``b`` in every tile
    that gave no match: fold it with an aggregate that skips nulls.
    """
    keys = list(keys)
    hot = crowded(keys, left) if left is right else crowded(keys, left, right)
    if hot is None:
        return _on_pages(left, right, on, keys, pad, pad_right, how)
    (few_left, left), (few_right, right) = apart(left, hot, keys), apart(right, hot, keys)
    tiled = _joined(left, right, on, keys, pad, pad_right, how, tile).select(*[F.col(f"_a_{k}").alias(k) for k in keys], "a", "b")
    return _on_pages(few_left, few_right, on, keys, pad, pad_right, how).unionByName(tiled)


def _joined(left, right, on, keys, pad, pad_right=0, how="inner", tile=TILE, itself=False) -> DataFrame:
    lt, rt = _on_tiles(left, keys, "a", pad, tile, itself), _on_tiles(right, keys, "b", pad_right, tile)
    first_x, first_y = F.greatest("_a_l", "_b_l"), F.greatest("_a_t", "_b_t")
    cond = on(F.col("a"), F.col("b"))
    cond = cond & (F.col("_a_tx") == F.col("_b_tx")) & (F.col("_a_ty") == F.col("_b_ty"))
    for k in keys:
        cond = cond & (F.col(f"_a_{k}") == F.col(f"_b_{k}"))
    cond = (cond & (floor_div(first_x, tile) == F.col("_a_tx")) & (floor_div(first_y, tile) == F.col("_a_ty"))
            & (first_x <= F.least("_a_r", "_b_r")) & (first_y <= F.least("_a_b", "_b_b")))
    return lt.join(rt, cond, how)


def _matches(left: DataFrame, right: DataFrame, on, keys, pad) -> DataFrame:
    """``a``, ``b`` and ``_self``: the pairs, and each left row once by itself. Grouped by ``a``, the rows by themselves count how
    often a row is there, so equal rows need no number of their own and a repeated task changes nothing."""
    pairs = _joined(left, right, on, keys, pad, how="left", itself=True)
    alone = F.coalesce(F.col("_a_tx") >= APART // 2, F.lit(True))
    return pairs.select("a", "b", alone.alias("_self")).where(F.col("_self") | F.col("b").isNotNull())


def _repeated(grouped: DataFrame, names: Sequence[str], *more: Column) -> DataFrame:
    """The columns of ``a`` and ``more``, as often as ``_times`` says."""
    return grouped.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*[F.col("a")[c].alias(c) for c in names], *more)


def _looked_up(left: DataFrame, right: DataFrame, keys, found, on, pad) -> DataFrame:
    """Left rows with the columns ``found(own, item, hits)`` over ``_rights``, the array of their page's right rows: the row's own columns,
    those of an entry, and whether an entry matches."""
    own = {c: F.col(c) for c in left.columns}
    rest = [c for c in right.columns if c not in keys]
    item = lambda x: {**{c: x[c] for c in rest}, **{k: own[k] for k in keys}}
    rights = right.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_rights"))
    grow = pad if isinstance(pad, Column) else F.lit(pad)
    meets = (lambda x: touch(own, item(x))) if isinstance(pad, int) and pad == 0 else (lambda x: _meet(own, item(x), grow, F.lit(0)))
    hits = lambda x: meets(x) & on(own, item(x))
    return left.join(rights, list(keys), "left").select(*left.columns, *[c.alias(n) for n, c in found(own, item, hits).items()])


def best_match(left: DataFrame, right: DataFrame, on, *, rank, pick: dict[str, str],
               keys: Sequence[str] = ("page_id",), pad: int | Column = 0) -> DataFrame:
    """Every left row with columns ``pick`` (new name -> right column) of its best right
    row, the one with the least ``rank(a, b)``; null where nothing matches. Equal left rows and rows with a null side stay."""
    keys = list(keys)

    def found(own, item, hits):
        entry = lambda x: F.struct(*[c.alias(f"k{i}") for i, c in enumerate(rank(own, item(x)))], *[item(x)[src].alias(f"p{i}") for i, src in enumerate(pick.values())])
        return {"_m": F.array_min(F.transform(F.filter("_rights", hits), entry))}

    def on_pages(left, right):
        done = _looked_up(left, right, keys, found, on, pad)
        return done.select(*left.columns, *[F.col("_m")[f"p{i}"].alias(new) for i, new in enumerate(pick)])

    hot = crowded(keys, right)
    if hot is None:
        return on_pages(left, right)
    (few_left, left), (few_right, right) = apart(left, hot, keys), apart(right, hot, keys)
    return on_pages(few_left, few_right).unionByName(_best_on_tiles(left, right, on, rank, pick, keys, pad))


def _best_on_tiles(left, right, on, rank, pick, keys, pad) -> DataFrame:
    pairs = _matches(left, right, on, keys, pad)
    a, b = F.col("a"), F.col("b")
    candidate = F.when(b.isNotNull(), F.struct(
        *[c.alias(f"k{i}") for i, c in enumerate(rank(a, b))],
        *[b[src].alias(f"p{i}") for i, src in enumerate(pick.values())]))
    best = pairs.groupBy("a").agg(F.min(candidate).alias("m"), F.count_if("_self").alias("_times"))
    return _repeated(best, left.columns, *[F.col(f"m.p{i}").alias(new) for i, new in enumerate(pick)])


def with_match_flag(left: DataFrame, right: DataFrame, on, *, name: str = "matched",
                    keys: Sequence[str] = ("page_id",), pad: int | Column = 0) -> DataFrame:
    """Every left row plus a boolean: does any right row satisfy ``on``? Equal left rows and rows with a null side stay."""
    keys = list(keys)

    def on_pages(left, right):
        return _looked_up(left, right, keys, lambda own, item, hits: {name: F.coalesce(F.exists("_rights", hits), F.lit(False))}, on, pad)

    hot = crowded(keys, right)
    if hot is None:
        return on_pages(left, right)
    (few_left, left), (few_right, right) = apart(left, hot, keys), apart(right, hot, keys)
    return on_pages(few_left, few_right).unionByName(_flag_on_tiles(left, right, on, name, keys, pad))


def _flag_on_tiles(left, right, on, name, keys, pad) -> DataFrame:
    pairs = _matches(left, right, on, keys, pad)
    flagged = pairs.groupBy("a").agg(F.max(F.col("b").isNotNull()).alias("_m"), F.count_if("_self").alias("_times"))
    return _repeated(flagged, left.columns, F.col("_m").alias(name))


def keep_matched(left, right, on, **kw) -> DataFrame:
    return with_match_flag(left, right, on, name="_hit", **kw).where("_hit").drop("_hit")


def drop_matched(left, right, on, **kw) -> DataFrame:
    return with_match_flag(left, right, on, name="_hit", **kw).where("NOT _hit").drop("_hit")


def nearest_center(left: DataFrame, right: DataFrame, distance, *, right_id: str, pick: dict[str, str],
                   keys: Sequence[str] = ("page_id",), start: int = 128) -> DataFrame:
    """Every left row with the right row of the page whose centre is nearest by ``distance(a, b)``
    (least id on ties), null where the page has none. ``distance`` may not be less than the
    greater of the two axis distances.

    Searches squares around the centre. A hit no farther than the square's half side is final;
    only the other rows search again in a square four times as wide."""
    keys = list(keys)
    a = {s: F.col(s) for s in "ltrb"}
    at = {"l": center_x(a), "t": center_y(a), "r": center_x(a), "b": center_y(a)}
    keep = {f"_{s}": s for s in "ltrb"}
    targets = right.select(*keys, right_id, *[F.col(s).alias(n) for n, s in keep.items()], *[e.alias(s) for s, e in at.items()])
    names = list(dict.fromkeys(pick.values()))
    sides = {s: f"_{s}" for s in "ltrb"}
    has = left.join(targets.select(*keys).distinct(), keys, "left_semi")
    none = left.join(targets.select(*keys).distinct(), keys, "left_anti")
    out = none.select("*", *[F.lit(None).cast(right.schema[src].dataType).alias(new) for new, src in pick.items()])
    rest = has.select(*left.columns, *[F.col(s).alias(f"_own_{s}") for s in "ltrb"]).withColumns(at)
    reach = start
    while True:
        found = best_match(rest, targets, lambda p, q: distance(p, q) <= reach, pad=reach, keys=keys,
                           rank=lambda p, q: [distance(p, q), q[right_id]],
                           pick={f"_p_{n}": sides.get(n, n) for n in names} | {"_hit": right_id})
        found = cut_lineage(found)
        done = found.where("_hit IS NOT NULL").withColumns({s: F.col(f"_own_{s}") for s in "ltrb"})
        out = out.unionByName(done.select(*left.columns, *[F.col(f"_p_{src}").alias(new) for new, src in pick.items()]))
        rest = found.where("_hit IS NULL").select(*rest.columns)
        if rest.isEmpty():
            return out
        reach *= 4
