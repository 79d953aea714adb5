"""Merging, suppression and column building as rounds over the best links.

Each round looks for links between rectangles of a page, reduces them to one per rectangle, and settles all links
that are the best at both of their ends. The best link of a page is always among those, so every round makes
progress, and the result doesn't hang on the order of the input. Pages of ``IN_ARRAY`` rows or less are shuffled once and go through all
their rounds in one array; a round looks anew only for links of rows that the last one changed. On fuller pages each round is one tiled join
for all of them; pages without a link leave, the rest go on to the fixpoint.
Relative lengths are in units of ``cw``, an integer column of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagelattice.functions import geometry as G
from pagelattice.operators.joins import covers_box, inked_in, uncovered
from pagelattice.operators.pagefold import IN_ARRAY, hot_pages, let, searched
from pagelattice.operators.spatial import best_match, drop_matched, near_pairs, touch
from pagelattice.session import cut_lineage, page_row_limit

SIDES = ("l", "t", "r", "b")
#: How the columns of united rows are put together.
ENCLOSING = {"l": "min", "t": "min", "r": "max", "b": "max"}


def union_width(a, b) -> Column:
    return F.greatest(a["r"], b["r"]) - F.least(a["l"], b["l"])


def union_height(a, b) -> Column:
    return F.greatest(a["b"], b["b"]) - F.least(a["t"], b["t"])


def enclosing() -> list[Column]:
    return [F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b")]


def best_links(active: DataFrame, link, rank, *, row_id: str, keys: Sequence[str], pad, more=None) -> DataFrame:
    """(keys, id, e): for each row with a link, its best one by ``rank(a, b)``, then by ids. ``e`` holds the ids ``u`` < ``v`` and what
    ``more(a, b)`` adds. Links are reduced as they are found; only one per row is ever kept."""
    pairs = near_pairs(active, active, lambda a, b: (a[row_id] < b[row_id]) & link(a, b), keys=keys, pad=pad)
    a, b = F.col("a"), F.col("b")
    e = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(rank(a, b))], a[row_id].alias("u"), b[row_id].alias("v"), *(more(a, b) if more else []))
    ends = pairs.select(*keys, e.alias("e")).select(*keys, F.explode(F.array("e.u", "e.v")).alias("id"), "e")
    return ends.groupBy(*keys, "id").agg(F.min("e").alias("e"))


def mutual(best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The links that are the best of both their rows."""
    return best.groupBy(*keys, "e").count().where("count = 2").select(*keys, "e")


def by_fullness(items: DataFrame, keys: Sequence[str], in_arrays: Callable[[DataFrame], DataFrame], in_joins: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``in_arrays(rows)`` for the pages of ``IN_ARRAY`` rows or less, ``in_joins(rows)`` for the others."""
    full = hot_pages(items, keys, IN_ARRAY)
    if full is None:
        return in_arrays(items)
    out = in_arrays(items.join(full, list(keys), "left_anti"))
    return out.unionByName(in_joins(items.join(full, list(keys), "left_semi")).select(*out.columns))


def array_rounds(items: DataFrame, link, rank, settle: Callable[[Column, Column], Column], *, row_id: str, keys: Sequence[str], pad=0, depth: int = 1, more=None) -> DataFrame:
    """``settle(rows, links)`` again and again inside each page's array, ``links`` being the best of both their rows. ``settle`` gives the new
    rows with a flag ``_moved`` on those that are changed. n rows take at most n ** ``depth`` rounds. Most pairs are told apart by four comparisons."""
    rest = [c for c in items.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest], F.lit(False).alias("_moved"))
    arrays = items.groupBy(*keys).agg(F.collect_list(row).alias("_xs"))

    def entry(a, b):
        return F.struct(*[x.alias(f"k{i}") for i, x in enumerate(rank(a, b))], a[row_id].alias("u"), b[row_id].alias("v"), *(more(a, b) if more else []))

    def close(a, b):
        grow = pad(a) if callable(pad) else F.lit(pad)
        return ((a["l"] - grow <= F.greatest(b["l"], b["r"])) & (b["l"] - grow <= F.greatest(a["l"], a["r"]))
                & (a["t"] - grow <= F.greatest(b["t"], b["b"])) & (b["t"] - grow <= F.greatest(a["t"], a["b"])))

    def first_links(xs):
        return F.flatten(F.transform(xs, lambda a: F.transform(F.filter(xs, lambda b: (a[row_id] < b[row_id]) & close(a, b) & link(a, b)), lambda b: entry(a, b))))

    def new_links(xs):
        """Links with a changed row at one end or both, each once."""
        def of(c):
            others = F.filter(xs, lambda y: close(c, y) & (y[row_id] != c[row_id]) & (~y["_moved"] | (y[row_id] > c[row_id])))
            pairs = F.transform(others, lambda y: F.when(c[row_id] < y[row_id], F.struct(c.alias("a"), y.alias("b"))).otherwise(F.struct(y.alias("a"), c.alias("b"))))
            return F.transform(F.filter(pairs, lambda p: link(p["a"], p["b"])), lambda p: entry(p["a"], p["b"]))
        return F.flatten(F.transform(F.filter(xs, lambda x: x["_moved"]), of))

    def best_of_both(es):
        ends = F.array_distinct(F.flatten(F.transform(es, lambda e: F.array(e["u"], e["v"]))))
        best = F.transform(ends, lambda i: F.struct(i.alias("id"), F.array_min(F.filter(es, lambda e: (e["u"] == i) | (e["v"] == i))).alias("e")))
        return let(best, lambda bs: F.transform(
            F.filter(bs, lambda p: (p["id"] == p["e"]["u"]) & F.exists(bs, lambda q: (q["id"] == p["e"]["v"]) & (q["e"]["u"] == p["id"]) & (q["e"]["v"] == q["id"]))), lambda p: p["e"]))

    def turn(state, _):
        def after(ms):
            def left(xs):
                gone = lambda i: F.exists(ms, lambda m: (m["u"] == i) | (m["v"] == i))
                kept = F.filter(state["es"], lambda e: ~gone(e["u"]) & ~gone(e["v"]))
                return F.struct(xs.alias("xs"), F.concat(kept, new_links(xs)).alias("es"))
            return let(settle(state["xs"], ms), left)
        return F.when(F.size(state["es"]) > 0, let(best_of_both(state["es"]), after)).otherwise(state)

    def run(level):
        if level == 0:
            return turn
        deeper = run(level - 1)
        return lambda state, _: F.when(F.size(state["es"]) > 0, F.aggregate(F.sequence(F.lit(1), F.size(state["xs"])), state, deeper)).otherwise(state)

    start = let(F.col("_xs"), lambda xs: F.struct(xs.alias("xs"), first_links(xs).alias("es")))
    done = let(start, lambda s: run(depth)(s, None))["xs"]
    return arrays.select(*keys, F.explode(done).alias("x")).select(*keys, *[F.col("x")[c].alias(c) for c in rest])


def in_rounds(items: DataFrame, find: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame, DataFrame], DataFrame], keys: Sequence[str]) -> DataFrame:
    """``settle(rows, found)`` again and again on the pages where ``find(rows)`` finds something."""
    active, done = cut_lineage(items), []
    while True:
        found = cut_lineage(find(active))
        if found.isEmpty():
            return reduce(DataFrame.unionByName, [*done, active])
        busy = found.select(*keys).distinct()
        done.append(active.join(busy, list(keys), "left_anti"))
        active = cut_lineage(settle(active.join(busy, list(keys), "left_semi"), found).select(*items.columns))


def merged(items: DataFrame, link, rank, grown: dict[str, str], *, row_id: str, keys: Sequence[str] = ("page_id",), pad=0) -> DataFrame:
    """Rows united pair by pair while ``link(a, b)`` holds, best links first; the lesser id stays and ``grown`` names for each column what it
    becomes: ``min``, ``max`` or ``sum``. ``link`` may hold only for rectangles that meet when one grows by ``pad``, pixels or a function of a row
    that is the same for all rows of a page."""
    keys = list(keys)
    items = items.select(*keys, row_id, *grown)
    grow = pad({c: F.col(c) for c in grown}) if callable(pad) else pad
    pair = {"min": F.least, "max": F.greatest, "sum": lambda p, q: p + q}
    total = {"min": F.min, "max": F.max, "sum": F.sum}

    def unite(xs, ms):
        def with_own(x, own):
            other = F.filter(xs, lambda y: y[row_id] == own[0]["v"])
            one = lambda y: F.struct(x[row_id].alias(row_id), *[pair[how](x[c], y[0][c]).alias(c) for c, how in grown.items()], F.lit(True).alias("_moved"))
            same = F.struct(*[x[c].alias(c) for c in (row_id, *grown)], F.lit(False).alias("_moved"))
            return F.when(F.size(own) > 0, let(other, one)).otherwise(same)
        stay = F.filter(xs, lambda x: ~F.exists(ms, lambda m: m["v"] == x[row_id]))
        return F.transform(stay, lambda x: let(F.filter(ms, lambda m: m["u"] == x[row_id]), lambda own: with_own(x, own)))

    def settle(active, best):
        moves = mutual(best, keys).select(*keys, F.col("e.v").alias(row_id), F.col("e.u").alias("_to"))
        sums = [total[how](c).alias(c) for c, how in grown.items()]
        return active.join(moves, [*keys, row_id], "left").withColumn(row_id, F.coalesce("_to", row_id)).groupBy(*keys, row_id).agg(*sums)

    return by_fullness(
        items, keys, lambda rows: array_rounds(rows, link, rank, unite, row_id=row_id, keys=keys, pad=pad),
        lambda rows: in_rounds(rows, lambda active: best_links(active, link, rank, row_id=row_id, keys=keys, pad=grow), settle, keys))


# ---- lines --------------------------------------------------------------------------------------

#: Fixed value: in-region lines come before outside dialogue, and that before effects.
PRIORITY = {"BUBBLED": 3, "ORPHAN": 2}


def line_dedup(lines: DataFrame, percent: int = 65, row_id: str = "line_id", keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Of lines that share more than ``percent`` % of the smaller one, the one of higher category, then larger area, then lower id stays
    and grows over the other. In each round the lines that nothing dominates take in those whose strongest rival they are; then
    ranks are taken anew from the grown rectangles, until no two lines share that much."""
    keys = list(keys)
    level = reduce(lambda w, c: w.when(F.col("category") == c, -PRIORITY[c]), PRIORITY, F).otherwise(-1)

    def rows(df):
        return df.withColumn("_rank", F.struct(level.alias("level"), (-G.area(G.rect())).alias("area"), F.col(row_id).alias("id")))

    def find(active):
        ranked = rows(active)
        pairs = near_pairs(ranked, ranked, lambda a, b: (a["_rank"] < b["_rank"]) & G.containment_over(a, b, percent), keys=keys)
        ends = pairs.select(*keys, F.explode(F.array(
            F.struct(F.col(f"a.{row_id}").alias("id"), F.lit(None).cast(ranked.schema["_rank"].dataType).alias("by")),
            F.struct(F.col(f"b.{row_id}").alias("id"), F.col("a._rank").alias("by")))).alias("x"))
        return ends.groupBy(*keys, "x.id").agg(F.min("x.by").alias("by"))

    def settle(active, strongest):
        tops = strongest.where("by IS NULL").select(*keys, F.col("id").alias("_to"))
        moves = strongest.where("by IS NOT NULL").select(*keys, F.col("id").alias(row_id), F.col("by.id").alias("_to")).join(tops, [*keys, "_to"], "left_semi")
        moved = rows(active).join(moves, [*keys, row_id], "left").withColumn(row_id, F.coalesce("_to", row_id))
        return moved.groupBy(*keys, row_id).agg(F.min(F.struct("_rank", "category"))["category"].alias("category"), *enclosing())

    return in_rounds(lines.select(*keys, row_id, "category", *SIDES), find, settle, keys)


def unbubbled_extend(lines: DataFrame, row_id: str = "line_id") -> DataFrame:
    """Outside lines in one column become one: centres within .35 W, together at most 1.40 W wide, at most 3 W apart and sharing at
    most 30 % of the lower one's height. Nearest pairs first; the width limit is checked against what has grown so far. An
    effect makes the whole an effect. In-region lines stay as they are."""
    cols = ["page_id", row_id, "category", *SIDES]

    def link(a, b):
        shared = G.overlap_y(a, b) * 100 <= F.least(G.height(a), G.height(b)) * 30
        return ((G.center_dx(a, b) * 100 <= a["cw"] * 35) & (union_width(a, b) * 100 <= a["cw"] * 140) & (G.gap_y(a, b) <= a["cw"] * 3) & shared)

    outside = merged(lines.where("category <> 'BUBBLED'").select(*cols, "cw"), link, lambda a, b: [G.gap_y(a, b), G.center_dx(a, b)],
                     {"category": "max", **ENCLOSING, "cw": "min"}, row_id=row_id, pad=lambda a: a["cw"] * 3)
    return outside.select(*cols).unionByName(lines.where("category = 'BUBBLED'").select(*cols))


def edge_trim(units: DataFrame, page_w: int, page_h: int, row_id: str = "box_id", least: int = 10, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Overlapping rectangles are cut apart in the middle of their overlap, along the axis on which their centres are farther apart.

    Each overlap sets one cut line; a rectangle takes all its cuts at once, the innermost on each side. So one pass leaves no overlap,
    in any order. Rectangles are kept within the page, those under ``least`` pixels a side go."""
    keys = list(keys)
    meets = near_pairs(units, units, lambda a, b: (a[row_id] < b[row_id]) & (G.intersection(a, b) > 0), keys=keys)
    a, b = F.col("a"), F.col("b")
    dx, dy = G.center_x(b) - G.center_x(a), G.center_y(b) - G.center_y(a)
    y = G.floor_div(F.greatest(a["t"], b["t"]) + F.least(a["b"], b["b"]), 2)
    x = G.floor_div(F.greatest(a["l"], b["l"]) + F.least(a["r"], b["r"]), 2)
    stacked = F.abs(dy) >= F.abs(dx)

    def end(row, first):
        """The side of ``row`` that is cut; ``first``: whether it is the upper or left one."""
        return F.struct(row[row_id].alias(row_id), F.when(~stacked & ~first, x).alias("cl"), F.when(stacked & ~first, y).alias("ct"),
                        F.when(~stacked & first, x).alias("cr"), F.when(stacked & first, y).alias("cb"))

    before = F.when(stacked, dy >= 0).otherwise(dx >= 0)
    cuts = meets.select(*keys, F.explode(F.array(end(a, before), end(b, ~before))).alias("c")).groupBy(*keys, f"c.{row_id}").agg(
        F.max("c.cl").alias("cl"), F.max("c.ct").alias("ct"), F.min("c.cr").alias("cr"), F.min("c.cb").alias("cb"))
    hold = {"l": F.greatest("l", "cl"), "t": F.greatest("t", "ct"), "r": F.least("r", "cr"), "b": F.least("b", "cb")}
    most = {"l": page_w, "r": page_w, "t": page_h, "b": page_h}
    rest = [c for c in units.columns if c not in (*keys, row_id, *SIDES)]
    out = units.join(cuts, [*keys, row_id], "left").select(*keys, row_id, *[G.clamp(hold[s], 0, most[s]).alias(s) for s in SIDES], *rest)
    return out.where((F.col("r") - F.col("l") >= least) & (F.col("b") - F.col("t") >= least))


def crossover_resolve(lines: DataFrame, row_id: str = "line_id", least: int = 6) -> DataFrame:
    """Lines that overlap are settled, the largest overlap first, until none is left.

    Against an in-region line an outside one goes where 40 % of it is covered, else it is cut back to the other's edge. Two of a kind
    in one column (centres within .85 W, or together within 1.65 W, or sharing a quarter of the narrower width and within 2.1 W)
    become one, an effect if either is; others are cut at the middle. What is left of a line under ``least`` px wide goes."""
    cols = ["page_id", row_id, "category", *SIDES]

    def more(a, b):
        w, both = a["cw"], union_width(a, b)
        narrow = F.least(G.width(a), G.width(b))
        column = ((G.center_dx(a, b) * 100 < w * 85) | (both <= F.floor(w * 165 / 100)) |
                  ((narrow > 0) & (G.overlap_x(a, b) * 100 >= narrow * 25) & (both <= F.floor(w * 210 / 100))))
        a_in, b_in = a["category"] == "BUBBLED", b["category"] == "BUBBLED"
        a_left = G.center_x(a) < G.center_x(b)
        mid = F.when(a_left, G.floor_div(a["r"] + b["l"], 2)).otherwise(G.floor_div(b["r"] + a["l"], 2))

        def side(x, y, x_in, y_in, x_left):
            """New left and right side of x, and whether it goes."""
            trimmed, free = y_in & ~x_in, (x_in == y_in) & ~column
            lo = F.when(trimmed & ~x_left, F.greatest(x["l"], y["r"])).when(free & ~x_left, mid).otherwise(x["l"])
            hi = F.when(trimmed & x_left, F.least(x["r"], y["l"])).when(free & x_left, mid).otherwise(x["r"])
            gone = (trimmed & G.ratio_at_least(G.intersection(x, y), G.area(x), 40)) | ((trimmed | free) & (hi - lo < least))
            return F.struct(lo.cast("int").alias("l"), hi.cast("int").alias("r"), gone.alias("gone"))

        return [((a_in == b_in) & column).alias("one"), side(a, b, a_in, b_in, a_left).alias("x"),
                side(b, a, b_in, a_in, ~a_left).alias("y")]

    def settle(active, best):
        e = F.col("e")
        chosen = mutual(best, ["page_id"]).select("page_id", F.explode(F.array(
            F.struct(e["u"].alias("id"), e["u"].alias("to"), e["x"].alias("s")),
            F.struct(e["v"].alias("id"), F.when(e["one"], e["u"]).otherwise(e["v"]).alias("to"), e["y"].alias("s")))).alias("c"))
        moves = chosen.select("page_id", F.col("c.id").alias(row_id), F.col("c.to").alias("_to"), F.col("c.s.l").alias("_l"), F.col("c.s.r").alias("_r"), F.col("c.s.gone").alias("_gone"))
        moved = active.join(moves, ["page_id", row_id], "left").where("_gone IS NULL OR NOT _gone") \
            .withColumns({row_id: F.coalesce("_to", row_id), "l": F.coalesce("_l", "l"), "r": F.coalesce("_r", "r")})
        return moved.groupBy("page_id", row_id).agg(F.max("category").alias("category"), *enclosing(), F.min("cw").alias("cw"))

    def find(active):
        return best_links(active, meets, largest, row_id=row_id, keys=["page_id"], pad=0, more=more)

    def settled(xs, ms):
        """The array form: what a link says about its row, then rows of one id united."""
        def says(x):
            of = F.filter(ms, lambda m: (m["u"] == x[row_id]) | (m["v"] == x[row_id]))
            return let(of, lambda o: F.when(F.size(o) > 0, F.struct(
                F.when((o[0]["v"] == x[row_id]) & o[0]["one"], o[0]["u"]).otherwise(x[row_id]).alias("to"), F.when(o[0]["u"] == x[row_id], o[0]["x"]).otherwise(o[0]["y"]).alias("s"))))

        def placed(x):
            return let(says(x), lambda c: F.struct(
                F.coalesce(c["to"], x[row_id]).alias(row_id), x["category"].alias("category"), F.coalesce(c["s"]["l"], x["l"]).alias("l"), x["t"].alias("t"),
                F.coalesce(c["s"]["r"], x["r"]).alias("r"), x["b"].alias("b"), x["cw"].alias("cw"), c.isNotNull().alias("_moved"), F.coalesce(c["s"]["gone"], F.lit(False)).alias("_gone"),
                (c["to"] < x[row_id]).alias("_into")))

        def one(x, other):
            both = lambda f, c: F.when(F.size(other) > 0, f(x[c], other[0][c])).otherwise(x[c])
            return F.struct(x[row_id].alias(row_id), both(F.greatest, "category").alias("category"), both(F.least, "l").alias("l"), both(F.least, "t").alias("t"), both(F.greatest, "r").alias("r"),
                            both(F.greatest, "b").alias("b"), x["cw"].alias("cw"), x["_moved"].alias("_moved"))

        def united(ys):
            into = F.filter(ys, lambda y: F.coalesce(y["_into"], F.lit(False)))
            return F.transform(F.filter(ys, lambda y: ~F.coalesce(y["_into"], F.lit(False))), lambda x: let(F.filter(into, lambda y: y[row_id] == x[row_id]), lambda other: one(x, other)))

        return let(F.filter(F.transform(xs, placed), lambda y: ~y["_gone"]), united)

    def meets(a, b):
        return (G.overlap_x(a, b) > 0) & (G.overlap_y(a, b) > 0)

    largest = lambda a, b: [-G.intersection(a, b)]
    rows = lines.select(*cols, "cw")
    return by_fullness(rows, ["page_id"], lambda d: array_rounds(d, meets, largest, settled, row_id=row_id, keys=["page_id"], depth=3, more=more).select(*cols),
                       lambda d: in_rounds(d, find, settle, ["page_id"]).select(*cols))


def united(units: DataFrame, rule, row_id: str = "unit_id", keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Rectangles that ``rule(a, b, shared, smaller)`` calls one, joined until none are, those that share most first. ``n`` adds up."""
    def link(a, b):
        shared = G.intersection(a, b)
        return (shared > 0) & rule(a, b, shared, G.min_area(a, b))

    return merged(units.select(*keys, row_id, *SIDES, "n"), link, lambda a, b: [-G.intersection(a, b)], ENCLOSING | {"n": "sum"}, row_id=row_id, keys=keys)


# ---- boxes --------------------------------------------------------------------------------------

def recombine_glyphs(boxes: DataFrame, row_id: str = "box_id") -> DataFrame:
    """Boxes of one split character become one: nested or touching boxes, parts side by side, parts one above the other, as long as
    the whole fits one character (``cwr``, the region's width unit, or ``cw``, the page's, where neither box has a region). Nearest
    pairs first. Boxes of two regions never join; a joined box stays in the region of its parts."""
    def link(a, b):
        w = F.coalesce(a["cwr"], b["cwr"], a["cw"])
        uw, uh = union_width(a, b), union_height(a, b)
        near = lambda p, q: (p["l"] - 4 <= q["l"]) & (p["t"] - 4 <= q["t"]) & (p["r"] + 4 >= q["r"]) & (p["b"] + 4 >= q["b"])
        nested = G.ratio_at_least(G.intersection(a, b), G.min_area(a, b), 35) | near(a, b) | near(b, a)
        low, high = F.least(G.width(a), G.width(b)), F.greatest(G.width(a), G.width(b))
        beside = ((G.overlap_y(a, b) * 100 >= F.greatest(F.lit(1), F.least(G.height(a), G.height(b))) * 40) & (G.gap_x(a, b) <= F.greatest(F.lit(6), F.floor(w * 22 / 100)))
                  & ((high * 100 <= w * 85) | ((low * 100 <= w * 60) & (high * 100 <= w * 115)))
                  & (uw * 100 <= w * 125) & (uh <= F.greatest(G.height(a), G.height(b)) + F.floor(w * 30 / 100)))
        above = (((G.overlap_x(a, b) * 100 >= F.greatest(F.lit(1), low) * 40) | (G.center_dx(a, b) * 100 <= w * 35)) & (G.gap_y(a, b) <= F.greatest(F.lit(6), F.floor(w * 25 / 100)))
                 & (uh * 100 <= w * 128) & (uw * 100 <= w * 125))
        alike = a["region_id"].isNull() | b["region_id"].isNull() | (a["region_id"] == b["region_id"])
        return alike & (nested | beside | above)

    rows = boxes.select("page_id", row_id, "region_id", *SIDES, "cw", "cwr")
    return merged(rows, link, lambda a, b: [G.gap_x(a, b) + G.gap_y(a, b), union_width(a, b).cast("long") * union_height(a, b)],
                  {"region_id": "min", **ENCLOSING, "cw": "min", "cwr": "min"}, row_id=row_id, pad=12)


def reach_seeded(boxes: DataFrame, percent: int = 250, row_id: str = "box_id", label: str = "cluster_id") -> DataFrame:
    """Clusters grown from the lowest box that is in none yet: a box reaches those within ``percent`` % of its own longer side, which
    need not reach it back. A box's cluster is the lowest id from which a way leads to it.

    On ordinary pages the boxes of a page's array are taken once each: from those that the cluster reached last, or else the lowest that is
    left. On fuller ones labels run along the directed links and, as a label's own label leads to the same boxes, also jump to it."""
    side = F.greatest(G.width(G.rect()), G.height(G.rect()))
    sized = boxes.withColumn("_reach", F.floor(side * percent / 100).cast("int"))
    reaches = lambda x, y: (G.gap_x(x, y) <= x["_reach"]) & (G.gap_y(x, y) <= x["_reach"])
    labelled = by_fullness(sized, ["page_id"], lambda rows: searched(rows, reaches, row_id=row_id, keys=["page_id"], label="_label"), lambda rows: rows.join(_reached_in_joins(rows, row_id), ["page_id", row_id]))
    return labelled.select(*boxes.columns, F.col("_label").alias(label))


def _reached_in_joins(sized: DataFrame, row_id: str) -> DataFrame:
    sized = cut_lineage(sized.select("page_id", row_id, *SIDES, "_reach"))
    pairs = near_pairs(sized, sized, lambda a, b: (a[row_id] != b[row_id]) & (G.gap_x(a, b) <= a["_reach"]) & (G.gap_y(a, b) <= a["_reach"]), pad=F.col("_reach"))
    links = cut_lineage(pairs.select("page_id", F.col(f"a.{row_id}").alias("u"), F.col(f"b.{row_id}").alias("v")))
    state = sized.select("page_id", F.col(row_id).alias("id"), F.col(row_id).alias("label"), F.lit(True).alias("new"))
    while True:
        fresh = state.where("new").select("page_id", F.col("id").alias("u"), "label")
        come = links.join(fresh, ["page_id", "u"]).groupBy("page_id", F.col("v").alias("id")).agg(F.min("label").alias("come"))
        jump = state.where("id <> label").select("page_id", F.col("id").alias("label"), F.col("label").alias("jump"))
        best = F.least("label", "come", "jump")
        state = cut_lineage(state.join(come, ["page_id", "id"], "left").join(jump, ["page_id", "label"], "left")
                            .select("page_id", "id", best.alias("label"), (best < F.col("label")).alias("new")))
        if state.where("new").isEmpty():
            return state.select("page_id", F.col("id").alias(row_id), F.col("label").alias("_label"))


#: Where a line in the result comes from.
GIVEN, FROM_BOX, FROM_REGION = 0, 1, 2


def reconcile_uncovered(lines: DataFrame, boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """``page_id, origin, line_id, category, l, t, r, b``: the lines, grown and added to until every box of ``boxes`` (with ``category`` and
    ``cw``) is covered by centre or 35 %.

    In each round uncovered boxes look for the first line they may extend: in their region (the one that shares most with them, if it holds
    their centre or 35 % of them) an in-region line with its centre within .75 W, elsewhere an outside line within .8 W and 2.0 W
    vertically. Of the boxes without one, those with no lower such box in the same reach start a line (``origin`` FROM_BOX, the
    box's id); the others look again next round, at the lines that this one has grown and started. At last a region
    with boxes but without an in-region line gets one around them (FROM_REGION, the region's id).

    Pages of up to ``IN_ARRAY`` boxes, lines and regions without nulls run all rounds in their arrays, so each table is spread by page once; the
    others through joins."""
    boxes = boxes.select("page_id", "box_id", "category", *SIDES, "cw")
    lines, regions = lines.select("page_id", "line_id", "category", *SIDES), regions.select("page_id", "region_id", *SIDES)
    tables = (lines, boxes, regions)
    most = min(IN_ARRAY, page_row_limit(lines.sparkSession))
    unknown = lambda d: reduce(lambda p, q: p | q, [F.col(c).isNull() for c in d.columns])
    full = [d.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max(unknown(d)).alias("gap")).where((F.col("n") > most) | F.col("gap")).select("page_id") for d in tables]
    hot = cut_lineage(reduce(DataFrame.unionByName, full).distinct())
    if hot.isEmpty():
        return _reconciled_in_arrays(*tables)
    same = F.col("page_id").eqNullSafe(F.col("_hot"))
    few, rest = zip(*[[d.join(hot.withColumnRenamed("page_id", "_hot"), same, how).select(*d.columns) for how in ("left_anti", "left_semi")] for d in tables])
    return _reconciled_in_arrays(*few).unionByName(_reconciled_in_joins(*rest))


def _look(x) -> dict[str, Column]:
    """The rectangle a box looks in: beside its centre over the region's height, or around it."""
    inside, reach, far = x["region_id"].isNotNull(), F.floor(x["cw"] * 75 / 100).cast("int"), x["cw"] * 2
    cx = G.center_x(x)
    return {"l": F.when(inside, cx - reach).otherwise(x["l"] - far), "t": F.when(inside, x["gt"]).otherwise(x["t"] - far),
            "r": F.when(inside, cx + reach).otherwise(x["r"] + far), "b": F.when(inside, x["gb"]).otherwise(x["b"] + far)}


def _beside(x, rect) -> Column:
    return G.center_dx(x["box"], rect) * 100 <= x["cw"] * 75


def _around(x, rect) -> Column:
    return (G.center_dx(x["box"], rect) * 100 <= x["cw"] * 80) & (G.gap_y(x["box"], rect) <= x["cw"] * 2)


def _extends(x, y) -> Column:
    frame = {s: x[f"g{s}"] for s in SIDES}
    within = (y["category"] == "BUBBLED") & (G.holds_center(frame, y) | (G.intersection(frame, y) > 0)) & _beside(x, y)
    return F.when(x["region_id"].isNotNull(), within).otherwise((y["category"] != "BUBBLED") & _around(x, y))


def _before(x, y) -> Column:
    both_in = (x["region_id"] == y["region_id"]) & _beside(x, y["box"])
    return (x["box_id"] < y["box_id"]) & F.when(x["region_id"].isNotNull(), F.coalesce(both_in, F.lit(False))).otherwise(y["region_id"].isNull() & _around(x, y["box"]))


def _holds(x, g) -> Column:
    return (G.intersection(x, g) > 0) & (G.holds_center(g, x) | G.covered_at_least(x, g, 35))


def _in_line_of(g, y) -> Column:
    return G.holds_center(g, y) | (G.intersection(g, y) > 0)


def _new_line(x) -> dict[str, Column]:
    """Category and rectangle of the line that a box starts."""
    inside, half, cx = x["region_id"].isNotNull(), F.floor(x["cw"] * 54 / 100).cast("int"), G.center_x(x)
    return {"category": F.when(inside, "BUBBLED").when(x["category"] == "SFX", "SFX").otherwise("ORPHAN"),
            "l": F.when(inside, F.greatest(x["gl"], F.least(cx - half, x["l"]))).otherwise(x["l"]), "t": F.when(inside, F.greatest(x["gt"], x["t"])).otherwise(x["t"]),
            "r": F.when(inside, F.least(x["gr"], F.greatest(cx + half, x["r"]))).otherwise(x["r"]), "b": F.when(inside, F.least(x["gb"], x["b"])).otherwise(x["b"])}


def _reconciled_in_arrays(lines: DataFrame, boxes: DataFrame, regions: DataFrame) -> DataFrame:
    id_type = lines.schema["line_id"].dataType
    listed = lambda d, name, *cols: d.groupBy("page_id").agg(F.collect_list(F.struct(*cols)).alias(name))
    ls = listed(lines, "ls", F.lit(GIVEN).alias("origin"), "line_id", "category", *SIDES)
    bs = listed(boxes, "bs", "box_id", "category", *SIDES, "cw")
    gs = listed(regions, "gs", "region_id", *SIDES)
    d = ls.join(bs.join(gs, "page_id", "left"), "page_id", "full")  # regions matter to boxes only
    d = d.select("page_id", *[F.coalesce(n, F.array().cast(t.schema[n].dataType)).alias(n) for t, n in ((ls, "ls"), (bs, "bs"), (gs, "gs"))])
    covered = lambda b, by: F.exists(by, lambda y: touch(b, y) & covers_box(b, y))
    line = lambda origin, row_id, of: F.struct(F.lit(origin).alias("origin"), row_id.cast(id_type).alias("line_id"), of["category"].alias("category"), *[of[s].cast("int").alias(s) for s in SIDES])

    def seeker(x):
        entry = lambda g: F.struct((-G.intersection(x, g)).alias("k"), g["region_id"].alias("region_id"), *[g[s].alias(f"g{s}") for s in SIDES])
        own = F.array_min(F.transform(F.filter("gs", lambda g: touch(x, g) & _holds(x, g)), entry))

        def placed(o):
            row = {**{c: x[c] for c in ("box_id", "category", *SIDES, "cw")}, **{c: o[c] for c in ("region_id", *[f"g{s}" for s in SIDES])}}
            return F.struct(*[row[c].alias(c) for c in row if c not in SIDES], F.struct(*[x[s].alias(s) for s in SIDES]).alias("box"), *[c.alias(s) for s, c in _look(row).items()])
        return let(own, placed)

    def turn(state, _):
        def target(x):
            met = F.filter(state["ls"], lambda y: touch(x, y) & _extends(x, y))
            return F.struct(x.alias("x"), F.array_min(F.transform(met, lambda y: F.struct(y["origin"].alias("origin"), y["line_id"].alias("line_id")))).alias("to"))

        def split(ts):
            free = F.transform(F.filter(ts, lambda e: e["to"].isNull()), lambda e: e["x"])
            waits = lambda xs: F.transform(xs, lambda y: F.struct(y.alias("x"), F.exists(xs, lambda x: touch(x, y) & _before(x, y)).alias("waits")))
            return let(let(free, waits), lambda ws: after(F.filter(ts, lambda e: e["to"].isNotNull()), ws))

        def after(taken, ws):
            def grown(y):
                own = F.filter(taken, lambda e: (e["to"]["origin"] == y["origin"]) & (e["to"]["line_id"] == y["line_id"]))
                side = lambda o, s: (F.least if s in "lt" else F.greatest)(y[s], (F.array_min if s in "lt" else F.array_max)(F.transform(o, lambda e: e["x"]["box"][s])))
                return let(own, lambda o: F.struct(*[y[c].alias(c) for c in ("origin", "line_id", "category")], *[side(o, s).alias(s) for s in SIDES]))

            def started(w):
                x = w["x"]
                row = {**{c: x[c] for c in ("category", "cw", "region_id", *[f"g{s}" for s in SIDES])}, **{s: x["box"][s] for s in SIDES}}
                return line(FROM_BOX, x["box_id"], _new_line(row))
            now = F.concat(F.transform(state["ls"], grown), F.transform(F.filter(ws, lambda w: ~w["waits"]), started))
            left = lambda ys: F.filter(F.transform(F.filter(ws, lambda w: w["waits"]), lambda w: w["x"]), lambda x: ~covered(x["box"], ys))
            return let(now, lambda ys: F.struct(ys.alias("ls"), left(ys).alias("xs")))
        return F.when(F.size(state["xs"]) > 0, let(F.transform(state["xs"], target), split)).otherwise(state)

    d = d.withColumn("xs", F.transform(F.filter("bs", lambda x: ~covered(x, "ls")), seeker))
    start = F.struct("ls", "xs")
    d = d.withColumn("ls", F.when(F.size("xs") > 0, F.aggregate(F.sequence(F.lit(1), F.size("xs")), start, turn)["ls"]).otherwise(F.col("ls")))

    def around(g):
        def bound(held):
            low, high = (lambda c: F.array_min(F.transform(held, lambda x: x[c]))), (lambda c: F.array_max(F.transform(held, lambda x: x[c])))
            row = {**{s: (low if s in "lt" else high)(s) for s in SIDES}, "cw": low("cw"), "region_id": g["region_id"], **{f"g{s}": g[s] for s in SIDES}, "category": F.lit("BUBBLED")}
            return F.when(F.size(held) > 0, line(FROM_REGION, g["region_id"], _new_line(row)))
        return let(F.filter("bs", lambda x: touch(x, g) & inked_in(x, g)), bound)

    bare = F.filter("gs", lambda g: ~F.exists("ls", lambda y: (y["category"] == "BUBBLED") & touch(g, y) & _in_line_of(g, y)))
    added = F.filter(F.transform(bare, around), lambda x: x.isNotNull())
    return d.select("page_id", F.explode(F.concat("ls", added)).alias("y")).select("page_id", "y.*")


def _reconciled_in_joins(lines: DataFrame, boxes: DataFrame, regions: DataFrame) -> DataFrame:
    page, a, b = ["page_id"], F.col("a"), F.col("b")
    box_cols = ["page_id", "box_id", "category", *SIDES, "cw"]
    boxes = boxes.select(*box_cols)
    line_cols = ["page_id", "origin", "line_id", "category", *SIDES]
    given = lines.withColumn("origin", F.lit(GIVEN)).select(*line_cols)
    left = uncovered(boxes, lines)
    own = near_pairs(left, regions.select("page_id", "region_id", *SIDES), _holds)
    own = own.groupBy("page_id", a["box_id"].alias("box_id")).agg(F.min(F.struct((-G.intersection(a, b)).alias("k"), b["region_id"].alias("region_id"), *[b[s].alias(f"g{s}") for s in SIDES])).alias("g"))
    left = left.join(own, ["page_id", "box_id"], "left").select(*box_cols, *[F.col(f"g.{c}").alias(c) for c in ("region_id", "gl", "gt", "gr", "gb")])
    left = cut_lineage(left)
    pages = left.select("page_id").distinct()
    quiet, now = given.join(pages, page, "left_anti"), cut_lineage(given.join(pages, page, "left_semi"))

    def looking(rows):
        return rows.withColumn("box", F.struct(*SIDES)).withColumns(_look({c: F.col(c) for c in rows.columns}))

    while not left.isEmpty():
        targets = near_pairs(looking(left), now, _extends).groupBy("page_id", a["box_id"].alias("box_id")).agg(F.min(F.struct(b["origin"].alias("origin"), b["line_id"].alias("line_id"))).alias("to"))
        placed = cut_lineage(left.join(targets, ["page_id", "box_id"], "left"))
        free = placed.where("to IS NULL").drop("to")
        waiting = cut_lineage(near_pairs(looking(free), looking(free), _before).select("page_id", b["box_id"].alias("box_id")).distinct())
        new = _new_line({c: F.col(c) for c in free.columns})
        started = free.join(waiting, ["page_id", "box_id"], "left_anti").select(
            "page_id", F.lit(FROM_BOX).alias("origin"), F.col("box_id").alias("line_id"), *[c.alias(n) for n, c in new.items()])
        taken = placed.where("to IS NOT NULL").select("page_id", "to.origin", "to.line_id", F.lit(None).cast("string").alias("category"), *SIDES)
        grown = now.unionByName(taken.select(*line_cols)).groupBy("page_id", "origin", "line_id").agg(F.max("category").alias("category"), *enclosing())
        now = cut_lineage(grown.select(*line_cols).unionByName(started.withColumn("line_id", F.col("line_id").cast(lines.schema["line_id"].dataType))))
        left = cut_lineage(drop_matched(free.join(waiting, ["page_id", "box_id"], "left_semi"), now.select("page_id", *SIDES), covers_box).select(*left.columns))

    every = quiet.unionByName(now)
    inked = near_pairs(boxes, regions.select("page_id", "region_id", *SIDES), inked_in)
    inked = inked.groupBy("page_id", b["region_id"].alias("line_id"), *[b[s].alias(f"g{s}") for s in SIDES]).agg(
        *[(F.min if s in "lt" else F.max)(a[s]).alias(s) for s in SIDES], F.min(a["cw"]).alias("cw"))
    has = near_pairs(regions.select("page_id", "region_id", *SIDES), every.where("category = 'BUBBLED'"), _in_line_of)
    bare = inked.join(has.select("page_id", a["region_id"].alias("line_id")).distinct(), ["page_id", "line_id"], "left_anti")
    half, cx = F.floor(F.col("cw") * 54 / 100).cast("int"), G.center_x(G.rect())
    added = bare.select("page_id", F.lit(FROM_REGION).alias("origin"), F.col("line_id").cast(lines.schema["line_id"].dataType).alias("line_id"), F.lit("BUBBLED").alias("category"),
                        F.greatest(F.col("gl"), F.least(cx - half, F.col("l"))).alias("l"), F.greatest("gt", "t").alias("t"),
                        F.least(F.col("gr"), F.greatest(cx + half, F.col("r"))).alias("r"), F.least("gb", "b").alias("b"))
    return every.unionByName(added)


# ---- columns ------------------------------------------------------------------------------------

def columns_outside(boxes: DataFrame) -> DataFrame:
    """Columns of boxes outside regions: centres within .60 W, at most 2.0 W apart and, where they overlap in height, by at most a quarter
    of the lower one. Nearest columns join first, by mean centre.

    ``orphan`` marks boxes of dialogue candidates, which only join each other: such a column is ORPHAN if it has two boxes or more, is at most
    1.45 W wide, at least 1.8 W high and 1.3 times as high as wide, at a uniform width of 1.15 W (18 to 52 px) or more;
    all others are SFX as large as their boxes. Columns under 6 px a side go."""
    start = boxes.select("page_id", "orphan", "box_id", *SIDES, "cw", F.lit(1).cast("long").alias("n"), G.center_x(G.rect()).cast("long").alias("s"))

    def apart(a, b):
        return F.abs(a["s"] / a["n"] - b["s"] / b["n"])

    def link(a, b):
        near = F.abs(a["s"] * b["n"] - b["s"] * a["n"]) * 100 <= a["cw"] * a["n"] * b["n"] * 60
        return near & (G.gap_y(a, b) <= a["cw"] * 2) & (G.overlap_y(a, b) * 100 <= F.least(G.height(a), G.height(b)) * 25)

    keys = ["page_id", "orphan"]
    columns = merged(start, link, lambda a, b: [apart(a, b), G.gap_y(a, b)], {**ENCLOSING, "cw": "min", "n": "sum", "s": "sum"},
                     row_id="box_id", keys=keys, pad=lambda a: a["cw"] * 2)
    half = F.floor(G.clamp(F.floor(F.col("cw") * 115 / 100), 18, 52) / 2).cast("int")
    cx = F.floor(F.col("s") / F.col("n")).cast("int")
    wide = columns.withColumns({"wl": F.least(cx - half, F.col("l")), "wr": F.greatest(cx + half, F.col("r")), "h": F.col("b") - F.col("t")})
    w = F.col("wr") - F.col("wl")
    proper = F.col("orphan") & (w * 100 <= F.col("cw") * 145) & (F.col("h") * 100 >= F.col("cw") * 180) & (F.col("n") >= 2) & (F.col("h") * 100 >= w * 130)
    out = wide.withColumn("_ok", proper).select("page_id", F.col("box_id").alias("column_id"), F.when(F.col("_ok"), "ORPHAN").otherwise("SFX").alias("category"),
                                                F.when(F.col("_ok"), F.col("wl")).otherwise(F.col("l")).alias("l"), "t",
                                                F.when(F.col("_ok"), F.col("wr")).otherwise(F.col("r")).alias("r"), "b", "n")
    return out.where("r - l >= 6 AND b - t >= 6").withColumnRenamed("n", "n_boxes")


#: The rule that a gap between neighbouring columns falls under; lower rules come first. Fixed values, in hundredths of W.
CORRIDOR, PITCH, WEAK, CAPACITY = 1, 2, 3, 4


def ruby_into_nearest(boxes: DataFrame, keys: Sequence[str], row_id: str = "box_id") -> DataFrame:
    """Boxes under .52 W wide and over 6 px high that aren't in line with a main box (.38 W) go into the nearest main box .38 to 1.40 W aside
    that shares some height; the others stay. Main boxes are taken as they were; ``absorbed`` counts what they took."""
    keys = list(keys)
    a = G.rect()
    rows = boxes.select(*keys, row_id, *SIDES, "cw")
    small = (G.width(a) * 100 < F.col("cw") * 52) & (G.height(a) > 6)
    narrow, main = rows.where(small), rows.where(~small)
    # In line with a main box however far above or below: heights don't count.
    flat = {"t": F.lit(0), "b": F.lit(0)}
    aligned = lambda p, q: G.center_dx(p, q) * 100 <= p["cw"] * 38
    spots = main.withColumns(flat | {"l": G.center_x(a), "r": G.center_x(a)}).select(*keys, *SIDES).distinct()
    tagged = narrow.select(*keys, row_id, *SIDES, "cw", *[F.col(s).alias(f"_{s}") for s in SIDES]).withColumns(flat | {"l": G.center_x(a), "r": G.center_x(a)})
    lone = drop_matched(tagged, spots, aligned, keys=keys, pad=F.col("cw")).withColumns({s: F.col(f"_{s}") for s in SIDES}).select(*rows.columns)
    held = best_match(lone, main, lambda p, q: (G.overlap_y(p, q) > 0) & (G.center_dx(p, q) * 100 >= p["cw"] * 38) & (G.center_dx(p, q) * 100 <= p["cw"] * 140),
                      rank=lambda p, q: [G.center_dx(p, q), q[row_id]], pick={"_into": row_id}, keys=keys, pad=F.col("cw") * 2)
    moves = held.where("_into IS NOT NULL").select(*keys, row_id, "_into")
    moved = rows.join(moves, [*keys, row_id], "left").withColumns({"_one": F.col("_into").isNotNull().cast("long"), row_id: F.coalesce("_into", row_id)})
    return moved.groupBy(*keys, row_id).agg(*enclosing(), F.min("cw").alias("cw"), F.sum("_one").alias("absorbed"))


def columns_in_region(boxes: DataFrame) -> DataFrame:
    """``boxes(page_id, region_id, box_id, l, t, r, b, cw, gl, gt, gr, gb)`` with the page's width unit and the region's frame ->
    ``page_id, region_id, column_no, l, t, r, b, n_boxes``: the columns of each region from left to right.

    Boxes are cut to the frame (under 6 px a side they go), nested ones (.40 of the smaller) become one, ruby goes into its main box. W
    is the region's upper median width of full characters. Boxes of equal centre are one column from the start; so a region has at
    most as many columns as pixels, however many boxes it holds. Then neighbouring columns join in ranked rounds, each round the gaps
    that are smaller than both gaps beside them, under the first rule that any gap of the region meets: one corridor (.75 W and 1.70 W together,
    or sharing 35 % and 1.85 W); a pitch under 1.15 W; a weak column (lower than 1.25 W or 35 % of the highest, two boxes at most) within
    1.40 W; more columns than the region can hold, the closest first, down to what it holds. A region that holds one column joins all.
    Columns get a uniform width of 1.08 W, stay within the frame and are cut at the seam to their neighbours, all seams at once."""
    keys = ["page_id", "region_id"]
    a = G.rect()
    cut = boxes.select(*keys, "box_id", F.greatest("l", "gl").alias("l"), F.greatest("t", "gt").alias("t"), F.least("r", "gr").alias("r"), F.least("b", "gb").alias("b"), "cw", "gl", "gt", "gr", "gb")
    cut = cut_lineage(cut.where("r - l >= 6 AND b - t >= 6"))
    frame = cut.groupBy(*keys).agg(F.min("cw").alias("pw"), *[F.min(c).alias(c) for c in ("gl", "gt", "gr", "gb")])
    whole = merged(cut.select(*keys, "box_id", *SIDES), lambda p, q: G.ratio_at_least(G.intersection(p, q), G.min_area(p, q), 40),
                   lambda p, q: [-G.intersection(p, q)], ENCLOSING, row_id="box_id", keys=keys)
    unit = whole.groupBy(*keys).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY IF(b - t >= 16 AND r - l >= 12, r - l, NULL) DESC)").cast("int").alias("_m"))
    unit = frame.join(unit, keys, "left").withColumn("cw", G.clamp(F.coalesce("_m", "pw"), 16, F.greatest(F.lit(48), F.floor(F.col("pw") * 3 / 2).cast("int")))).drop("_m", "pw")
    unit = unit.withColumn("most", F.greatest(F.lit(1), F.floor(((F.col("gr") - F.col("gl")) * 100 - F.col("cw") * 30) / (F.col("cw") * 120)).cast("int")))
    unit = cut_lineage(unit)
    clean = ruby_into_nearest(whole.join(unit.select(*keys, "cw"), keys), keys)
    state = clean.groupBy(*keys, G.center_x(a).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"), *enclosing()).withColumn("s", F.col("id") * F.col("n"))
    state = state.join(unit.select(*keys, "cw", "most"), keys)
    columns = _joined_columns(state, keys).join(unit.select(*keys, "gl", "gt", "gr", "gb"), keys)
    return _grounded(columns, keys)


def _joined_columns(state: DataFrame, keys: list[str]) -> DataFrame:
    """Rounds over the gaps of each region's columns (id, n, s, l, t, r, b, cw, most); a region has at most one column a pixel, so
    its window is bounded by its width."""
    names, done = state.columns, []
    line = W.partitionBy(*keys).orderBy("mean", "id")
    region = W.partitionBy(*keys)
    while True:
        w = F.col("cw")
        rows = state.withColumn("mean", F.col("s") / F.col("n"))
        rows = rows.withColumns({"nx": F.lead(F.struct("mean", "n", *SIDES)).over(line), "count": F.count(F.lit(1)).over(region), "high": F.max(F.col("b") - F.col("t")).over(region)})
        nx, own = F.col("nx"), {s: F.col(s) for s in SIDES}
        gap = nx["mean"] - F.col("mean")
        wide, narrow = union_width(own, nx), F.least(G.width(own), G.width(nx))
        weak = lambda x, n: ((x["b"] - x["t"]) * 100 < F.greatest(w * 125, F.col("high") * 35)) & (n <= 2)
        corridor = ((gap * 100 <= w * 75) & (wide * 100 <= w * 170)) | ((narrow > 0) & (G.overlap_x(own, nx) * 100 >= narrow * 35) & (wide * 100 <= w * 185))
        rule = F.when(corridor, CORRIDOR).when(gap * 100 < w * 115, PITCH).when((F.col("most") == 1) | ((weak(own, F.col("n")) | weak(nx, nx["n"])) & (gap * 100 <= w * 140)), WEAK) \
            .when(F.col("count") > F.col("most"), CAPACITY)
        rows = rows.withColumns({"gap": F.when(nx.isNotNull(), gap), "rule": F.when(nx.isNotNull(), rule)}).withColumn("first", F.min("rule").over(region))
        rows = rows.withColumn("g", F.when(F.col("rule") == F.col("first"), F.struct("gap", "id")))
        rows = rows.withColumns({"before": F.lag("g").over(line), "after": F.lead("g").over(line)})
        least = F.col("g").isNotNull() & F.coalesce(F.col("g") < F.col("before"), F.lit(True)) & F.coalesce(F.col("g") < F.col("after"), F.lit(True))
        rows = rows.withColumn("least", least).withColumn("nth", F.row_number().over(region.orderBy(F.col("least").desc(), "gap", "id")))
        join = F.col("least") & ((F.col("first") < CAPACITY) | (F.col("nth") <= F.col("count") - F.col("most")))
        rows = rows.withColumn("join", join).withColumn("to", F.when(F.lag("join", 1, False).over(line), F.lag("id").over(line)).otherwise(F.col("id")))
        rows = cut_lineage(rows.select(*names, "first", "to"))
        done.append(rows.where("first IS NULL").select(*names))
        active = rows.where("first IS NOT NULL")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done)
        state = active.groupBy(*keys, F.col("to").alias("id")).agg(F.sum("n").alias("n"), *enclosing(), F.sum("s").alias("s"), F.min("cw").alias("cw"), F.min("most").alias("most")).select(*names)


def _grounded(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Columns at their uniform width, within the frame, cut at the seams."""
    w = F.col("cw")
    floor = F.greatest(F.lit(16), F.floor(w * 75 / 100).cast("int"))
    d = columns.withColumn("least", floor).withColumn("mean", F.col("s") / F.col("n"))
    half = F.floor(G.clamp(F.floor(w * 108 / 100).cast("int"), F.col("least"), 56) / 2).cast("int")
    cx = F.floor("mean").cast("int")
    d = d.withColumns({"cl": F.greatest(F.least(cx - half, F.col("l")), F.col("gl")), "cr": F.least(F.greatest(cx + half, F.col("r")), F.col("gr")),
                       "ct": F.greatest("t", "gt"), "cb": F.least("b", "gb")})
    missing = F.col("least") - (F.col("cr") - F.col("cl"))
    d = d.withColumn("lack", F.when((missing > 0) & (F.col("gr") - F.col("gl") >= F.col("least")), missing).otherwise(0))
    d = d.withColumn("more", F.least(F.floor(F.col("lack") / 2).cast("int"), F.greatest(F.lit(0), F.col("cl") - F.col("gl"))))
    d = d.withColumns({"cl": F.col("cl") - F.col("more"), "cr": F.col("cr") + F.least(F.col("lack") - F.col("more"), F.greatest(F.lit(0), F.col("gr") - F.col("cr")))})
    d = d.where("cr - cl >= 8 AND cb - ct >= 12").withColumn("mid", F.floor((F.col("cl") + F.col("cr")) / 2).cast("int"))
    line = W.partitionBy(*keys).orderBy("mid", "id")
    d = d.withColumn("nx", F.lead(F.struct("cl", "ct", "cr", "cb", "l", "mean")).over(line))
    nx = F.col("nx")
    meets = (F.least("cb", nx["cb"]) > F.greatest("ct", nx["ct"])) & (F.col("cr") > nx["cl"])
    seam = F.when(F.col("r") <= nx["l"], F.floor((F.col("r") + nx["l"]) / 2)).otherwise(F.floor((F.col("mean") + nx["mean"]) / 2)).cast("int")
    lo, hi = F.col("cl") + F.col("least"), nx["cr"] - F.col("least")
    safe = F.when(lo <= hi, G.clamp(seam, lo, hi)).otherwise(F.floor((F.col("cl") + nx["cr"]) / 2).cast("int"))
    d = d.withColumn("cut", F.when(meets, safe)).withColumn("cut_before", F.lag("cut").over(line)).withColumn("column_no", F.row_number().over(line).cast("long"))
    return d.select(*keys, "column_no", F.greatest("cl", "cut_before").alias("l"), F.col("ct").alias("t"), F.least("cr", "cut").alias("r"), F.col("cb").alias("b"), F.col("n").alias("n_boxes"))
