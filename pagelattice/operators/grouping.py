"""Suppression, merging and clustering of boxes and lines.

Thresholds carry the defaults of the rule they belong to. Relative lengths are in units of a
character width, an integer column; see :func:`with_char_width`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagelattice.functions import geometry as G
from pagelattice.operators.joins import center_first, center_or_overlap
from pagelattice.operators.pagefold import cluster, fold, fold_pages, greedy_keep, hot_pages, independent_blocks, let, page_arrays, split
from pagelattice.operators.ranking import with_previous
from pagelattice.operators.spatial import apart, best_match, crowded, near_pairs, nearest_center
from pagelattice.session import cut_lineage

SIDES = ("l", "t", "r", "b")


def with_char_width(df: DataFrame, lo: int, hi: int, default: int, keys: Sequence[str] = ("page_id",), name: str = "cw",
                    size: Column | None = None, only: Column | None = None) -> DataFrame:
    """Add the upper median of ``size`` (box width) over the rows where ``only`` holds, clipped."""
    size = G.width(G.rect()) if size is None else size
    picked = df.select(*keys, (F.when(only, size) if only is not None else size).alias("_x"))
    unit = picked.groupBy(*keys).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _x DESC)").cast("int").alias("_m"))
    unit = unit.select(*keys, F.coalesce(G.clamp(F.col("_m"), lo, hi), F.lit(default)).alias(name))
    return df.join(unit, list(keys))


def with_glyph_widths(boxes: DataFrame) -> DataFrame:
    """Add ``cw`` and ``cwr``: the upper median width of upright boxes (of all where none is upright), clipped to 16..44, over the
    page and over the box's ``region_id`` (null outside regions)."""
    upright = F.when(F.col("b") - F.col("t") >= F.col("r") - F.col("l"), F.col("r") - F.col("l"))

    def unit(df, keys, name):
        rows = df.select(*keys, upright.alias("_u"), (F.col("r") - F.col("l")).alias("_a"))
        upper = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)").cast("int")
        return rows.groupBy(*keys).agg(G.clamp(F.coalesce(upper("_u"), upper("_a")), 16, 44).alias(name))

    page = unit(boxes, ["page_id"], "cw")
    region = unit(boxes.where("region_id IS NOT NULL"), ["page_id", "region_id"], "cwr")
    return boxes.join(page, "page_id").join(region, ["page_id", "region_id"], "left")


def times(factor: float, total: Column) -> Column:
    """``factor`` times half of ``total``, in doubles and in this order: the rules that measure in mean lengths are rounded that way, so a
    gap of 11 is under 1.1 times a mean height of 10."""
    return F.lit(factor) * (total / F.lit(2.0))


def short_side(a=None) -> Column:
    a = G.rect() if a is None else a
    return F.least(G.width(a), G.height(a))


# ---- suppression ----------------------------------------------------------------------------

def nms(boxes: DataFrame, iou: int = 35, row_id: str = "box_id", hot="find") -> DataFrame:
    """Best score first; drop what overlaps a kept box by more than ``iou`` % IoU."""
    return greedy_keep(boxes, lambda k, x: G.iou_over(k, x, iou), row_id=row_id, hot=hot,
                       order={"_s": -F.col("conf_m"), "_o": F.col(row_id)})


def nms_containment(boxes: DataFrame, iou: int = 45, inside: int = 70, row_id: str = "box_id", hot="find") -> DataFrame:
    return greedy_keep(boxes, lambda k, x: G.iou_over(k, x, iou) | G.containment_over(k, x, inside), row_id=row_id, hot=hot,
                       order={"_s": -F.col("conf_m"), "_o": F.col(row_id)})


def dedup_first(boxes: DataFrame, percent: int = 35, row_id: str = "box_id", hot="find") -> DataFrame:
    """First come, first kept; drop what overlaps a kept box by more than ``percent`` % of the smaller."""
    return greedy_keep(boxes, lambda k, x: G.containment_over(k, x, percent), row_id=row_id, order={"_o": F.col(row_id)}, hot=hot)


def dedup_regions(regions: DataFrame, iou: int = 70, row_id: str = "region_id", hot="find") -> DataFrame:
    """First come, first kept by IoU, but a region flagged ``is_lobe`` is always kept."""
    return greedy_keep(regions, lambda k, x: ~x["is_lobe"] & G.iou_over(k, x, iou), row_id=row_id, order={"_o": F.col(row_id)}, hot=hot)


def fold_union(boxes: DataFrame, percent: int = 65, row_id: str = "region_id", hot="find") -> DataFrame:
    """One scan in input order: a box overlapping a kept one by more than ``percent`` % of the smaller
    enlarges the first such, else it is kept. The result keeps the id of the first member."""
    def scan(rows, keys):
        def step(kept, x):
            first = F.array_position(F.transform(kept, lambda k: G.containment_over(k, x, percent)), True)
            grown = lambda at: F.transform(kept, lambda k, i: F.when(i + 1 == at, F.struct(
                k[row_id].alias(row_id), *[c.alias(s) for s, c in G.union_rect(k, x).items()])).otherwise(k))
            return let(first, lambda at: F.when(at > 0, grown(at)).otherwise(F.concat(kept, F.array(x))))
        arrays = page_arrays(rows.select(*keys, row_id, *SIDES), keys, {})
        return arrays.select("page_id", F.inline(fold(F.col("items"), step)))

    return fold_pages(boxes.select("page_id", row_id, *SIDES), scan, row_id=row_id, hot=hot)


# ---- connected components -------------------------------------------------------------------

def proximity(a, b) -> Column:
    """Same column (1.25 W apart, gap 2.8 W) or parallel (gap 2.2 W, 15 % of the height shared or 1 W apart)."""
    w = a["cw"]
    column = (G.center_dx(a, b) * 100 <= w * 125) & (G.gap_y(a, b) * 10 <= w * 28)
    shared = (G.overlap_y(a, b) > 0) & (G.overlap_y(a, b) * 100 >= F.least(G.height(a), G.height(b)) * 15)
    return column | ((G.gap_x(a, b) * 10 <= w * 22) & (shared | (G.gap_y(a, b) <= w)))


def proximity_clusters(boxes: DataFrame, row_id: str = "box_id", hot="find") -> DataFrame:
    d = with_char_width(boxes, 16, 50, 16, size=short_side())
    return cluster(d, proximity, row_id=row_id, pad=F.floor(F.col("cw") * 3 / 2).cast("int"), hot=hot).drop("cw")


def reach_clusters(boxes: DataFrame, percent: int = 250, row_id: str = "box_id", hot="find") -> DataFrame:
    """Symmetric form of the reach rule: within ``percent`` % of the longer side of the larger box."""
    side = lambda a: F.greatest(G.width(a), G.height(a))

    def near(a, b):
        reach = F.greatest(side(a), side(b)) * percent
        return (G.gap_x(a, b) * 100 <= reach) & (G.gap_y(a, b) * 100 <= reach)

    return cluster(boxes, near, row_id=row_id, pad=F.ceil(side(G.rect()) * percent / 100).cast("int"), hot=hot)


def beside_or_collinear(a, b) -> Column:
    w = a["cw"]
    shared = (G.overlap_y(a, b) > 0) & (G.overlap_y(a, b) * 100 >= F.least(G.height(a), G.height(b)) * 22)
    return (((G.gap_x(a, b) * 100 <= w * 185) & shared)
            | ((G.center_dx(a, b) * 100 <= w * 75) & (G.gap_y(a, b) * 10 <= w * 14)))


def outside_clusters(lines: DataFrame, row_id: str = "line_id", hot="find") -> DataFrame:
    """Dialogue units of lines outside regions; W is the page's median line width, at least 10."""
    d = lines if "cw" in lines.columns else with_char_width(lines, 10, 1_000_000, 24)
    return cluster(d, beside_or_collinear, row_id=row_id, pad=F.col("cw"), hot=hot).drop("cw")


def same_fragment_group(a, b, rtl: bool = True) -> Column:
    """Neighbouring text fragments of one unit: adjacent aligned columns, stacked pieces of one
    column (rows and pieces of a row for horizontal text), or a 20 % overlap."""
    wa, wb, ha, hb = G.width(a), G.width(b), G.height(a), G.height(b)
    ox, oy = F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]), F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])
    gx, gy = G.gap_x(a, b), G.gap_y(a, b)
    mw, mh = F.least(wa, wb), F.least(ha, hb)
    off_y = F.abs(a["t"] + a["b"] - b["t"] - b["b"])
    off_x = F.abs(a["l"] + a["r"] - b["l"] - b["r"])
    upright = (((gx * 200 < (wa + wb) * 150) & (oy * 100 > mh * 35) & (off_y * 100 < mh * 110))
               | (((ox * 100 > mw * 35) | (gx < times(0.2, wa + wb))) & (gy < times(0.55, ha + hb))))
    flat = (((gy < times(1.35, ha + hb)) & (ox * 100 > mw * 40) & (off_x * 100 < mw * 90))
            | (((oy * 100 > mh * 40) | (gy < times(0.2, ha + hb))) & (gx * 200 < (wa + wb) * 50)))
    vertical = F.lit(True) if rtl else (ha * 100 > wa * 115) | (hb * 100 > wb * 115)
    return F.when(vertical, upright).otherwise(flat) | G.containment_over(a, b, 20)


def _longest(percent: int) -> Column:
    return F.ceil(F.greatest(G.width(G.rect()), G.height(G.rect())) * percent / 100).cast("int")


def fenced_fragments(boxes: DataFrame, regions: DataFrame, rtl: bool = True, fence: bool = False,
                     row_id: str = "box_id", hot="find") -> DataFrame:
    """Fragment groups that never join two regions; ``fence`` also keeps assigned from unassigned."""
    def near(a, b):
        ra, rb = a["region_id"], b["region_id"]
        apart = (ra != rb) if fence else (ra != rb) & (ra >= 0) & (rb >= 0)
        return ~apart & same_fragment_group(a, b, rtl)

    return cluster(center_or_overlap(boxes, regions), near, row_id=row_id, pad=_longest(75), hot=hot)


def cluster_bounds(clusters: DataFrame, keys: Sequence[str] = ("page_id", "cluster_id")) -> DataFrame:
    return clusters.groupBy(*keys).agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"),
                                       F.count(F.lit(1)).alias("n"))


def bridged_lines(boxes: DataFrame, regions: DataFrame, rtl: bool = True, row_id: str = "box_id", hot="find") -> DataFrame:
    """Lines through gaps of up to 2.5 characters in one column (row when ltr), inside one region."""
    def near(a, b):
        wa, wb, ha, hb = G.width(a), G.width(b), G.height(a), G.height(b)
        ok = ~((a["region_id"] >= 0) & (b["region_id"] >= 0) & (a["region_id"] != b["region_id"]))
        if rtl:
            line = (G.center_dx(a, b) * 100 < F.least(wa, wb) * 55) | ((F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])) * 100 > F.least(wa, wb) * 30)
            return ok & line & (G.gap_y(a, b) * 4 <= (ha + hb) * 5)
        line = (G.center_dy(a, b) * 100 < F.least(ha, hb) * 55) | ((F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])) * 100 > F.least(ha, hb) * 30)
        return ok & line & (G.gap_x(a, b) * 4 <= (wa + wb) * 5)

    d = center_first(boxes.select("page_id", row_id, *SIDES), regions)
    return cluster(d, near, row_id=row_id, pad=_longest(126), hot=hot)


def strict_lines(boxes: DataFrame, rtl: bool = True, row_id: str = "box_id", hot="find") -> DataFrame:
    """Lines without bridging: centres within 45 % of the narrower box and close by."""
    def near(a, b):
        wa, wb, ha, hb = G.width(a), G.width(b), G.height(a), G.height(b)
        if rtl:
            m, off, over, gap = F.least(wa, wb), G.center_dx(a, b), F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]), G.gap_y(a, b)
            room = F.greatest(times(1.1, ha + hb), times(1.8, wa + wb))
        else:
            m, off, over, gap = F.least(ha, hb), G.center_dy(a, b), F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]), G.gap_x(a, b)
            room = F.greatest(times(1.1, wa + wb), times(1.8, ha + hb))
        return (off * 100 < m * 45) & ((over * 100 > m * 35) | (off * 100 < m * 30)) & (gap < room)

    return cluster(boxes.select("page_id", row_id, *SIDES), near, row_id=row_id, pad=_longest(91), hot=hot)


def with_gutter_cells(boxes: DataFrame, gutters: DataFrame) -> DataFrame:
    """Per axis the number of gutters below, and up to, the box centre. Two centres have a gutter
    strictly between them iff the greater one's ``lt`` exceeds the smaller one's ``le``."""
    lists = gutters.groupBy("page_id").agg(F.collect_set("gutter_x").alias("_gx"), F.collect_set("gutter_y").alias("_gy"))
    a = G.rect()
    count = lambda col, test: F.coalesce(F.size(F.filter(F.coalesce(col, F.array().cast("array<int>")), test)), F.lit(0))
    return (boxes.join(lists, "page_id", "left")
            .withColumns({"x_lt": count("_gx", lambda g: g < G.center_x(a)), "x_le": count("_gx", lambda g: g <= G.center_x(a)),
                          "y_lt": count("_gy", lambda g: g < G.center_y(a)), "y_le": count("_gy", lambda g: g <= G.center_y(a))})
            .drop("_gx", "_gy"))


def outside_units(boxes: DataFrame, gutters: DataFrame, page_w: int, page_h: int, rtl: bool = True, pad: int = 6,
                  row_id: str = "box_id", hot="find") -> DataFrame:
    """Units of boxes outside regions: like-sized close neighbours on one side of every gutter."""
    def near(a, b):
        wa, wb, ha, hb = G.width(a), G.width(b), F.greatest(G.height(a), F.lit(1)), F.greatest(G.height(b), F.lit(1))
        split = lambda ax: (a[ax + "_lt"] > b[ax + "_le"]) | (b[ax + "_lt"] > a[ax + "_le"])
        gx, gy = G.gap_x(a, b), G.gap_y(a, b)
        upright = (((gx < times(0.85, wa + wb)) & (G.overlap_y(a, b) * 100 > F.least(ha, hb) * 40))
                   | ((gx * 200 < (wa + wb) * 25) & (gy < times(0.65, ha + hb))))
        flat = (((gy < times(0.8, ha + hb)) & (G.overlap_x(a, b) * 100 > F.least(wa, wb) * 40))
                | ((gy * 200 < (ha + hb) * 25) & (gx < times(0.6, wa + wb))))
        vertical = F.lit(True) if rtl else (ha * 10 > wa * 12) | (hb * 10 > wb * 12)
        return (~split("x") & ~split("y") & (F.greatest(ha, hb) * 10 <= F.least(ha, hb) * 16)
                & F.when(vertical, upright).otherwise(flat))

    c = cluster(with_gutter_cells(boxes.select("page_id", row_id, *SIDES), gutters), near, row_id=row_id, pad=_longest(50), hot=hot)
    u = cluster_bounds(c)
    u = u.withColumns({"l": F.greatest(F.col("l") - pad, F.lit(0)), "t": F.greatest(F.col("t") - pad, F.lit(0)),
                       "r": F.least(F.col("r") + pad, F.lit(page_w)), "b": F.least(F.col("b") + pad, F.lit(page_h))})
    return u.where((F.col("r") - F.col("l") >= 10) & (F.col("b") - F.col("t") >= 10))


def lobes(lines: DataFrame, regions: DataFrame, page_w: int, page_h: int, chunk: int = 2, pad: int = 8, hot="find") -> DataFrame:
    """Lobes of each region: chains of side-by-side lines that are not stair-stepped. A line that was cut at both seams may end left of
    its start; its negative width counts as such in the mean width."""
    def near(a, b):
        m = F.least(G.height(a), G.height(b))
        over = F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])
        stairs = ((F.abs(a["t"] - b["t"]) * 10 > m * 7) & (F.abs(a["b"] - b["b"]) * 10 > m * 7)) | (over * 10 < m * 3)
        return (G.gap_x(a, b) <= times(1.4, a["r"] - a["l"] + b["r"] - b["l"])) & (over > 0) & (over * 100 >= m * 35) & ~stairs

    owned = center_first(lines.select("page_id", "line_id", *SIDES), regions).where("region_id >= 0")
    c = cluster(owned, near, row_id="line_id", pad=_longest(70), keys=("page_id", "region_id"), hot=hot)
    u = cluster_bounds(c, ("page_id", "region_id", "cluster_id"))
    u = u.withColumns({"l": G.clamp(F.col("l") - pad, 0, page_w), "t": G.clamp(F.col("t") - pad, 0, page_h),
                       "r": G.clamp(F.col("r") + pad, 0, page_w), "b": G.clamp(F.col("b") + pad, 0, page_h)})
    return u.withColumn("line_fallback", (F.col("n") > chunk) | (F.col("b") - F.col("t") > 280) | (F.col("r") - F.col("l") > 220))


# ---- greedy assignment ----------------------------------------------------------------------

def seed_windows(lines: DataFrame, dx: int = 140, dy: int = 220, row_id: str = "line_id", hot="find") -> DataFrame:
    """The first unused line gathers all unused lines whose centre lies within (dx, dy) of its own.

    Seeds are the lines no earlier seed reaches; every line belongs to the first seed reaching it."""
    near = lambda k, x: (G.center_dx(k, x) < dx) & (G.center_dy(k, x) < dy)
    a = G.rect()
    point = {"l": G.center_x(a), "t": G.center_y(a), "r": G.center_x(a), "b": G.center_y(a), "height": G.height(a)}
    pts = lines.select("page_id", row_id, *SIDES).withColumns(point)
    reach = max(dx, dy)
    seeds = greedy_keep(pts, near, order={"_o": F.col(row_id)}, row_id=row_id, pad=(reach + 1) // 2, hot=hot)
    return best_match(pts, seeds, lambda x, s: near(s, x), rank=lambda x, s: [s[row_id]], pick={"cluster_id": row_id}, pad=reach)


def best_seed_window(lines: DataFrame, **kw) -> DataFrame:
    """Per page the window cluster with the largest summed height, the first on ties."""
    c = seed_windows(lines, **kw).groupBy("page_id", "cluster_id").agg(F.sum("height").alias("total_height"), F.count(F.lit(1)).alias("n_lines"))
    return c.groupBy("page_id").agg(F.min(F.struct((-F.col("total_height")).alias("k"), "cluster_id", "n_lines")).alias("m")).select(
        "page_id", "m.cluster_id", (-F.col("m.k")).alias("total_height"), "m.n_lines")


def absorb_near(units: DataFrame, boxes: DataFrame, reach: int = 6, percent: int = 20, hot="find") -> DataFrame:
    """Unassigned boxes join the first unit that holds their centre, overlaps by a fifth or lies
    within ``reach`` px; the unit grows before the next box is looked at. Returns the units."""
    rows = units.select("page_id", F.lit(0).alias("kind"), F.col("unit_id").alias("id"), *SIDES).unionByName(
        boxes.select("page_id", F.lit(1).alias("kind"), F.col("box_id").alias("id"), *SIDES))
    rows = rows.withColumn("row_id", F.col("id") * 2 + F.col("kind")).withColumn("n", F.lit(0))

    def scan(d, keys):
        def step(us, x):
            hit = lambda u: G.holds_center(u, x) | G.containment_over(u, x, percent) | ((G.gap_x(u, x) <= reach) & (G.gap_y(u, x) <= reach))
            grown = lambda at: F.transform(us, lambda u, i: F.when(i + 1 == at, F.struct(
                u["kind"].alias("kind"), u["id"].alias("id"), *[c.alias(s) for s, c in G.union_rect(u, x).items()],
                u["row_id"].alias("row_id"), (u["n"] + 1).alias("n"))).otherwise(u))
            return let(F.array_position(F.transform(us, hit), True), lambda at: F.when(at > 0, grown(at)).otherwise(us))
        arrays = page_arrays(d, keys, {})
        start = F.filter("items", lambda i: i["kind"] == 0)
        out = F.aggregate(F.filter("items", lambda i: i["kind"] == 1), start, step)
        return arrays.select("page_id", F.inline(out))

    return fold_pages(rows, scan, row_id="row_id", pad=reach, hot=hot).select(
        "page_id", F.col("id").alias("unit_id"), *SIDES, F.col("n").alias("n_absorbed"))


def _with_group_flags(d: DataFrame, by: list[str], narrow: Column) -> DataFrame:
    """Whole-group facts the scans need even when a group is cut into blocks."""
    facts = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(narrow).alias("n_narrow"))
    return d.join(facts, by)


def ruby_absorb(boxes: DataFrame, by: Sequence[str] = ("page_id", "region_id"), row_id: str = "box_id", hot="find") -> DataFrame:
    """Narrow boxes (below .52 W) in line with a main box stay, otherwise the nearest box .38 to 1.40 W
    aside swallows them. Rows carry ``absorbed``, the number of boxes they took in."""
    by = list(by)
    narrow = lambda x: (G.width(x) * 100 < x["cw"] * 52) & (G.height(x) > 6)
    flat = {**G.rect(), "cw": F.col("cw")}
    d = _with_group_flags(boxes.select(*by, row_id, *SIDES, "cw"), by, narrow(flat)).withColumn("absorbed", F.lit(0))

    def scan(rows, keys):
        arrays = page_arrays(rows, keys, {"_o": F.col(row_id)})
        main = F.filter("items", lambda x: ~narrow(x))

        def step(acc, x):
            aligned = F.exists(main, lambda m: G.center_dx(m, x) * 100 <= x["cw"] * 38)
            side = lambda k: (G.overlap_y(k, x) > 0) & (G.center_dx(k, x) * 100 >= x["cw"] * 38) & (G.center_dx(k, x) * 100 <= x["cw"] * 140)
            closest = F.array_min(F.transform(acc, lambda k, i: F.when(side(k), F.struct(G.center_dx(k, x).alias("d"), i.alias("i")))))["i"]
            grown = lambda at: F.transform(acc, lambda k, i: F.when(i == at, F.struct(
                k["_o"].alias("_o"), k[row_id].alias(row_id), *[c.alias(s) for s, c in G.union_rect(k, x).items()],
                k["cw"].alias("cw"), k["n_all"].alias("n_all"), k["n_narrow"].alias("n_narrow"),
                (k["absorbed"] + 1).alias("absorbed"))).otherwise(k))
            return let(F.when(aligned, F.lit(None)).otherwise(closest), lambda at: F.when(at.isNull(), F.concat(acc, F.array(x))).otherwise(grown(at)))

        done = F.aggregate(F.filter("items", narrow), main, step)
        first = F.get("items", F.lit(0))
        plain = (first["n_narrow"] == first["n_all"]) | (first["n_narrow"] == 0)
        return arrays.select(*by, F.inline(F.when(plain, F.col("items")).otherwise(done))).select(*by, row_id, *SIDES, "cw", "absorbed")

    # Alignment ignores the vertical distance, so groups are only cut along x.
    return fold_pages(d, scan, row_id=row_id, pad=100, keys=by, flat=True, hot=hot)


def ruby_absorb_gap(boxes: DataFrame, by: Sequence[str] = ("page_id", "region_id"), gap: int = 12, row_id: str = "box_id",
                    hot="find") -> DataFrame:
    """Older rule: boxes below .48 W join the first wider box beside them within ``gap`` px, or vanish.
    Groups of one box are left alone. Rows carry ``ruby_count``, the narrow boxes of the group."""
    by = list(by)
    boxes = boxes.select(*by, row_id, *SIDES)
    small, big = split(boxes, by, hot)

    def absorbed(arrays, narrow, count):
        def step(acc, x):
            first = F.array_position(F.transform(acc, lambda k: (G.overlap_y(k, x) > 0) & (G.gap_x(k, x) <= gap)), True)
            grown = lambda at: F.transform(acc, lambda k, i: F.when(i + 1 == at, F.struct(
                *[k[c].alias(c) for c in ("_o", row_id)], *[c.alias(s) for s, c in G.union_rect(k, x).items()], *[k[c].alias(c) for c in more])).otherwise(k))
            return let(first, lambda at: F.when(at > 0, grown(at)).otherwise(acc))

        more = [c for c in ("cw", "n_all", "n_narrow") if count is None]
        done = F.aggregate(F.filter("items", narrow), F.filter("items", lambda x: ~narrow(x)), step)
        rows = arrays.select(*by, F.inline(done), *([] if count is None else [count.alias("ruby_count")]))
        return rows.select(*by, row_id, *SIDES, F.when(F.col("n_all") > 1, F.col("n_narrow")).otherwise(0).alias("ruby_count") if count is None else F.col("ruby_count"))

    # Ordinary groups: width unit and counts come from the group's array, so its rows are read once.
    arrays = page_arrays(small, by, {"_o": F.col(row_id)})
    widths = F.sort_array(F.transform("items", G.width))
    arrays = arrays.withColumn("cw", F.coalesce(G.clamp(F.get(widths, F.floor(F.size("items") / 2).cast("int")), 14, 40), F.lit(14)))
    narrow = lambda x: (G.width(x) * 100 < F.col("cw") * 48) & (F.size("items") > 1)
    out = absorbed(arrays, narrow, F.size(F.filter("items", narrow)).cast("long"))
    if big is None:
        return out
    d = with_char_width(big, 14, 40, 14, keys=by)
    d = _with_group_flags(d, by, G.width(G.rect()) * 100 < F.col("cw") * 48)
    scan = lambda rows, keys: absorbed(page_arrays(rows, keys, {"_o": F.col(row_id)}), lambda x: (G.width(x) * 100 < x["cw"] * 48) & (x["n_all"] > 1), None)
    blocks = independent_blocks(d, row_id=row_id, pad=gap, keys=by)
    return out.unionByName(scan(blocks, by + ["_block"]))


# ---- columns and lines ----------------------------------------------------------------------

def split_smear(boxes: DataFrame, by: Sequence[str] = ("page_id", "region_id"), row_id: str = "box_id") -> DataFrame:
    """A box at least 1.85 W wide that rounds to two or more characters becomes that many boxes.
    ``piece`` numbers the parts; W is the group's median width clipped to 16..34."""
    d = with_char_width(boxes, 16, 34, 22, keys=by)
    w, left = G.width(G.rect()), F.col("l")
    n = F.floor((w * 2 + F.col("cw")) / (F.col("cw") * 2)).cast("int")
    n = F.when((n >= 2) & (w * 100 >= F.col("cw") * 185), n).otherwise(1)
    d = d.withColumns({"_n": n, "_w": w}).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    edge = lambda k: left + F.floor(k * F.col("_w") / F.col("_n")).cast("int")
    out = d.withColumns({"_l": edge(F.col("piece")), "_r": F.when(F.col("piece") == F.col("_n") - 1, F.col("r")).otherwise(edge(F.col("piece") + 1))})
    return out.withColumns({"l": F.col("_l"), "r": F.col("_r")}).drop("_n", "_w", "_l", "_r")


def strip_chain(boxes: DataFrame, page_w: int, page_h: int, by: Sequence[str] = ("page_id", "region_id")) -> DataFrame:
    """Lines of a region (frame ``gl gt gr gb``, width unit ``cw``): boxes fall into equal strips by
    centre and chain downwards while the gap stays within 4.5 W.

    Boxes of a strip with the same top are combined first, so a chain scans at most one row per
    pixel row of the page, however many boxes there are."""
    by = list(by)
    frame_w = F.greatest(F.col("gr") - F.col("gl"), F.lit(1))
    n = F.greatest(F.lit(1), F.floor((frame_w * 2 + F.col("cw")) / (F.col("cw") * 2)).cast("int"))
    x = G.clamp(G.center_x(G.rect()) - F.col("gl"), F.lit(0), frame_w - 1)
    strip = F.least(F.floor(x * n / frame_w).cast("int"), n - 1)
    rows = boxes.withColumn("strip", strip).groupBy(*by, "strip", "cw", "t").agg(
        F.min("l").alias("l"), F.max("r").alias("r"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by, "strip").orderBy("t")
    low = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(low.isNull() | ((F.col("t") - low) * 10 > F.col("cw") * 45), 1).otherwise(0))
    rows = rows.withColumn("chain", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by, "strip", "chain").agg(
        G.clamp(F.min("l"), 0, page_w).alias("l"), G.clamp(F.min("t"), 0, page_h).alias("t"),
        G.clamp(F.max("r"), 0, page_w).alias("r"), G.clamp(F.max("b"), 0, page_h).alias("b"), F.sum("n").alias("n_boxes"))


def seam_trim(lines: DataFrame, row_id: str, by: Sequence[str] = ("page_id", "region_id"), hot="find") -> DataFrame:
    """From left to right by centre: two neighbours that overlap in x are both cut in the middle."""
    by = list(by)

    def scan(rows, keys):
        arrays = page_arrays(rows, keys, {"_c": G.center_x(G.rect()), "_o": F.col(row_id)})

        def step(acc, x):
            last = F.try_element_at(acc, F.lit(-1))
            seam = G.floor_div(last["r"] + x["l"], 2)
            with_side = lambda k, side: F.struct(*[(seam if c == side else k[c]).alias(c) for c in ["_c", "_o"] + cols])
            cut = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(with_side(last, "r"), with_side(x, "l")))
            return F.when((F.size(acc) > 0) & (last["r"] > x["l"]), cut).otherwise(F.concat(acc, F.array(x)))

        cols = [c for c in rows.columns if c not in keys]
        return arrays.select(*[k for k in keys if k != "_block"], F.inline(fold(F.col("items"), step))).drop("_c", "_o")

    return fold_pages(lines, scan, row_id=row_id, keys=by, flat=True, hot=hot)


def region_exclusion(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """In-region lines are clamped to the region of their centre (else the nearest one); outside
    lines that enter a region are trimmed at its edge, or dropped when 35 % is inside, the line is
    lower than 24 px, or too little is left."""
    cols = ["page_id", "line_id", "category", *SIDES]
    lines, regions = lines.select(*cols), regions.select("page_id", "region_id", *SIDES)
    hot = crowded(["page_id"], regions)
    if hot is None:
        return _excluded_on_pages(lines, regions)
    (few_lines, lines), (few_regions, regions) = apart(lines, hot, ["page_id"]), apart(regions, hot, ["page_id"])
    return _excluded_on_pages(few_lines, few_regions).unionByName(_excluded_on_tiles(lines, regions))


def _clamped(a, g) -> list[Column]:
    """Sides of a line cut to a region, as they are without one: ``greatest`` and ``least`` skip nulls."""
    return [F.greatest(a["l"], g["l"]).alias("l"), F.greatest(a["t"], g["t"]).alias("t"), F.least(a["r"], g["r"]).alias("r"), F.least(a["b"], g["b"]).alias("b")]


def _trimmed(regions: Column, start: Column) -> Column:
    """The outside line ``start`` (sides and ``ok``) after the regions it meets, one after the other."""
    rect = lambda a, **new: F.struct(*[new.get(s, a[s]).alias(s) for s in SIDES], new.get("ok", a["ok"]).alias("ok"))

    def step(a, g):
        cut = F.when((a["t"] < g["t"]) & (a["b"] > g["t"]), rect(a, b=g["t"])).when(
            (a["b"] > g["b"]) & (a["t"] < g["b"]), rect(a, t=g["b"])).when(
            (a["l"] < g["l"]) & (a["r"] > g["l"]), rect(a, r=g["l"])).when(
            (a["r"] > g["r"]) & (a["l"] < g["r"]), rect(a, l=g["r"])).otherwise(a)
        lost = G.ratio_at_least(G.intersection(a, g), G.area(a), 35) | ((G.area(a) > 0) & (G.height(a) < 24))
        small = (cut["r"] - cut["l"] < 8) | (cut["b"] - cut["t"] < 12)
        return F.when(~a["ok"] | (G.intersection(a, g) == 0), a).otherwise(F.when(lost, rect(a, ok=F.lit(False))).otherwise(
            let(F.struct(cut.alias("c"), small.alias("small")), lambda x: rect(x["c"], ok=~x["small"]))))

    return F.aggregate(regions, start, step)


LEFT_OVER = "r - l >= 8 AND b - t >= 12"


def _excluded_on_pages(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Each line looks once through the array of its page's regions."""
    gs = regions.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.col("region_id").alias("id"), *SIDES))).alias("gs"))
    a = G.rect()
    held = F.get(F.filter("gs", lambda g: G.holds_center(g, a)), F.lit(0))
    near = F.array_min(F.transform("gs", lambda g: F.struct((G.center_dx(a, g) + G.center_dy(a, g)).alias("d"), g["id"].alias("id"), g.alias("g"))))["g"]
    inside = let(F.coalesce(held, near), lambda g: F.struct(*_clamped(a, g), F.lit(True).alias("ok")))
    outside = _trimmed(F.filter("gs", lambda g: G.intersection(a, g) > 0), F.struct(*SIDES, F.lit(True).alias("ok")))
    outside = F.coalesce(outside, F.struct(*SIDES, F.lit(True).alias("ok")))  # a page without regions
    d = lines.join(gs, "page_id", "left").select("page_id", "line_id", "category", F.when(F.col("category") == "BUBBLED", inside).when(F.col("category") != "BUBBLED", outside).alias("k"))
    return d.where("k.ok").select("page_id", "line_id", "category", *[f"k.{s}" for s in SIDES]).where(LEFT_OVER)


def _excluded_on_tiles(lines: DataFrame, regions: DataFrame) -> DataFrame:
    cols = lines.columns
    gcols = {"gl": "l", "gt": "t", "gr": "r", "gb": "b"}
    inside = lines.where("category = 'BUBBLED'")
    held = best_match(inside, regions, lambda a, g: G.holds_center(g, a), rank=lambda a, g: [g["region_id"]], pick=gcols)
    stray = held.where("gl IS NULL").select(*cols)
    near = nearest_center(stray, regions, lambda p, q: G.center_dx(p, q) + G.center_dy(p, q), right_id="region_id", pick=gcols)
    near = near.select(*cols, *gcols)
    put = held.where("gl IS NOT NULL").unionByName(near)
    put = put.select("page_id", "line_id", "category", *_clamped(G.rect(), G.rect("g")))

    outside = near_pairs(lines.where("category <> 'BUBBLED'"), regions, lambda a, g: G.intersection(a, g) > 0, how="left")
    met = outside.groupBy("a").agg(F.array_sort(F.collect_list(F.when(F.col("b").isNotNull(), F.struct(
        F.col("b.region_id").alias("id"), *[F.col(f"b.{s}").alias(s) for s in SIDES])))).alias("gs"))
    start = F.struct(*[F.col(f"a.{s}").alias(s) for s in SIDES], F.lit(True).alias("ok"))
    done = met.select("a.page_id", "a.line_id", "a.category", _trimmed(F.col("gs"), start).alias("k")).where("k.ok")
    return put.unionByName(done.select("page_id", "line_id", "category", *[f"k.{s}" for s in SIDES])).where(LEFT_OVER)


def split_tall_regions(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """A region over 1.35 times as high as wide with two or more lines is split at its largest
    vertical gap, if that exceeds 40 % of the two lines' mean height and stays 20 px off the edges."""
    tall = regions.where((F.col("b") - F.col("t")) * 100 > (F.col("r") - F.col("l")) * 135)
    held = near_pairs(lines.select("page_id", "line_id", *SIDES), tall, lambda a, g: G.holds_center(g, a))
    a = F.col("a")
    rows = held.select("page_id", "b.region_id", "a.line_id", G.center_y(a).alias("cy"), a["t"].alias("t"), a["b"].alias("b"))
    rows = with_previous(rows, ["page_id", "region_id"], ["cy", "line_id"], G.floor_div(F.col("cy"), 64), {"pt": "t", "pb": "b"})
    gap = F.col("t") - F.col("pb")
    ok = gap * 200 > (F.col("b") - F.col("t") + F.col("pb") - F.col("pt")) * 40
    cut = rows.where(ok & (gap > 0)).groupBy("page_id", "region_id").agg(
        F.min(F.struct((-gap).alias("k"), "cy", "line_id", F.expr("int((pb + t) div 2)").alias("y")))["y"].alias("y"))
    d = regions.join(cut, ["page_id", "region_id"], "left")
    split = F.col("y").isNotNull() & (F.col("y") >= F.col("t") + 20) & (F.col("y") < F.col("b") - 20)
    part = lambda no, t, b: F.struct(F.lit(no).alias("part"), t.alias("t"), b.alias("b"))
    parts = F.when(split, F.array(part(1, F.col("t"), F.col("y")), part(2, F.col("y"), F.col("b")))).otherwise(F.array(part(0, F.col("t"), F.col("b"))))
    return d.select("page_id", "region_id", F.explode(parts).alias("p"), "l", "r").select("page_id", "region_id", "p.part", "l", "p.t", "r", "p.b")


# ---- order-dependent steps on one page or region --------------------------------------------


#: Rectangles of a page that are united in one scan.
SCAN = 100
#: When two rectangles are one, in hundredths of the smaller area or of the union.
UNION_RULES = {
    "nested": lambda p, q, both, least: both * 100 >= least * 40,
    "alike": lambda p, q, both, least: (both * 100 > (G.area(p) + G.area(q) - both) * 45) | (both * 100 > least * 85),
    "touching": lambda p, q, both, least: both * 100 > least * 12,
}


def merge_overlaps(boxes: DataFrame, rule: str = "nested", row_id: str = "box_id", keys: Sequence[str] = ("page_id",), hot="find") -> DataFrame:
    """Pairwise union to the fixpoint: ``nested`` (.40 of the smaller), ``alike`` (IoU .45 or containment .85) or ``touching``
    (.12 of the smaller). Each turn unites the first rectangle by id that has a partner with its first partner. Turns look at all pairs, so
    only pages of ``SCAN`` rectangles or less are scanned whole; others by blocks that no union leaves."""
    boxes = boxes.select(*keys, row_id, *SIDES)
    hot = hot_pages(boxes, list(keys), SCAN) if hot == "find" else hot

    def meets(x, y):
        both = G.intersection(x, y)
        return (y["id"] > x["id"]) & (both > 0) & UNION_RULES[rule](x, y, both, F.least(G.area(x), G.area(y)))

    def turn(state, _):
        xs = state["xs"]
        first = F.filter(xs, lambda x: F.exists(xs, lambda y: meets(x, y)))
        pair = let(first, lambda f: F.when(F.size(f) > 0, F.struct(f[0].alias("x"), F.filter(xs, lambda y: meets(f[0], y))[0].alias("y"))))
        united = lambda p, k: F.when(k["id"] == p["x"]["id"], F.struct(
            k["id"].alias("id"), F.least(k["l"], p["y"]["l"]).alias("l"), F.least(k["t"], p["y"]["t"]).alias("t"),
            F.greatest(k["r"], p["y"]["r"]).alias("r"), F.greatest(k["b"], p["y"]["b"]).alias("b"))).otherwise(k)
        after = let(pair, lambda p: F.when(p.isNull(), F.struct(xs.alias("xs"), F.lit(False).alias("more"))).otherwise(F.struct(
            F.transform(F.filter(xs, lambda k: k["id"] != p["y"]["id"]), lambda k: united(p, k)).alias("xs"), F.lit(True).alias("more"))))
        return F.when(state["more"], after).otherwise(state)

    def scan(rows, by):
        arrays = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(row_id).cast("bigint").alias("id"), *SIDES))).alias("xs"))
        done = F.aggregate(F.sequence(F.lit(1), F.size("xs")), F.struct(F.col("xs"), F.lit(True).alias("more")), turn)["xs"]
        return arrays.select(*by, F.explode(done).alias("x")).select(*by, F.col("x.id").alias(row_id), *[F.col(f"x.{c}").alias(c) for c in SIDES])

    return fold_pages(boxes, scan, row_id=row_id, keys=list(keys), hot=hot)
