"""Row-wise rectangle and keypoint projections; every result stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.functions import geometry as G
from pagelattice.operators.pagefold import greedy_keep
from pagelattice.operators.spatial import best_match, drop_matched, near_pairs


def rect_metrics(df: DataFrame) -> DataFrame:
    a = G.rect()
    return df.select("*", G.width(a).alias("width"), G.height(a).alias("height"), G.area(a).alias("area"),
                     G.center_x(a).alias("cx"), G.center_y(a).alias("cy"))


def pair_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """All overlapping pairs with intersection, IoU, containment and share of the left one."""
    p = near_pairs(left, right, lambda a, b: G.intersection(a, b) > 0)
    a, b = F.col("a"), F.col("b")
    inter = G.intersection(a, b)
    return p.select("page_id", a[left_id].alias(left_id), b[right_id].alias(right_id), inter.alias("inter"),
                    (inter / (G.area(a) + G.area(b) - inter)).alias("iou"),
                    (inter / G.min_area(a, b)).alias("containment"), (inter / G.area(a)).alias("ioa"))


def pair_gaps(left: DataFrame, right: DataFrame, left_id: str, right_id: str, reach: int) -> DataFrame:
    """Axis gaps, overlap lengths and centre distances of all pairs at most ``reach`` px apart."""
    p = near_pairs(left, right, lambda a, b: (G.gap_x(a, b) <= reach) & (G.gap_y(a, b) <= reach), pad=reach)
    a, b = F.col("a"), F.col("b")
    return p.select("page_id", a[left_id].alias(left_id), b[right_id].alias(right_id),
                    G.gap_x(a, b).alias("gap_x"), G.gap_y(a, b).alias("gap_y"),
                    G.overlap_x(a, b).alias("h_overlap"), G.overlap_y(a, b).alias("v_overlap"),
                    G.center_dx(a, b).alias("dcx"), G.center_dy(a, b).alias("dcy"))


def rescale_boxes(df: DataFrame, input_size: int, page_w: int, page_h: int, min_side: int = 20) -> DataFrame:
    """Centre-format model output ``mx my mw mh`` to integer corners in page pixels."""
    at = lambda c, half, size: F.floor((F.col(c) + half) * size / input_size).cast("int")
    hw, hh = F.col("mw") / 2, F.col("mh") / 2
    out = df.withColumns({
        "l": F.greatest(F.lit(0), at("mx", -hw, page_w)), "t": F.greatest(F.lit(0), at("my", -hh, page_h)),
        "r": F.least(F.lit(page_w), at("mx", hw, page_w)), "b": F.least(F.lit(page_h), at("my", hh, page_h))})
    return out.where((F.col("r") - F.col("l") >= min_side) & (F.col("b") - F.col("t") >= min_side))


def letterbox_inverse(df: DataFrame, points: list[tuple[str, str]], width: str, height: str, dim: int = 640) -> DataFrame:
    """Undo uniform scaling with centred padding on the point columns; scaled sizes round half to even."""
    w, h = F.col(width), F.col(height)
    scale = F.least(F.lit(float(dim)) / h, F.lit(float(dim)) / w)
    pad = lambda side: F.floor((F.lit(dim) - F.bround(side * scale)) / 2)
    new = {}
    for x, y in points:
        new[x] = (F.col(x) - pad(w)) / scale
        new[y] = (F.col(y) - pad(h)) / scale
    return df.withColumns(new)


def adaptive_crop(df: DataFrame, lo: int, hi: int, page_w: int, page_h: int) -> DataFrame:
    """Padding grows from ``lo`` at 150 px to ``hi`` 350 px later; crop clamped to the page."""
    a = G.rect()
    side = F.greatest(G.width(a), G.height(a))
    pad = G.clamp(F.bround(F.lit(lo) + (side - 150) * F.lit(4.0) / F.lit(350.0)).cast("int"), lo, hi)
    return df.select("*", pad.alias("pad")).select(
        "*", F.greatest(F.lit(0), F.col("l") - F.col("pad")).alias("crop_l"),
        F.greatest(F.lit(0), F.col("t") - F.col("pad")).alias("crop_t"),
        F.least(F.lit(page_w), F.col("r") + F.col("pad")).alias("crop_r"),
        F.least(F.lit(page_h), F.col("b") + F.col("pad")).alias("crop_b"))


def probe_crop(df: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Grow each side by a fifth of its length, 2..12 px, and keep at least one pixel."""
    a = G.rect()
    px = G.clamp(G.floor_div(G.width(a), 5), 2, 12)
    py = G.clamp(G.floor_div(G.height(a), 5), 2, 12)
    out = df.withColumns({"probe_l": G.clamp(F.col("l") - px, 0, page_w - 1), "probe_t": G.clamp(F.col("t") - py, 0, page_h - 1)})
    return out.withColumns({
        "probe_r": G.clamp(F.col("r") + px, F.col("probe_l") + 1, page_w),
        "probe_b": G.clamp(F.col("b") + py, F.col("probe_t") + 1, page_h)})


def canonical_points(df: DataFrame) -> DataFrame:
    """Order keypoints (x0,y0), (x1,y1) by x, then y."""
    swap = F.struct("x1", "y1") < F.struct("x0", "y0")
    pick = lambda first, second: F.when(swap, F.col(second)).otherwise(F.col(first))
    return df.withColumns({"x0": pick("x0", "x1"), "y0": pick("y0", "y1"), "x1": pick("x1", "x0"), "y1": pick("y1", "y0")})


#: Training copies of one crop and their rotation in degrees.
VARIANTS = [("original", 0.0), ("mirror", 0.0), ("rot_p6", 6.0), ("rot_m6", -6.0), ("rot_p12", 12.0),
            ("rot_m12", -12.0), ("photometric", 0.0)]


def augment_points(df: DataFrame, width: str = "crop_w", height: str = "crop_h") -> DataFrame:
    """Seven rows per crop: mirrored, rotated about the centre on a grown canvas, or unchanged
    points; canonical order afterwards. One explode of a constant array, no join."""
    kinds = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(d).alias("deg")) for n, d in VARIANTS])
    rows = df.select("*", F.explode(kinds).alias("_v")).select("*", "_v.variant", F.radians("_v.deg").alias("_rad")).drop("_v")
    w, h, rad = F.col(width).cast("double"), F.col(height).cast("double"), F.col("_rad")
    turned = F.col("variant").startswith("rot")
    grown = lambda along, across: F.floor(across * F.abs(F.sin(rad)) + along * F.abs(F.cos(rad))).cast("int")
    out_w = F.when(turned, grown(w, h)).otherwise(F.col(width))
    out_h = F.when(turned, grown(h, w)).otherwise(F.col(height))

    def moved(x, y):
        dx, dy = F.col(x) - w / 2, F.col(y) - h / 2
        nx = F.cos(rad) * dx + F.sin(rad) * dy + out_w / 2
        ny = F.cos(rad) * dy - F.sin(rad) * dx + out_h / 2
        mx = F.when(F.col("variant") == "mirror", w - 1 - F.col(x)).otherwise(F.col(x).cast("double"))
        return (F.round(F.when(turned, nx).otherwise(mx), 6),
                F.round(F.when(turned, ny).otherwise(F.col(y).cast("double")), 6))

    (ax, ay), (bx, by) = moved("x0", "y0"), moved("x1", "y1")
    out = rows.withColumns({"x0": ax, "y0": ay, "x1": bx, "y1": by, "out_w": out_w, "out_h": out_h}).drop("_rad")
    return canonical_points(out)


def half_plane_value(x: Column, y: Column) -> Column:
    """Cross product of a point against the cut p1 -> p2; not negative means lobe A."""
    c = lambda n: F.col(n).cast("long")
    return (x - c("p1x")) * (c("p2y") - c("p1y")) - (y - c("p1y")) * (c("p2x") - c("p1x"))


def half_plane(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """Lobe of every line whose centre lies in a cut region."""
    p = near_pairs(lines, cuts, lambda a, b: G.holds_center(b, a))
    flat = p.select("page_id", "b.region_id", "a.line_id", F.col("a").alias("a"),
                    *[F.col(f"b.{c}").alias(c) for c in ("p1x", "p1y", "p2x", "p2y")])
    d = half_plane_value(G.center_x(F.col("a")), G.center_y(F.col("a")))
    return flat.select("page_id", "region_id", "line_id", F.when(d >= 0, "A").otherwise("B").alias("lobe"))


def straddle_class(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """Corner votes per line: lobe A, lobe B, or straddling the cut, where an over-wide line
    counts as two lines read as one and anything else goes by its centre."""
    p = near_pairs(lines, cuts, lambda a, b: G.holds_center(b, a))
    sides = "ltrb"
    flat = p.select("page_id", "b.region_id", "a.line_id", *[F.col(f"a.{s}").alias(s) for s in sides],
                    *[F.col(f"b.{c}").alias(c) for c in ("p1x", "p1y", "p2x", "p2y")])
    a = G.rect()
    mid = flat.groupBy("page_id", "region_id").agg(
        F.percentile(G.width(a), 0.5).alias("mw"), F.percentile(G.height(a), 0.5).alias("mh"))
    d = flat.join(mid, ["page_id", "region_id"])
    votes = sum((F.when(half_plane_value(F.col(x), F.col(y)) >= 0, 1).otherwise(0) for x in "lr" for y in "tb"), F.lit(0))
    upright = F.abs(F.col("p2y") - F.col("p1y")) >= F.abs(F.col("p2x") - F.col("p1x"))
    off = lambda lo, hi, at: F.least(F.abs(F.col(lo) - F.col(at)), F.abs(F.col(hi) - F.col(at)))
    wide = (G.width(a) >= 1.3 * F.col("mw")) | ((G.width(a) >= 26) & (off("l", "r", "p1x") >= 6))
    tall = (G.height(a) >= 1.3 * F.col("mh")) | ((G.height(a) >= 30) & (off("t", "b", "p1y") >= 6))
    joined = F.when(upright, wide).otherwise(tall)
    center = F.when(half_plane_value(G.center_x(a), G.center_y(a)) >= 0, "A").otherwise("B")
    return d.select("page_id", "region_id", "line_id", votes.alias("votes"),
                    F.when(votes >= 3, "A").when(votes <= 1, "B").otherwise(center).alias("lobe"),
                    ((votes == 2) & joined).alias("joined_misread"))


def block_shape(df: DataFrame) -> DataFrame:
    """Symbol size and text angle of a block from its rectangle and text."""
    n = F.greatest(F.length("text"), F.lit(1))
    w, h = G.width(G.rect()), G.height(G.rect())
    return df.select("*", (w / n).alias("sym_width"), (h / n).alias("sym_height"),
                     F.when(h * 10 > w * 13, 90).otherwise(0).alias("angle"))


def neighbor_cells(boxes: DataFrame, regions: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Box-sized probe cells left, right, above and below each box inside a region; dropped when
    small, outside the region, over a quarter covered by a box, or half covered by an earlier cell."""
    inside = best_match(boxes.where((F.col("r") - F.col("l") >= 8) & (F.col("b") - F.col("t") >= 8)), regions,
                        lambda a, b: G.holds_center(b, a, edge="exclusive"), rank=lambda a, b: [b["region_id"]],
                        pick={"region_id": "region_id", "gl": "l", "gt": "t", "gr": "r", "gb": "b"}).where("region_id IS NOT NULL")
    w, h = F.col("r") - F.col("l"), F.col("b") - F.col("t")

    def cell(i, dx, dy):
        x = lambda c: G.clamp(F.col(c) + dx * w, 0, page_w)
        y = lambda c: G.clamp(F.col(c) + dy * h, 0, page_h)
        return F.struct(F.lit(i).alias("side"), x("l").alias("l"), y("t").alias("t"), x("r").alias("r"), y("b").alias("b"))

    cells = inside.select("page_id", "box_id", "gl", "gt", "gr", "gb",
                          F.explode(F.array(cell(0, -1, 0), cell(1, 1, 0), cell(2, 0, -1), cell(3, 0, 1))).alias("c"))
    region = {"l": F.col("gl"), "t": F.col("gt"), "r": F.col("gr"), "b": F.col("gb")}
    c = F.col("c")
    cells = cells.where((G.width(c) >= 10) & (G.height(c) >= 10) & G.holds_center(region, c, edge="exclusive"))
    cells = cells.select("page_id", (F.col("box_id") * 4 + F.col("c.side")).alias("cell_id"), "box_id", "c.side", "c.l", "c.t", "c.r", "c.b")
    free = drop_matched(cells, boxes.select("page_id", "l", "t", "r", "b"), lambda a, b: G.ratio_over(G.intersection(a, b), G.area(a), 25))
    return greedy_keep(free, lambda k, x: G.containment_over(k, x, 50), order={"_o": F.col("cell_id")}, row_id="cell_id")


def unclip_boxes(df: DataFrame, ratio: float, scale_x: float, scale_y: float, map_w: int, map_h: int) -> DataFrame:
    """Grow shrunken detections back and scale them to the page (half-up rounding)."""
    keep = df.where((F.col("score") >= 0.55) & (F.col("n_cells") >= 6))
    grow = lambda side: G.round_half_up((side + 1) * (ratio - 1) * 0.5)
    px, py = grow(F.col("r") - F.col("l")), grow(F.col("b") - F.col("t"))
    page_w, page_h = int(map_w * scale_x), int(map_h * scale_y)
    out = keep.withColumns({
        "l": F.greatest(F.lit(0), F.col("l") - px), "t": F.greatest(F.lit(0), F.col("t") - py),
        "r": F.least(F.lit(map_w - 1), F.col("r") + px), "b": F.least(F.lit(map_h - 1), F.col("b") + py)})
    out = out.withColumns({
        "l": G.clamp(G.round_half_up(F.col("l") * scale_x), 0, page_w - 1),
        "t": G.clamp(G.round_half_up(F.col("t") * scale_y), 0, page_h - 1),
        "r": G.round_half_up((F.col("r") + 1) * scale_x), "b": G.round_half_up((F.col("b") + 1) * scale_y)})
    out = out.withColumns({"r": G.clamp(F.col("r"), F.col("l") + 1, page_w), "b": G.clamp(F.col("b"), F.col("t") + 1, page_h)})
    return out.where((F.col("r") - F.col("l") >= 6) & (F.col("b") - F.col("t") >= 6))
