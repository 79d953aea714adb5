"""Page layout from boxes and regions to ordered lines and dialogue groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagelattice.functions import geometry as G
from pagelattice.functions.text import compose
from pagelattice.operators import grouping as GR, joins as J, rounds as R
from pagelattice.operators.filters import region_size
from pagelattice.operators.ordering import reading_key
from pagelattice.operators.pagefold import hot_pages
from pagelattice.operators.projections import half_plane
from pagelattice.operators.ranking import ranked
from pagelattice.operators.spatial import best_match, drop_matched
from pagelattice.session import cut_lineage

SIDES = ("l", "t", "r", "b")
FRAME = tuple("g" + s for s in SIDES)


def framed(d: DataFrame, regions: DataFrame) -> DataFrame:
    """Add the corners of the row's region as ``gl gt gr gb``."""
    return d.join(regions.select("page_id", "region_id", *[F.col(s).alias("g" + s) for s in SIDES]), ["page_id", "region_id"])


def lines_in_frames(boxes: DataFrame, page_w: int, page_h: int, hot="find") -> DataFrame:
    """Vertical lines of framed boxes: split smears, chain in strips, separate at seams."""
    d = GR.split_smear(boxes.select("page_id", "region_id", "box_id", *SIDES, *FRAME))
    chains = GR.strip_chain(d, page_w, page_h)
    chains = chains.withColumn("line_no", F.col("strip") * 1_000_000 + F.col("chain"))
    return GR.seam_trim(chains, "line_no", hot=hot)


def extract_lines(boxes: DataFrame, regions: DataFrame, page_w: int = 512, page_h: int = 800, rtl: bool = True, hot="find") -> DataFrame:
    """Lines of a page in reading order. Regions overlapping an earlier one by .60 are ignored;
    boxes centred in a region lose their ruby and become its lines; the others are clustered
    first (by symmetric reach) and each cluster's bounds act as its region."""
    boxes = boxes.select("page_id", "box_id", *SIDES)
    if hot == "find":
        hot = hot_pages(boxes)
    envelopes = cut_lineage(GR.dedup_first(regions.select("page_id", "region_id", *SIDES), 60, "region_id"))
    placed = cut_lineage(J.center_first(boxes, envelopes))
    inside = GR.ruby_absorb_gap(placed.where("region_id >= 0"), hot=None if hot is None else "find")
    stray = placed.where("region_id < 0").drop("region_id")
    clusters = cut_lineage(GR.reach_clusters(stray, 250, hot=hot))
    key = (-1 - F.col("cluster_id")).alias("region_id")
    frames = envelopes.unionByName(GR.cluster_bounds(clusters).select("page_id", key, *SIDES))
    every = inside.select("page_id", "region_id", "box_id", *SIDES).unionByName(clusters.select("page_id", key, "box_id", *SIDES))
    lines = lines_in_frames(framed(every, frames), page_w, page_h, hot=None if hot is None else "find")
    lines = cut_lineage(lines.withColumn("category", F.when(F.col("region_id") >= 0, "BUBBLED").otherwise("ORPHAN")))  # ranks read them more than once
    row, along = reading_key(G.rect(), 200, rtl)
    order = [row, along, *[F.col(c) for c in ("t", "region_id", "l", "r", "line_no")]]
    out = ranked(lines, ["page_id"], order, [row, G.floor_div(along, 64)], "reading_order")
    return out.select("page_id", "region_id", "category", *SIDES, "n_boxes", "reading_order")


def prepare_groups(lines: DataFrame, regions: DataFrame, cuts: DataFrame, page_w: int = 512, page_h: int = 800, pad: int = 10,
                   rtl: bool = True, hot="find") -> DataFrame:
    """Lines with their dialogue group. Effects are dropped. Lines of cut regions (``cuts``) form
    two lobes; other lines join the region they overlap most if centred in it or 40 % covered;
    the rest is clustered. Groups get padded bounds ``ul ut ur ub`` and are renumbered in
    reading order; ``line_order`` counts the lines of a group."""
    lines = lines.where("category <> 'SFX'").select("page_id", "line_id", *SIDES)
    lines = GR.with_char_width(lines, 10, 1_000_000, 24, size=F.greatest(G.width(G.rect()), F.lit(10)))
    lines = cut_lineage(lines)
    sides = cut_lineage(half_plane(lines, cuts))
    lobe = sides.groupBy("page_id", "line_id").agg(F.min(F.struct("region_id", "lobe")).alias("m")).select("page_id", "line_id", "m.region_id", "m.lobe")
    used = cuts.join(sides.select("page_id", "region_id").distinct(), ["page_id", "region_id"], "left_semi")
    regular = drop_matched(regions.select("page_id", "region_id", *SIDES), used.select("page_id", *SIDES),
                           lambda g, c: G.ratio_over(G.intersection(g, c), G.area(g), 70))
    free = lines.join(lobe.select("page_id", "line_id"), ["page_id", "line_id"], "left_anti")
    best = best_match(free, regular, lambda a, g: G.intersection(a, g) > 0, rank=lambda a, g: [-G.intersection(a, g), g["region_id"]],
                      pick={"region_id": "region_id", "gl": "l", "gt": "t", "gr": "r", "gb": "b"})
    frame = {s: F.col("g" + s) for s in SIDES}
    joins = F.col("region_id").isNotNull() & (G.holds_center(frame, G.rect()) | G.covered_at_least(G.rect(), frame, 40))
    best = cut_lineage(best.withColumn("_in", joins))
    none = F.lit(None).cast("int")
    lobed = lines.join(lobe, ["page_id", "line_id"]).join(regions.select("page_id", "region_id", *[F.col(s).alias("g" + s) for s in SIDES]), ["page_id", "region_id"])
    cols = ["page_id", "line_id", *SIDES, "kind", "unit", *FRAME]
    a = lobed.withColumns({"kind": F.when(F.col("lobe") == "A", 0).otherwise(1), "unit": F.col("region_id")}).select(*cols)
    b = best.where("_in").withColumns({"kind": F.lit(2), "unit": F.col("region_id")}).select(*cols)
    c = GR.outside_clusters(best.where("NOT _in").select("page_id", "line_id", *SIDES, "cw"), hot=hot)
    c = c.withColumns({"kind": F.lit(3), "unit": F.col("cluster_id"), **{f: none for f in FRAME}}).select(*cols)
    every = cut_lineage(a.unionByName(b).unionByName(c))

    key = ["page_id", "kind", "unit"]
    g = every.groupBy(*key).agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), *[F.first(f).alias(f) for f in FRAME])
    outside = F.col("kind") == 3
    low = lambda s: F.when(outside, F.greatest(F.lit(0), F.col(s) - 6)).otherwise(F.least(F.greatest(F.lit(0), F.col("g" + s), F.col(s) - pad), F.col(s)))
    high = lambda s, size: F.when(outside, F.least(F.lit(size), F.col(s) + 6)).otherwise(F.greatest(F.least(F.lit(size), F.col("g" + s), F.col(s) + pad), F.col(s)))
    g = g.select(*key, low("l").alias("l"), low("t").alias("t"), high("r", page_w).alias("r"), high("b", page_h).alias("b"))
    row, along = reading_key(G.rect(), 250, rtl)
    g = ranked(g, ["page_id"], [row, along, F.col("kind"), F.col("unit")], [row, G.floor_div(along, 64)], "group_no")
    g = g.select(*key, "group_no", *[F.col(s).alias("u" + s) for s in SIDES])
    x = -G.center_x(G.rect()) if rtl else G.center_x(G.rect())
    every = ranked(every.drop(*FRAME), key, [x, F.col("t"), F.col("line_id")], [G.floor_div(x, 64)], "line_order")
    return every.join(g, key).withColumn("is_bubble", F.col("kind") < 3)


def group_table(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("page_id", "group_no", "is_bubble", "ul", "ut", "ur", "ub").agg(F.count(F.lit(1)).alias("n_lines"))


def group_text(grouped: DataFrame, texts: DataFrame) -> DataFrame:
    """Composed text of every group from its lines' texts in order."""
    d = grouped.join(texts, ["page_id", "line_id"])
    return d.groupBy("page_id", "group_no").agg(compose(F.transform(F.array_sort(F.collect_list(F.struct("line_order", "text"))), lambda x: x["text"])).alias("text"))


def line_text(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, line_id, text) from boxes with a recognised ``text``: each line has the boxes whose centre it is the first line to hold,
    from top to bottom. A line's text is gathered in one place, as it is one value."""
    held = best_match(boxes.select("page_id", "box_id", *SIDES, "text"), lines.select("page_id", "line_id", *SIDES), lambda a, g: G.holds_center(g, a),
                      rank=lambda a, g: [g["line_id"]], pick={"line_id": "line_id"})
    parts = F.array_sort(F.collect_list(F.struct("t", "box_id", "text")))
    return held.where("line_id IS NOT NULL").groupBy("page_id", "line_id").agg(compose(F.transform(parts, lambda x: x["text"])).alias("text"))


def layout_text(boxes: DataFrame, regions: DataFrame, envelopes: DataFrame, cuts: DataFrame, page_w: int = 512, page_h: int = 800) -> DataFrame:
    """From boxes with recognised ``text`` to the text of each dialogue group in reading order. A group no box lies in has an empty text."""
    grouped = cut_lineage(layout_groups(boxes, regions, envelopes, cuts, page_w, page_h))
    texts = group_text(grouped, line_text(boxes, grouped))
    return group_table(grouped).join(texts, ["page_id", "group_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def categorize(boxes: DataFrame, regions: DataFrame, envelopes: DataFrame, iou: int = 35) -> tuple[DataFrame, DataFrame]:
    """Suppressed boxes with region or cluster and category, and the combined regions. Hot pages are
    looked up once, on the input, as no later step adds rows to a page."""
    hot = hot_pages(boxes)
    kept = GR.nms(boxes, iou, hot=hot).select("page_id", "box_id", *SIDES)
    frames = GR.fold_union(region_size(regions), 65)
    placed = cut_lineage(J.max_intersection(kept, frames))
    out = GR.proximity_clusters(placed.where("region_id IS NULL").drop("region_id"), hot=hot)
    out = J.ctd_match(out, envelopes).withColumn("region_id", F.lit(None).cast("bigint"))
    inside = placed.where("region_id IS NOT NULL").withColumns({"cluster_id": F.lit(None).cast("bigint"), "category": F.lit("BUBBLED")})
    return inside.unionByName(out), frames


def layout_counts(boxes: DataFrame, regions: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Per page: boxes by category, outside clusters, first in-region box in reading order."""
    d, _ = categorize(boxes, regions, envelopes)
    row, along = reading_key(G.rect(), 200)
    n = lambda c: F.count_if(F.col("category") == c)
    per = d.groupBy("page_id").agg(
        n("BUBBLED").alias("n_bubbled"), n("ORPHAN").alias("n_orphan"), n("SFX").alias("n_sfx"),
        F.count_if(F.col("cluster_id") == F.col("box_id")).alias("n_clusters"),
        F.min(F.when(F.col("category") == "BUBBLED", F.struct(row.alias("y"), along.alias("x"), "box_id")))["box_id"].alias("first_box"))
    return per


def layout_groups(boxes: DataFrame, regions: DataFrame, envelopes: DataFrame, cuts: DataFrame, page_w: int = 512, page_h: int = 800) -> DataFrame:
    """From raw boxes and regions to dialogue groups: categories, lines, groups, reading order."""
    d, frames = categorize(boxes, regions, envelopes)
    d = cut_lineage(d)
    spans = d.where("region_id IS NULL").groupBy("page_id", "cluster_id").agg(
        F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), F.first("category").alias("category"))
    key = (-1 - F.col("cluster_id")).alias("region_id")
    every = d.select("page_id", F.coalesce("region_id", key).alias("region_id"), "box_id", *SIDES)
    all_frames = frames.unionByName(spans.select("page_id", key, *SIDES))
    lines = lines_in_frames(framed(every, all_frames), page_w, page_h)
    kinds = spans.select("page_id", key, "category")
    lines = lines.join(kinds, ["page_id", "region_id"], "left").withColumn("category", F.coalesce("category", F.lit("BUBBLED")))
    row, along = reading_key(G.rect(), 200)
    lines = ranked(lines, ["page_id"], [row, along, *[F.col(c) for c in ("t", "region_id", "l", "r", "line_no")]], [row, G.floor_div(along, 64)], "line_id")
    return prepare_groups(cut_lineage(lines), frames, cuts, page_w, page_h)


PRESETS = {
    0: "strict lines, then fragment groups",
    1: "boxes to fragment groups, fenced by region",
    2: "bridged lines",
    3: "regions and outside units, joined where they overlap and cut apart",
    4: "vertical lines to lobes and outside clusters",
    5: "whole regions, tall ones split, with outside clusters",
    6: "coverage tiers with nearest centre",
    7: "lines by coverage tiers and outside clusters, like units joined",
    8: "coverage tiers over cut regions",
    9: "lines by coverage tiers over cut regions and outside clusters, like units joined",
}


def layout(boxes: DataFrame, regions: DataFrame, method: int, cuts: DataFrame | None = None, gutters: DataFrame | None = None,
           page_w: int = 512, page_h: int = 800) -> DataFrame:
    """Units (page_id, unit_id, l, t, r, b, n) of one named composition, see ``PRESETS``."""
    if method not in PRESETS:
        raise ValueError(f"no preset {method}")
    boxes = boxes.select("page_id", "box_id", *SIDES)
    units = lambda c, key: GR.cluster_bounds(c, ("page_id", key)).withColumnRenamed(key, "unit_id")
    tail = ["page_id", "unit_id", *SIDES, "n"]
    if method == 0:
        lines = units(GR.strict_lines(boxes), "cluster_id").select("page_id", F.col("unit_id").alias("box_id"), *SIDES)
        return units(GR.fenced_fragments(lines, regions), "cluster_id").select(*tail)
    if method == 1:
        return units(GR.fenced_fragments(boxes, regions, fence=True), "cluster_id").select(*tail)
    if method == 2:
        return units(GR.bridged_lines(boxes, regions), "cluster_id").select(*tail)
    if method == 4:
        lines = extract_lines(boxes, regions, page_w, page_h).withColumnRenamed("reading_order", "line_id")
        lines = cut_lineage(lines)
        inner = GR.lobes(lines.where("category = 'BUBBLED'"), regions, page_w, page_h).select("page_id", F.col("cluster_id").alias("unit_id"), *SIDES, "n")
        outer = units(GR.outside_clusters(lines.where("category = 'ORPHAN'").select("page_id", "line_id", *SIDES)), "cluster_id")
        return inner.unionByName(outer.select(*tail))
    if method == 5:
        parts = GR.split_tall_regions(regions, boxes.withColumnRenamed("box_id", "line_id"))
        parts = parts.withColumn("region_id", F.col("region_id") * 3 + F.col("part")).drop("part")
        placed = cut_lineage(J.center_first(boxes, parts))
        inner = units(placed.where("region_id >= 0"), "region_id")
        outer = units(GR.proximity_clusters(placed.where("region_id < 0").drop("region_id")), "cluster_id")
        return inner.select(*tail).unionByName(outer.withColumn("unit_id", -1 - F.col("unit_id")).select(*tail))
    outside_id = -1 - F.col("cluster_id")
    if method == 3:
        placed = cut_lineage(J.center_or_overlap(boxes, regions))
        inner = units(placed.where("region_id >= 0"), "region_id").select(*tail)
        bars = gutters if gutters is not None else boxes.sparkSession.createDataFrame([], "page_id bigint, gutter_x int, gutter_y int")
        outer = GR.outside_units(placed.where("region_id < 0").select(*boxes.columns), bars, page_w, page_h).withColumn("unit_id", outside_id)
        return R.edge_trim(R.united(inner.unionByName(outer.select(*tail)), GR.UNION_RULES["touching"]), page_w, page_h, row_id="unit_id").select(*tail)
    if method in (7, 9):
        if method == 9 and cuts is None:
            raise ValueError("preset 9 needs the cut lines of the regions")
        lines = cut_lineage(extract_lines(boxes, regions, page_w, page_h).select("page_id", F.col("reading_order").alias("box_id"), *SIDES))
        placed = cut_lineage(J.ioa_tiered(lines, regions, page_w, page_h))
        inner = placed.where("region_id IS NOT NULL").withColumn("unit_id", F.col("region_id"))
        if method == 9:
            lobe = half_plane(lines.withColumnRenamed("box_id", "line_id"), cuts).withColumnRenamed("line_id", "box_id")
            inner = inner.join(lobe, ["page_id", "region_id", "box_id"], "left").withColumn("unit_id", F.col("region_id") * 2 + F.when(F.col("lobe") == "B", 1).otherwise(0))
        stray = placed.where("region_id IS NULL").select("page_id", F.col("box_id").alias("line_id"), *SIDES)
        outer = units(GR.outside_clusters(stray).withColumn("unit_id", outside_id), "unit_id")
        return R.united(units(inner, "unit_id").select(*tail).unionByName(outer.select(*tail)), GR.UNION_RULES["alike"]).select(*tail)
    if method == 8:
        if cuts is None:
            raise ValueError("preset 8 needs the cut lines of the regions")
        placed = J.ioa_tiered(boxes, regions, page_w, page_h).where("region_id IS NOT NULL")
        lobe = half_plane(boxes.withColumnRenamed("box_id", "line_id"), cuts).withColumnRenamed("line_id", "box_id")
        placed = placed.join(lobe, ["page_id", "region_id", "box_id"], "left")
        placed = placed.withColumn("unit_id", F.col("region_id") * 2 + F.when(F.col("lobe") == "B", 1).otherwise(0))
    else:
        placed = J.ioa_tiered(boxes, regions, page_w, page_h).where("region_id IS NOT NULL").withColumn("unit_id", F.col("region_id"))
    out = units(placed, "unit_id")
    return out.select(*tail)
