"""Assignment, matching and lookup joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagelattice.functions import geometry as G
from pagelattice.operators.ranking import ranked, top_per_key
from pagelattice.operators.spatial import best_match, drop_matched, keep_matched, near_pairs, with_match_flag


def id_buckets(col: str) -> list[Column]:
    """Nested buckets of a dense integer id, about a thousand per level."""
    return [F.floor(F.col(col) / 1_048_576), F.floor(F.col(col) / 1024)]


def max_intersection(boxes: DataFrame, regions: DataFrame, frame: bool = False) -> DataFrame:
    """Each box with the qualifying region it overlaps most (least id on ties), or null; with ``frame`` also its corners ``gl gt gr gb``."""
    def qualifies(a, g):
        inter, own = G.intersection(a, g), G.area(a)
        excess = F.greatest(a["r"] - g["r"], F.lit(0)) + F.greatest(g["l"] - a["l"], F.lit(0))
        slack = F.greatest(F.lit(12), G.floor_div(G.width(a), 4))
        well_in = ((inter * 100 >= own * 60) & (excess <= slack)) | (inter * 100 >= own * 85)
        center = G.holds_center(g, a) & ((inter * 100 >= own * 45) | well_in)
        return (inter > 0) & (center | (G.holds_center(g, a, 4) & (inter * 100 >= own * 70)))

    return best_match(boxes, regions, qualifies, rank=lambda a, g: [-G.intersection(a, g), g["region_id"]],
                      pick={"region_id": "region_id"} | ({f"g{s}": s for s in "ltrb"} if frame else {}))


def ioa_tiered(boxes: DataFrame, regions: DataFrame, page_w: int, page_h: int, grow: int = 8) -> DataFrame:
    """Strong overlap (.70) keeps its region. From .35 the region is kept if growing it covers
    .60 of the box, otherwise the region with the nearest centre wins. Below .35 none."""
    best = best_match(boxes, regions, lambda a, g: (G.intersection(a, g) > 0) & (G.area(a) > 0),
                      rank=lambda a, g: [-G.intersection(a, g), g["region_id"]],
                      pick={"own_id": "region_id", "gl": "l", "gt": "t", "gr": "r", "gb": "b"})
    a = G.rect()
    region = {s: F.col("g" + s) for s in "ltrb"}
    grown = {"l": F.greatest(F.lit(0), region["l"] - grow), "t": F.greatest(F.lit(0), region["t"] - grow),
             "r": F.least(F.lit(page_w), region["r"] + grow), "b": F.least(F.lit(page_h), region["b"] + grow)}
    tier = F.when(G.covered_at_least(a, region, 70), "strong").when(
        G.covered_at_least(a, region, 35), F.when(G.covered_at_least(a, grown, 60), "grown").otherwise("nearest"))
    best = best.withColumn("tier", F.when(F.col("own_id").isNotNull(), tier))
    keep = best.where("tier IS DISTINCT FROM 'nearest'").select(*boxes.columns, "tier", F.when(F.col("tier").isNotNull(), F.col("own_id")).alias("region_id"))
    # The own region bounds the search radius for a nearer centre.
    reach = F.ceil(F.sqrt(G.center_dist2(a, region))).cast("int")
    open_ = best.where("tier = 'nearest'").select("*", reach.alias("reach"), *[F.col(s).alias("o" + s) for s in "ltrb"])
    point = {"l": G.center_x(a), "t": G.center_y(a), "r": G.center_x(a), "b": G.center_y(a)}
    open_ = open_.withColumns(point)
    mids = regions.withColumns(point).select("page_id", "region_id", *"ltrb")
    near = best_match(open_, mids, lambda p, q: G.center_dist2(p, q) <= p["reach"].cast("long") * p["reach"], pad=F.col("reach"),
                      rank=lambda p, q: [G.center_dist2(p, q), q["region_id"]], pick={"region_id": "region_id"})
    near = near.withColumns({s: F.col("o" + s) for s in "ltrb"})
    return keep.unionByName(near.select(*boxes.columns, "tier", "region_id"))


def center_first(boxes: DataFrame, regions: DataFrame, edge: str = "inclusive") -> DataFrame:
    """Least region id holding the box centre, -1 if none."""
    d = best_match(boxes, regions, lambda a, g: G.holds_center(g, a, edge=edge), rank=lambda a, g: [g["region_id"]],
                   pick={"region_id": "region_id"})
    return d.withColumn("region_id", F.coalesce("region_id", F.lit(-1)))


def center_or_overlap(boxes: DataFrame, regions: DataFrame, percent: int = 35) -> DataFrame:
    """Greatest region id holding the centre or covering ``percent`` % of the box, -1 if none."""
    d = best_match(boxes, regions, lambda a, g: G.holds_center(g, a) | G.covered_at_least(a, g, percent),
                   rank=lambda a, g: [-g["region_id"]], pick={"region_id": "region_id"})
    return d.withColumn("region_id", F.coalesce("region_id", F.lit(-1)))


def exact_then_max(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Region with the very same rectangle, else the most overlapped one, first on ties."""
    return best_match(lines, regions, lambda a, g: G.same_rect(a, g) | (G.intersection(a, g) > 0),
                      rank=lambda a, g: [F.when(G.same_rect(a, g), 0).otherwise(1), -G.intersection(a, g), g["region_id"]],
                      pick={"region_id": "region_id"})


def covers_box(box, line) -> Column:
    return G.holds_center(line, box) | ((G.intersection(box, line) > 0) & (G.intersection(box, line) * 100 >= G.area(box) * 35))


def uncovered(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """Boxes no line covers, by centre or 35 % overlap."""
    return drop_matched(boxes, lines.select("page_id", *"ltrb"), covers_box)


def suppress_lower(outside: DataFrame, inside: DataFrame, percent: int = 50, min_side: int = 6) -> DataFrame:
    """Outside lines without those half covered by an inside line or thinner than 6 px."""
    a = G.rect()
    big = outside.where((G.width(a) >= min_side) & (G.height(a) >= min_side))
    return drop_matched(big, inside.select("page_id", *"ltrb"), lambda a, b: G.covered_at_least(a, b, percent))


def inked_in(box, region) -> Column:
    return G.holds_center(region, box) | ((G.intersection(box, region) > 0) & (G.intersection(box, region) * 100 >= G.area(box) * 45))


def empty_regions(boxes: DataFrame, lines: DataFrame, regions: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Regions that hold boxes but own no in-region line, with a box no in-region line covers.
    ``owners`` may give the (page_id, region_id) of regions that own lines."""
    inside = lines.where("category = 'BUBBLED'")
    if owners is None:
        owners = exact_then_max(inside, regions).where("region_id IS NOT NULL")
    owners = owners.select("page_id", "region_id").distinct()
    bare = regions.join(owners, ["page_id", "region_id"], "left_anti")
    return keep_matched(bare, uncovered(boxes, inside), lambda g, b: inked_in(b, g))


def ctd_match(clusters: DataFrame, envelopes: DataFrame, min_side: int = 14) -> DataFrame:
    """Category per cluster: ORPHAN if any member meets a detector envelope, else SFX."""
    a = G.rect()
    env = envelopes.where((G.width(a) >= min_side) & (G.height(a) >= min_side)).select("page_id", *"ltrb")

    def meets(x, e):
        inter, own = G.intersection(x, e), G.area(x)
        return ((G.holds_center(e, x) & G.ratio_at_least(inter, own, 35))
                | (G.holds_center(e, x, 6) & G.ratio_at_least(inter, own, 40)) | G.ratio_at_least(inter, own, 55))

    flagged = with_match_flag(clusters, env, meets, pad=6)
    kind = flagged.groupBy("page_id", "cluster_id").agg(F.max("matched").alias("_any"))
    return (flagged.drop("matched").join(kind, ["page_id", "cluster_id"])
            .withColumn("category", F.when(F.col("_any"), "ORPHAN").otherwise("SFX")).drop("_any"))


def partial_overlap_report(regions: DataFrame, boxes: DataFrame, low: int = 10, high: int = 95) -> DataFrame:
    """Region-box pairs where part of the box, from ``low`` to below ``high`` %, is inside."""
    p = near_pairs(boxes, regions, lambda a, g: G.ratio_at_least(G.intersection(a, g), G.area(a), low)
                   & (G.intersection(a, g) * 100 < G.area(a) * high))
    a, g = F.col("a"), F.col("b")
    return p.select("page_id", g["region_id"].alias("region_id"), a["box_id"].alias("box_id"),
                    (G.intersection(a, g) / G.area(a)).alias("ratio"))


def pred_truth(truth: DataFrame, preds: DataFrame) -> DataFrame:
    """Evaluated truth rows with their prediction; ``has_prediction`` marks the missing ones."""
    joined = truth.join(preds.withColumn("_p", F.lit(True)), "crop_key", "left")
    return joined.withColumn("has_prediction", F.col("_p").isNotNull()).drop("_p")


LABEL_COLUMNS = ["is_conjoined", "is_discarded", "discard_reason", "status", "annotated_at"]


def label_sync(source: DataFrame, sample: DataFrame) -> DataFrame:
    """Source manifest with the labels of a derived sample merged in by original id."""
    touched = sample.where("status = 'verified' OR is_conjoined IS NOT NULL OR is_discarded")
    newest = touched.groupBy(F.col("original_id").alias("bubble_id")).agg(
        F.max_by(F.struct(*LABEL_COLUMNS), "sample_id").alias("_n"))
    return source.join(newest, "bubble_id", "left").select(
        *[c for c in source.columns if c not in LABEL_COLUMNS],
        *[F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) for c in LABEL_COLUMNS],
        F.col("_n").isNotNull().alias("synced"))


def label_sync_counts(merged: DataFrame) -> DataFrame:
    live = F.col("synced") & ~F.coalesce("is_discarded", F.lit(False))
    return merged.agg(F.count_if("synced").alias("synced"),
                      F.count_if(F.col("synced") & F.coalesce("is_discarded", F.lit(False))).alias("discarded"),
                      F.count_if(live & F.col("is_conjoined")).alias("conjoined"),
                      F.count_if(live & ~F.col("is_conjoined")).alias("single"))


def lineage(crops: DataFrame, archives: DataFrame) -> DataFrame:
    """Crop -> page -> archive title, by the number in page names like ``c07_p012``."""
    number = F.regexp_extract("page_name", r"^c(\d+)_", 1)
    key = F.when(number != "", F.concat(F.lit("cbz_"), F.lpad(number, 2, "0"), F.lit(".cbz")))
    return (crops.withColumn("archive", key).join(archives, "archive", "left")
            .withColumn("title", F.coalesce("title", F.lit("Unknown"))))


def curated(listing: DataFrame, available: DataFrame, prefix: str) -> DataFrame:
    """Curated pages that exist, under their staged names."""
    have = listing.join(available.select("filename").distinct(), "filename", "left_semi")
    return have.withColumn("staged", F.concat(F.lit(prefix + "_"), "filename"))


def curated_missing(listing: DataFrame, available: DataFrame) -> DataFrame:
    return listing.join(available.select("filename").distinct(), "filename", "left_anti")


def new_sources(paths: DataFrame, seen: DataFrame, tag: str) -> DataFrame:
    """Tagged paths no earlier batch has."""
    return paths.where(F.col("path").contains(tag)).join(seen.select("path").distinct(), "path", "left_anti")


def _as_point(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumns({"l": F.col(x), "t": F.col(y), "r": F.col(x), "b": F.col(y)})


def nearest_snap(preds: DataFrame, candidates: DataFrame) -> DataFrame:
    """Move both predicted points to their nearest candidate within max(45, 12 % of the short
    side); the second may not take the first one's candidate. ``crop_w``/``crop_h`` give the size."""
    reach = F.ceil(F.greatest(F.lit(45.0), F.least("crop_w", "crop_h") * 0.12)).cast("int")
    side = F.least("crop_w", "crop_h").cast("long")
    preds = preds.withColumns({"reach": reach, "_short": side})
    spots = _as_point(candidates.select("crop_key", "point_id", "x", "y"), "x", "y")

    def snap(df, x, y, out, used=None):
        def on(a, b):
            d2 = G.center_dist2(a, b)
            near = (d2 <= 2025) | (d2 * 10000 <= a["_short"] * a["_short"] * 144)
            return near if used is None else near & ~F.coalesce((b["x"] == a[used[0]]) & (b["y"] == a[used[1]]), F.lit(False))
        d = best_match(_as_point(df, x, y), spots, on, keys=("crop_key",), pad=F.col("reach"),
                       rank=lambda a, b: [G.center_dist2(a, b), b["point_id"]], pick={out[0]: "x", out[1]: "y"})
        return d.drop(*"ltrb")

    d = snap(preds, "px0", "py0", ("sx0", "sy0"))
    d = snap(d, "px1", "py1", ("sx1", "sy1"), used=("sx0", "sy0"))
    return d.withColumns({c: F.coalesce(c, raw) for c, raw in (("sx0", "px0"), ("sy0", "py0"), ("sx1", "px1"), ("sy1", "py1"))}).drop("reach", "_short")


def best_pair(candidates: DataFrame, crops: DataFrame) -> DataFrame:
    """Best-scoring pair of candidate points of each crop, aligned with its short axis.

    The score never exceeds the summed depths. A first pass over the 16 deepest points gives
    a floor; only points that can still reach it with the deepest partner are paired after it."""
    def pairs(c):
        lo = c.join(crops.select("crop_key", "crop_w", "crop_h"), "crop_key").alias("p")
        hi = c.alias("q")
        d = lo.join(hi, (F.col("p.crop_key") == F.col("q.crop_key")) & (F.col("p.point_id") < F.col("q.point_id")))
        dx, dy = F.abs(F.col("p.x") - F.col("q.x")), F.abs(F.col("p.y") - F.col("q.y"))
        w, h = F.col("p.crop_w"), F.col("p.crop_h")
        d2 = dx * dx + dy * dy
        ok = (d2 >= 400) & (d2 * 10000 <= F.pow(F.greatest(w, h) * 95, 2))
        tall, wide = h * 100 > w * 115, w * 100 > h * 115
        ok = ok & F.when(tall, dy * 10 <= dx * 8).when(wide, dx * 10 <= dy * 8).otherwise(F.lit(True))
        lean = F.when(tall, dy / (dx + F.lit(1e-4))).when(wide, dx / (dy + F.lit(1e-4))).otherwise(F.lit(0.0))
        score = F.round((F.col("p.depth") + F.col("q.depth")) / (1 + lean), 9)
        return d.where(ok).select("p.crop_key", F.struct(
            (-score).alias("k"), F.col("p.point_id").alias("i"), F.col("q.point_id").alias("j"),
            F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by")).alias("s")) \
            .groupBy("crop_key").agg(F.min("s").alias("s"))

    cand = candidates.select("crop_key", "point_id", "x", "y", "depth")
    head = top_per_key(cand, ["crop_key"], [F.col("depth").desc(), F.col("point_id")], 16).drop("rn")
    floor_ = pairs(head).select("crop_key", (-F.col("s.k")).alias("_floor"))
    deepest = cand.groupBy("crop_key").agg(F.max("depth").alias("_max"))
    live = (cand.join(deepest.join(floor_, "crop_key", "left"), "crop_key")
            .where("_floor IS NULL OR depth + _max >= _floor").drop("_max", "_floor"))
    return pairs(live).select("crop_key", (-F.col("s.k")).alias("score"), "s.ax", "s.ay", "s.bx", "s.by")


def best_deep_pair(candidates: DataFrame) -> DataFrame:
    """Among the 6 deepest points against the 8 deepest: largest (summed depth x distance) at
    30 px and more, or simply the two deepest points."""
    d = top_per_key(candidates, ["crop_key"], [F.col("depth").desc(), F.col("point_id")], 8)
    pts = d.groupBy("crop_key").agg(F.array_sort(F.collect_list(F.struct("rn", "x", "y", "depth"))).alias("c")).where(F.size("c") >= 2)
    far = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
    scored = F.flatten(F.transform(F.slice("c", 1, 6), lambda p: F.transform(
        F.filter("c", lambda q: (q["rn"] > p["rn"]) & (far(p, q) >= 900)),
        lambda q: F.struct((-F.round((p["depth"] + q["depth"]) * F.sqrt(far(p, q)), 6)).alias("k"), p["rn"].alias("i"), q["rn"].alias("j")))))
    best = F.array_min(scored)
    i, j = F.coalesce(best["i"], F.lit(1)), F.coalesce(best["j"], F.lit(2))
    return pts.select("crop_key", F.element_at("c", i).alias("p"), F.element_at("c", j).alias("q"), (-best["k"]).alias("score")).select(
        "crop_key", "score", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))


def series_title(pages: DataFrame, index: DataFrame) -> DataFrame:
    """Series from the index (title, else series), else the file name before its last ``_``."""
    blank_to_null = lambda c: F.when(F.trim(c) != "", c)
    names = index.select("filename", F.coalesce(blank_to_null(F.col("title")), blank_to_null(F.col("series"))).alias("_s")).where(
        "_s IS NOT NULL AND trim(filename) <> ''")
    last = names.groupBy("filename").agg(F.max("_s").alias("_s"))
    stem = F.when(F.col("filename").contains("_"), F.regexp_extract("filename", r"^(.*)_[^_]*$", 1)).otherwise(F.col("filename"))
    return (pages.join(last, "filename", "left")
            .withColumn("page_series", F.coalesce("_s", blank_to_null(stem), F.lit("Manga"))).drop("_s"))


def review_item(manifest: DataFrame, annotations: DataFrame) -> DataFrame:
    """Manifest rows with position and total in their batch and the verified points, if any."""
    placed = ranked(manifest, ["batch"], [F.col("crop_key")], id_buckets("crop_key"), name="position", total="total")
    empty = F.array().cast("array<struct<x:int,y:int>>")
    return placed.join(annotations, "crop_key", "left").withColumn("points", F.coalesce("points", empty))


def review_list(manifest: DataFrame, only: str) -> DataFrame:
    """Finished, live rows of one kind (``conjoined`` or ``single``) with their manifest position."""
    flag = F.coalesce("is_conjoined", F.lit(False))
    placed = ranked(manifest, ["batch"], [F.col("crop_key")], id_buckets("crop_key"), name="position")
    done = placed.where(F.col("status").isin("verified", "annotated") & ~F.col("is_discarded"))
    return done.where(flag if only == "conjoined" else ~flag)


def unbarred_pairs(boxes: DataFrame, gutters: DataFrame, reach: int) -> DataFrame:
    """Box pairs within ``reach`` px that have no page gutter between their centres."""
    pairs = near_pairs(boxes, boxes, lambda a, b: (a["box_id"] < b["box_id"]) & (G.gap_x(a, b) <= reach) & (G.gap_y(a, b) <= reach), pad=reach)
    x1, x2 = G.center_x(F.col("a")), G.center_x(F.col("b"))
    spans = pairs.select("page_id", "a.box_id", F.col("b.box_id").alias("box_id2"), F.least(x1, x2).alias("l"),
                         F.greatest(x1, x2).alias("r"), F.lit(0).alias("t"), F.lit(0).alias("b"))
    bars = gutters.select("page_id", F.col("gutter_x").alias("l"), F.col("gutter_x").alias("r"), F.lit(0).alias("t"), F.lit(0).alias("b"))
    return drop_matched(spans, bars, lambda s, g: (g["l"] > s["l"]) & (g["l"] < s["r"])).select("page_id", "box_id", "box_id2")
