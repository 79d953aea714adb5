"""Filters and predicates over boxes, regions, lines, crops and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.functions import geometry as G
from pagelattice.operators.spatial import drop_matched, best_match


def region_size(df: DataFrame, min_w: int = 18, min_h: int = 22, min_area: int = 400) -> DataFrame:
    a = G.rect()
    return df.where((G.width(a) >= min_w) & (G.height(a) >= min_h) & (G.area(a) >= min_area))


def detection_sanity(df: DataFrame, page_w: int, page_h: int, min_conf_m: int = 400) -> DataFrame:
    """Confidence, minimum side, share of the page side and area, and aspect limits."""
    a = G.rect()
    w, h = G.width(a), G.height(a)
    return df.where(
        (F.col("conf_m") >= min_conf_m) & (w >= 10) & (h >= 10)
        & (w * 100 <= page_w * 65) & (h * 100 <= page_h * 65) & (G.area(a) * 4 <= page_w * page_h)
        & (w * 2 <= h * 7) & (h * 2 <= w * 7))


def context_threshold(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Weaker limits inside a region: confidence .18 and 6 px, or .22 and 8 px outside. ``n_cells``
    is the support of the detection: 3 cells, or 2 with a .22 peak, inside; always 3 outside."""
    d = best_match(boxes, regions, lambda a, b: G.holds_center(b, a), rank=lambda a, b: [b["region_id"]],
                   pick={"region_id": "region_id"})
    inside = F.col("region_id").isNotNull()
    side = F.least(G.width(G.rect()), G.height(G.rect()))
    strong = (F.col("n_cells") >= 3) | (inside & (F.col("n_cells") >= 2) & (F.col("conf_m") >= 220))
    return d.where(strong & (F.col("conf_m") >= F.when(inside, 180).otherwise(220)) & (side >= F.when(inside, 6).otherwise(8)))


def exclusion_zones(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Drop every rectangle that overlaps a user zone of its page."""
    return drop_matched(df, zones, lambda a, b: (G.overlap_x(a, b) > 0) & (G.overlap_y(a, b) > 0))


def positive_pages(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Pages that hold at least one region."""
    return pages.join(regions.select("page_id").distinct(), "page_id", "left_semi")


def page_filter_counts(pages: DataFrame, regions: DataFrame) -> DataFrame:
    flagged = pages.join(regions.select("page_id", F.lit(True).alias("_hit")).distinct(), "page_id", "left")
    return flagged.agg(F.count(F.lit(1)).alias("scanned"), F.count("_hit").alias("kept"),
                       F.count_if(F.col("_hit").isNull()).alias("filtered"))


def eval_ready(df: DataFrame) -> DataFrame:
    """Verified or labelled, and not discarded; a null label is not a label."""
    return df.where(((F.col("status") == "verified") | F.col("is_conjoined").isNotNull()) & ~F.coalesce("is_discarded", F.lit(False)))


#: Code points that count as script rather than noise.
SCRIPT_CLASS = r"[぀-ゟ゠-ヿ一-鿿･-ﾟ　-〿！-～\p{L}\p{Nd}]"


def script_glyphs(text: Column) -> Column:
    """Does the text hold a kana, CJK character or mark, full-width sign, letter or digit?"""
    return F.coalesce(text.rlike(SCRIPT_CLASS), F.lit(False))


def genuine_lines(df: DataFrame, fallback: bool = False) -> DataFrame:
    """Lines of 60 x 14 px and more. With ``fallback`` a page without any takes those of
    45 x 12 px, and all of its lines when there are none of these either."""
    a = G.rect()
    big = (G.height(a) >= 60) & (G.width(a) >= 14)
    if not fallback:
        return df.where(big)
    mid = (G.height(a) >= 45) & (G.width(a) >= 12)
    tier = F.when(big, 0).when(mid, 1).otherwise(2)
    best = df.groupBy("page_id").agg(F.min(tier).alias("_best"))
    return df.join(best, "page_id").where((tier <= F.col("_best"))).drop("_best")


def gutter_between(lo: Column, hi: Column, gutters: Column) -> Column:
    """Does a gutter coordinate lie strictly between two centres?"""
    return F.exists(gutters, lambda g: (g > F.least(lo, hi)) & (g < F.greatest(lo, hi)))
