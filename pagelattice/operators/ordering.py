"""Reading order, queues, chunks, carried values and top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.functions import geometry as G
from pagelattice.functions.text import natural_key
from pagelattice.operators.joins import id_buckets
from pagelattice.operators.ranking import neighbours, ranked, top_per_key, with_previous
from pagelattice.session import cut_lineage


def reading_key(a, band: int, rtl: bool = True) -> tuple[Column, Column]:
    """(row band of the centre, position along the reading direction)."""
    x = G.center_x(a)
    return G.floor_div(G.center_y(a), band), (-x if rtl else x)


def reading_order(df: DataFrame, band: int = 200, rtl: bool = True, row_id: str = "box_id",
                  by: Sequence[str] = ("page_id",), name: str = "reading_order") -> DataFrame:
    """Rank on the page by bands from the top, right to left (or left to right) inside one."""
    row, along = reading_key(G.rect(), band, rtl)
    return ranked(df, by, [row, along, F.col(row_id)], [row, G.floor_div(along, 64)], name)


def corner_order(df: DataFrame, band: int, row_id: str, by=("page_id",), name: str = "reading_order") -> DataFrame:
    """Crop order: bands by top edge, then right to left by left edge."""
    row = G.floor_div(F.col("t"), band)
    return ranked(df, by, [row, -F.col("l"), F.col(row_id)], [row, G.floor_div(-F.col("l"), 64)], name)


def strip_order(df: DataFrame, strip: int, row_id: str, by=("page_id",), name: str = "reading_order") -> DataFrame:
    """Line order: strips of the right edge from the right, then by top."""
    col = -G.floor_div(F.col("r"), strip)
    return ranked(df, by, [col, F.col("t"), F.col(row_id)], [col, G.floor_div(F.col("t"), 128)], name)


def page_summary(placed: DataFrame) -> DataFrame:
    """Boxes in and outside regions and the first and last inside box in reading order."""
    row, along = reading_key(G.rect(), 200)
    key = F.when(F.col("region_id").isNotNull(), F.struct(row.alias("y"), along.alias("x"), F.col("box_id").alias("id")))
    return placed.groupBy("page_id").agg(
        F.count("region_id").alias("n_inside"), F.count_if(F.col("region_id").isNull()).alias("n_outside"),
        F.min(key)["id"].alias("first_box"), F.max(key)["id"].alias("last_box"))


def in_group_order(df: DataFrame, group: Sequence[str], row_id: str, name: str = "line_order") -> DataFrame:
    x = -G.center_x(G.rect())
    return ranked(df, group, [x, F.col("t"), F.col(row_id)], [G.floor_div(x, 64)], name)


def crop_ids(crops: DataFrame, band: int = 150) -> DataFrame:
    """Running crop ids per batch in page and reading order, and the index on the page."""
    row = G.floor_div(F.col("t"), band)
    order = [F.col("page_name"), row, -F.col("l"), F.col("crop_key")]
    d = ranked(crops, ["batch"], order, [F.substring("page_name", 1, 3), F.col("page_name"), row], "seq_no")
    d = ranked(d, ["batch", "page_name"], order[1:], [row], "index_on_page")
    return d.withColumn("new_id", F.concat("batch", F.lit("_b"), F.lpad(F.col("seq_no").cast("string"), 5, "0")))


def queue_navigation(queue: DataFrame) -> DataFrame:
    """Position k of n in the batch queue with previous and next id."""
    d = ranked(queue, ["batch"], [F.col("crop_key")], id_buckets("crop_key"), "position", total="total")
    return neighbours(d, ["batch"], "position", {"previous_id": ("bubble_id", -1), "next_id": ("bubble_id", 1)})


def line_chunks(lines: DataFrame, k: int = 2, sep: str = "") -> DataFrame:
    """Consecutive lines of a group in chunks of ``k`` with bounds and joined text."""
    d = ranked(lines, ["page_id"], [F.col("line_no")], [F.floor(F.col("line_no") / 256)], "_rn")
    d = d.withColumn("chunk_no", F.floor((F.col("_rn") - 1) / k))
    items = F.array_sort(F.collect_list(F.struct("_rn", "text")))
    return d.groupBy("page_id", "chunk_no").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"),
        F.array_join(F.transform(items, lambda i: i["text"]), sep).alias("text"))


def carry_forward(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """The value, or the last positive one before it when it is 0."""
    d = df.withColumn("_v", F.when(F.col(value) > 0, F.col(value)))
    return with_previous(d, by, [order], F.floor(F.col(order) / 65536), {name: "_v"}, only_set=True).drop("_v")


def usage_deltas(samples: DataFrame, by: str, cores: int) -> DataFrame:
    """Utilisation percent between consecutive samples of a cumulated counter, clamped to 0..100."""
    d = with_previous(samples, [by], ["ts", "event_id"], F.date_trunc("day", "ts"), {"_v": "value", "_ts": "ts"})
    us = F.timestamp_diff("MICROSECOND", F.col("_ts"), F.col("ts"))
    pct = F.when(us > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("value") - F.col("_v")) * 1e8 / (us * cores))))
    return d.withColumn("usage_pct", pct).drop("_v", "_ts")


def worst_pages(ledger: DataFrame, k: int = 5) -> DataFrame:
    """The k pages with most violations and the first k clean ones. The ledger is written once: otherwise both choices audit every page, and
    their filters would work out the counters, which look into each other's arrays, over again inside one expression."""
    ledger = cut_lineage(ledger)
    worst = ledger.where("violations > 0").orderBy(F.col("violations").desc(), "page_id").limit(k)
    clean = ledger.where("violations = 0").orderBy("page_id").limit(k)
    return worst.withColumn("kind", F.lit("worst")).unionByName(clean.withColumn("kind", F.lit("clean")))


def top_pages_per_batch(ledger: DataFrame, measure: str, k: int = 6) -> DataFrame:
    return top_per_key(ledger, ["batch"], [F.col(measure).desc(), F.col("page_id")], k, "place")


def first_matching_pages(lines: DataFrame, k: int = 3, pad: int = 20, page_w: int = 512, page_h: int = 800) -> DataFrame:
    """First k pages per batch with a genuine outside line, and the padded box around these."""
    a = G.rect()
    hit = lines.where((F.col("category") == "ORPHAN") & (G.height(a) >= 60) & (G.width(a) >= 14))
    pages = hit.groupBy("batch", "page_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min("l").alias("l"), F.min("t").alias("t"),
                                                F.max("r").alias("r"), F.max("b").alias("b"))
    d = top_per_key(pages, ["batch"], [F.col("page_id")], k, "place")
    return d.select("batch", "page_id", "place", "n_lines",
                    F.greatest(F.lit(0), F.col("l") - pad).alias("crop_l"), F.greatest(F.lit(0), F.col("t") - pad).alias("crop_t"),
                    F.least(F.lit(page_w), F.col("r") + pad).alias("crop_r"), F.least(F.lit(page_h), F.col("b") + pad).alias("crop_b"))


def queue_head(manifest: DataFrame) -> DataFrame:
    """Per batch: first unlabelled live crop, first pending review by name, pending count."""
    todo = (F.col("status") == "unlabeled") & ~F.col("is_discarded")
    review = F.col("status").isin("conjoined", "recheck") & ~F.col("is_discarded")
    return manifest.groupBy("batch").agg(
        F.min_by("bubble_id", F.when(todo, F.col("crop_key"))).alias("next_unlabeled"),
        F.min(F.when(review, F.col("bubble_id"))).alias("next_review"), F.count_if(review).alias("pending"))


def natural_sort(files: DataFrame, by: Sequence[str], row_id: str = "file_id") -> DataFrame:
    """Position of each path in natural order within ``by``, equal paths by ``row_id``."""
    d = files.withColumn("_k", natural_key(F.col("path")))
    return ranked(d, by, [F.col("_k"), F.col("path"), F.col(row_id)], [F.substring("_k", 1, 24), F.substring("_k", 1, 48)], "position").drop("_k")


def featured_first(listing: DataFrame) -> DataFrame:
    """First page of each series in listing order."""
    return top_per_key(listing, ["series"], [F.col("list_no")], 1).drop("rn")


def error_gallery(evaluated: DataFrame, columns: int = 7) -> DataFrame:
    """False positives and negatives laid out in rows of seven."""
    kind = F.when(F.col("predicted") & ~F.col("is_conjoined"), "false_positive").when(~F.col("predicted") & F.col("is_conjoined"), "false_negative")
    d = evaluated.withColumn("kind", kind).where("kind IS NOT NULL")
    d = ranked(d, ["kind"], [F.col("crop_key")], id_buckets("crop_key"), "_rn")
    return d.withColumns({"gallery_row": F.floor((F.col("_rn") - 1) / columns), "gallery_col": (F.col("_rn") - 1) % columns}).drop("_rn")
