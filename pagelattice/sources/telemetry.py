"""Nested page documents: one JSON per page with one object per stage.

A page with more than ``MAX_ITEMS`` rows in a table is written as several parts, so no document
gathers an unbounded number of rows; reading simply unites the parts. Counts in a part are those of the page.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import udtf

from pagelattice.functions import geometry as G
from pagelattice.operators.joins import id_buckets
from pagelattice.operators.ranking import ranked
from pagelattice.session import cut_lineage

MAX_ITEMS = 2000
RECT = "left:int,top:int,right:int,bottom:int"
# Names of the stage objects and their fields.
DOCUMENT = f"""
page_index bigint, page_label string, image_width int, image_height int,
module_1_ctd struct<duration_ms:bigint,lines_count:int,bubbles_count:int,lines:array<struct<id:bigint,confidence:double,{RECT}>>,bubbles:array<struct<index:bigint,{RECT}>>>,
module_1_5_categorize struct<duration_ms:bigint,total_boxes:int,boxes:array<struct<id:bigint,category:string,{RECT}>>>,
module_2_vertical_lines struct<duration_ms:bigint,total_lines:int,suppressed_furigana_count:int,lines:array<struct<id:bigint,category:string,orientation:string,{RECT}>>>,
module_3_waist_crunch struct<duration_ms:bigint,total_partitions:int,conjoined_count:int,partitions:array<struct<bubble_index:bigint,bubble_rect:struct<{RECT}>,is_conjoined:boolean,conf_conj:double,
 p1_raw:struct<x:int,y:int>,p2_raw:struct<x:int,y:int>,p1_snapped:struct<x:int,y:int>,p2_snapped:struct<x:int,y:int>,candidate_notches:array<struct<x:int,y:int>>,lobe_a_line_ids:array<bigint>,lobe_b_line_ids:array<bigint>>>>,
module_4_ocr struct<total_groups:int,groups:array<struct<group_id:bigint,is_bubble:boolean,bubble_index:bigint,category:string,{RECT},recognized_text:string,
 reading_order_lines:array<struct<line_id:bigint,reading_order:int,{RECT},recognized_text:string>>>>>,
module_5_translate struct<engine:string,total_groups:int,groups:array<struct<group_id:bigint,is_bubble:boolean,category:string,recognized_text:string,translated_text:string,{RECT}>>>,
module_6_typeset struct<total_blocks_typeset:int,blocks:array<struct<group_id:bigint,is_bubble:boolean,font_size:double,ja:string,en:string>>>"""

STAGES = {"boxes": "module_1_ctd.lines", "regions": "module_1_ctd.bubbles", "categories": "module_1_5_categorize.boxes", "lines": "module_2_vertical_lines.lines",
          "partitions": "module_3_waist_crunch.partitions", "groups": "module_4_ocr.groups", "translations": "module_5_translate.groups", "blocks": "module_6_typeset.blocks"}


def read_telemetry(spark, paths) -> DataFrame:
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(paths)


def parse_telemetry(docs: DataFrame, column: str = "doc") -> DataFrame:
    return docs.select(F.from_json(column, DOCUMENT).alias("d")).select("d.*")


def explode_telemetry(pages: DataFrame) -> dict[str, DataFrame]:
    """One table per stage, keyed by ``page_id``; rectangles as ``l t r b``."""
    out = {}
    for name, path in STAGES.items():
        d = pages.select(F.col("page_index").alias("page_id"), F.explode(path).alias("x")).select("page_id", "x.*")
        for long, short in (("left", "l"), ("top", "t"), ("right", "r"), ("bottom", "b")):
            if long in d.columns:
                d = d.withColumnRenamed(long, short)
        out[name] = d
    groups = out["groups"]
    out["groups"] = groups.drop("reading_order_lines")
    out["group_lines"] = groups.select("page_id", "group_id", F.explode("reading_order_lines").alias("x")).select(
        "page_id", "group_id", "x.line_id", "x.reading_order", "x.recognized_text",
        F.col("x.left").alias("l"), F.col("x.top").alias("t"), F.col("x.right").alias("r"), F.col("x.bottom").alias("b"))
    return out


def telemetry_rows(pages: DataFrame, rows: dict[str, Callable[[Column], list[Column]]]) -> DataFrame:
    """(stage, page_id, and what ``rows[stage](item)`` gives) for each item of the named stages, all from one reading of the documents.
    ``group_lines`` items have the fields ``group`` and ``line``."""
    def items(stage):
        if stage == "group_lines":
            each = lambda g: F.transform(g["reading_order_lines"], lambda x: F.struct(F.lit(stage).alias("stage"), *rows[stage]({"group": g, "line": x})))
            return F.flatten(F.filter(F.transform(STAGES["groups"], each), lambda xs: xs.isNotNull()))
        return F.transform(STAGES[stage], lambda x: F.struct(F.lit(stage).alias("stage"), *rows[stage](x)))

    told = F.flatten(F.filter(F.array(*[items(s) for s in rows]), lambda xs: xs.isNotNull()))
    return pages.select(F.col("page_index").alias("page_id"), F.explode(told).alias("x")).select("page_id", "x.*")


def _rect() -> list[Column]:
    return [F.col(s).alias(n) for s, n in zip("ltrb", ("left", "top", "right", "bottom"))]


def _rect_struct() -> Column:
    return F.struct(*_rect())


def _point(x: str, y: str) -> Column:
    return F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))


#: Stands for the missing number of a page while parts are numbered.
NO_PAGE = -(1 << 63)


def _page_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per page: rows of each table as ``n_<name>``, lines by category and conjoined partitions."""
    number = lambda kind: F.count_if(F.col("category") == kind).cast("int")
    more = {"lines": [number(k).alias(f"n_{k}") for k in ("BUBBLED", "ORPHAN", "SFX")], "partitions": [F.count_if("is_conjoined").cast("int").alias("n_conjoined")]}
    counts = [t.groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias(f"n_{n}"), *more.get(n, [])) for n, t in tables.items()]
    stacked = reduce(lambda p, q: p.unionByName(q, allowMissingColumns=True), counts)
    return cut_lineage(stacked.groupBy("page_id").agg(*[F.max(c).alias(c) for c in stacked.columns if c != "page_id"]))


def _listed(row_id: str, item: Column) -> Column:
    """Aggregate: the items in id order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(row_id).alias("_k"), item.alias("x")))), lambda e: e["x"])


def _lines_of_groups(group_lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per group its lines in reading order; a group is one object, so its lines stand together."""
    line = F.struct(F.col("line_id").cast("long").alias("line_id"), F.col("reading_order").cast("int").alias("reading_order"), *_rect(), F.col("text").alias("recognized_text"))
    return group_lines.groupBy(*keys, "group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "line_id", line.alias("x")))), lambda e: e["x"]).alias("_lines"))


def _with_lines(groups: Column, lists: Column) -> Column:
    """Group objects with the lines listed under their id, null where there are none."""
    of = lambda g: F.get(F.filter(lists, lambda e: e["group_id"] == g["group_id"]), F.lit(0))["_lines"]
    return F.transform(groups, lambda g: g.withField("reading_order_lines", of(g)))


def _whole_pages(sizes: DataFrame, kinds: dict, group_lines: DataFrame | None) -> DataFrame:
    """Pages with the items of each kind as an array. Every table is spread by page once, and the page rows meet where they are."""
    d = sizes.withColumn("part", F.lit(0).cast("long"))
    for name, (table, row_id, item) in kinds.items():
        d = d.join(table.groupBy("page_id").agg(_listed(row_id, item).alias(name)), "page_id", "left")
    if group_lines is not None:
        lists = _lines_of_groups(group_lines, ["page_id"]).groupBy("page_id").agg(F.collect_list(F.struct("group_id", "_lines")).alias("_lists"))
        d = d.join(lists, "page_id", "left").withColumn("groups", _with_lines(F.col("groups"), F.col("_lists"))).drop("_lists")
    return d


def _pages_in_parts(sizes: DataFrame, kinds: dict, group_lines: DataFrame | None, max_items: int) -> DataFrame:
    """As ``_whole_pages`` for pages with more than ``max_items`` rows of a kind: numbered in buckets, ``max_items`` to a part."""
    known = lambda df: df.withColumn("page_id", F.coalesce("page_id", F.lit(NO_PAGE)))
    sizes = known(sizes)
    stacked = None
    for name, (table, row_id, item) in kinds.items():
        table = known(table).join(sizes.select("page_id"), "page_id", "left_semi")
        rows = ranked(table, ["page_id"], [F.col(row_id)], id_buckets(row_id), "_rn").withColumn("part", F.floor((F.col("_rn") - 1) / max_items))
        if name == "groups" and group_lines is not None:
            listed = _lines_of_groups(known(group_lines).join(sizes.select("page_id"), "page_id", "left_semi"), ["page_id"])
            rows = rows.join(listed, ["page_id", "group_id"], "left")
            item = item.withField("reading_order_lines", F.col("_lines"))
        g = rows.groupBy("page_id", "part").agg(_listed("_rn", item).alias(name))
        stacked = g if stacked is None else stacked.unionByName(g, allowMissingColumns=True)
    d = stacked.groupBy("page_id", "part").agg(*[F.first(n, ignorenulls=True).alias(n) for n in kinds]).join(sizes, "page_id", "left")
    return d.withColumn("page_id", F.when(F.col("page_id") != NO_PAGE, F.col("page_id")))


def to_page_json(boxes: DataFrame, regions: DataFrame, lines: DataFrame, page_w: int, page_h: int, max_items: int = MAX_ITEMS, *,
                 categories: DataFrame | None = None, partitions: DataFrame | None = None, groups: DataFrame | None = None, group_lines: DataFrame | None = None,
                 translations: DataFrame | None = None, blocks: DataFrame | None = None, engine: str = "none") -> DataFrame:
    """(page_id, part, doc): nested documents with per-stage counts, items in id order. Stages that aren't given are left out.

    ``categories(page_id, box_id, category, l t r b)``; ``partitions(page_id, region_id, l t r b, is_conjoined, conf_conj, p1x_raw p1y_raw p2x_raw
    p2y_raw, p1x p1y p2x p2y, notches, lobe_a, lobe_b)``; ``groups(page_id, group_id, region_id, is_bubble, category, l t r b, text)`` with
    ``group_lines(page_id, group_id, line_id, reading_order, l t r b, text)``; ``translations`` like groups with ``translated``;
    ``blocks(page_id, group_id, is_bubble, font_size, ja, en)``."""
    a = G.rect()
    kinds = {
        "boxes": (boxes, "box_id", F.struct(F.col("box_id").alias("id"), (F.col("conf_m") / 1000.0).alias("confidence"), *_rect(), G.center_x(a).alias("centerX"), G.center_y(a).alias("centerY"))),
        "bubbles": (regions, "region_id", F.struct(F.col("region_id").alias("index"), *_rect(), G.width(a).alias("width"), G.height(a).alias("height"))),
        "lines": (lines, "line_id", F.struct(F.col("line_id").alias("id"), "category", F.lit("VERTICAL").alias("orientation"), *_rect())),
    }
    if categories is not None:
        kinds["categories"] = (categories, "box_id", F.struct(F.col("box_id").alias("id"), "category", *_rect()))
    if partitions is not None:
        kinds["partitions"] = (partitions, "region_id", F.struct(
            F.col("region_id").alias("bubble_index"), _rect_struct().alias("bubble_rect"), "is_conjoined", "conf_conj", _point("p1x_raw", "p1y_raw").alias("p1_raw"), _point("p2x_raw", "p2y_raw").alias("p2_raw"),
            _point("p1x", "p1y").alias("p1_snapped"), _point("p2x", "p2y").alias("p2_snapped"), F.col("notches").alias("candidate_notches"), F.col("lobe_a").alias("lobe_a_line_ids"), F.col("lobe_b").alias("lobe_b_line_ids")))
    if groups is not None:
        kinds["groups"] = (groups, "group_id", F.struct("group_id", "is_bubble", F.col("region_id").alias("bubble_index"), "category", *_rect(), F.col("text").alias("recognized_text")))
    if translations is not None:
        kinds["translations"] = (translations, "group_id", F.struct("group_id", "is_bubble", "category", F.col("text").alias("recognized_text"), F.col("translated").alias("translated_text"), *_rect()))
    if blocks is not None:
        kinds["blocks"] = (blocks, "group_id", F.struct("group_id", "is_bubble", "font_size", "ja", "en"))
    tables = {name: table for name, (table, _, _) in kinds.items()}
    sizes = _page_sizes(tables if group_lines is None else tables | {"group_lines": group_lines})
    over = [F.col(c) > max_items for c in sizes.columns if c in {f"n_{k}" for k in (*tables, "group_lines")}]
    full = F.coalesce(reduce(lambda p, q: p | q, [F.coalesce(x, F.lit(False)) for x in over]), F.lit(False)) | F.col("page_id").isNull()
    hot = sizes.where(full)
    if hot.isEmpty():
        d = _whole_pages(sizes, kinds, group_lines)
    else:
        few = {n: (t.join(hot.select("page_id"), "page_id", "left_anti").where("page_id IS NOT NULL"), *more) for n, (t, *more) in kinds.items()}
        said = None if group_lines is None else group_lines.join(hot.select("page_id"), "page_id", "left_anti").where("page_id IS NOT NULL")
        d = _whole_pages(sizes.where(~full), few, said).unionByName(_pages_in_parts(hot, kinds, group_lines, max_items))
    size = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(0))
    state = lambda c: F.when(size(c) > 0, "COMPLETED").otherwise("PENDING").alias("status")
    doc = [
        F.col("page_id").alias("page_index"), F.lit(page_w).alias("image_width"), F.lit(page_h).alias("image_height"),
        F.struct(state("boxes"), size("boxes").alias("lines_count"), size("bubbles").alias("bubbles_count"), F.col("boxes").alias("lines"), "bubbles").alias("module_1_ctd"),
        F.struct(state("lines"), size("lines").alias("total_lines"), size("BUBBLED").alias("bubbled_lines_count"), size("ORPHAN").alias("orphan_lines_count"),
                 size("SFX").alias("sfx_lines_count"), "lines").alias("module_2_vertical_lines")]
    extra = {
        "categories": lambda: F.struct(state("categories"), size("categories").alias("total_boxes"), F.col("categories").alias("boxes")).alias("module_1_5_categorize"),
        "partitions": lambda: F.struct(state("partitions"), size("partitions").alias("total_partitions"), size("conjoined").alias("conjoined_count"), "partitions").alias("module_3_waist_crunch"),
        "groups": lambda: F.struct(state("groups"), size("groups").alias("total_groups"), "groups").alias("module_4_ocr"),
        "translations": lambda: F.struct(state("translations"), F.lit(engine).alias("engine"), size("translations").alias("total_groups"), F.col("translations").alias("groups")).alias("module_5_translate"),
        "blocks": lambda: F.struct(state("blocks"), size("blocks").alias("total_blocks_typeset"), "blocks").alias("module_6_typeset"),
    }
    doc += [make() for name, make in extra.items() if name in kinds]
    return d.select("page_id", "part", F.to_json(F.struct(*doc)).alias("doc"))


@udtf(returnType="stage string, item_id bigint, l int, t int, r int, b int")
class PageItems:
    """Table function: a page document to one typed row per box, region and line."""

    def eval(self, doc: str):
        import json
        page = json.loads(doc)
        for stage, module, field, key in (("boxes", "module_1_ctd", "lines", "id"), ("regions", "module_1_ctd", "bubbles", "index"),
                                          ("lines", "module_2_vertical_lines", "lines", "id")):
            for x in (page.get(module) or {}).get(field) or []:
                yield stage, x[key], x["left"], x["top"], x["right"], x["bottom"]


def page_items(docs: DataFrame) -> DataFrame:
    """``PageItems`` as a lateral join over (page_id, doc)."""
    spark = docs.sparkSession
    spark.udtf.register("page_items", PageItems)
    return spark.sql("SELECT d.page_id, i.* FROM {docs} d, LATERAL page_items(d.doc) i", docs=docs)
