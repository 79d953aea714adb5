"""Steps that read each table of a page once: figures grow with the input, results stay those of the other plans."""

from pyspark.sql import functions as F

from pagelattice.sources import telemetry as T

RECT = "page_id bigint, {0} bigint, l int, t int, r int, b int"


def rects(rows, row_id, spark):
    return spark.createDataFrame(rows, RECT.format(row_id))


def test_documents_of_whole_pages_and_of_parts(spark):
    """a page's items meet without a second shuffle, full pages stand in parts, and rows without a page stay."""
    rows = [(p, i, i, 2 * i, i + 9, 2 * i + 30) for p, n in ((1, 3), (2, 8), (None, 5)) for i in range(n)]
    boxes = rects(rows, "box_id", spark).withColumn("conf_m", F.lit(500)).repartition("page_id")
    lines = rects(rows, "line_id", spark).withColumn("category", F.lit("ORPHAN")).repartition("page_id")
    regions = rects([(p, i, 0, 0, 90, 90) for p in (1, 2, None) for i in (7, 8)], "region_id", spark)
    groups = regions.select("page_id", F.col("region_id").alias("group_id"), "region_id", F.lit(True).alias("is_bubble"), F.lit("BUBBLED").alias("category"), *"ltrb", F.lit("g").alias("text"))
    said = lines.select("page_id", F.lit(7).cast("long").alias("group_id"), "line_id", (-F.col("line_id")).alias("reading_order"), *"ltrb", F.lit("x").alias("text"))
    one = lambda key: lambda x: [x[key].alias("item_id"), F.lit(None).cast("int").alias("at")]
    told = {"boxes": one("id"), "lines": one("id"), "regions": one("index"), "groups": one("group_id"),
            "group_lines": lambda x: [x["line"]["line_id"].alias("item_id"), x["line"]["reading_order"].alias("at")]}
    want = sorted(str(tuple(x)) for name, df, key in (("boxes", boxes, "box_id"), ("lines", lines, "line_id"), ("regions", regions, "region_id"), ("groups", groups, "group_id"), ("group_lines", said, "line_id"))
                  for x in df.select(F.lit(name), "page_id", key, F.col("reading_order") if name == "group_lines" else F.lit(None).cast("int")).collect())
    for most, parts in ((2000, 3), (4, 5)):
        docs = T.to_page_json(boxes, regions, lines, 512, 800, most, groups=groups, group_lines=said)
        assert docs.count() == parts
        got = T.telemetry_rows(T.parse_telemetry(docs), told).select("stage", "page_id", "item_id", "at").collect()
        assert sorted(str(tuple(x)) for x in got) == want
        assert {x["doc"].count('"lines_count":8') for x in docs.where("page_id = 2").collect()} == {1}
    whole = T.to_page_json(boxes.where("page_id > 0"), regions.where("page_id > 0"), lines.where("page_id > 0"), 512, 800)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4, plan


def sources(df):
    """How often the plan reads its tables."""
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def both_plans(spark, form, limit):
    plain = sorted(map(str, form().collect()))
    spark.conf.set("pagelattice.pageRowLimit", limit)
    try:
        assert sorted(map(str, form().collect())) == plain
    finally:
        spark.conf.unset("pagelattice.pageRowLimit")
    return plain


def layout(spark):
    lines = rects([(p, i, (i * 37) % 400, (i * 91) % 700, (i * 37) % 400 + 6 + (i * 7) % 50, (i * 91) % 700 + 20 + i % 70) for p in (1, 2, 3) for i in range(20 * p)], "line_id", spark)
    regions = rects([(p, i, (i * 61) % 300, (i * 131) % 500, (i * 61) % 300 + 90, (i * 131) % 500 + 150) for p in (1, 2) for i in range(4 * p)], "region_id", spark)
    return lines.withColumn("category", F.element_at(F.array(F.lit("BUBBLED"), F.lit("ORPHAN"), F.lit("SFX")), (F.col("line_id") % 3 + 1).cast("int"))), regions


def test_exclusion_reads_lines_and_regions_once(spark):
    """a line looks once through its page's regions; crowded pages give the same lines."""
    from pagelattice.operators import grouping as GR
    lines, regions = layout(spark)
    form = lambda: GR.region_exclusion(lines, regions)
    assert sources(form()) == 2
    assert len(both_plans(spark, form, 6)) > 60


def test_ruby_groups_are_read_once(spark):
    """the width unit and the counts of a group come from its array; crowded groups give the same boxes."""
    from pagelattice.operators import grouping as GR
    lines, regions = layout(spark)
    boxes = lines.withColumn("region_id", F.floor(F.col("line_id") / 7)).withColumnRenamed("line_id", "box_id")
    form = lambda: GR.ruby_absorb_gap(boxes)
    assert sources(form()) == 1
    assert len(both_plans(spark, form, 6)) > 60


def test_ledger_of_pages_in_arrays_equals_that_of_joins(spark):
    """each table is read for the counts and for the arrays, no more; fuller pages are audited by joins with the same figures."""
    from pagelattice.operators import audits as A
    lines, regions = layout(spark)
    boxes = lines.withColumns({"r": F.col("l") + 12 + F.col("line_id").cast("int") % 20, "b": F.col("t") + 14 + F.col("line_id").cast("int") % 9}).drop("line_id")
    parts = regions.withColumns({"is_conjoined": F.col("region_id") % 2 == 0, "n_split_lines": F.lit(1), **{c: F.col("l") for c in ("p1x_raw", "p1y_raw", "p1x", "p1y", "p2x_raw", "p2y_raw", "p2x", "p2y")}})
    form = lambda: A.page_ledger(boxes, lines, regions, parts)
    assert sources(form()) == 4  # the counts are a table by then
    for limit in (25, 45):  # all pages and some of them
        assert len(both_plans(spark, form, limit)) == 3
    assert sum(r["column_pitch_violations"] + r["dropped_box_count"] + r["empty_bubbles_with_ink"] for r in form().collect()) > 0


def test_array_searches_start_with_cheap_steps(spark):
    """arrays are sorted without an interpreted comparison and pairs that are apart are left at once; lines and heaps of rectangles give
    the same rows as on tiles."""
    from pagelattice.operators import grouping as GR, joins as J
    rows = [(p, i, (i * 37) % 90, (i * 91) % 80, (i * 37) % 90 + (i * 7) % 40, (i * 91) % 80 + (i % 5) * 9) for p in (1, 2) for i in range(12 * p)]
    boxes = rects([*rows, (1, 90, 5, 5, 5, 5), (2, 91, 30, 30, 30, 60)], "box_id", spark).withColumn("conf_m", (F.col("box_id") * 31 % 100).cast("int"))
    regions = rects([(p, i, i * 20, i * 15, i * 20 + 50, i * 15 + 50) for p in (1, 2) for i in range(4)], "region_id", spark)
    form = lambda: J.max_intersection(GR.nms(boxes), regions)
    plan = form()._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan
    assert len(both_plans(spark, form, 3)) > 10


def test_region_frames_come_with_the_match(spark):
    """the matched region's corners need no second join."""
    from pagelattice.operators import joins as J
    boxes, regions = rects([(1, 1, 10, 10, 30, 30), (1, 2, 400, 10, 430, 30)], "box_id", spark), rects([(1, 7, 0, 5, 90, 80)], "region_id", spark)
    form = J.max_intersection(boxes, regions, frame=True)
    assert sources(form) == 2
    assert {tuple(r[c] for c in ("box_id", "region_id", "gl", "gt", "gr", "gb")) for r in form.collect()} == {(1, 7, 0, 5, 90, 80), (2, None, None, None, None, None)}
