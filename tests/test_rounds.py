"""Round-based grouping: what must hold of any result, edge rows, and one page or region with very many boxes."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import geometry as G
from pagelattice.operators import joins as J, rounds as R
from pagelattice.operators.spatial import near_pairs

RECT = "l int, t int, r int, b int"


def heap(seed, n, pages=3, size=600):
    rnd = random.Random(seed)
    rows = []
    for p in range(pages):
        for i in range(n):
            l, t = rnd.randrange(0, size), rnd.randrange(0, size)
            rows.append((p, i, rnd.choice(["BUBBLED", "ORPHAN", "SFX"]), l, t, l + rnd.randrange(0, 40), t + rnd.randrange(0, 90)))
        rows += [(p, n, "SFX", 5, 5, 25, 60), (p, n + 1, "SFX", 5, 5, 25, 60), (p, n + 2, "ORPHAN", 9, 9, 9, 9)]
    return rows


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(heap(3, 60), f"page_id long, line_id long, category string, {RECT}").withColumn("cw", F.lit(24)).cache()


@pytest.fixture(scope="module")
def boxes(lines):
    return lines.withColumnRenamed("line_id", "box_id")


def overlaps(df, row_id, on):
    return near_pairs(df, df, lambda a, b: (a[row_id] < b[row_id]) & on(a, b)).count()


def test_line_dedup_leaves_no_pair(lines):
    out = R.line_dedup(lines).cache()
    assert 0 < out.count() < lines.count()
    assert overlaps(out, "line_id", lambda a, b: G.containment_over(a, b, 65)) == 0
    assert R.line_dedup(out).exceptAll(out).count() == 0
    assert {r.line_id for r in out.where("l = 5 AND t = 5 AND page_id = 0").collect()} <= {60}


def test_crossings_are_gone_and_kinds_stay_apart(lines):
    out = R.crossover_resolve(lines).cache()
    assert overlaps(out, "line_id", lambda a, b: G.intersection(a, b) > 0) == 0
    inside = lines.where("category = 'BUBBLED'").select("page_id", "line_id")
    assert out.where("category = 'BUBBLED'").join(inside, ["page_id", "line_id"], "left_anti").count() == 0


def test_extension_keeps_its_width_limit_and_leaves_region_lines(lines):
    out = R.unbubbled_extend(lines).cache()
    grown = out.join(lines.select("page_id", "line_id", F.col("r").alias("r0"), F.col("l").alias("l0"), F.col("t").alias("t0"), F.col("b").alias("b0")), ["page_id", "line_id"])
    changed = grown.where("r <> r0 OR l <> l0 OR t <> t0 OR b <> b0")
    assert changed.count() > 0 and changed.where("(r - l) * 100 > 24 * 140").count() == 0
    same = lines.where("category = 'BUBBLED'").select(*out.columns)
    assert same.exceptAll(out.where("category = 'BUBBLED'")).count() == 0


def test_trimmed_rectangles_do_not_overlap(boxes):
    out = R.edge_trim(boxes, 640, 700)
    assert overlaps(out, "box_id", lambda a, b: G.intersection(a, b) > 0) == 0
    assert out.where("r - l < 10 OR b - t < 10 OR l < 0 OR r > 640").count() == 0


def test_seeded_reach_is_the_search_from_the_lowest_box(boxes):
    got = {(r.page_id, r.box_id): r.cluster_id for r in R.reach_seeded(boxes, 60).collect()}
    rows = {}
    for r in boxes.collect():
        rows.setdefault(r.page_id, []).append(r)
    for page, rs in rows.items():
        rs.sort(key=lambda r: r.box_id)
        seen = {}
        for s in rs:
            if s.box_id in seen:
                continue
            seen[s.box_id], todo = s.box_id, deque([s])
            while todo:
                x = todo.popleft()
                far = int(max(x.r - x.l, x.b - x.t) * 60 / 100)
                for y in rs:
                    if y.box_id not in seen and max(max(x.l, y.l) - min(x.r, y.r), 0) <= far and max(max(x.t, y.t) - min(x.b, y.b), 0) <= far:
                        seen[y.box_id] = s.box_id
                        todo.append(y)
        assert {k: got[page, k] for k in seen} == seen
    assert len(set(got.values())) > 3


def test_reconciled_lines_cover_every_box(spark, lines, boxes):
    few = lines.where("line_id % 7 = 0").drop("cw")
    regions = spark.createDataFrame([(0, 1, 50, 50, 250, 300), (0, 2, 300, 300, 590, 640), (1, 1, 0, 0, 600, 600), (9, 1, 0, 0, 9, 9)], f"page_id long, region_id long, {RECT}")
    out = R.reconcile_uncovered(few, boxes, regions).cache()
    assert J.uncovered(boxes.select("page_id", "box_id", *"ltrb"), out).count() == 0
    assert out.where("origin = 0").count() == few.count()
    assert out.groupBy("page_id", "origin", "line_id").count().where("count > 1").count() == 0
    alone = R.reconcile_uncovered(few.limit(0), boxes.where("page_id = 2"), regions)
    assert J.uncovered(boxes.where("page_id = 2").select("page_id", "box_id", *"ltrb"), alone).count() == 0


def test_glyphs_fit_one_character(boxes):
    out = R.recombine_glyphs(boxes.withColumn("region_id", F.when(F.col("l") < 300, 1).cast("long")).withColumn("cwr", F.lit(20)))
    assert 0 < out.count() < boxes.count()
    assert out.groupBy("page_id", "box_id").count().where("count > 1").count() == 0


def test_outside_columns(boxes):
    out = R.columns_outside(boxes.withColumn("orphan", F.col("category") == "ORPHAN"))
    assert out.where("category = 'ORPHAN' AND (n_boxes < 2 OR (r - l) * 100 > 24 * 145 OR (b - t) * 100 < (r - l) * 130)").count() == 0
    assert out.agg(F.sum("n_boxes")).first()[0] <= boxes.count()


def test_empty_tables(lines, boxes):
    none, no_boxes = lines.limit(0), boxes.limit(0)
    assert R.line_dedup(none).count() == R.crossover_resolve(none).count() == R.unbubbled_extend(none).count() == 0
    assert R.edge_trim(no_boxes, 9, 9).count() == R.reach_seeded(no_boxes).count() == 0
    framed = no_boxes.select("page_id", F.col("box_id").alias("region_id"), "box_id", *"ltrb", "cw", *[F.col(s).alias(f"g{s}") for s in "ltrb"])
    assert R.columns_in_region(framed).count() == 0


def test_a_region_of_a_hundred_thousand_boxes(spark):
    """Twenty columns of narrow jitter and one region of three boxes; nothing depends on the number of boxes in a column."""
    i = F.col("id").cast("int")
    big = spark.range(100_000).select(
        F.lit(1).cast("long").alias("page_id"), F.lit(1).cast("long").alias("region_id"), F.col("id").alias("box_id"),
        (i % 20 * 60 + 20 + F.floor(i / 20).cast("int") % 5).alias("l"), (F.floor(i / 20).cast("int") * 25).alias("t"))
    big = big.withColumns({"r": F.col("l") + 24, "b": F.col("t") + 22, "cw": F.lit(24), "gl": F.lit(0), "gt": F.lit(0), "gr": F.lit(1230), "gb": F.lit(130_000)})
    small = spark.createDataFrame([(2, 5, 1, 10, 10, 34, 34), (2, 5, 2, 11, 40, 35, 64), (2, 5, 3, 60, 10, 84, 64)], f"page_id long, region_id long, box_id long, {RECT}")
    small = small.withColumns({"cw": F.lit(24), "gl": F.lit(0), "gt": F.lit(0), "gr": F.lit(120), "gb": F.lit(90)})
    out = R.columns_in_region(big.unionByName(small)).cache()
    assert [(r.column_no, r.n_boxes) for r in out.where("page_id = 1").orderBy("column_no").collect()] == [(k + 1, 5000) for k in range(20)]
    assert [tuple(r) for r in out.where("page_id = 2").orderBy("column_no").select("l", "r", "n_boxes").collect()] == [(10, 35, 2), (60, 84, 1)]
    assert overlaps(out, "column_no", lambda a, b: G.intersection(a, b) > 0) == 0
