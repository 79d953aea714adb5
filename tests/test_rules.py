"""Golden values and thresholds on tiny tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.functions import text as X
from pagelattice.operators import audits as A, dataset as D, grouping as GR, joins as J
from pagelattice.operators.graph import connected_components, greedy_losers
from pagelattice.operators.ranking import neighbours, ranked, running, with_previous


def rects(spark, rows, names="page_id bigint, box_id bigint, l int, t int, r int, b int"):
    return spark.createDataFrame(rows, names)


def one(spark, fn, *values):
    d = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in d.select(fn(F.col("s"))).collect()]


def test_published_confusion_ratios(spark):
    n = spark.createDataFrame([(146, 3, 788, 21, 958)], "tp int, fn int, tn int, fp int, eligible int")
    r = D.confusion_rates(n).first()
    got = [round(r[c], 4) for c in ("accuracy", "precision", "recall", "specificity", "f1")]
    assert got == [97.4948, 87.4251, 97.9866, 97.4042, 92.4051]  # 788 of 809 is 97.40420 %


def test_empty_confusion_is_zero(spark):
    r = D.confusion_rates(spark.createDataFrame([(0, 0, 0, 0, 0)], "tp int, fn int, tn int, fp int, eligible int")).first()
    assert r["accuracy"] == r["precision"] == r["f1"] == 0


def test_nms_threshold_is_strict(spark):
    # 100 x 100 boxes: shifted by 48, IoU = 5200/14800 = .3514 (dropped); by 49, 5100/14900 = .342 (kept).
    d = rects(spark, [(1, 1, 0, 0, 100, 100, 900), (1, 2, 48, 0, 148, 100, 800), (2, 3, 0, 0, 100, 100, 900), (2, 4, 49, 0, 149, 100, 800), (3, 5, 7, 7, 7, 7, 1)],
              "page_id bigint, box_id bigint, l int, t int, r int, b int, conf_m int")
    assert sorted(r.box_id for r in GR.nms(d).collect()) == [1, 3, 4, 5]


def test_equal_intersections_keep_the_first_region(spark):
    boxes = rects(spark, [(1, 1, 40, 10, 60, 30), (1, 2, 200, 200, 200, 200)])
    regions = rects(spark, [(1, 7, 0, 0, 100, 100), (1, 5, 20, 0, 120, 100)], "page_id bigint, region_id bigint, l int, t int, r int, b int")
    got = {r.box_id: r.region_id for r in J.max_intersection(boxes, regions).collect()}
    assert got == {1: 5, 2: None}


def test_center_on_an_edge(spark):
    boxes = rects(spark, [(1, 1, 90, 10, 110, 30)])
    regions = rects(spark, [(1, 7, 0, 0, 100, 100)], "page_id bigint, region_id bigint, l int, t int, r int, b int")
    assert J.center_first(boxes, regions).first().region_id == 7
    assert J.center_first(boxes, regions, edge="exclusive").first().region_id == -1


def test_tiles_report_a_pair_once(spark):
    from pagelattice.operators.spatial import near_pairs
    a = rects(spark, [(1, 1, -300, -300, 900, 900), (1, 2, 256, 256, 512, 512)])
    pairs = near_pairs(a, a, lambda p, q: p["box_id"] < q["box_id"])
    assert pairs.count() == 1


def test_components_and_greedy(spark):
    rng = np.random.default_rng(3)
    e = [(1, int(u), int(v)) for u, v in rng.integers(0, 300, (220, 2))]
    d = spark.createDataFrame(e, "k int, u bigint, v bigint")
    got = {r.id: r.label for r in connected_components(d, ["k"]).collect()}
    parent = list(range(300))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, u, v in e:
        p, q = find(u), find(v)
        parent[max(p, q)] = min(p, q)
    assert all(label == find(i) for i, label in got.items())
    conflicts = {(min(u, v), max(u, v)) for _, u, v in e if u != v}
    lost = {r.id for r in greedy_losers(spark.createDataFrame([(1, a, b) for a, b in conflicts], "k int, hi bigint, lo bigint"), ["k"]).collect()}
    kept = []
    for i in range(300):
        if not any((k, i) in conflicts for k in kept):
            kept.append(i)
    assert lost == set(range(300)) - set(kept)


def test_two_level_scans_equal_plain_windows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(i), int(x) if x else None) for i, (k, x) in enumerate(zip(rng.integers(0, 2, 500), rng.integers(0, 9, 500)))]
    d = spark.createDataFrame(rows, "k int, i bigint, x int")
    bucket = F.floor(F.col("i") / 37)
    got = ranked(d, ["k"], [F.col("i")], [bucket], "rn", total="n")
    got = with_previous(got, ["k"], ["i"], bucket, {"prev": "x"})
    got = with_previous(got, ["k"], ["i"], bucket, {"last_set": "x"}, only_set=True)
    got = running(got, ["k"], ["i"], bucket, "sum", "x", "total")
    got = neighbours(got, ["k"], "rn", {"after": ("i", 1)})
    got.createOrReplaceTempView("got")
    bad = spark.sql("""SELECT count(*) AS n FROM (SELECT *, row_number() OVER w AS rn2, lag(x) OVER w AS p2, last(x, true) OVER w AS s2, coalesce(sum(x) OVER w, 0) AS t2, lead(i) OVER w AS a2
        FROM got WINDOW w AS (PARTITION BY k ORDER BY i)) WHERE rn <> rn2 OR NOT (prev <=> p2) OR NOT (last_set <=> s2) OR coalesce(total, 0) <> t2 OR NOT (after <=> a2)""").first().n
    assert bad == 0 and got.count() == 500


def test_cjk_text(spark):
    d = spark.createDataFrame([(["日本", " 語 ", "", "abc", "def-", "ghi", "テスト"],)], "a array<string>")
    assert d.select(X.compose(F.col("a"))).first()[0] == "日本語 abc def-ghi テスト"
    assert one(spark, X.normalize_source, "あああああ！！\nやった♡　いいぃぃぃ…", "soooo？") == ["ああ!! やった ♡ いいぃぃ...", "soo?"]
    from pagelattice.operators.filters import script_glyphs
    assert one(spark, script_glyphs, "…!?", "ｱ", "「」", "７", "a") == [False, True, True, True, True]


def test_names(spark):
    assert one(spark, X.safe_name, " ..a/b:c?  d- ", "...", 'x"y') == ["a-b-c- d", "Translated Manga", "x'y"]
    assert one(spark, X.chapter_name, "/d/Title Ch. 7/Chapter.cbz", "/d/downloads/Chapter.cbz", "/d/Some/chapter 3.zip", "/d/Some/Chapter.cbz") == [
        "Chapter 7 Translated.cbz", "Chapter Translated.cbz", "chapter 3 Translated.cbz", "Some Translated.cbz"]
    d = spark.createDataFrame([("p10",), ("p9",), ("P009a",), ("p-1",), ("p",)], "s string")
    assert [r.s for r in d.orderBy(X.natural_key(F.col("s")), "s").collect()] == ["p", "p9", "P009a", "p10", "p-1"]


def test_six_decimals_round_like_c(spark):
    rng = np.random.default_rng(1)
    vals = [float(v) for v in rng.random(3000)] + [k / 128 for k in range(129)] + [0.1081535, 0.0, 1.0]
    d = spark.createDataFrame([(v,) for v in vals], "v double")
    assert [r[0] for r in d.select(D.six_decimals(F.col("v"))).collect()] == [f"{v:.6f}" for v in vals]


def test_small_batch_is_an_error(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "batch string, k bigint")
    with pytest.raises(ValueError):
        D.sample_per_batch(d, 2, 1, "k")
    assert D.sample_per_batch(d, 2, 1, "k", check=False).count() == 3


def test_ledger_goldens(spark):
    rows = [(i, 100 + i, 0) for i in range(6)] + [(9, 5, 4)]
    d = spark.createDataFrame(rows, "page_id int, m1_box_count int, v int")
    for m, _ in A.SUMMARY_METRICS:
        d = d.withColumn(m, F.col("v") if m == "width_choking_count" else F.lit(0))
    got = {r.metric: (r.total, r.verdict) for r in A.ledger_summary(d).collect()}
    assert got["width_choking_count"] == (4, "DEFECT") and got["furigana_leaks"] == (0, "PASS") and got["total_violations"][1] is None


def test_equal_rows_and_null_sides_stay_in_spatial_matches(spark):
    boxes = spark.createDataFrame([(1, 5, 0, 0, 10, 10), (1, 5, 0, 0, 10, 10), (1, 6, None, 0, 10, 10)], "page_id int, box_id int, l int, t int, r int, b int")
    regions = spark.createDataFrame([(1, 7, 0, 0, 20, 20)], "page_id int, region_id int, l int, t int, r int, b int")
    got = sorted((r.box_id, r.region_id) for r in J.max_intersection(boxes, regions).collect())
    assert got == [(5, 7), (5, 7), (6, None)]


def test_union_goes_on_to_the_fixpoint(spark):
    """Twelve overlapping pairs on one page: all are united, whatever the page's size counts as."""
    rows = [(1, 2 * i + k, 0, 100 * i, 20, 100 * i + 20 + k) for i in range(12) for k in (0, 1)]
    d = spark.createDataFrame(rows, "page_id int, box_id int, l int, t int, r int, b int")
    for limit in ("5", "2000"):
        spark.conf.set("pagelattice.pageRowLimit", limit)
        try:
            assert sorted(r.box_id for r in GR.merge_overlaps(d).collect()) == [2 * i for i in range(12)]
        finally:
            spark.conf.unset("pagelattice.pageRowLimit")


def test_crops_without_an_archive_have_an_unknown_title(spark):
    crops = spark.createDataFrame([("b1", "c07_p012.webp"), ("b2", "c7_p1.webp"), ("b3", "c99_p1.webp"), ("b4", "cover.webp"), ("b5", None)], "bubble_id string, page_name string")
    archives = spark.createDataFrame([("cbz_07.cbz", "Seven"), ("cbz_08.cbz", "Eight")], "archive string, title string")
    got = {r.bubble_id: (r.archive, r.title) for r in J.lineage(crops, archives).collect()}
    assert got == {"b1": ("cbz_07.cbz", "Seven"), "b2": ("cbz_07.cbz", "Seven"), "b3": ("cbz_99.cbz", "Unknown"), "b4": (None, "Unknown"), "b5": (None, "Unknown")}


def test_pages_without_fragmented_columns_stay_in_the_audit(spark):
    owned = spark.createDataFrame([(1, 1, 1, 0, 0, 20, 90, 48), (1, 1, 2, 100, 0, 120, 90, 48), (2, 1, 3, 0, 0, 20, 90, 48), (2, 1, 4, 4, 0, 24, 90, 48)],
                                  "page_id bigint, region_id bigint, line_id bigint, l int, t int, r int, b int, local_width2 int")
    assert sorted(tuple(r) for r in A.fragmentation(owned).collect()) == [(1, 0), (2, 1)]


def test_two_thousand_paired_boxes_on_one_page(spark):
    import time
    rows = [(1, 2 * i + k, 30 * (i % 40) + k, 30 * (i // 40), 30 * (i % 40) + 20, 30 * (i // 40) + 20) for i in range(1000) for k in (0, 1)]
    boxes = rects(spark, rows)
    GR.merge_overlaps(boxes.limit(10), "nested").collect()
    start = time.time()
    got = sorted(tuple(r) for r in GR.merge_overlaps(boxes, "nested").collect())
    assert time.time() - start < 30
    assert got == sorted((1, 2 * i, 30 * (i % 40), 30 * (i // 40), 30 * (i % 40) + 20, 30 * (i // 40) + 20) for i in range(1000))


def test_matching_keeps_equal_rows_and_null_sides_without_row_ids(spark):
    from pagelattice.operators.spatial import best_match, with_match_flag
    left = rects(spark, [(1, 1, 0, 0, 600, 600), (1, 1, 0, 0, 600, 600), (1, 1, 0, 0, 600, 600), (1, 2, None, 0, 5, 5), (1, 2, None, 0, 5, 5), (2, 3, 9, 9, 9, 9)])
    right = spark.createDataFrame([(1, 7, 10, 10, 20, 20), (1, 8, 500, 500, 590, 590)], "page_id bigint, region_id bigint, l int, t int, r int, b int")
    over = lambda a, b: b["region_id"] > 0
    got = best_match(left, right, over, rank=lambda a, b: [-b["region_id"]], pick={"into": "region_id"})
    assert sorted((r.box_id, r.into) for r in got.collect() if r.into) == [(1, 8)] * 3 and got.where("into IS NULL").count() == 3
    flagged = with_match_flag(left, right, over)
    assert sorted((r.box_id, r.matched) for r in flagged.collect()) == [(1, True)] * 3 + [(2, False)] * 2 + [(3, False)]
    assert "monotonically_increasing_id" not in got._jdf.queryExecution().toString()
