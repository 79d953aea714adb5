"""Findings of round 3, each by the rows that showed it."""

from pyspark.sql import functions as F

from pagelattice.functions import text as X
from pagelattice.operators import grouping as GR, ordering as O
from pagelattice.plans import layout as L

RECT = "page_id bigint, {0} bigint, l int, t int, r int, b int"


def labels(df, row_id):
    return {r[row_id]: r["cluster_id"] for r in df.collect()}


def test_one_letter_capitals(spark, con):
    """F8: the first letter's capital is one letter, as in the SQL, for every letter of the basic plane."""
    codes = [c for c in range(33, 0xD7A4) if not 0x1C80 <= c <= 0x1CBF and not 0xA640 <= c <= 0xABFF and not 0x2C00 <= c <= 0x2E7F]
    d = spark.createDataFrame([(chr(c),) for c in codes], "s string")
    got = {r["s"]: r["u"] for r in d.select("s", X.capital(F.col("s")).alias("u")).collect()}
    want = dict(con.execute("SELECT s, upper(s) FROM (SELECT unnest(?) AS s)", [[chr(c) for c in codes]]).fetchall())
    assert {s: u for s, u in got.items() if u != want[s] and len(s.upper()) > 1} == {}
    assert d.limit(1).select(X.clean_target(F.lit("ßheit , da")).alias("x")).first()["x"] == "ẞheit, da"


def test_equal_paths_by_id(spark):
    """files of one path stand in the order of their ids."""
    rows = [(i, "http://h.example/en/7", "h") for i in range(60, 0, -1)] + [(99, "http://h.example/en/6", "h")]
    d = O.natural_sort(spark.createDataFrame(rows, "file_id long, path string, host string").repartition(7), ["host"])
    assert [r["file_id"] for r in d.orderBy("position").collect()] == [99, *range(1, 61)]


def test_lengths_in_doubles(spark):
    """11 is less than 1.1 times 10, and 126 more than 1.4 times 90, in doubles."""
    boxes = spark.createDataFrame([(1, 1, 0, 0, 6, 100), (1, 2, 0, 210, 6, 310)], RECT.format("box_id"))
    assert labels(GR.strict_lines(boxes), "box_id") == {1: 1, 2: 1}
    regions = spark.createDataFrame([(1, 5, 0, 0, 500, 300)], RECT.format("region_id"))
    lines = spark.createDataFrame([(1, 1, 0, 0, 45, 100), (1, 2, 108, 0, 153, 100)], RECT.format("line_id"))
    assert GR.lobes(lines, regions, 512, 800).count() == 2


def test_lobes_of_an_inverted_line(spark):
    """a line cut at both seams has a negative width, which narrows the reach to its neighbour."""
    regions = spark.createDataFrame([(1, 5, 0, 0, 500, 600)], RECT.format("region_id"))
    lines = spark.createDataFrame([(1, 16, 254, 461, 252, 495), (1, 17, 244, 462, 250, 493)], RECT.format("line_id"))
    assert GR.lobes(lines, regions, 512, 800).count() == 2


def test_lines_of_one_centre_by_left_side(spark):
    """of two lines of a region with one centre and one top the wider comes first."""
    boxes = spark.createDataFrame([(1, 1, 120, 100, 160, 140), (1, 2, 121, 100, 159, 140)], RECT.format("box_id"))
    regions = spark.createDataFrame([(1, 5, 100, 80, 200, 300)], RECT.format("region_id"))
    import pagelattice.plans.layout as plan
    plain = plan.lines_in_frames
    try:  # the strips' numbers run against the sides here
        plan.lines_in_frames = lambda d, *a, **k: d.select("page_id", "region_id", "l", "t", "r", "b", F.lit(1).alias("n_boxes"), (-F.col("box_id")).alias("line_no"))
        got = L.extract_lines(boxes, regions).orderBy("reading_order").select("l").collect()
    finally:
        plan.lines_in_frames = plain
    assert [r["l"] for r in got] == [120, 121]


def test_ordinary_pages_meet_without_tiles(spark):
    """Rows of ordinary pages aren't repeated over tiles; crowded pages give the same matches."""
    from pagelattice.functions import geometry as G
    from pagelattice.operators import spatial as S
    rows = [(p, i, (i * 37) % 400, (i * 91) % 700, (i * 37) % 400 + 30 + i % 50, (i * 91) % 700 + 20 + i % 70) for p in (1, 2) for i in range(25 * p)]
    boxes = spark.createDataFrame([*rows, rows[0], (3, 1, 0, 0, 9, 9), (1, 99, None, 0, 9, 9)], RECT.format("box_id"))
    regions = spark.createDataFrame([r for r in rows if r[1] % 3 == 0], RECT.format("region_id"))
    meets = lambda a, b: G.intersection(a, b) > 0
    forms = {
        "best": lambda: S.best_match(boxes, regions, meets, rank=lambda a, g: [-G.intersection(a, g), g["region_id"]], pick={"region_id": "region_id", "gl": "l"}, pad=5),
        "flag": lambda: S.with_match_flag(boxes, regions, meets),
        "pairs": lambda: S.near_pairs(boxes, boxes, lambda a, b: a["box_id"] < b["box_id"], pad=F.col("r") - F.col("l"), pad_right=3),
    }
    for form in forms.values():
        assert "explode" not in form()._jdf.queryExecution().optimizedPlan().toString()
        whole = sorted(map(str, form().collect()))
        spark.conf.set("pagelattice.pageRowLimit", 5)
        try:
            assert sorted(map(str, form().collect())) == whole
        finally:
            spark.conf.unset("pagelattice.pageRowLimit")
