"""Findings of round 4."""

import pandas as pd
from pyspark.sql import functions as F

from pagelattice.functions import models as MO
from pagelattice.operators import ordering as O, rounds as R


def test_worst_pages_audit_each_page_once(spark):
    """both choices and their filters read one written ledger, so no counter is worked out again for them."""
    asked = spark.sparkContext.accumulator(0)

    def audit(n):
        asked.add(1)
        return n % 7

    ledger = spark.range(1, 101).select(F.col("id").alias("page_id"), F.udf(audit, "int")("id").alias("violations"))
    got = [tuple(r) for r in O.worst_pages(ledger).orderBy("kind", "page_id").collect()]
    assert got == [(p, 0, "clean") for p in (7, 14, 21, 28, 35)] + [(p, 6, "worst") for p in (6, 13, 20, 27, 34)]
    assert asked.value == 100


def test_pages_travel_together_and_stay_whole(spark):
    """functions of a page see what grouped pages show them, over pages longer than a batch, null pages, null values and empty results;
    a worker gets many pages at once."""
    rows = [(p, i, None if p == 3 and i == 1 else i * 5, f"t{i}", i % 2 == 0) for p, n in ((2**60 + 1, 3), (2**60 + 2, 700), (3, 4), (None, 5), (4, 1), (5, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id bigint, box_id bigint, l int, text string, flag boolean").repartition(3)

    def describe(pdf):
        if len(pdf) == 1:
            return pdf.head(0).assign(n=0, kinds="", total=0.0)
        return pd.DataFrame({"kinds": [" ".join(map(str, pdf.dtypes))], "page_id": pdf["page_id"].head(1), "n": len(pdf) + int(pdf.index[0]), "total": pdf["l"].sum(), "extra": 1})

    schema = "page_id bigint, n int, total double, kinds string"
    names = ["page_id", "n", "total", "kinds"]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "64")
    try:
        got = MO.per_page(df, describe, schema)
        want = df.groupBy("page_id").applyInPandas(lambda pdf: describe(pdf)[names], schema)
        assert got.schema == want.schema
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5
        assert MO.per_page(df.limit(0), describe, schema).collect() == []
        listed = df.withColumn("more", F.array("l"))
        assert sorted(map(str, MO.per_page(listed, lambda pdf: describe(pdf.drop(columns="more")), schema).collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set(size, before)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_uncovered_boxes_in_arrays_and_in_joins(spark):
    """pages whose rounds run in their arrays get the lines that the joins give; pages with nulls and without a number stay."""
    rect = "l int, t int, r int, b int"
    rows = lambda n, step, w, h, seed: [(p if p < 4 else None, p * 1000 + i, (i * step * seed + p * 37) % 440, (i * 61 * seed + p * 53) % 700, w + i * 7 % 19, h + i * 5 % 23) for p in range(5) for i in range(n if p else 3)]
    table = lambda data, name: spark.createDataFrame([(p, i, l, t, l + w, t + h) for p, i, l, t, w, h in data], f"page_id long, {name} long, {rect}")
    kind = lambda c: F.element_at(F.array(F.lit("BUBBLED"), F.lit("ORPHAN"), F.lit("SFX")), (F.col(c) % 3 + 1).cast("int"))
    boxes = table(rows(40, 43, 16, 18, 1), "box_id").withColumns({"category": kind("box_id"), "cw": F.lit(24)})
    lines = table(rows(12, 71, 12, 60, 3), "line_id").withColumn("category", kind("line_id"))
    lines = lines.withColumn("l", F.when(F.col("line_id") != 2005, F.col("l")))
    lines = lines.withColumns({"r": F.when(F.col("page_id") == 3, 900).otherwise(F.col("r")), "b": F.when(F.col("page_id") == 3, 900).otherwise(F.col("b")),
                               "category": F.when(F.col("page_id") == 3, "ORPHAN").otherwise(F.col("category"))})  # covered, but not from in-region lines
    regions = table(rows(6, 97, 90, 110, 5), "region_id")
    shuffles = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    got = R.reconcile_uncovered(lines, boxes, regions)
    want = R._reconciled_in_joins(lines, boxes, regions)
    assert got.schema.simpleString() == want.select(*got.columns).schema.simpleString()
    listed = lambda d: sorted(str(tuple(r)) for r in d.select("page_id", "origin", "line_id", "category", *"ltrb").collect())
    assert listed(got) == listed(want)
    assert {1, 2} <= {r.origin for r in got.where("page_id = 1 OR page_id = 3").collect()}
    clean = R.reconcile_uncovered(*[d.where("page_id IS NOT NULL AND l IS NOT NULL") for d in (lines, boxes, regions)])
    assert shuffles(clean) <= 3


def test_documents_read_each_table_of_a_page_once(spark):
    """what is made of regions comes from one spreading by page, as do lines and boxes."""
    from checks.c_sources import full_docs
    from pagelattice.derived import Tables
    plan = full_docs(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    again = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "ENSURE_REQUIREMENTS" in x]
    assert "REPARTITION_BY_COL" in plan and not again, plan


def test_lines_are_ranked_from_what_is_written(spark):
    """Ranks read lines several times, but chaining and trimming run once."""
    from pagelattice.plans import layout as L
    rect = "l int, t int, r int, b int"
    boxes = spark.createDataFrame([(1, i, 20 + i % 3 * 30, 20 + i * 18, 40 + i % 3 * 30, 36 + i * 18) for i in range(12)], f"page_id long, box_id long, {rect}")
    regions = spark.createDataFrame([(1, 7, 10, 10, 120, 150)], f"page_id long, region_id long, {rect}")
    lines = L.extract_lines(boxes, regions)
    assert [r.reading_order for r in lines.orderBy("reading_order").collect()] == list(range(1, lines.count() + 1))
    assert "aggregate(" not in lines._jdf.queryExecution().optimizedPlan().toString()
