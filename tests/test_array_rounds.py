"""Rounds of ordinary pages run in one array each: nothing is written in between, and the result is that of the joins."""

import random

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import geometry as G
from pagelattice.operators import rounds as R


def units(spark, n=12, pages=2):
    rnd = random.Random(11)
    rows = []
    for p in range(pages):
        for i in range(n):
            l, t = rnd.randrange(0, 160), rnd.randrange(0, 160)
            rows.append((p, i, rnd.choice(["BUBBLED", "ORPHAN", "SFX"]), l, t, l + rnd.randrange(-2, 50), t + rnd.randrange(0, 90), 24, 1))
        rows += [(p, n, "SFX", 5, 5, 25, 60, 24, 1), (p, n + 1, "SFX", 5, 5, 25, 60, 24, 1), (p, n + 2, "ORPHAN", 9, 9, 9, 9, 24, 1)]
    rows += [(77, 0, "SFX", 1, 1, 30, 30, 24, 1)]
    return spark.createDataFrame(rows, "page_id long, line_id long, category string, l int, t int, r int, b int, cw int, n long").cache()


FORMS = {
    "crossings": lambda d: R.crossover_resolve(d),
    "extended": lambda d: R.unbubbled_extend(d),
    "united": lambda d: R.united(d.withColumnRenamed("line_id", "unit_id"), lambda p, q, both, least: both * 100 > least * 12),
    "glyphs": lambda d: R.recombine_glyphs(d.select("*", F.col("line_id").alias("box_id"), F.when(F.col("l") < 80, 1).cast("long").alias("region_id"), F.lit(20).alias("cwr"))),
    "columns": lambda d: R.columns_outside(d.select("*", F.col("line_id").alias("box_id"), (F.col("category") == "ORPHAN").alias("orphan"))),
    "reached": lambda d: R.reach_seeded(d, 40, row_id="line_id").select("page_id", "line_id", "cluster_id"),
}


@pytest.mark.parametrize("name", FORMS)
def test_arrays_write_nothing_and_equal_the_joins(spark, monkeypatch, name):
    rows, cuts = units(spark), []
    cut = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    inside = sorted(map(tuple, FORMS[name](rows).collect()), key=repr)
    assert not cuts
    monkeypatch.setattr(R, "IN_ARRAY", 4)
    joined = sorted(map(tuple, FORMS[name](rows).collect()), key=repr)
    assert cuts and inside == joined
