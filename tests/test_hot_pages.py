"""Pages above the row limit take the distributed plans; results must not change."""

import os

import pytest

from tests.harness import _rows
from tests.conftest import SF

EXACT = ["grp_nms", "grp_nms_containment", "grp_dedup_first", "grp_dedup_first_lobes", "grp_fold_union_45", "grp_proximity_cc", "grp_reach_symmetric",
         "grp_lines_bridged", "grp_lobes", "grp_seed_window", "grp_absorb_near", "grp_ruby_absorb", "grp_ruby_absorb_gap", "grp_seam_trim"]


CORE = ["grp_nms", "grp_fold_union_45", "grp_proximity_cc", "grp_seed_window", "grp_absorb_near", "grp_ruby_absorb"]


@pytest.mark.parametrize("name", EXACT if os.environ.get("ALL_QUERIES") else CORE)
def test_low_row_limit_gives_the_checked_result(spark, con, entry, name):
    spark.conf.set("pagelattice.pageRowLimit", "31" if not name.endswith(("absorb", "gap", "trim", "lobes")) else "6")
    try:
        df = entry.queries()[name](spark, SF)
        got = _rows(df.columns, df.collect())
    finally:
        spark.conf.unset("pagelattice.pageRowLimit")
    cur = con.execute(entry.oracle_sql()[name])
    assert got == _rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["grp_fixpoint_union", "grp_fixpoint_union_alike", "grp_fixpoint_union_touching"])
def test_low_row_limit_equals_the_ordinary_plan(spark, entry, name):
    plain = entry.queries()[name](spark, SF)
    want = _rows(plain.columns, plain.collect())
    spark.conf.set("pagelattice.pageRowLimit", "7")
    try:
        df = entry.queries()[name](spark, SF)
        got = _rows(df.columns, df.collect())
    finally:
        spark.conf.unset("pagelattice.pageRowLimit")
    assert got == want


def test_one_page_holding_most_rows(spark):
    """A third of all rows and more on one page: clusters still match a plain union-find."""
    from pyspark.sql import functions as F
    from pagelattice.operators import grouping as GR
    d = spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).cast("long").alias("page_id"), F.col("id").alias("box_id"),
                                 ((F.col("id") * 7919) % 9973).cast("int").alias("l"), ((F.col("id") * 104729) % 9967).cast("int").alias("t"))
    d = d.withColumns({"r": F.col("l") + 60, "b": F.col("t") + 60})
    got = {(x.page_id, x.box_id): x.cluster_id for x in GR.reach_clusters(d, 100).collect()}
    rows = [x for x in d.collect() if x.page_id == 1]
    parent = {x.box_id: x.box_id for x in rows}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows.sort(key=lambda x: x.l)
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if b.l - a.r > 60:
                break
            if max(0, max(a.t, b.t) - min(a.b, b.b)) <= 60:
                p, q = find(a.box_id), find(b.box_id)
                parent[max(p, q)] = min(p, q)
    assert all(got[(1, x.box_id)] == find(x.box_id) for x in rows)
