"""Clusters of ordinary pages are searched in the page's array, without a join over pairs, and equal those by edges."""

import random

from pyspark.sql import functions as F

from pagelattice.operators import grouping as GR, pagefold as P


def test_no_join_over_pairs_and_the_same_clusters(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(p, i, l := rnd.randrange(0, 400), t := rnd.randrange(0, 600), l + rnd.randrange(-2, 30), t + rnd.randrange(0, 40)) for p in range(3) for i in range(25)]
    boxes = spark.createDataFrame(rows + [(9, 4, 1, 1, 5, 5)], "page_id long, box_id long, l int, t int, r int, b int")
    by_edges = P.near_pairs

    def refuse(*_, **__):
        raise AssertionError("a join over pairs")

    monkeypatch.setattr(P, "near_pairs", refuse)
    found = sorted(map(tuple, GR.reach_clusters(boxes, 150).collect()))
    monkeypatch.setattr(P, "near_pairs", by_edges)
    monkeypatch.setattr(P, "IN_ARRAY", 10)
    assert found == sorted(map(tuple, GR.reach_clusters(boxes, 150).collect()))
    assert 3 < len({(r[0], r[-1]) for r in found}) < len(found)
