"""User functions get whole pages, whatever the row limit."""

import pandas as pd
import pytest

from pagelattice.functions.models import per_page


@pytest.mark.parametrize("limit", ["5", "2000"])
def test_median_of_whole_pages(spark, limit):
    """Boxes far apart would be cut into blocks of their own; a page has 1 to 2,500 rows."""
    rows = [(p, i, 100 * i, 100 * p, 100 * i + 10, 100 * p + 10) for p, n in enumerate((1, 4, 6, 9, 2500)) for i in range(n)]
    boxes = pd.DataFrame(rows, columns=["page_id", "box_id", "l", "t", "r", "b"])

    def middle(pdf):
        return pd.DataFrame({"page_id": pdf["page_id"].head(1), "n": len(pdf), "middle": pdf["l"].median()})

    spark.conf.set("pagelattice.pageRowLimit", limit)
    try:
        got = per_page(spark.createDataFrame(boxes), middle, "page_id bigint, n bigint, middle double").collect()
    finally:
        spark.conf.unset("pagelattice.pageRowLimit")
    want = boxes.groupby("page_id")["l"].agg(["size", "median"])
    assert sorted(map(tuple, got)) == [(p, int(x["size"]), x["median"]) for p, x in want.iterrows()]
