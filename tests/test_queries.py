"""Every registered query against its SQL at the smallest scale, and shape rules for the registry."""

import os

import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SF
from tests.harness import compare

NAMES = list(entry_mod.queries())
QUICK = ["page_reading_summary", "join_max_intersection", "join_nearest_snap", "reading_order", "crop_ids", "carry_forward", "grp_nms", "grp_proximity_cc",
         "grp_strip_chain", "grp_fixpoint_union", "split_tall_regions", "audit_fragmentation", "agg_confusion", "job_dataset", "st_annotation_state",
         "txt_compose", "mt_attach_numbered", "src_telemetry", "st_log_levels", "stage_cache"]


@pytest.mark.parametrize("name", NAMES if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_matches_its_sql(spark, con, name):
    message, fine = compare(spark, con, name, SF, entry_mod.queries(), entry_mod.oracle_sql())
    assert fine, message


def test_every_check_belongs_to_a_query():
    assert set(entry_mod.oracle_sql()) <= set(NAMES)
    assert len(NAMES) >= 170


@pytest.mark.parametrize("name", ["join_max_intersection", "grp_proximity_cc", "reading_order", "audit_pitch_gutter", "merge_label_sync"])
def test_plans_stay_in_the_jvm_without_cartesian_products(spark, name):
    plan = entry_mod.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in plan
