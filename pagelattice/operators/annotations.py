"""Current state of annotated crops from their action log, undo included.

Actions push on the undo stack of their batch, ``undo`` pops it and is ignored on an empty one.
``verify`` and ``reject`` only set the status and leave the stack alone; they are lost when an
earlier action on the same crop is undone after them, as undo restores the whole crop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagelattice.operators.ranking import running, with_previous

PUSHING = ("flag_conjoined", "annotate_single", "annotate_conjoined", "discard")
REVIEWS = ("verify", "reject")
STATUS = {"flag_conjoined": "conjoined", "annotate_single": "verified", "annotate_conjoined": "verified",
          "discard": "discarded", "verify": "verified", "reject": "recheck"}
SPAN = 65536


def surviving_actions(actions: DataFrame) -> DataFrame:
    """The actions no undo takes back. Needs batch, bubble_id, seq (unique per batch), action.

    The stack depth is the running sum of pushes and undos, reflected at zero. Push and undo of
    one depth alternate, so the undo of a push is the next event of its depth. All scans run over
    (batch, seq bucket) with carried-in totals, no batch is ever one task."""
    bucket = lambda: F.floor(F.col("seq") / SPAN)
    step = F.when(F.col("action").isin(*PUSHING), 1).when(F.col("action") == "undo", -1).otherwise(0)
    d = running(actions.withColumn("_d", step), ["batch"], ["seq"], bucket(), "sum", "_d", "_s")
    d = running(d, ["batch"], ["seq"], bucket(), "min", "_s", "_low")
    d = running(d, ["batch"], ["seq"], bucket(), "min", "_s", "_low_before", include_row=False)
    depth = F.col("_s") - F.least(F.lit(0), F.col("_low"))
    before = F.col("_s") - F.col("_d") - F.least(F.lit(0), F.coalesce("_low_before", F.lit(0)))
    d = d.withColumn("_level", F.when(F.col("_d") > 0, depth).when(F.col("_d") < 0, before))
    stack = d.where("_level > 0").withColumn("_back", -F.col("seq"))
    stack = with_previous(stack, ["batch", "_level"], ["_back"], F.floor(F.col("_back") / SPAN), {"_undone_at": "seq"})
    pushes = stack.where("_d > 0").select("batch", "bubble_id", "seq", "action", "_undone_at")
    reviews = d.where(F.col("action").isin(*REVIEWS)).select("batch", "bubble_id", "seq", "action", F.lit(None).cast("bigint").alias("_undone_at"))
    both = running(pushes.unionByName(reviews), ["batch", "bubble_id"], ["seq"], bucket(), "max", "_undone_at", "_open_until", include_row=False)
    lost = F.col("_undone_at").isNotNull() | (F.col("action").isin(*REVIEWS) & F.coalesce(F.col("_open_until") > F.col("seq"), F.lit(False)))
    return both.where(~lost).select("batch", "bubble_id", "seq", "action")


def annotation_state(actions: DataFrame) -> DataFrame:
    """Last status, label and discard flag of every crop touched by the log."""
    status = F.coalesce(*[F.when(F.col("action") == a, s) for a, s in STATUS.items()])
    label = F.when(F.col("action").isin("flag_conjoined", "annotate_conjoined"), True).when(F.col("action") == "annotate_single", False)
    kept = surviving_actions(actions).withColumns({"_status": status, "_label": label})
    now = kept.groupBy("batch", "bubble_id").agg(
        F.max_by("_status", "seq").alias("status"), F.max_by("_label", F.when(F.col("_label").isNotNull(), F.col("seq"))).alias("is_conjoined"),
        F.max(F.col("action") == "discard").alias("is_discarded"))
    touched = actions.where("action <> 'undo'").select("batch", "bubble_id").distinct()
    return touched.join(now, ["batch", "bubble_id"], "left").select(
        "batch", "bubble_id", F.coalesce("status", F.lit("unlabeled")).alias("status"), "is_conjoined", F.coalesce("is_discarded", F.lit(False)).alias("is_discarded"))
