"""Streaming twins equal their batch form; file sources read what the formats prescribe."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from pagelattice.derived import Tables
from pagelattice.operators.annotations import annotation_state
from pagelattice.session import scratch_path
from pagelattice.sources import archives as AR, manifests as M
from pagelattice.sources.stages import StageCache
from pagelattice.streaming import live as S
from pagelattice.streaming.annotations import annotation_updates
from tests.conftest import SF


def test_annotation_stream_equals_batch(spark):
    actions = Tables(spark, SF).actions
    src = scratch_path(spark, "actions")
    for lo, hi in ((0, 300), (300, 650), (650, 10**9)):
        actions.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = scratch_path(spark, "states")
    q = (annotation_updates(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "marks"))
         .foreachBatch(lambda df, i: df.withColumn("i", F.lit(i)).write.mode("append").parquet(out)).start())
    q.awaitTermination()
    last = spark.read.parquet(out).groupBy("batch", "bubble_id").agg(F.max_by(F.struct("status", "is_conjoined", "is_discarded"), "i").alias("s")).select("batch", "bubble_id", "s.*")
    want = annotation_state(actions)
    assert last.exceptAll(want).count() == 0 and want.exceptAll(last).count() == 0


def test_undo_on_an_empty_stack_and_review_lost_by_undo(spark):
    log = [("a", "x", 1, "undo"), ("a", "x", 2, "flag_conjoined"), ("a", "x", 3, "verify"), ("a", "x", 4, "undo"), ("a", "y", 5, "reject"), ("a", "y", 6, "discard")]
    got = {r.bubble_id: (r.status, r.is_conjoined, r.is_discarded) for r in annotation_state(spark.createDataFrame(log, "batch string, bubble_id string, seq bigint, action string")).collect()}
    assert got == {"x": ("unlabeled", None, False), "y": ("discarded", None, True)}


def test_ledger_stops_on_a_violation(spark):
    src = scratch_path(spark, "bad")
    spark.createDataFrame([(1, 0), (2, 3)], "page_id bigint, dropped_box_count int").write.parquet(src)
    with pytest.raises(Exception, match="dropped_box_count"):
        S.append_ledger(S.event_stream(spark, src, "*.parquet"), scratch_path(spark, "t"), scratch_path(spark, "m"), ["dropped_box_count"])


def test_manifest_array_and_annotation_folders(spark, tmp_path):
    (tmp_path / "batch_07").mkdir()
    (tmp_path / "batch_07" / "manifest.json").write_text(json.dumps([{"bubble_id": "b1", "is_conjoined": None}, {"bubble_id": "b2", "batch": "other", "is_discarded": True}]))
    got = {r.bubble_id: (r.batch, r.is_discarded, r.status) for r in M.read_manifest(spark, str(tmp_path / "*" / "manifest.json")).collect()}
    assert got == {"b1": ("batch_07", False, "unlabeled"), "b2": ("other", True, "unlabeled")}
    for folder, note in (("annotations", "old"), ("verified_annotated", "good")):
        d = tmp_path / "ann" / "batch_07" / folder
        d.mkdir(parents=True)
        (d / "b1.json").write_text(json.dumps({"bubble_id": "b1", "notes": note, "crunch_points": [{"id": "1", "center": [1.5, 2]}]}))
    r = M.read_annotations(spark, str(tmp_path / "ann")).collect()
    assert [(x.batch, x.notes, x.crunch_points[0].center) for x in r] == [("batch_07", "good", [1.5, 2.0])]


def test_archives(spark, tmp_path):
    box = tmp_path / "in" / "My Series"
    box.mkdir(parents=True)
    with zipfile.ZipFile(box / "Chapter.cbz", "w") as z:
        for n in ("p10.jpg", "p9.JPG", "__MACOSX/p1.jpg", "notes.txt"):
            z.writestr(n, "x" * 400_000)
    got = AR.list_archive(spark, str(box)).orderBy("entry_no").collect()
    assert [(r.entry, r.title) for r in got] == [("p9.JPG", "My Series"), ("p10.jpg", "My Series")]
    assert [(r.title, r.folder) for r in AR.scan_archives(spark, str(tmp_path / "in")).collect()] == [("My Series", "My Series")]


def test_stage_cache_restarts(spark):
    calls = []
    stage = lambda name, fn: (name, lambda d: (calls.append(name), fn(d))[1])
    cache = StageCache(spark, scratch_path(spark, "c"), [stage("a", lambda _: spark.range(5)), stage("b", lambda d: d.where("id > 1")), stage("c", lambda d: d.where("id > 2"))])
    with pytest.raises(FileNotFoundError):
        cache.run(from_stage=2)
    cache.run()
    del calls[:]
    assert cache.run(from_stage=3).count() == 2 and calls == ["c"]
