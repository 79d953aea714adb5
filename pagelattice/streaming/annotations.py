"""Streaming twin of the annotation state: one undo stack per batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagelattice.operators.annotations import PUSHING, STATUS
from pagelattice.session import scratch_path

LABEL = {"flag_conjoined": True, "annotate_conjoined": True, "annotate_single": False}
#: What is known of a crop no action has touched.
FRESH = ("unlabeled", None, False)
CROP = "status string, is_conjoined boolean, is_discarded boolean"
OUT = f"batch string, bubble_id string, {CROP}"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class UndoableCrops(StatefulProcessor):
    """State of a batch in rows of the state store: one per crop, one per place of the undo stack, and the stack's height. A trigger
    reads and writes only the crops and places that its actions touch, however long the batch's history is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.crops = handle.getMapState("crops", "bubble_id string", CROP)
        self.stack = handle.getMapState("stack", "place int", f"bubble_id string, {CROP}")
        self.height = handle.getValueState("height", "places int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        crops: dict[str, tuple] = {}
        places: dict[int, tuple] = {}
        height = stored = self.height.get()[0] if self.height.exists() else 0

        def crop(name: str) -> tuple:
            if name not in crops:
                crops[name] = self.crops.getValue((name,)) if self.crops.containsKey((name,)) else FRESH
            return crops[name]

        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            if row.action == "undo":
                if height:
                    height -= 1
                    name, *old = places.pop(height) if height in places else self.stack.getValue((height,))
                    crops[name] = tuple(old)
                continue
            now = crop(row.bubble_id)
            if row.action in PUSHING:
                places[height] = (row.bubble_id, *now)
                height += 1
            crops[row.bubble_id] = (STATUS[row.action], LABEL.get(row.action, now[1]), bool(now[2]) or row.action == "discard")
        for place, value in places.items():
            self.stack.updateValue((place,), value)
        for place in range(height, stored):
            self.stack.removeKey((place,))
        self.height.update((height,))
        for name, value in crops.items():
            self.crops.updateValue((name,), value)
        yield pd.DataFrame([(key[0], name, *value) for name, value in crops.items()], columns=["batch", "bubble_id", "status", "is_conjoined", "is_discarded"])

    def close(self) -> None:
        pass


def annotation_updates(actions: DataFrame) -> DataFrame:
    """Changed crop rows per trigger. Actions of a batch must arrive in ``seq`` order across triggers. The state store must be one with
    many rows a key: unless the session names another than the default, the RocksDB one is set for it."""
    conf = actions.sparkSession.conf
    if "RocksDB" not in conf.get(STORE):
        conf.set(STORE, ROCKS)
    return actions.select("batch", "bubble_id", "seq", "action").groupBy("batch").transformWithStateInPandas(
        UndoableCrops(), outputStructType=OUT, outputMode="Update", timeMode="None")


def drained_state(actions: DataFrame, folder: str) -> DataFrame:
    """The state of each crop after all the stream has at hand. Each trigger writes its own folder, so one that is repeated replaces its
    rows; of a crop's rows the last trigger's counts."""
    def save(df: DataFrame, trigger: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/trigger={trigger}")

    marks = scratch_path(actions.sparkSession, "marks")
    annotation_updates(actions).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", marks).foreachBatch(save).start().awaitTermination()
    rows = actions.sparkSession.read.option("basePath", folder).schema(f"{OUT}, trigger bigint").parquet(folder)
    last = rows.groupBy("batch", "bubble_id").agg(F.max_by(F.struct("status", "is_conjoined", "is_discarded"), "trigger").alias("s"))
    return last.select("batch", "bubble_id", "s.*")
