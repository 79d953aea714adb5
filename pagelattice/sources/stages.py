"""Stage outputs kept as parquet, so a run can restart at a later stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


class StageCache:
    """Named stages in order, each ``fn(previous) -> DataFrame``, saved below ``root``."""

    def __init__(self, spark: SparkSession, root: str, stages: list[tuple[str, Callable[[DataFrame | None], DataFrame]]]):
        self.spark, self.root, self.stages = spark, root, stages

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def load(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path(name))
        except AnalysisException:
            return None

    def run(self, from_stage: int = 1) -> DataFrame:
        """Start at stage ``from_stage`` (from 1) with the saved result before it. A missing first
        stage is an error; a later missing one is recomputed from the stage before it."""
        start = from_stage - 1
        data = None
        while start > 0:
            data = self.load(self.stages[start - 1][0])
            if data is not None:
                break
            if start == 1:
                raise FileNotFoundError(f"no saved output of stage {self.stages[0][0]!r}")
            start -= 1
        for name, fn in self.stages[start:]:
            fn(data).write.mode("overwrite").parquet(self.path(name))
            data = self.spark.read.parquet(self.path(name))
        return data
