"""Session helpers shared by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Pages holding more rows than this leave the one-array-per-page plan for the
#: distributed plan. Override with ``spark.conf.set("pagelattice.pageRowLimit", n)``.
PAGE_ROW_LIMIT = 2000


def page_row_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("pagelattice.pageRowLimit", str(PAGE_ROW_LIMIT)))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(configured)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files, below the shared checkpoint folder."""
    cut_lineage(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
