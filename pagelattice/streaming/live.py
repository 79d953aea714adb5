"""Streaming logs, usage, progress, ledgers and one-time handling.

Every transform takes a streaming or a batch DataFrame alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagelattice.session import scratch_path


def event_stream(spark: SparkSession, folder: str, file_glob: str, files_per_trigger: int = 100) -> DataFrame:
    """File stream over matching parquet files, with the schema of the files there."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def drain(stream: DataFrame, mode: str, name: str = "stream") -> DataFrame:
    """Run an available-now query into parquet and return what it wrote. A complete result replaces the table in each trigger; an append
    or update result goes to the trigger's own folder, so one that is repeated replaces its rows."""
    out, marks = scratch_path(stream.sparkSession, name), scratch_path(stream.sparkSession, name + "-marks")

    def save(df: DataFrame, trigger: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/trigger={0 if mode == 'complete' else trigger}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", marks).foreachBatch(save).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out).drop("trigger")


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def level_counts(logs: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Entries per level in tumbling windows of event time."""
    d = logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = d.groupBy(F.window("ts", width).alias("w"), "level").agg(F.count(F.lit(1)).alias("n"))
    return g.select(_stamp("w.start").alias("window_start"), "level", "n")


def last_entries(logs: DataFrame, k: int = 500) -> DataFrame:
    """The newest ``k`` entries; each task keeps k rows before the merge."""
    return logs.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(k)


def usage_windows(samples: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean and greatest value in sliding windows."""
    d = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = d.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"), F.max("value").alias("max_value"))
    return g.select(_stamp("w.start").alias("window_start"), "n", F.round("avg_value", 6).alias("avg_value"), "max_value")


def progress(steps: DataFrame, totals: DataFrame) -> DataFrame:
    """Per run: pages done, percent, current item and last status. ``totals`` gives pages per run."""
    g = steps.join(totals, "run_id").groupBy("run_id", "total").agg(
        F.count_if(F.col("status") == "done").alias("done"), F.max_by("item", F.struct("ts", "item")).alias("current_item"),
        F.max_by("status", F.struct("ts", "item")).alias("last_status"))
    return g.withColumn("percent", F.round(F.col("done") * 100.0 / F.col("total"), 4))


def first_handling(items: DataFrame, key: str, late: str = "365 days") -> DataFrame:
    """Each key once within the watermark."""
    return items.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


ZERO_TOLERANCE = ["dropped_box_count", "empty_bubbles_with_ink", "mask_boundary_bleed_count"]


class ViolationFound(RuntimeError):
    """A zero-tolerance counter of a page is not zero."""


def append_ledger(records: DataFrame, table: str, marks: str, zero: list[str] = ZERO_TOLERANCE) -> None:
    """Append page results as they arrive and stop at the first trigger holding a violation. The
    trigger id names the folder, so a repeated trigger replaces its own rows."""
    bad = " OR ".join(f"{c} > 0" for c in zero) or "false"

    def save(df: DataFrame, trigger: int) -> None:
        df.write.mode("overwrite").parquet(f"{table}/trigger={trigger}")
        hit = df.where(bad).limit(1).collect()
        if hit:
            raise ViolationFound(str(hit[0].asDict()))

    query = records.writeStream.trigger(availableNow=True).option("checkpointLocation", marks).foreachBatch(save).start()
    query.awaitTermination()


def ledger_totals(spark: SparkSession, table: str, counters: list[str]) -> DataFrame:
    d = spark.read.parquet(table)
    return d.agg(F.count(F.lit(1)).alias("pages"), *[F.sum(c).cast("long").alias(c) for c in counters], F.max("page_id").alias("last_page"))
