"""Crop manifests, annotations and the staged page index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelattice.operators.ranking import top_per_key

# Field names and types of the manifest and annotation documents.
MANIFEST = """
bubble_id string, batch string, filename string, page_name string, page_index int, bubble_index_on_page int,
page_dimensions struct<width:int,height:int>, raw_bbox array<int>, crop_bbox array<int>, crop_dimensions struct<width:int,height:int>,
padding_used int, confidence double, mask_area_px int, is_conjoined boolean, is_discarded boolean, discard_reason string,
status string, annotated_at string, original_batch4_id string"""
ANNOTATION = """
bubble_id string, batch string, filename string, page_name string, page_dimensions struct<width:int,height:int>, crop_bbox array<int>,
crop_dimensions struct<width:int,height:int>, is_conjoined boolean,
crunch_points array<struct<id:string,label:string,bbox:array<int>,center:array<double>>>,
dividing_lines array<struct<line_id:string,points:array<array<double>>,cut_type:string>>, notes string, timestamp string"""


def read_manifest(spark: SparkSession, paths: str | list[str], array_files: bool = True) -> DataFrame:
    """Manifests of all batches with absent fields defaulted. ``array_files`` reads one JSON array
    per file; line-delimited files (see :func:`write_manifest`) split over tasks. A missing batch
    is taken from the folder, ``batch=NAME`` or the plain parent name."""
    raw = spark.read.schema(MANIFEST).option("multiLine", array_files).json(paths)
    parent = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return raw.withColumns({
        "batch": F.coalesce("batch", F.regexp_replace(parent, "^batch=", "")),
        "is_discarded": F.coalesce("is_discarded", F.lit(False)), "status": F.coalesce("status", F.lit("unlabeled")),
        "raw_bbox": F.coalesce("raw_bbox", F.array().cast("array<int>")), "crop_bbox": F.coalesce("crop_bbox", F.array().cast("array<int>"))})


def write_manifest(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per batch. Rows are spread by batch and id, so a large batch is many files."""
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    salt = F.pmod(F.xxhash64("bubble_id"), F.lit(max(1, int(n) // 8)))
    df.repartition("batch", salt).write.mode(mode).partitionBy("batch").json(path)


def prefer_verified(annotations: DataFrame) -> DataFrame:
    """One annotation per crop, the verified copy before the plain one (``priority`` ascending)."""
    return top_per_key(annotations, ["batch", "bubble_id"], [F.col("priority"), F.col("timestamp").desc_nulls_last()], 1).drop("rn", "priority")


def read_annotations(spark: SparkSession, root: str, array_files: bool = True) -> DataFrame:
    """One document per crop below ``root/<batch>/``; ``verified_annotated`` wins over ``annotations``. Line-delimited files, as
    :func:`write_annotations` makes them, split over tasks with ``array_files=False``. Folders may be named ``column=NAME``."""
    raw = (spark.read.schema(ANNOTATION).option("multiLine", array_files).option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.json").json(root))
    parts = F.split(F.col("_metadata.file_path"), "/")
    name = lambda at: F.regexp_replace(F.element_at(parts, at), "^[a-z]+=", "")
    folder = name(-2)
    d = raw.withColumns({"batch": F.coalesce("batch", name(-3)), "priority": F.when(folder == "verified_annotated", 0).otherwise(1)})
    return prefer_verified(d.where(folder.isin("verified_annotated", "annotations")))


def write_annotations(annotations: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Annotations with ``batch`` and ``verified`` below ``root``, verified ones apart."""
    folder = F.when(F.col("verified"), "verified_annotated").otherwise("annotations")
    annotations.withColumn("folder", folder).drop("verified").write.mode(mode).partitionBy("batch", "folder").json(root)


def build_index(staged: DataFrame) -> DataFrame:
    """Index rows of staged pages: file name with batch prefix, title, series."""
    return staged.select(F.col("staged").alias("filename"), "title", F.col("title").alias("series"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Latest snapshot per page and named slot."""
    safe = lambda c: F.regexp_replace(c, r"[^a-zA-Z0-9_.\-]", "_")
    d = snapshots.withColumns({"page": safe("page"), "slot": safe("slot")})
    return top_per_key(d, ["page", "slot"], [F.col("modified").desc(), F.col("snapshot_id").desc()], 1).drop("rn")
