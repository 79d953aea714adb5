"""Archives of page images: entry listing and archive scan. No image is decoded."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelattice.functions.text import natural_key
from pagelattice.operators.ranking import ranked, top_per_key

IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".avif")


#: The entry that may name the series, and how it does. Fixed values.
TAG_FILE, TAG = "comicinfo.xml", r"(?s)<Series>(.*?)</Series>"


def _directory(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The directory of each archive as it stands, with the text of its tag file; an archive that can't be read gives one row."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                    for at, e in enumerate(z.infolist()):
                        tag = z.read(e).decode("utf-8", "replace") if e.filename.lower().endswith(TAG_FILE) else None
                        rows.append((path, at, e.filename, e.file_size, tag, None))
            except (zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, RuntimeError) as damage:
                rows = [(path, None, None, None, None, type(damage).__name__)]
            yield pd.DataFrame(rows, columns=["path", "at", "entry", "size", "tag", "damage"]).astype({"at": "Int64", "size": "Int64"})


def archive_directory(files: DataFrame) -> DataFrame:
    """``path, at, entry, size, tag, damage`` of zip archives (``path``, ``content``): every entry in the archive's order; ``damage`` is set
    in the only row of an archive that can't be read."""
    return files.select("path", "content").mapInPandas(_directory, "path string, at bigint, entry string, size bigint, tag string, damage string")


def damaged_archives(files: DataFrame) -> DataFrame:
    return archive_directory(files).where("damage IS NOT NULL").select("path", "damage")


def archive_entries(files: DataFrame) -> DataFrame:
    """Page entries of zip archives (``path``, ``content``) in natural order with the series title: the XML tag (the last one, where there
    are several), else the parent folder, else the file's own name. Folders, system and hidden entries and other files are
    left out; a damaged archive has no entries, see :func:`damaged_archives`."""
    low = F.lower("entry")
    page = low.rlike(r"\.(?:" + "|".join(x[1:] for x in IMAGES) + ")$")
    seen = ~low.endswith("/") & ~low.contains("__macosx") & ~low.startswith(".")
    series = F.regexp_extract("tag", TAG, 1)
    named = F.when(F.trim(series) != "", F.trim(series))
    d = archive_directory(files).where("damage IS NULL").where(seen).withColumn("_series", named)
    last = F.max_by("_series", F.when(F.col("_series").isNotNull(), F.col("at")))
    titles = d.where("tag IS NOT NULL").groupBy("path").agg(last.alias("series"))
    d = d.where(page).select("path", "entry", "size").join(titles, "path", "left")
    parts = F.split("path", "/")
    folder = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    title = F.coalesce("series", F.when((F.trim(folder) != "") & (F.lower(folder) != "downloads"), folder), stem)
    d = d.withColumns({"title": title, "_k": natural_key(F.col("entry"))}).drop("series")
    return ranked(d, ["path"], [F.col("_k"), F.col("entry")], [F.substring("_k", 1, 24)], "entry_no").drop("_k")


def list_archive(spark: SparkSession, paths) -> DataFrame:
    return archive_entries(spark.read.format("binaryFile").load(paths))


def archive_listing(files: DataFrame, root_depth: int, min_bytes: int = 500 * 1024, max_depth: int = 3) -> DataFrame:
    """Archives among files (``path``, ``length``): by extension, size and depth, each path once,
    titled by the folder when the file is named generically."""
    parts = F.split("path", "/")
    name, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    low = F.lower(name)
    hidden = F.exists(F.slice(parts, root_depth + 1, F.greatest(F.size(parts) - root_depth - 1, F.lit(0))), lambda x: x.startswith("."))
    d = files.where((low.endswith(".cbz") | low.endswith(".zip")) & (F.col("length") > min_bytes) & ~hidden
                    & (F.size(parts) - 1 - root_depth <= max_depth))
    d = d.dropDuplicates(["path"])
    title = F.when(low.isin("chapter.cbz", "chapter.zip"), folder).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    return d.select("path", "length", title.alias("title"), folder.alias("folder"))


def scan_archives(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing below ``root``, by title. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    bare = lambda p: F.regexp_replace(p, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")  # without scheme and host, as the root may be given
    depth = len(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/").split("/"))
    return archive_listing(files.withColumn("path", bare("path")), depth).orderBy("title", "path")
