"""Translation requests over dialogue text, and replies joined back to their lines.

A request holds at most ``max_blocks`` lines, so an ordinary page is one request and a page of
any size still never gathers in one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pagelattice.functions.text import strip
from pagelattice.operators.ranking import ranked

MAX_BLOCKS = 2000
THINKING = r"(?s)<think>.*?</think>"
NUMBERED = r"(?m)^\[?(\d+)\]?[.:\-\s]+(.+)$"
LEADING_NUMBER = r"^\[?\d+\]?[.:\-\s]*"


def _placed(lines: DataFrame, max_blocks: int) -> DataFrame:
    """Lines with their place ``n`` (1..) in request ``request_no`` of the page."""
    d = ranked(lines, ["page_id"], [F.col("line_no")], [F.floor(F.col("line_no") / 256)], "_rn")
    return d.withColumns({"request_no": F.floor((F.col("_rn") - 1) / max_blocks), "n": (F.col("_rn") - 1) % max_blocks + 1}).drop("_rn")


def requests(lines: DataFrame, style: str = "json", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Requests by (page_id, request_no): one per page of up to ``max_blocks`` lines, else one for each such run of lines, numbered
    from 1 within it. Each is a JSON array of the non-blank texts, or numbered lines ``[k] text``."""
    if style == "json":
        lines = lines.where(strip(F.col("text")) != "")
    items = F.array_sort(F.collect_list(F.struct("n", "text")))
    d = _placed(lines, max_blocks).groupBy("page_id", "request_no").agg(F.count(F.lit(1)).alias("n_blocks"), items.alias("i"))
    if style == "json":
        body = F.to_json(F.transform("i", lambda x: x["text"]))
    else:
        body = F.array_join(F.transform("i", lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] "), x["text"])), "\n")
    return d.select("page_id", "request_no", "n_blocks", body.alias("request"))


def attach_positional(lines: DataFrame, replies: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Zip a JSON array reply back to the non-blank lines; blank or missing items stay null and
    surplus items are ignored."""
    told = replies.select("page_id", "request_no", F.posexplode(F.from_json("reply", "array<string>")).alias("pos", "translation"))
    told = told.where(strip(F.col("translation")) != "").withColumn("n", F.col("pos").cast("long") + 1).drop("pos")
    return _placed(lines.where(strip(F.col("text")) != ""), max_blocks).join(told, ["page_id", "request_no", "n"], "left").select(*lines.columns, "translation")


def attach_numbered(lines: DataFrame, replies: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Take ``[n] text`` lines of a reply without its thinking block; where a number is missing
    fall back to the n-th non-blank line without its number."""
    clean = replies.select("page_id", "request_no", strip(F.regexp_replace("reply", THINKING, "")).alias("c"))
    key = ["page_id", "request_no", "n"]
    found = clean.select("page_id", "request_no", F.posexplode(F.arrays_zip(
        F.regexp_extract_all("c", F.lit(NUMBERED), F.lit(1)).alias("k"),
        F.regexp_extract_all("c", F.lit(NUMBERED), F.lit(2)).alias("v"))).alias("pos", "m"))
    found = (found.select("page_id", "request_no", F.expr("try_cast(m.k AS BIGINT)").alias("n"), "pos", strip(F.col("m.v")).alias("v"))
             .where("v <> ''").groupBy(*key).agg(F.max_by("v", "pos").alias("by_number")))
    plain = F.filter(F.split("c", r"\r?\n"), lambda x: strip(x) != "")
    lines_ = clean.select("page_id", "request_no", F.posexplode(plain).alias("pos", "v"))
    lines_ = lines_.select("page_id", "request_no", (F.col("pos").cast("long") + 1).alias("n"),
                           strip(F.regexp_replace("v", LEADING_NUMBER, "")).alias("by_line")).where("by_line <> ''")
    d = _placed(lines, max_blocks).join(found, key, "left").join(lines_, key, "left")
    return d.select(*lines.columns, F.coalesce("by_number", "by_line").alias("translation"))


def batch_apply(df: DataFrame, translate: Callable[[list[str]], list[str]], text: str = "text") -> DataFrame:
    """Translate each distinct non-blank text once. Blank text gives "", a failing one stays as is."""
    def one(s):
        try:
            return translate([s])[0]
        except Exception:
            return s

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            source = pdf["_src"].tolist()
            try:
                out = list(translate(source))
                if len(out) != len(source):
                    raise ValueError("translator changed the number of texts")
            except Exception:
                out = [one(s) for s in source]
            yield pd.DataFrame({"_src": source, "translation": out})

    todo = df.select(F.col(text).alias("_src")).where(strip(F.col("_src")) != "").distinct()
    done = todo.mapInPandas(run, "_src string, translation string")
    return (df.join(done, F.col(text) == F.col("_src"), "left").drop("_src")
            .withColumn("translation", F.when(F.coalesce(strip(F.col(text)), F.lit("")) == "", "").otherwise(F.col("translation"))))


def apply_progress(translated: DataFrame) -> DataFrame:
    return translated.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("translation") != "").alias("translated"),
                          F.count_if(F.col("translation") == "").alias("blank"))
