"""User models inside Spark: batch functions with an enforced output schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

BOX_SCHEMA = "page_id bigint, l int, t int, r int, b int, conf_m int"
TEXT_SCHEMA = "page_id bigint, line_id bigint, text string"


def run_model(df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Map Arrow batches through ``factory()``, which is built once per task. Output columns are
    checked by name; extra, missing or unordered columns are an error or put in order."""
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            out = model(pdf)
            if set(out.columns) != set(names):
                raise ValueError(f"model returned {sorted(out.columns)}, expected {sorted(names)}")
            yield out[names]

    return df.mapInPandas(run, schema)


def detect(pages: DataFrame, factory) -> DataFrame:
    """Boxes of page images (``page_id``, ``content``)."""
    return run_model(pages.select("page_id", "content"), factory, BOX_SCHEMA)


def recognize(crops: DataFrame, factory) -> DataFrame:
    """Text of line crops (``page_id``, ``line_id``, ``content``)."""
    return run_model(crops.select("page_id", "line_id", "content"), factory, TEXT_SCHEMA)


#: Types whose values are the same in pandas whether a page is converted alone or beside others.
PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType, T.BinaryType)


def per_page(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Grouped-map escape hatch: ``fn`` gets each page whole, at any size, and ``schema`` starts with ``page_id``. Memory is bound by
    the largest page: a Python worker holds the rows of one page at a time, once in Arrow and once in pandas, besides what ``fn``
    makes of them (two million rows of eight numbers: about 256 MB). What can be cut into blocks belongs in ``pagefold``.

    Tables of plain columns travel in batches of many pages, which are cut apart in the worker; handing over each small page by itself would
    cost more than most functions do."""
    out = T.StructType.fromDDL(schema)
    names = out.fieldNames()
    if not all(isinstance(f.dataType, PLAIN) for f in [*df.schema.fields, *out.fields]):
        return df.groupBy("page_id").applyInPandas(lambda pdf: fn(pdf)[names], schema)
    arrow = to_arrow_schema(out)

    def frames(rows: pa.Table, starts) -> Iterator[pd.DataFrame]:
        cuts = [*starts, rows.num_rows]
        if any(c.null_count for c in rows.columns):  # nulls change a column's type, but only on their own page
            for a, b in zip(cuts, cuts[1:]):
                yield rows.slice(a, b - a).to_pandas()
        else:
            whole = rows.to_pandas()
            for a, b in zip(cuts, cuts[1:]):
                yield whole.iloc[a:b].reset_index(drop=True)

    def convert(done: list[pd.DataFrame]) -> list[pa.RecordBatch]:
        pdf = done[0] if len(done) == 1 else pd.concat(done, ignore_index=True)
        return pa.Table.from_pandas(pdf, schema=arrow, preserve_index=False, safe=False).to_batches()

    def results(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        starts = np.flatnonzero(rows["_first"].to_numpy())
        done: list[pd.DataFrame] = []
        kinds = None
        for page in frames(rows.drop_columns(["_first"]), starts):
            new = fn(page)
            if list(new.columns) != names:
                new = new[names]
            if not len(new):
                continue
            own = [new[c].dtype for c in names]
            if done and own != kinds:
                yield from convert(done)
                done = []
            kinds = own
            done.append(new)
        if done:
            yield from convert(done)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []  # from the start of a page on
        for batch in batches:
            starts = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            if len(starts):
                end = int(starts[-1])
                if parts or end:
                    yield from results([*parts, batch.slice(0, end)])
                parts = [batch.slice(end)]
            elif batch.num_rows:
                parts.append(batch)
        if parts:
            yield from results(parts)

    first = F.row_number().over(Window.partitionBy("page_id").orderBy(F.lit(0))) == 1
    return df.withColumn("_first", first).mapInArrow(run, out)
