"""Row numbers, lags and carried values that survive a key holding most of the rows.

A plain ``row_number`` over a batch sorts the whole batch in one task. These helpers take
buckets that agree with the sort order, number rows inside (key, bucket), and add the size
of all earlier buckets, which comes from a pre-aggregated count table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], buckets: Sequence[Column],
           name: str = "rn", total: str | None = None) -> DataFrame:
    """Add ``name`` = position of the row in ``order`` within ``by``, starting at 1.

    ``buckets`` are nested and ascend with ``order``; each level should have few distinct
    values inside its parent. ``total`` also adds the number of rows of the key.
    """
    by = list(by)
    bcols = [f"_b{i}" for i in range(len(buckets))]
    rows = df.select("*", *[c.alias(n) for c, n in zip(buckets, bcols)])
    sizes = rows.groupBy(*by, *bcols).agg(F.count(F.lit(1)).alias("_n"))
    level, offsets = sizes, None
    for depth in range(len(bcols), 0, -1):
        parent, own = by + bcols[:depth - 1], bcols[depth - 1]
        before = W.partitionBy(*parent).orderBy(own).rowsBetween(W.unboundedPreceding, -1)
        here = level.withColumn(f"_o{depth}", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        level = level.groupBy(*parent).agg(F.sum("_n").alias("_n"))
        here = here.drop("_n")
        offsets = here if offsets is None else offsets.join(here, parent + [own])
    if total:
        offsets = offsets.join(level.withColumnRenamed("_n", total), by)
    numbered = F.row_number().over(W.partitionBy(*by, *bcols).orderBy(*order))
    shift = sum((F.col(f"_o{d}") for d in range(1, len(bcols) + 1)), F.lit(0))
    out = rows.join(offsets, by + bcols)
    extra = [total] if total else []
    return out.select(*df.columns, *extra, (numbered + shift).cast("long").alias(name))


def top_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
                name: str = "rn") -> DataFrame:
    """First ``k`` rows per key. Spark limits each map task to ``k`` rows per key before
    the shuffle (window group limit), so a hot key costs k rows per task."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def neighbours(df: DataFrame, by: Sequence[str], rank: str, cols: dict[str, tuple[str, int]]) -> DataFrame:
    """Values of the rows some positions away, given a gapless ``rank``.

    ``cols`` maps a new column to (source column, offset); offset -1 is the previous row.
    Each row is sent to the positions that need it and regrouped there: one shuffle on
    (key, position), no per-key sort.
    """
    by = list(by)
    shifts = sorted({0} | {-off for _, off in cols.values()})
    sent = df.withColumn("_shift", F.explode(F.array(*[F.lit(s) for s in shifts])))
    sent = sent.withColumn("_at", F.col(rank) + F.col("_shift"))
    own = F.max(F.when(F.col("_shift") == 0, F.struct(*df.columns)))
    aggs = [F.max(F.when(F.col("_shift") == -off, F.col(src))).alias(new)
            for new, (src, off) in cols.items()]
    got = sent.groupBy(*by, "_at").agg(own.alias("_own"), *aggs)
    return got.where(F.col("_own").isNotNull()).select("_own.*", *cols)


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column,
                  cols: dict[str, str], only_set: bool = False) -> DataFrame:
    """Add for each new name in ``cols`` the source value of the previous row in ``order``;
    with ``only_set`` the last non-null value up to and including this row.

    ``bucket`` ascends with ``order``. Rows are scanned inside (key, bucket); the value that
    enters a bucket is the last one of the buckets before it.
    """
    by = list(by)
    rows = df.withColumn("_b", bucket)
    inside = W.partitionBy(*by, "_b").orderBy(*order)
    across = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    key = F.struct(*order)
    if only_set:
        tails = rows.groupBy(*by, "_b").agg(*[
            F.max_by(F.col(s), F.when(F.col(s).isNotNull(), key)).alias(f"_t_{n}") for n, s in cols.items()])
        here = {n: F.last(s, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
                for n, s in cols.items()}
    else:
        tails = rows.groupBy(*by, "_b").agg(*[F.max_by(F.col(s), key).alias(f"_t_{n}") for n, s in cols.items()])
        here = {n: F.lag(s).over(inside) for n, s in cols.items()}
    enter = tails.select(*by, "_b", *[F.last(f"_t_{n}", ignorenulls=only_set).over(across).alias(f"_e_{n}") for n in cols])
    first = F.row_number().over(inside) == 1
    joined = rows.join(enter, by + ["_b"])
    pick = {n: (F.coalesce(c, F.col(f"_e_{n}")) if only_set else F.when(first, F.col(f"_e_{n}")).otherwise(c))
            for n, c in here.items()}
    return joined.select(*df.columns, *[c.alias(n) for n, c in pick.items()])


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column, how: str, value: str, name: str,
            include_row: bool = True) -> DataFrame:
    """Running ``sum``, ``min`` or ``max`` of ``value`` within ``by`` in ``order``. Rows are scanned
    inside (key, bucket); what the earlier buckets contribute comes from one row per bucket."""
    by = list(by)
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    both = {"sum": lambda p, q: F.coalesce(p, F.lit(0)) + F.coalesce(q, F.lit(0)), "min": F.least, "max": F.greatest}[how]
    rows = df.withColumn("_b", bucket)
    before = rows.groupBy(*by, "_b").agg(agg(value).alias("_t")).select(
        *by, "_b", agg("_t").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_e"))
    inside = W.partitionBy(*by, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if include_row else -1)
    return rows.join(before, by + ["_b"]).select(*df.columns, both(F.col("_e"), agg(value).over(inside)).alias(name))
