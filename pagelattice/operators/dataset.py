"""Sampling, splits, set operations, labels and evaluation of annotated crops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagelattice.operators.ordering import corner_order, crop_ids
from pagelattice.operators.projections import augment_points, canonical_points
from pagelattice.operators.ranking import ranked, top_per_key


def hash_order(seed: int, row_id: str) -> Column:
    """Seeded pseudo-random sort key, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def sample_per_batch(df: DataFrame, n: int, seed: int, row_id: str, check: bool = True) -> DataFrame:
    """Exactly ``n`` rows per batch in hash order. A smaller batch is an error, as in the reference
    job, unless ``check`` is off, when it is taken whole."""
    if check:
        short = df.groupBy("batch").count().where(F.col("count") < n)
        if not short.isEmpty():
            raise ValueError(f"a batch has fewer than {n} rows")
    return top_per_key(df, ["batch"], [hash_order(seed, row_id), F.col(row_id)], n, "pick")


def sample_global(crops: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` crops over all batches, renumbered in page and reading order, original id kept."""
    picked = crops.orderBy(hash_order(seed, "crop_key"), "crop_key").limit(n)
    kept = picked.withColumns({"original_id": F.col("bubble_id"), "batch": F.lit("sample")})
    return crop_ids(kept)


def split_stratified(crops: DataFrame, seed: int, val_pos: int = 100, val_neg: int = 500, ratio: int = 7) -> DataFrame:
    """Per class hash order: the first rows are validation, the rest training, with at most
    ``ratio`` negatives per training positive. Rows past that cap are left out by design."""
    h = hash_order(seed, "crop_key")
    d = ranked(crops, ["is_conjoined"], [h, F.col("crop_key")], [F.substring(h, 1, 2), F.substring(h, 1, 4)], "place")
    positives = crops.agg(F.count_if("is_conjoined")).scalar()
    room = F.greatest(positives - val_pos, F.lit(0)) * ratio
    limit = F.when(F.col("is_conjoined"), val_pos).otherwise(val_neg)
    split = F.when(F.col("place") <= limit, "val").when(F.col("is_conjoined") | (F.col("place") <= limit + room), "train")
    return d.withColumn("split", split).where("split IS NOT NULL")


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Live, annotated crops of all batches: singles, and conjoined ones with two points taken from
    the cut points or else from the first dividing line. Columns a batch lacks are null."""
    d = reduce(lambda p, q: p.unionByName(q, allowMissingColumns=True), batches)
    d = d.where(~F.coalesce("is_discarded", F.lit(False)) & F.col("is_conjoined").isNotNull())
    cut, line = F.col("cut_points"), F.col("line_points")
    pts = F.when(F.size(cut) >= 2, F.slice(cut, 1, 2)).when(F.size(line) >= 2, F.slice(line, 1, 2))
    at = lambda i, c: F.when(F.col("is_conjoined"), F.get("_p", F.lit(i))[c])
    d = d.withColumn("_p", pts).where(~F.col("is_conjoined") | F.col("_p").isNotNull())
    d = d.withColumns({"x0": at(0, "x"), "y0": at(0, "y"), "x1": at(1, "x"), "y1": at(1, "y")}).drop("_p", "cut_points", "line_points")
    return canonical_points(d)


def dedup_paths(paths: DataFrame) -> DataFrame:
    """First listing of each path over overlapping roots."""
    return top_per_key(paths, ["path"], [F.col("root_no"), F.col("file_id")], 1).drop("rn")


def id_differences(source: DataFrame, annotated: DataFrame, key: str) -> DataFrame:
    """Ids without annotation and annotations without source, flagged by ``side``."""
    s, a = source.select(key).distinct(), annotated.select(key).distinct()
    return s.join(a, key, "left_anti").withColumn("side", F.lit("unannotated")).unionByName(
        a.join(s, key, "left_anti").withColumn("side", F.lit("orphaned")))


def six_decimals(v: Column) -> Column:
    """A value in 0..1 as text, rounded on its exact binary value with ties to even.

    ``format_string`` rounds the shortest decimal half up instead. Splitting the value in two
    halves of its bits keeps the distance to the tie free of rounding."""
    n = F.floor(v * 1_000_000)
    high = v * 134_217_729.0 - (v * 134_217_729.0 - v)
    beyond = (high * 2_000_000.0 - (n * 2 + 1)) + (v - high) * 2_000_000.0
    up = (beyond > 0) | ((beyond == 0) & (n % 2 == 1))
    n = n + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("."), F.lpad((n % 1_000_000).cast("string"), 6, "0"))


def to_pose_labels(crops: DataFrame, width: str = "crop_w", height: str = "crop_h") -> DataFrame:
    """Label line per crop: class, full-crop box, two clamped key points with visibility 2, or zeros."""
    share = lambda c, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.col(size)))
    d = canonical_points(crops)
    # Shares and their texts in steps of their own, so that none is computed more than once.
    d = d.withColumns({"_" + c: share(c, width if c[0] == "x" else height) for c in ("x0", "y0", "x1", "y1")})
    d = d.withColumns({"_" + c: six_decimals(F.col("_" + c)) for c in ("x0", "y0", "x1", "y1")})
    points = F.concat_ws(" ", "_x0", "_y0", F.lit("2"), "_x1", "_y1", F.lit("2"))
    head = F.concat(F.when(F.col("is_conjoined"), "0").otherwise("1"), F.lit(" 0.500000 0.500000 1.000000 1.000000 "))
    label = F.concat(head, F.when(F.col("is_conjoined") & F.col("x0").isNotNull(), points).otherwise("0.000000 0.000000 0 0.000000 0.000000 0"))
    return d.withColumn("label", label).drop("_x0", "_y0", "_x1", "_y1")


def training_labels(crops: DataFrame, seed: int, **limits) -> DataFrame:
    """Split, augmentation of training positives, and label text in one table."""
    d = split_stratified(crops, seed, **limits)
    plain = d.where("split = 'val' OR NOT is_conjoined").withColumns({"variant": F.lit("original"), "out_w": F.col("crop_w"), "out_h": F.col("crop_h")})
    grown = augment_points(d.where("split = 'train' AND is_conjoined"))
    cols = ["bubble_id", "split", "variant", "is_conjoined", "x0", "y0", "x1", "y1", "out_w", "out_h"]
    return to_pose_labels(plain.select(*cols).unionByName(grown.select(*cols)), "out_w", "out_h").select("bubble_id", "split", "variant", "label")


def write_pose_labels(labels: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Label files below ``path/split=NAME``: a line per crop and variant of name, tab, label. A split of any size is many files."""
    line = F.concat_ws("\t", "bubble_id", "variant", "label")
    labels.select("split", line.alias("value")).write.mode(mode).partitionBy("split").text(path)


def read_pose_labels(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("value string, split string").text(path)
    part = F.split("value", "\t")
    return d.select(part[0].alias("bubble_id"), "split", part[1].alias("variant"), part[2].alias("label"))


# ---- status and evaluation --------------------------------------------------------------------

def batch_status(manifest: DataFrame, active: str) -> DataFrame:
    """Counts per batch and, with a null batch, over all. ``done`` is verified plus discarded in the
    active batch, elsewhere everything that is not unlabelled."""
    live = ~F.coalesce("is_discarded", F.lit(False))
    status = lambda *s: F.count_if(live & F.col("status").isin(*s))
    d = manifest.groupBy("batch").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~live).alias("discarded"), status("unlabeled").alias("unlabeled"),
        status("verified", "annotated").alias("verified"), status("conjoined").alias("queued"), status("unverified").alias("unverified"),
        status("recheck").alias("recheck"), F.count_if(live & F.col("is_conjoined")).alias("conjoined"), F.count_if(live & ~F.col("is_conjoined")).alias("single"))
    d = d.withColumn("done", F.when(F.col("batch") == active, F.col("verified") + F.col("discarded")).otherwise(F.col("total") - F.col("unlabeled")))
    counts = [c for c in d.columns if c != "batch"]
    total = d.rollup("batch").agg(*[F.sum(c).alias(c) for c in counts])
    return total.withColumn("pct_complete", F.round((F.col("verified") + F.col("discarded")) * 100 / F.greatest("total", F.lit(1)), 1))


def rate(num: Column, den: Column) -> Column:
    return F.when(den > 0, num * 100.0 / den).otherwise(F.lit(0.0))


def confusion(evaluated: DataFrame) -> DataFrame:
    """Counts and rates. Rows without a prediction still count in the accuracy's denominator."""
    truth, said = F.col("is_conjoined"), F.col("predicted")
    n = evaluated.agg(F.count_if(truth & said).alias("tp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"),
                      F.count_if(~truth & said).alias("fp"), F.count(F.lit(1)).alias("eligible"))
    return confusion_rates(n)


def confusion_rates(counts: DataFrame) -> DataFrame:
    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    return counts.select("*", rate(tp + tn, F.col("eligible")).alias("accuracy"), rate(tp, tp + fp).alias("precision"),
                         rate(tp, tp + fn).alias("recall"), rate(tn, tn + fp).alias("specificity"), rate(tp * 2, tp * 2 + fp + fn).alias("f1"))


def keypoint_error(evaluated: DataFrame) -> DataFrame:
    """Median, mean and share within 10 and 20 px of both points' distance, raw and snapped."""
    d = canonical_points(evaluated)
    dist = lambda p, i: F.hypot(F.col(f"{p}x{i}") - F.col(f"x{i}"), F.col(f"{p}y{i}") - F.col(f"y{i}"))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), dist(p, i).alias("err")) for k, p in (("raw", "p"), ("snapped", "s")) for i in (0, 1)])
    e = d.select(F.explode(rows).alias("x")).select("x.*")
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("err", 0.5), 6).alias("median_err"), F.round(F.avg("err"), 6).alias("mean_err"),
                                 F.round(F.avg(F.when(F.col("err") <= 10, 100.0).otherwise(0.0)), 6).alias("within_10"),
                                 F.round(F.avg(F.when(F.col("err") <= 20, 100.0).otherwise(0.0)), 6).alias("within_20"))


def cut_arity(annotations: DataFrame) -> DataFrame:
    """Crops with several cuts (more than one line or two points) against those with one."""
    multi = (F.size("lines") > 1) | (F.size("points") > 2)
    return annotations.agg(F.count_if(multi).alias("multi_cut"), F.count_if(~multi).alias("single_cut"))
