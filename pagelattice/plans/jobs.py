"""End-to-end jobs composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagelattice.operators.dataset import confusion, keypoint_error


def evaluate(evaluated: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Classification rates and key point errors as (metric, value) rows."""
    rates = ("accuracy", "precision", "recall", "specificity", "f1")
    long = lambda d, names: d.select(F.explode(F.array(*[F.struct(n.alias("metric"), F.round(v, 6).alias("value")) for n, v in names])).alias("x")).select("x.*")
    a = long(confusion(evaluated), [(F.lit(c), F.col(c)) for c in rates])
    named = [("median", "median_err"), ("mean", "mean_err"), ("within_10", "within_10"), ("within_20", "within_20")]
    b = long(keypoint_error(keypoints), [(F.concat("kind", F.lit("_" + s)), F.col(c)) for s, c in named])
    return a.unionByName(b)
