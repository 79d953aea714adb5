"""Importance resampling towards a target's n-grams, hashed from running checksums of each text."""

from __future__ import annotations

import hashlib
import math
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelattice.llm.common import slices, stash, table, text_or_empty

BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 3
#: Bytes of text worked on at once within a task.
CHUNK = 1_500_000
#: Rows of a range that ranks are given in.
RANGE_ROWS = 200_000
#: Every byte as it counts: A-Z in lower case, a blank for what parts words, the rest as it is.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _byte_step() -> np.ndarray:
    """What the low byte of a checksum adds when one zero byte follows, from the polynomial of crc32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> 1) ^ (np.uint32(0xEDB88320) * (c & 1))
    return c


STEP = _byte_step()


def _through(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


class Shifts(list):
    """``self[k]``: four tables by byte for the linear map over GF(2) that 2**k zero bytes apply to a checksum."""

    def of(self, k: int) -> np.ndarray:
        while len(self) <= k:
            if self:
                self.append(_through(self[-1], self[-1].ravel()).reshape(4, 256))
            else:
                bytes_ = np.arange(256, dtype=np.uint32)
                self.append(np.stack([STEP, bytes_, bytes_ << np.uint32(8), bytes_ << np.uint32(16)]))
        return self[k]


SHIFTS = Shifts()


def shifted(c: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums ``c`` as ``length`` zero bytes each would change them, one power of two at a time."""
    c = c.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero((length >> k) & 1)
        c[at] = _through(SHIFTS.of(k), c[at])
    return c


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def feature_hashes(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of 1 to ``LONGEST`` words, the crc32 of all n-grams of some texts and the text each is from.

    The words are gone through once, each with the blank before it, and the running checksum after each is kept. The checksum of an
    n-gram is that after its last word, less that before its first word carried over the n-gram's bytes: what came
    before cancels out, other texts too.
    """
    words = [w for t in texts for w in t]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    after = np.fromiter(accumulate(map(b" ".__add__, words), lambda c, w: crc32(w, c), initial=0), np.uint32, len(words) + 1)
    ends = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=ends[1:])
    inner = ~after[:-1]
    before = ~(STEP[(inner ^ np.uint32(0x20)) & 255] ^ (inner >> np.uint32(8)))  # after the blank
    out = []
    for k in range(1, LONGEST + 1):
        first = np.flatnonzero(owner[:len(owner) - k + 1] == owner[k - 1:]) if len(owner) >= k else np.zeros(0, np.int64)
        out.append((after[first + k] ^ shifted(before[first], ends[first + k] - ends[first] - 1), owner[first]))
    return out


def _chunks(batch, columns: list[str]):
    lists = [batch.column(c).to_pylist() for c in columns]
    return slices(lists, [len(t) for t in lists[-1]], CHUNK)


def _bucket_counts(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for texts, in _chunks(batch, ["text"]):
            for h, _ in feature_hashes([words_of(t) for t in texts]):
                total += np.bincount(h % BUCKETS, minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket over all texts: at most ``BUCKETS`` rows a task, ``BUCKETS`` numbers for the driver."""
    sums = texts.select("text").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in sums:
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths by which the logarithm of a bucket's smoothed share in the target is above that in the source, rounded down."""
    s_all, t_all = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weights(shared, seed: int):
    def run(batches):
        gain = shared.value
        for batch in batches:
            for ids, texts in _chunks(batch, ["doc_id", "text"]):
                words = [words_of(t) for t in texts]
                weight, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for h, owner in feature_hashes(words):
                    total = np.concatenate([[0], np.cumsum(gain[h % BUCKETS])])
                    upto = np.searchsorted(owner, np.arange(len(texts) + 1))
                    weight += total[upto[1:]] - total[upto[:-1]]
                    n += np.diff(upto)
                score = weight + np.array([noise(i, seed) for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(n), pa.array(weight), pa.array(score)],
                    names=["doc_id", "n_words", "n_features", "weight", "score"])
    return run


def ranked(rows: DataFrame, wanted: int, n: int) -> DataFrame:
    """``rows(doc_id, score, ...)`` with ``rank``: 1, 2, 3... by descending score, then ascending doc_id; null beyond ``wanted``.
    Rows are dealt by ranges of that order, numbered within a range and moved on by the sizes of the ranges before."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = stash(rows.repartitionByRange(max(1, math.ceil(n / RANGE_ROWS)), *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("rows"))
    earlier = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("earlier")
    return dealt.join(earlier, "part").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank").cast("long"))).drop("part", "earlier")


def importance_resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_features, weight, score, rank``, one row per row of it.

    Features are all runs of 1 to 3 words of a whole text, in 10,000 buckets by crc32. ``weight`` sums over them how much more
    frequent their buckets are in ``target(text, ...)`` than in ``docs``; ``score`` adds Gumbel noise from the doc_id, so the highest
    scores are a draw without replacement with odds by weight. Of the texts with ``least`` words or more, ``percent`` of a hundred
    (rounded down) are drawn; ``rank`` is their place and null for all others.

    Null texts have no features, weight 0 and are never drawn. Rows that share a doc_id are each weighed by their own text with the
    same noise; a null doc_id has the noise of an empty id and stands last among ties. Equal rows take consecutive ranks. Texts
    of any length are gone through once, in memory that grows with one text. An empty ``docs`` gives no row, an empty
    ``target`` counts as one without features. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    gain = gains(bucket_counts(source), bucket_counts(target.select(text_or_empty().alias("text"))))
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    weighed = stash(source.mapInArrow(_weights(shared, seed), "doc_id long, n_words long, n_features long, weight long, score long"))
    able = weighed.where(F.col("n_words") >= least)
    n = able.count()
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = weighed.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked(able, percent * n // 100, n).select(columns).union(rest.select(columns))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
