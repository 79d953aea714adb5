"""A quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import THIN, WORD_CACHE, forget, forgetting, fresh, table, text_or_empty

#: Word buckets and components of a vector: together they bound what is shared with every task (2 MB).
BUCKETS, DIM = 16_384, 32
#: What the network sees of a document.
INPUTS = 2 * DIM + 3
#: Neighbours on either side that count as context, and non-zero entries of an index vector.
WINDOW, MARKS = 2, 4
#: At most so many labelled documents train the network (those with the least hashes of their ids).
MOST_LABELLED = 20_000
#: A document is kept from this probability on.
THRESHOLD = 0.7
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")


def token_bucket(token: str) -> int:
    """Words in lower case; longer words in capitals, numbers by length and runs of signs as they are have buckets of their own."""
    if token[0].isalpha():
        token = "\x01capitals" if len(token) > 1 and token.isupper() else token.lower()
    elif token[0].isdigit():
        token = f"\x01digits{min(len(token), 6)}"
    return zlib.crc32(token.encode()) % BUCKETS


class _Buckets(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[token] = token_bucket(token)
        return value


KNOWN = _Buckets()


def buckets_of(text: str) -> np.ndarray:
    tokens = TOKEN.findall(text)
    return np.fromiter(map(KNOWN.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The sparse random vector of each bucket: places and signs of its non-zero entries, fixed by a seed."""
    rng = np.random.default_rng(20_011)
    return rng.integers(0, DIM, (BUCKETS, MARKS)), rng.choice([-1.0, 1.0], (BUCKETS, MARKS))


def _contexts(batches):
    """Sums of the index vectors of neighbouring words for each word bucket of one task."""
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for start in range(0, len(texts), 400):
            parts = [buckets_of(t) for t in texts[start:start + 400]]
            words = np.concatenate(parts)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            for gap in range(1, WINDOW + 1):
                near = owner[gap:] == owner[:-gap]
                a, b = words[:-gap][near], words[gap:][near]
                for m in range(MARKS):
                    total += np.bincount(a * DIM + places[b, m], signs[b, m], BUCKETS * DIM)
                    total += np.bincount(b * DIM + places[a, m], signs[a, m], BUCKETS * DIM)
    vectors = total.reshape(BUCKETS, DIM)
    used = np.flatnonzero(vectors.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(list(vectors[used]), pa.list_(pa.float64()))], names=["bucket", "v"])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """One vector for each word bucket, from all texts: its contexts, scaled to length one, and its own index vector.

    Each task sends at most ``BUCKETS`` rows; the driver gets ``BUCKETS`` x ``DIM`` numbers, however many texts there are."""
    sums = texts.select("text").mapInArrow(forgetting(_contexts, KNOWN), "bucket long, v array<double>") \
        .groupBy("bucket").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)]).collect()
    out = np.zeros((BUCKETS, DIM))
    for row in sums:
        out[row[0]] = row[1:]
    out /= np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIM))
    for m in range(MARKS):
        np.add.at(own, (np.arange(BUCKETS), places[:, m]), signs[:, m])
    return (out + own / np.sqrt(MARKS)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a text's word vectors, the mean step from one word's vector to the next and to the one after it, and
    the logarithm of the number of words."""
    out = np.zeros((len(texts), INPUTS), np.float32)
    for i, t in enumerate(texts):
        b = buckets_of(t)
        if len(b):
            v = vectors[b]
            out[i, :DIM] = v.mean(0)
            out[i, DIM:2 * DIM] = v.std(0)
            for gap in (1, 2):
                if len(b) > gap:
                    out[i, 2 * DIM + gap - 1] = np.linalg.norm(v[gap:] - v[:-gap], axis=1).mean()
                else:
                    out[i, 2 * DIM + gap - 1] = 1.9  # about the step of unlike words
        out[i, -1] = np.log1p(len(b))
    return out


@dataclass
class Network:
    """Two layers on standardised inputs; ``temperature`` divides the logit so that probabilities fit held-back labels."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on the rows that aren't held back, then the temperature of least log loss on those that are. Without rows of both
    labels the score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(INPUTS), np.ones(INPUTS))
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), np.array(np.log(share / (1 - share)))]
    fit = np.flatnonzero(~calibrate)
    if len(set(y[fit])) < 2:
        return Network(mean, scale, *p[:3], float(p[3]))
    p[2] = rng.normal(0, hidden**-0.5, hidden)
    xs, m, v, t = (x - mean) / scale, [0.0] * 4, [0.0] * 4, 0
    for epoch in range(epochs):
        order = rng.permutation(fit)
        for start in range(0, len(order), 256):
            at = order[start:start + 256]
            a, target = xs[at], y[at]
            h = np.tanh(a @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - target) / len(at)
            dh = np.outer(d, p[2]) * (1 - h * h)
            t += 1
            for i, g in enumerate((a.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum())):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.01 * (0.5 if epoch > epochs // 2 else 1) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]))
    if calibrate.any():
        z, target = net.logits(x[calibrate]), y[calibrate]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 100))
        net.temperature = float(min(grid, key=lambda s: np.mean(np.logaddexp(0, z / s) - target * z / s)))
    return net


def _features(vectors):
    def run(batches):
        for batch in batches:
            x = pooled(batch.column("text").to_pylist(), vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "label", "x"])
    return forgetting(run, KNOWN)


def _scores(shared) -> Column:
    """A column function of texts: other columns stay in the JVM."""
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors, net = shared.value
        for texts in batches:
            parts = [net.score(pooled([t or "" for t in texts.slice(i, THIN).to_pylist()], vectors).astype(np.float64)) for i in range(0, len(texts), THIN)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
        forget(KNOWN)
    return score.asNondeterministic()  # so that a filter on the score doesn't compute it again


def held_out() -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, into: str = "_score") -> DataFrame:
    """``docs`` and its columns with ``into``: the probability that ``labels.quality`` is 1, from the whole text alone.

    Word vectors come from all texts. The network learns from labelled documents that aren't held out, at most
    ``MOST_LABELLED``; every fifth calibrates. Several labels of one doc_id count as their rounded mean, several texts as one of
    them; labels other than 0 and 1, and null ids, are ignored. Null texts are scored as empty ones, texts of any length whole, equal texts
    alike. Rows are neither lost nor added; an empty table gives none; a column ``into`` that is there already is replaced.
    """
    docs = docs.drop(into)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    vectors = word_vectors(texts)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    sample = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    sc = docs.sparkSession.sparkContext
    seen = texts.join(F.broadcast(sample), "doc_id").mapInArrow(_features(sc.broadcast(vectors)), "doc_id long, label int, x array<float>")
    rows = seen.groupBy("doc_id").agg(F.min("label"), F.min("x")).collect()  # one row for each labelled document, however often its id is there
    rows.sort(key=lambda r: r[0])
    x = np.array([r[2] for r in rows], np.float64).reshape(len(rows), INPUTS)
    calibrate = np.array([zlib.crc32(b"c%d" % r[0]) % 5 == 0 for r in rows], bool)
    net = train(x, np.array([r[1] for r in rows], np.float64), calibrate)
    return docs.withColumn(into, _scores(sc.broadcast((vectors, net)))("text"))


def good(docs: DataFrame, labels: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more; columns unchanged, whatever their names."""
    score = fresh("_score", docs.columns)
    return scored(docs, labels, score).where(F.col(score) >= least).select(docs.columns)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
