"""Mixing documents to target domain weights: soft domains from a classifier, rates by distributed Newton steps."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import THIN, forget, forgetting, stash, table, text_or_empty

#: Domains of the label table: toxic whatever the quality, else by quality.
DOMAINS = ("plain", "junk", "toxic")
#: Target shares of the expected tokens. Plain text stays whole; the others shrink to these shares beside it.
TARGETS = {"plain": 0.985, "junk": 0.010, "toxic": 0.005}
#: Feature buckets (with the domains they bound the shared weights: 6 MB) and the most labelled documents that fit them.
BUCKETS, MOST_LABELLED = 1 << 18, 10_000
#: Relative error at which the fit ends, and the weight of a ridge that settles targets which no rates reach.
CLOSE, RIDGE = 1e-6, 1e-9
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


def features(text: str) -> np.ndarray:
    """Buckets of the distinct words and runs of signs of a text, in lower case, and one of text in capitals."""
    words = set(TOKEN.findall(text))
    capitals = sum(w.isupper() and len(w) > 1 for w in words)
    out = {zlib.crc32(w.lower().encode()) % BUCKETS for w in words}
    if 2 * capitals > len(words):
        out.add(zlib.crc32(b"\x01capitals") % BUCKETS)
    return np.fromiter(out, np.int64, len(out))


def fit_domains(rows: list[np.ndarray], domain: np.ndarray, steps: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on present buckets by Adam over all rows, with a small ridge; weights and biases."""
    k = len(DOMAINS)
    share = (np.bincount(domain, minlength=k) + 1) / (len(domain) + k)
    w, b = np.zeros((BUCKETS, k), np.float32), np.log(share)
    if not len(rows):
        return w, b
    used, flat = np.unique(np.concatenate(rows), return_inverse=True)
    sizes = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    small, m, v = np.zeros((len(used), k)), np.zeros((len(used), k)), np.zeros((len(used), k))
    target = np.eye(k)[domain]
    scale = 1 / np.sqrt(np.maximum(1, sizes))
    for t in range(1, steps + 1):
        z = np.stack([np.bincount(owner, small[flat, j], len(rows)) for j in range(k)], axis=1) + b
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - target) * scale[:, None] ** 0.5
        g = np.stack([np.bincount(flat, error[owner, j], len(used)) for j in range(k)], axis=1) / len(rows) + 1e-6 * small
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        small -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    w[used] = small
    return w, b


def _present(batches):
    for batch in batches:
        rows = [features(t).astype(np.int32).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("domain"), pa.array(rows, pa.binary())], names=["doc_id", "domain", "at"])


def _posteriors(shared):
    """A column function of texts: number of words and posteriors; other columns stay in the JVM."""
    @F.arrow_udf("tokens long, domains array<double>")
    def soft(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, b = shared.value
        for batch in batches:
            tokens, p = np.zeros(len(batch), np.int64), np.zeros((len(batch), len(DOMAINS)))
            for i in range(0, len(batch), THIN):
                texts = [t or "" for t in batch.slice(i, THIN).to_pylist()]
                tokens[i:i + THIN] = [len(t.encode().split()) for t in texts]
                p[i:i + THIN] = np.stack([w[features(t)].sum(0, dtype=np.float64) for t in texts]) + b
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            yield pa.StructArray.from_arrays([pa.array(tokens), pa.array(list(p), pa.list_(pa.float64()))], names=["tokens", "domains"])
        forget()
    return soft.asNondeterministic()


def soft_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``, so no name can clash), ``doc_id``, ``_tokens`` (words) and ``_domains`` (posteriors
    over ``DOMAINS``), for every row. Several texts of one labelled doc_id teach as one of them."""
    quality, toxic = F.avg("quality") >= 0.5, F.avg("toxic") >= 0.5
    known = labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.when(toxic, 2).when(quality, 0).otherwise(1).alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    seen = texts.join(F.broadcast(known), "doc_id").mapInArrow(forgetting(_present), "doc_id long, domain int, at binary")
    rows = seen.groupBy("doc_id").agg(F.min("domain"), F.min("at")).collect()  # one row for each labelled document
    rows.sort(key=lambda r: r[0])
    w, b = fit_domains([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows], np.int64))
    shared = docs.sparkSession.sparkContext.broadcast((w, b))
    soft = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _posteriors(shared)("text").alias("soft"))
    return soft.select("row", "doc_id", F.col("soft.tokens").alias("_tokens"), F.col("soft.domains").alias("_domains"))


def rate_of(prices: list[float], domains: Column) -> Column:
    """A document's rate: 1 less the prices of its posteriors, and never below zero."""
    rate = F.lit(1.0)
    for i, x in enumerate(prices):
        rate = rate - F.lit(x) * domains[i]
    return F.greatest(F.lit(0.0), rate)


def fit_rates(soft: DataFrame, targets: dict[str, float], grow: bool = True) -> list[float]:
    """A price for each domain, from which each document's rate follows. Without ``grow``, a domain with less than its target
    keeps what it has: no document is repeated to raise it.

    The rates are those nearest to 1 (squares, by token) that are not negative and bring the domains' expected token totals
    to their targets; a ridge of RIDGE makes that the nearest totals where no rates reach them. Such rates are ``rate_of`` prices
    that minimise a convex function whose gradient is targets less totals. Each step is Newton's, over the documents whose
    rate is not clipped, and halved until the function falls; steps go on to convergence. A step is one aggregation of a few
    sums; the driver keeps one price per domain, and rates are never stored or shuffled.
    """
    k = len(DOMAINS)
    d, n, r = F.col("_domains"), F.col("_tokens"), F.col("rate")
    cells = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(prices: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
        """Of all documents: squared rates, expected totals, and the Gram matrix of those not clipped."""
        live = F.when(r > 0, n).otherwise(0)
        row = soft.select("_domains", "_tokens", rate_of([float(x) for x in prices], d).alias("rate")) \
            .agg(F.sum(n * r * r), *[F.sum(d[i] * n * r) for i in range(k)], *[F.sum(d[i] * d[j] * live) for i, j in cells]).first()
        if not row[0]:
            return None if row[0] is None else (0.0, np.zeros(k), np.zeros((k, k)))
        gram = np.zeros((k, k))
        for (i, j), x in zip(cells, row[1 + k:], strict=True):
            gram[i, j] = gram[j, i] = x
        return float(row[0]), np.array(row[1:1 + k], float), gram

    at = np.zeros(k)
    found = sums(at)
    if found is None or not found[0]:
        return []
    whole = found[0]  # at rates of 1 the squares add up to all tokens
    goal = np.array([targets[x] for x in DOMAINS]) * found[1][0] / targets[DOMAINS[0]]  # the first domain keeps its total
    if not grow:
        goal = np.minimum(goal, found[1])

    def judged(found, prices):
        squares, now, gram = found
        return (squares / 2 + prices @ goal) / whole + RIDGE / 2 * prices @ prices, (goal - now) / whole + RIDGE * prices, gram / whole + RIDGE * np.eye(k)

    value, slope, gram = judged(found, at)
    while np.abs(slope).sum() * whole > CLOSE * goal.sum():
        move, part = -np.linalg.solve(gram, slope), 1.0
        while True:
            there = at + part * move
            if (there == at).all():  # the function falls no more in double precision
                return [float(x) for x in at]
            new = judged(sums(there), there)
            if new[0] <= value + 1e-4 * part * (slope @ move):
                break
            part /= 2
        at, (value, slope, gram) = there, new
    return [float(x) for x in at]


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, p_plain, p_junk, p_toxic, rate, copies``.

    ``copies`` is the rate rounded up or down by a hash of the doc_id, so its expectation is the rate. Null and empty texts
    have no words and posteriors of the prior; labels outside 0 and 1 and null ids are ignored; without labels all
    domains are alike. Repeated rows get equal rates. Other columns are ignored; no row gives none. A text of any length counts
    whole.
    """
    soft = stash(soft_domains(docs.select("doc_id", "text"), labels).drop("row"))
    rate = rate_of(fit_rates(soft, targets or TARGETS), F.col("_domains"))
    return soft.select("doc_id", F.col("_tokens").alias("n_words"), *[F.col("_domains")[i].alias(f"p_{x}") for i, x in enumerate(DOMAINS)], rate.alias("rate")) \
        .withColumn("copies", copies_of(F.col("rate")))


def copies_of(rate: Column) -> Column:
    lucky = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + lucky).cast("int")


def resampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says; columns unchanged, whatever their names. Domains over their target shrink to
    it; one below it is not raised by repeating its few documents. Null and empty texts have no words
    and stay by the prior's rate; an empty table gives none."""
    soft = stash(soft_domains(docs, labels))
    rate = rate_of(fit_rates(soft, targets or TARGETS, grow=False), F.col("_domains"))
    repeated = soft.withColumn("copies", copies_of(rate)).where("copies > 0")
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
