"""Removal of long word passages that an earlier document has already: windows repeated at one length are extended to twice that length."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import ODD_B, WORDS, grams, mix, prefix_sums, sliding, span_hash, stash, table, text_or_empty

BIG = np.uint64(2**64 - 1)


def _second(h: np.ndarray) -> np.ndarray:
    return mix(h ^ ODD_B)


def anchors(h: np.ndarray, size: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the ``half``-word windows that are least in some ``size``-word window: each of those has one, and
    equal windows have it at the same place."""
    g = grams(h, half)
    span = size - half + 1
    least = sliding(g, span, np.minimum)
    pad = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), span, np.maximum) == g)
    return at, g[at]


def _short_windows(size: int, half: int):
    """Level one: for each anchor its hash, the hash of all words that a ``size``-word window around it can hold, and its place."""
    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                h = WORDS.of(raw.split())
                if len(h) < size:
                    continue
                at, g = anchors(h, size, half)
                lo, hi = np.maximum(0, at + half - size), np.minimum(len(h), at + size)
                around = span_hash(prefix_sums(_second(h)), lo, hi) + mix((at - lo).astype(np.uint64))
                out.append((g, around, np.full(len(at), doc, np.int64), at | (zlib.crc32(raw) >> 1 << 32)))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names=["anchor", "around", "doc_id", "place"])
    return run


def _pack(batches):
    """Texts compressed, for the shuffles by document."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw = [t.encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([zlib.crc32(t) >> 1 for t in raw], pa.int64()),
                                          pa.array([pack.compress(t) for t in raw], pa.binary())], names=["doc_id", "tag", "packed"])


def _long_windows(size: int, half: int):
    """Level two: the ``size``-word windows around anchors that are repeated, but not with the same words around them."""
    def run(batches):
        for batch in batches:
            out = []
            for doc, tag, packed, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "packed", "places")), strict=True):
                h = WORDS.of(zstandard.decompress(packed).split())
                at = np.unique(np.array(at))
                start = np.unique((at[:, None] - np.arange(size - half + 1)).ravel())
                start = start[(start >= 0) & (start <= len(h) - size)]
                out.append((span_hash(prefix_sums(h), start, start + size), span_hash(prefix_sums(_second(h)), start, start + size),
                            np.full(len(start), doc, np.int64), start | tag << 32))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names=["w1", "w2", "doc_id", "place"])
    return run


def _cut(batches):
    """Texts without the covered words."""
    for batch in batches:
        out = []
        for packed, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("packed", "starts", "ends")), strict=True):
            words = zstandard.decompress(packed).split()
            n = len(words)
            if starts:
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, np.array(starts), 1)
                np.add.at(depth, np.minimum(n, np.array(ends)), -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
            out.append((n, n - len(words), b" ".join(words).decode()))
        n, removed, text = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.string()),
                                          pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text], pa.string())],
                                         names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def substring_dedup(docs: DataFrame, size: int = 50) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_words, n_removed, kept_text, kept_sha256`` for every row.

    A word goes when a window of ``size`` words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the input. Level one groups windows of half that length at places chosen by content (about 7 in 100
    words; every long window holds one, equal long windows the same one). Only those repeated in another document go on:
    where all occurrences have the same words around them every long window there is repeated and nothing more is needed,
    else the long windows around them are grouped by a 128-bit hash. Then no candidate is left, as longer windows are
    covered by long ones.

    Null texts have no words. Texts shorter than the window keep all words. Rows sharing a doc_id don't remove each other;
    a null doc_id neither removes nor loses words. Other columns are ignored.
    """
    if size < 2:
        raise ValueError("windows have two words or more")
    half = size // 2
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    short = stash(source.where("doc_id is not null").mapInArrow(_short_windows(size, half), "anchor long, around long, doc_id long, place long"))
    repeated = stash(short.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("around").alias("r0"), F.max("around").alias("r1"))
                     .where("first < last").select("anchor", "first", (F.col("r0") == F.col("r1")).alias("same")))
    found = stash(short.join(repeated, "anchor").where(~F.col("same") | (F.col("doc_id") > F.col("first"))).select("doc_id", "place", "same"))
    place = F.col("place").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("at")
    tag = F.shiftright("place", 32).alias("tag")
    packed = source.mapInArrow(_pack, "doc_id long, tag long, packed binary")
    asked = found.where("not same").select("doc_id", tag, place).groupBy("doc_id", "tag").agg(F.collect_list("at").alias("places"))
    long_ = stash(packed.join(asked, ["doc_id", "tag"]).select("doc_id", "tag", "packed", "places")
                  .mapInArrow(_long_windows(size, half), "w1 long, w2 long, doc_id long, place long"))
    earliest = stash(long_.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w1", "w2", "first"))
    at = F.col("at")
    covered = found.where("same").select("doc_id", tag, place).select("doc_id", "tag", F.greatest(at + half - size, F.lit(0)).alias("start"), (at + size).alias("end")) \
        .union(long_.join(earliest, ["w1", "w2"]).where("doc_id > first").select("doc_id", tag, place).select("doc_id", "tag", "at", at + size))
    spans = covered.groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return packed.join(spans, ["doc_id", "tag"], "left").select("doc_id", "packed", "starts", "ends") \
        .mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")
