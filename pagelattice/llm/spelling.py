"""Spelling variants: words one edit apart, found by permuterm rotations, and the frequent form that each word leads to."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import mix, prefix_sums, slices, span_hash, stash, table, text_or_empty

#: Words and characters that a task counts before it hands them on.
HELD_WORDS, HELD_CHARS = 300_000, 30_000_000
#: Code points of the longest rotation that is a key as it stands; longer ones are keyed by two hashes and verified.
LONGEST_KEY = 64
SHORTEST = 5
#: Runs of letters that can be a word: shorter ones are never words, and a deletion only shortens.
RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % SHORTEST)


def counted_runs(doc_id: int | None, text: str) -> dict[str, int]:
    """Runs of letters of a text, in lower case (A-Z alone), each as it is counted for this document."""
    out: Counter[str] = Counter()
    start = zlib.crc32(f"{doc_id}:".encode()) if doc_id is not None else None
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
        if start is not None and (h := zlib.crc32(run.encode(), start)) % 97 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < SHORTEST:
                continue
        out[run] += n
    return out


def _counts(batches):
    held: dict[str, int] = {}
    chars = 0

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for word, n in counted_runs(doc_id, text).items():
                if word in held:
                    held[word] += n
                else:
                    held[word] = n
                    chars += len(word)
            if len(held) >= HELD_WORDS or chars >= HELD_CHARS:
                yield flush()
                chars = 0
    if held:
        yield flush()


def words_of(docs: DataFrame, least: int = 3) -> DataFrame:
    """``word, n``: the words of all texts with at least ``least`` occurrences."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """``key, word, n, whole, first``: each rotation of word + terminator by what it has in common with a neighbour's.

    A rotation that ends in the edited letter is known by the prefix without it (``whole`` false): two words that differ in that
    letter alone have the same prefix. A whole rotation (``whole`` true) equals the prefix of a word with one letter more.
    ``first`` marks the first of a run of equal letters, so a word that loses either of two equal letters is met once.
    Rotations up to ``LONGEST_KEY`` code points alone.
    """
    size = F.length("word")

    def around(i: Column, skip: int) -> Column:
        return F.concat(F.substring("word", i + skip, size), F.lit("$"), F.substring("word", F.lit(1), i - 1))

    cut = words.where(size <= LONGEST_KEY).select("word", "n", F.inline(F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(
        around(i, 1).alias("key"), F.lit(False).alias("whole"),
        ((i == 1) | (F.substring("word", i, F.lit(1)) != F.substring("word", i - 1, F.lit(1)))).alias("first")))))
    whole = words.where(size < LONGEST_KEY).select("word", "n", F.inline(F.transform(F.sequence(F.lit(1), size + 1), lambda i: F.struct(
        around(i, 0).alias("key"), F.lit(True).alias("whole"), F.lit(True).alias("first")))))
    return cut.union(whole)


def grouped(entries: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Groups of two or more entries with equal keys. Words of a group that is cut at a letter differ in that letter alone, so a group
    has at most as many entries as there are letters, and one whole rotation."""
    return entries.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("g")).where(F.size("g") > 1)


def others(e: Column, word: str) -> Column:
    """Entries of the group ``g`` that are neighbours of its entry ``e``."""
    return F.filter("g", lambda o: (o[word] != e[word]) & F.when(e["whole"], o["first"]).when(o["whole"], e["first"]).otherwise(True))


def short_neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best(m, near)`` for each group that a word has neighbours in; m is minus the neighbour's n."""
    groups = grouped(rotations(words), ["key"], ["word", "n", "whole", "first"])
    seen = groups.select(F.inline(F.transform("g", lambda e: F.struct(
        e["word"].alias("word"), F.transform(others(e, "word"), lambda o: F.struct((-o["n"]).alias("m"), o["word"].alias("near"))).alias("near")))))
    return seen.where(F.size("near") > 0).select("word", F.size("near").cast("long").alias("n_near"), F.array_min("near").alias("best"))


def _long_rotations(batches):
    """The same entries for rotations over ``LONGEST_KEY``, by hashes of two spans each: work grows with the word's length."""
    for batch in batches:
        for words, in slices([batch.column("word").to_pylist()], [len(w) for w in batch.column("word").to_pylist()], 200_000):
            for word in words:
                letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
                n, name = len(letters), hashlib.sha256(word.encode()).hexdigest()
                first = np.concatenate([[True], letters[1:] != letters[:-1]])
                sums = [prefix_sums(mix(letters + np.uint64(seed))) for seed in (0x51ED270B, 0x2545F491)]
                for whole, at in ((True, np.arange(n + 1)), (False, np.arange(n))):
                    if n + whole <= LONGEST_KEY:
                        continue
                    zero, end = np.zeros(len(at), np.int64), np.full(len(at), n)
                    keys = [mix(span_hash(s, at + (not whole), end) * np.uint64(0x9E3779B97F4A7C15) + span_hash(s, zero, at)).view(np.int64) for s in sums]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[0]), pa.array(keys[1]), pa.array([name] * len(at)), pa.array(np.full(len(at), whole)),
                        pa.array(np.full(len(at), True) if whole else first)], names=["k1", "k2", "name", "whole", "first"])


def near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from one to the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    low, high = 0, len(a)
    while low < high:  # the length of the common prefix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)):] == b[low + 1:]


def _verified(batches):
    for batch in batches:
        keep = [near(a, b) for a, b in zip(batch.column("word").to_pylist(), batch.column("near").to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def long_neighbours(words: DataFrame) -> DataFrame:
    """As ``short_neighbours``, for words with rotations over ``LONGEST_KEY``: groups hold names of words, pairs are verified."""
    long_words = words.where(F.length("word") >= LONGEST_KEY)
    groups = grouped(long_words.select("word").mapInArrow(_long_rotations, "k1 long, k2 long, name string, whole boolean, first boolean"),
                     ["k1", "k2"], ["name", "whole", "first"])
    pairs = groups.select(F.explode("g").alias("e"), "g").select(F.col("e.name").alias("a"), F.explode(F.transform(others(F.col("e"), "name"), lambda o: o["name"])).alias("b")).distinct()
    named = long_words.withColumn("name", F.sha2(F.col("word").cast("binary"), 256))
    found = pairs.join(named.select(F.col("name").alias("a"), "word"), "a").join(named.select(F.col("name").alias("b"), F.col("word").alias("near"), "n"), "b")
    sure = found.select("word", "near", "n").mapInArrow(_verified, "word string, near string, n long")
    return sure.select("word", F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("n")).alias("m"), F.col("near").alias("near")).alias("best"))


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every ordered pair of words one edit apart; a word has at most one pair for each place and letter."""
    groups = grouped(rotations(words), ["key"], ["word", "n", "whole", "first"])
    short = groups.select(F.explode("g").alias("e"), "g").select(F.col("e.word").alias("word"), F.col("e.n").alias("n"), F.explode(others(F.col("e"), "word")).alias("o")) \
        .select("word", "n", F.col("o.word").alias("near"), F.col("o.n").alias("near_n"))
    far = long_neighbours(words).select("word", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))
    return short.union(far.join(words, "word").select("word", "n", "near", "near_n"))


def followed(steps: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: forms followed to the last. Each round doubles the distance; n at least doubles
    with each step, so a chain over counts up to N has log2(N) steps and takes log2(log2(N)) rounds."""
    at = stash(steps.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = stash(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if at.where("moved").limit(1).count() == 0:
            return at.select("word", "root")
        at = at.drop("moved")


def spelling_variants(docs: DataFrame, least: int = 3) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``word, form, root, n, n_near, form_n``, one row for each word of all texts.

    Words are runs of Latin letters in lower case (A-Z alone), of five code points or more and ``least`` occurrences; where 97
    divides the crc32 of ``<doc_id>:<run>``, one letter of the run goes first. ``form`` is the most frequent word one edit away
    (ties: the smallest in code-point order) if it is at least twice as frequent, ``root`` the end of the chain of forms.

    Null texts have no words; runs of a document without id are counted as they are; rows that share an id, and equal rows,
    count each; other columns are ignored; an empty table gives none. Words of any length are compared, work and memory of a
    word growing with its length: rotations over 64 code points are keyed by hash and their pairs verified.
    """
    words = stash(words_of(docs, least))
    found = short_neighbours(words).union(long_neighbours(words)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    leads = -F.col("best.m") >= 2 * F.col("n")
    full = stash(words.join(found, "word", "left").select(
        "word", F.when(leads, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, -F.col("best.m")).alias("form_n")))
    roots = followed(full.where("form is not null"))
    return full.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
