"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import WORDS, forgetting, grams, mix, slices, stash, table, text_or_empty
from pagelattice.llm.components import components

#: A prime, so that x -> first + step * x runs through all slots and any two slots are as in a random permutation.
SLOTS = 211
#: 42 bands of 5: a pair of similarity 0.8 meets in no band with probability (1 - 0.8^5)^42 = 6e-8.
ROWS, BANDS = 5, 42
#: Shingles worked on at once within a task.
CHUNK = 600_000
#: Representatives of one part of a bucket; a task compares two parts by their signatures.
PART = 256
#: Cells of the counts by hash that bound an intersection from above; a set with a full cell isn't bounded by them.
CELLS, FULL = 512, 255
#: Standard deviations of a signature's estimate below the wanted similarity at which a pair is still verified.
SIGMAS = 4.0


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, a text without words none."""
    h = WORDS.of(text.encode().lower().split())  # bytes.lower() changes A-Z alone
    if not len(h):
        return h
    return np.unique(grams(h, min(width, len(h))) + np.uint64(min(width, len(h))))


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` values for each non-empty set.

    Every element visits the slots in an order of its own; in round j it offers j plus a fraction to its j-th slot, and a
    slot keeps the least offer. So ranks of an element are distinct over the slots, which lowers the variance against
    independent hashes. A set whose slots are all filled after round j is done: later offers are larger.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets)
    slot = (mix(items ^ np.uint64(0xA5A5)) % np.uint64(slots)).astype(np.int64)
    step = (mix(items + np.uint64(0x5A5A)) % np.uint64(slots - 1)).astype(np.int64) + 1
    out = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    for j in range(slots):
        offer = (mix(items + np.uint64(j * 0x632BE59BD9B4E019 & (2**64 - 1))) >> np.uint64(16)) | np.uint64(j << 48)
        np.minimum.at(out, owner * slots + slot, offer)
        open_ = (out.reshape(len(sets), slots) == np.iinfo(np.uint64).max).any(1)
        if not open_.any():
            break
        keep = open_[owner]
        owner, items, step = owner[keep], items[keep], step[keep]
        slot = (slot[keep] + step) % slots
    return out.reshape(len(sets), slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature[:, :ROWS * BANDS].reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def cell_counts(items: np.ndarray) -> np.ndarray:
    """How many elements of a set fall in each cell; two sets share at most the sum of the lesser counts."""
    return np.minimum(np.bincount((items % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), FULL).astype(np.uint8)


def _most_alike(x: np.ndarray, y: np.ndarray, nx: int, ny: np.ndarray) -> np.ndarray:
    """The most elements that ``x`` and each row of ``y`` can share by their cell counts."""
    full = (x.max(initial=0) == FULL) | (y.max(1, initial=0) == FULL)
    return np.where(full, np.minimum(nx, ny), np.minimum(x, y).sum(1, dtype=np.int64))


def _may_be_alike(x: np.ndarray, y: np.ndarray, nx: int, ny: np.ndarray, percent: int) -> np.ndarray:
    """False only where the cell counts prove that ``x`` and a row of ``y`` are less alike."""
    most = _most_alike(x, y, nx, ny)
    return 100 * most >= percent * (nx + ny - most)


def _describe(width: int):
    def run(batches):
        for batch in batches:
            ids, marks_of, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))
            for part_ids, part_keys, part in slices([ids, marks_of, texts], [len(t) // 6 for t in texts], CHUNK):
                sets = [shingle_set(t, width) for t in part]
                full = [s for s in sets if len(s)]
                marks = signatures(full) if full else np.zeros((0, SLOTS), np.uint64)
                keys = iter(band_keys(marks).view(np.int64))
                zero = np.zeros(0, np.int64)
                bands = [next(keys) if len(s) else zero for s in sets]
                short = iter((mix(marks) & np.uint64(255)).astype(np.uint8))
                short = [next(short).tobytes() + cell_counts(s).tobytes() if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays([
                    pa.array(part_ids, pa.int64()), pa.array(part_keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                    pa.array([int(mix(s ^ np.uint64(0xC3C3C3C3)).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(np.cumsum([0, *map(len, bands)]).astype(np.int32), pa.array(np.concatenate(bands))),
                    pa.array(short, pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "s1", "s2", "bands", "short"])
    return forgetting(run, WORDS)


def _sets(width: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, width).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "items"])
    return forgetting(run, WORDS)


def _alike(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return forgetting(run)


def _plausible(percent: int, best: bool):
    """Two parts of a bucket: pairs from different components whose sizes, signatures and cell counts allow the wanted similarity, each in
    the first band that both share. With ``best``, the likeliest pair of each component in sight, with that component."""
    j = percent / 100
    least = (j - SIGMAS * (j * (1 - j) / SLOTS) ** 0.5) * SLOTS

    def run(t: pa.Table) -> pa.Table:
        key, first, second = (t.column(c)[0].as_py() for c in ("key", "i", "j"))
        part, rep, n, c = (t.column(x).to_numpy() for x in ("part", "rep", "n", "c"))
        bands = np.array(t.column("bands").to_pylist(), np.int64)
        short = np.frombuffer(b"".join(t.column("short").to_pylist()), np.uint8).reshape(t.num_rows, SLOTS + CELLS)
        short, cells = short[:, :SLOTS], short[:, SLOTS:]
        a, b = np.flatnonzero(part == first), np.flatnonzero(part == second)
        out = []
        for x in a:
            y = b[(c[b] != c[x]) & (100 * n[b] >= percent * n[x]) & (100 * n[x] >= percent * n[b])]
            if first == second:
                y = y[rep[y] > rep[x]]
            if not len(y):
                continue
            shared = bands[y] == bands[x]
            same = (short[y] == short[x]).sum(1)
            keep = np.flatnonzero((bands[x][shared.argmax(1)] == key) & shared.any(1) & (same >= least))
            keep = keep[_may_be_alike(cells[x], cells[y[keep]], n[x], n[y[keep]], percent)]
            if len(keep):
                most = _most_alike(cells[x], cells[y[keep]], n[x], n[y[keep]])
                likely = np.minimum(same[keep] / SLOTS, most / (n[x] + n[y[keep]] - most))
                out.append((np.full(len(keep), rep[x]), rep[y[keep]], likely))
        left, right, same = (np.concatenate(o) for o in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        if best:  # one pair for each component in sight but the most frequent one
            owner = dict(zip(rep.tolist(), c.tolist(), strict=True))
            names, sizes = np.unique(c, return_counts=True)
            main, done, at, of = names[sizes.argmax()], set(), [], []
            for k in np.argsort(-same, kind="stable"):
                for end in {owner[int(left[k])], owner[int(right[k])]} - {main} - done:
                    done.add(end)
                    at.append(k)
                    of.append(end)
            return pa.table({"c": pa.array(of, pa.int64()), "a": left[at], "b": right[at], "same": same[at].astype(np.float64)})
        return pa.table({"a": left, "b": right})
    return run


def judged(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per row of it: ``doc_id, text_key, n_shingles, component_id, kept``; text_key is the
    text's xxhash64.

    Two documents are linked when their shingle sets share at least ``percent`` of their union, decided on the full sets.
    Documents with equal sets become one representative before anything else, so thousands of copies are one entry. In each
    bucket of a band, representatives are verified against a leader, and components form. Buckets that still hold several
    components are cut into parts by hash, and tasks compare signatures of two parts: first each component's
    likeliest pair with another is verified, then, with the components that gives, every pair across components whose
    signatures agree within four standard deviations of the wanted similarity and whose counts of elements by hash cell don't
    prove them less alike. So a pair that shares a bucket is verified
    unless its ends are already connected or its signatures rule it out (three in 100,000 at the very threshold).

    Null and word-less texts have no shingles, link with nothing and are kept. Rows that share a doc_id are each judged by
    their own text, under that id. A null doc_id has a null component and is kept. Other columns are ignored; no row gives none.
    A text of any length has all its shingles, its set in one task.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    described = stash(source.withColumn("text_key", F.xxhash64("text")).mapInArrow(_describe(width), "doc_id long, text_key long, n_shingles long, s1 long, s2 long, bands array<long>, short binary"))
    full = described.where("n_shingles > 0 and doc_id is not null")
    equal = stash(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")))
    single = full.join(equal.select("s1", "s2", F.col("rep").alias("doc_id")), ["s1", "s2", "doc_id"]) \
        .select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    crowded = stash(single.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("key", "leader"))
    live = stash(single.join(crowded, "key"))
    wanted = live.select(F.col("rep").alias("doc_id")).distinct()
    items = stash(source.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "id long, items binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        sized = pairs.where(F.col("a") != F.col("b")).distinct()
        return sized.join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a") \
            .join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").mapInArrow(_alike(percent), "a long, b long")

    links = stash(verified(live.select(F.col("leader").alias("a"), F.col("rep").alias("b"))))
    marks = stash(full.select(F.col("doc_id").alias("rep"), "s1", "s2", "bands", "short").join(equal, ["rep", "s1", "s2"]).select("rep", "bands", "short")
                  .join(wanted.withColumnRenamed("doc_id", "rep"), "rep"))
    for best in (True, False):
        groups = components(links)
        placed = stash(live.select("key", "rep", "n").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
                       .select("key", "rep", "n", F.coalesce("component", "rep").alias("c")))
        split = stash(placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
                      .where("c0 < c1").select("key", "parts"))
        rest = placed.join(split, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).join(marks, "rep") \
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
            .select("key", "rep", "n", "c", "bands", "short", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        parts = rest.groupBy("key", "i", "j")
        if best:
            seen = parts.applyInArrow(_plausible(percent, True), "c long, a long, b long, same double")
            pairs = seen.groupBy("c").agg(F.max(F.struct("same", "a", "b")).alias("p")).select("p.a", "p.b")
        else:
            pairs = parts.applyInArrow(_plausible(percent, False), "a long, b long")
        links = stash(links.union(verified(pairs)))
    named = components(links).withColumnRenamed("node", "rep")
    named = stash(equal.join(named, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return described.select("doc_id", "text_key", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left").select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per row of it: ``doc_id, n_shingles, component_id, kept``; see ``judged``."""
    return judged(docs, width, percent).drop("text_key")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but for those whose text is near one kept; columns unchanged, whatever their names.

    A row is judged by its own id and text: where one id has several texts, only the repeated ones go. Of rows equal in
    id and text, one stays if the text has words. Rows without words or without id all stay."""
    found = stash(judged(docs, width, percent).where("doc_id is not null and n_shingles > 0")
                  .groupBy("doc_id", "text_key").agg(F.min("kept").alias("kept"), F.count("*").alias("times")).where("not kept or times > 1"))
    mine = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_key"))
    rest = mine.join(found, ["doc_id", "text_key"], "left_anti").select("row.*")
    again = mine.join(found.where("kept"), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]).select("row.*")
    return rest.unionByName(again)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
