"""Document fingerprints as invertible Bloom lookup sketches over paragraph digests, in DataFrame operations alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelattice.llm.common import buckets_for, table, text_or_empty

#: A paragraph is a line, or each part of so many code points of a longer line.
PARAGRAPH = 256
#: Cells of a sub-table, of the fingerprint and of the retries; each digest falls into one cell of each of three sub-tables.
FIRST, RETRIES = 4, (16, 32, 128)
#: Paragraphs of both versions in one block of a retry, on average.
BLOCK = 16
#: Rows of one bucket of consecutive ids, and the most buckets (each then is a spillable window group).
BUCKET_ROWS, MOST_BUCKETS = 512, 65_536


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _starts(items: Column, by=lambda x: x) -> Column:
    """Where the runs of equal ``by(item)`` begin in a sorted array, from 0."""
    first = F.transform(items, lambda x, i: F.when((i == 0) | (by(x) != by(F.get(items, i - 1))), i))
    return F.filter(first, lambda i: i.isNotNull())


def _each_run(items: Column, starts: Column, body) -> Column:
    """``body(start, length)`` of each run, as an array."""
    return F.transform(starts, lambda a, k: body(a, F.coalesce(F.get(starts, k + 1), F.size(items)) - a))


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{PARAGRAPH}}}"), F.lit(0))


def digests(text: Column) -> Column:
    """64-bit digests of the paragraphs; the i-th copy of a paragraph has a digest of its own, so equal multisets and no others agree.
    Sorting apart, the work grows with the number of paragraphs: copies stand in runs, and are counted run by run."""
    return let(F.array_sort(F.transform(paragraphs(text), lambda p: F.xxhash64(p))), lambda s: let(_starts(s), lambda st: F.zip_with(
        s, F.flatten(_each_run(s, st, lambda a, n: F.sequence(F.lit(0), n - 1))), lambda h, nth: F.xxhash64(h, nth))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _entry(key: Column, side: int, width: int) -> Column:
    """A digest with its cell numbers; they come from one hash, of which each retry takes another."""
    h = F.xxhash64(key, F.lit(width))
    at = [(F.shiftrightunsigned(h, 20 * t).bitwiseAND(F.lit(width - 1)) + F.lit(t * width)).cast("int") for t in range(3)]
    return F.struct(key.alias("key"), _check(key).alias("chk"), F.lit(side).alias("n"), F.array(*at).alias("at"))


def _added(cell: Column, entries: Column, place: Column, sign: int) -> Column:
    """The cell with all entries that fall into it."""
    mine = F.filter(entries, lambda e: F.array_contains(e["at"], place))
    return F.aggregate(mine, cell, lambda c, e: F.struct((c["n"] + F.lit(sign) * e["n"]).cast("int").alias("n"),
                                                        c["key"].bitwiseXOR(e["key"]).alias("key"), c["chk"].bitwiseXOR(e["chk"]).alias("chk")))


def _empty() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("chk"))


def sketch(keys: Column, width: int = FIRST) -> Column:
    """Three times ``width`` cells of count, xor of keys and xor of check sums."""
    return let(F.transform(keys, lambda k: _entry(k, 1, width)),
               lambda entries: F.transform(F.sequence(F.lit(0), F.lit(3 * width - 1)), lambda j: _added(_empty(), entries, j, 1)))


def subtract(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: F.struct((a["n"] - b["n"]).cast("int").alias("n"), a["key"].bitwiseXOR(b["key"]).alias("key"), a["chk"].bitwiseXOR(b["chk"]).alias("chk")))


ENTRIES = "array<struct<key:bigint,side:int>>"


def peel(cells: Column, width: int) -> Column:
    """The digests that only one side has, as (key, side) with side 1 or -1, or null if a cell stays mixed. A cell of count 1 or -1
    whose check sum fits holds a single digest; it is taken out of its three cells, which may leave others single."""

    def turn(state, _):
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == _check(c["key"])))
        found = F.array_distinct(F.transform(single, lambda c: F.struct(c["key"].alias("key"), c["n"].alias("side"))))
        entries = F.transform(found, lambda f: F.struct(f["key"].alias("key"), _check(f["key"]).alias("chk"), f["side"].alias("n"), _entry(f["key"], 1, width)["at"].alias("at")))
        return F.when(F.exists(state["cells"], lambda c: F.abs(c["n"]) == 1), let(entries, lambda e: F.struct(
            F.transform(state["cells"], lambda c, j: _added(c, e, j, -1)).alias("cells"),
            F.concat(state["found"], F.transform(e, lambda x: F.struct(x["key"].alias("key"), x["n"].alias("side")))).cast(ENTRIES).alias("found")))).otherwise(state)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(8 if width < 64 else 16)), F.struct(cells.alias("cells"), F.array().cast(ENTRIES).alias("found")), turn)
    return let(end, lambda e: F.when(~F.exists(e["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["chk"] != 0)), e["found"]))


def _retried(x: Column, y: Column) -> Column:
    """The same for two digest sets dealt to blocks by digest: larger sketches until one peels, at last (never seen in tests of the
    sketch sizes) by the digests themselves. Blocks are runs of one sorted list, so the work grows with the number of digests."""
    blocks = F.greatest(F.lit(1), F.ceil((F.size(x) + F.size(y)) / F.lit(BLOCK)).cast("int"))

    def tagged(keys, side):
        return F.transform(keys, lambda k: F.struct(F.pmod(k, blocks).alias("b"), k.alias("key"), F.lit(side).alias("side")))

    def tried(p):
        exact = F.concat(*[F.transform(F.array_except(p[a], p[b]), lambda k, s=side: F.struct(k.alias("key"), F.lit(s).alias("side"))) for a, b, side in (("x", "y", 1), ("y", "x", -1))])
        return F.coalesce(*[peel(subtract(sketch(p["x"], w), sketch(p["y"], w)), w) for w in RETRIES], exact.cast(ENTRIES))

    def block(items):
        def mine(side):
            return F.transform(F.filter(items, lambda e: e["side"] == side), lambda e: e["key"])
        return let(F.struct(mine(1).alias("x"), mine(-1).alias("y")), tried)

    return let(F.array_sort(F.concat(tagged(x, 1), tagged(y, -1))), lambda m: let(_starts(m, lambda e: e["b"]), lambda st: F.flatten(
        _each_run(m, st, lambda a, n: let(F.slice(m, a + 1, n), block)))))


def differing(x: Column, y: Column, x_cells: Column, y_cells: Column) -> Column:
    """(key, side) of each digest that only ``x`` (side 1) or only ``y`` (side -1) has, recovered from the sketches' difference."""
    return F.coalesce(peel(subtract(x_cells, y_cells), FIRST), _retried(x, y))


def likeness(x: Column, y: Column, x_cells: Column, y_cells: Column) -> Column:
    """Shared digests over all digests (1 for two texts without paragraphs), by the difference that the sketches give."""
    both = F.size(x) + F.size(y)
    return F.when(both == 0, F.lit(1.0)).otherwise(let(F.size(differing(x, y, x_cells, y_cells)), lambda d: (both - d).cast("double") / (both + d).cast("double")))


def written(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"].cast("long")), F.lower(F.hex(c["key"])), F.lower(F.hex(c["chk"])))), "/")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` of the row that follows by ``doc_id`` (the first row after the last one).

    Ids are cut into buckets of consecutive ids by quantiles; the first rows of a bucket are also dealt to the bucket
    before, so every row meets its follower there. The driver gets at most 65,536 ids. Null ids come first; rows of equal
    id follow each other by text.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    n, low = docs.select(key.alias("k")).agg(F.count("*"), F.min("k")).first()
    count = buckets_for(n, BUCKET_ROWS, MOST_BUCKETS)
    bounds: list[int] = []
    if count > 1:
        shares = [i / count for i in range(1, count)]
        cut = docs.select(key.alias("k")).agg(F.percentile_approx("k", shares, max(10_000, 20 * count))).first()[0]
        bounds = sorted({b for b in cut if b > low})
    side = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i:i + side] for i in range(0, len(bounds), side)] or [[]]
    heads = F.split(F.lit(",".join(str(p[0]) for p in parts[1:])), ",").cast("array<bigint>") if len(parts) > 1 else F.array().cast("array<bigint>")
    lists = F.transform(F.split(F.lit(";".join(",".join(map(str, p)) for p in parts)), ";"), lambda p: F.split(p, ",").cast("array<bigint>")) if bounds \
        else F.array(F.array().cast("array<bigint>"))
    part = F.size(F.filter(heads, lambda b: b <= F.col("_k")))
    within = F.size(F.filter(F.col("_list"), lambda b: b <= F.col("_k")))
    bucket = (F.col("_part") * side + within).cast("int")
    placed = docs.withColumn("_k", key).withColumn("_part", part).withColumn("_list", F.element_at(lists, F.col("_part") + 1)).withColumn("_b", bucket)
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("halo"), F.lit(False).alias("wrap"))
    halo = [own, F.when(F.array_contains("_list", F.col("_k")), F.struct((F.col("_b") - 1).alias("b"), F.lit(True).alias("halo"), F.lit(False).alias("wrap"))),
            F.when(F.col("_k") == F.lit(low if low is not None else 0), F.struct(F.lit(len(bounds)).alias("b"), F.lit(True).alias("halo"), F.lit(True).alias("wrap")))]
    dealt = placed.withColumn("_at", F.explode(F.filter(F.array(*halo), lambda h: h.isNotNull()))).select(*docs.columns, "_k", F.col("_at.b").alias("_b"), "_at.halo", "_at.wrap")
    order = Window.partitionBy("_b").orderBy("wrap", "_k", "text")
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("not halo").drop("_k", "_b", "halo", "wrap")


def changed_paragraphs(pairs: DataFrame) -> DataFrame:
    """``pairs(id, text, other)`` -> ``id, side, paragraph``: the paragraphs that only ``text`` (side 1) or only ``other`` (side -1) has, as
    often as it has more of them, found by their recovered digests. Null texts count as empty; ids name pairs, so no two
    rows may share one."""
    rows = pairs.select("id", text_or_empty("text").alias("text"), text_or_empty("other").alias("other"))
    keyed = rows.select("id", "text", "other", digests(F.col("text")).alias("x"), digests(F.col("other")).alias("y"))
    keyed = keyed.select("*", sketch(F.col("x")).alias("xc"), sketch(F.col("y")).alias("yc"))
    found = keyed.select("id", F.explode(differing(F.col("x"), F.col("y"), F.col("xc"), F.col("yc"))).alias("d")).select("id", "d.side", "d.key")

    def listed(column: str, side: int) -> DataFrame:
        """Each distinct paragraph with its copies' digests."""
        counts = rows.select("id", F.explode(paragraphs(F.col(column))).alias("paragraph")).groupBy("id", "paragraph").agg(F.count("*").cast("int").alias("n"))
        return counts.select("id", F.lit(side).alias("side"), "paragraph", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.xxhash64(F.xxhash64("paragraph"), i))).alias("key"))

    return found.join(listed("text", 1).unionByName(listed("other", -1)), ["id", "side", "key"]).select("id", "side", "paragraph")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has the last quarter (whole code points, rounded down) replaced by as many from the start of the next
    document by id, or all it has. A fingerprint is a sketch of twelve cells of count, key xor and check xor over the
    paragraph digests; equal texts have equal ones. Two versions' sketches are subtracted and peeled; where that leaves a
    mixed cell, the paragraphs are dealt to blocks of about sixteen and larger sketches are tried; so, sorting apart, the work grows
    with the number of paragraphs, of very long texts too. Null texts count as empty; two empty texts have likeness 1. A table of one row follows
    itself. Columns besides ``doc_id`` and ``text`` are ignored.
    """
    source = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    rows = with_next(source, ["text"])
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - F.floor(F.col("n_chars") / 4).cast("int")),
                      F.substring(F.col("next_text"), F.lit(1), F.floor(F.col("n_chars") / 4).cast("int")))
    rows = rows.withColumn("n_chars", n).withColumn("edited", edited)
    rows = rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       digests(F.col("text")).alias("d"), digests(F.col("edited")).alias("e"), digests(F.col("next_text")).alias("x"))
    rows = rows.select("*", sketch(F.col("d")).alias("dc"), sketch(F.col("e")).alias("ec"), sketch(F.col("x")).alias("xc"))
    return rows.select("doc_id", "n_chars", "edited_sha256", written(F.col("dc")).alias("fingerprint"), written(F.col("ec")).alias("edited_fingerprint"),
                       likeness(F.col("d"), F.col("e"), F.col("dc"), F.col("ec")).alias("near_edited"), likeness(F.col("d"), F.col("x"), F.col("dc"), F.col("xc")).alias("near_next"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
