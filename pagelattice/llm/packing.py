"""Token ids in bit-packed files with block offsets: written by range partition, read back at random."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagelattice.llm.common import shared_folder, slices, stash, table, text_or_empty
from pagelattice.llm.pretokens import PIECE, PIECE_CACHE, SPACE, added_pattern, units_of

MAGIC = b"PLTOK001"
#: Characters of the texts whose new units are asked for at once.
SLICE = 400_000
#: Units that a worker knows before it starts anew with those it used since (about 140 MB, twice that with them).
KNOWN_UNITS = 700_000
#: Signs that end many units; and the end of the letters whose units are cut before them.
SIGNS, LATIN_END = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "\u0250"
ODD = re.compile(r"\s")
#: Ids in a block; a whole number of bytes at any width.
BLOCK = 1 << 15
WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}


def width_of(vocabulary: int) -> int:
    """The least number of bits that holds every id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, ``bits`` bits each, lowest bit first; the last byte is filled with zeros."""
    if bits in WHOLE:
        return ids.astype(WHOLE[bits]).tobytes()  # the same bytes
    places = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(places.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in WHOLE:
        return np.frombuffer(data, WHOLE[bits], count).astype(np.uint32)
    places = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    weights = (np.uint32(1) << np.arange(bits, dtype=np.uint32))
    return (places * weights).sum(axis=1, dtype=np.uint32)


class LibraryEncoder:
    """The tokenizers library, asked once for all the units of blank and word that a slice of texts has and a worker doesn't know yet.

    New units go to the library as the lines of one text. A line end is a piece and a token of its own between them, so it tells where
    each unit's ids end."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.cut = added_pattern(self.added) if self.added else None
        self.kind = np.dtype("<u2" if width_of(self.tokenizer.get_vocab_size()) <= 16 else "<u4")
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}  # ids of what follows a blank, the blank included
        self.before: dict[str, bytes] = {}
        self.alone: dict[str, bytes] = {}  # ids of pieces without a blank before them

    def ask(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def ask_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each of some texts without white space but for a blank at the start."""
        if not texts:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(texts)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(ids == self.line_end[0]).tolist() if len(self.line_end) == 1 else []
        if len(ends) != len(texts) - 1:  # another kind of tokenizer
            return [self.ask(t) for t in texts]
        data, size = ids.tobytes(), self.kind.itemsize
        return [data[a * size:b * size] for a, b in zip([0, *[e + 1 for e in ends]], [*ends, len(ids)], strict=True)]

    def _learn(self, firsts: set[str], units: set[str]) -> None:
        """Makes ``alone`` know the pieces of texts' beginnings and ``known`` all units."""
        if len(self.known) > KNOWN_UNITS:  # frequent units stay for another round
            self.known, self.before = {}, self.known
        if len(self.alone) > PIECE_CACHE:
            self.alone = {}
        new, apart, tailed, single = set(), {}, [], set()
        known, before = self.known, self.before
        for unit in units:
            if unit in known:
                continue
            if unit in before:
                known[unit] = before[unit]
                continue
            core = unit.rstrip(SIGNS)
            if core.isalpha() and core[-1] < LATIN_END:  # letters are a piece, and signs after them another
                if len(core) < len(unit):
                    tailed.append((unit, core))
                    single.add(unit[len(core):])
                    if core in known:
                        continue
                    if core in before:
                        known[core] = before[core]
                        continue
                new.add(core)
            elif not unit or ODD.search(unit):
                apart[unit] = PIECE.findall(" " + unit)
            else:
                new.add(unit)
        single = {sign for sign in single if sign not in self.alone}
        pieces = {p for f in firsts for p in PIECE.findall(f)}
        for parts in apart.values():
            pieces.update(parts)
        for p in pieces:
            if p[0] == " " and p != " " and not SPACE.search(p, 1):
                if p[1:] not in self.known:
                    new.add(p[1:])
            elif p not in self.alone:
                if SPACE.search(p):
                    self.alone[p] = self.ask(p)
                else:
                    single.add(p)
        listed, lone = list(new), list(single)
        got = self.ask_all([" " + u for u in listed] + lone)
        self.known.update(zip(listed, got, strict=False))
        self.alone.update(zip(lone, got[len(listed):], strict=True))
        for unit, core in tailed:
            self.known[unit] = self.known[core] + self.alone[unit[len(core):]]
        for unit, parts in apart.items():
            self.known[unit] = self._joined(parts)

    def _joined(self, pieces: list[str]) -> bytes:
        return b"".join([self.alone[p] if p in self.alone else self.known[p[1:]] for p in pieces])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of ``kind``."""
        cut, firsts, units = [], set(), set()
        for text in texts:
            parts = self.cut.split(text) if self.cut else [text]
            split = [units_of(p) if i % 2 == 0 else p for i, p in enumerate(parts)]
            cut.append(split)
            for part in split[::2]:
                firsts.add(part[0])
                units.update(part[1:])
        self._learn(firsts, units)
        of = self.known.__getitem__
        out = []
        for split in cut:
            done = [np.array([self.added[p]], self.kind).tobytes() if i % 2 else self._joined(PIECE.findall(p[0])) + b"".join(map(of, p[1:])) for i, p in enumerate(split)]
            out.append(done[0] if len(done) == 1 else b"".join(done))
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0], self.kind)


@lru_cache(2)
def encoder_of(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class TokenFile:
    """Header (magic, bits, number of ids, of documents, of blocks), block offsets, documents (id, null flag, first id), then blocks."""

    HEAD = struct.Struct("<8sIQQQ")

    def __init__(self, source):
        self.source = source
        magic, self.bits, self.ids, self.docs, blocks = self.HEAD.unpack(source.read_at(self.HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = self.HEAD.size
        self.offsets = np.frombuffer(source.read_at(8 * (blocks + 1), at), "<u8")
        at += 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(source.read_at(8 * self.docs, at), "<i8")
        at += 8 * self.docs
        self.nulls = np.frombuffer(source.read_at(self.docs, at), np.uint8)
        at += self.docs
        self.starts = np.frombuffer(source.read_at(8 * (self.docs + 1), at), "<u8")
        self.base = at + 8 * (self.docs + 1)

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to ``end``, read from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (end - 1) // BLOCK
        lo, hi = int(self.offsets[first]), int(self.offsets[last + 1])
        count = min(self.ids, (last + 1) * BLOCK) - first * BLOCK
        got = unpack(self.source.read_at(hi - lo, self.base + lo), count, self.bits)
        return got[start - first * BLOCK:end - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.starts[i]), int(self.starts[i + 1]))

    @staticmethod
    def write(store, path: str, bits: int, doc_ids: list, lengths: list[int], ids: list[bytes]) -> None:
        """Written beside its place and then moved there, so a repeated task leaves one whole file."""
        starts = np.zeros(len(lengths) + 1, "<u8")
        np.cumsum(lengths, out=starts[1:])
        total = int(starts[-1])
        all_ids = np.frombuffer(b"".join(ids), "<u2" if bits <= 16 else "<u4")
        blocks = [pack(all_ids[i:i + BLOCK], bits) for i in range(0, total, BLOCK)]
        offsets = np.zeros(len(blocks) + 1, "<u8")
        np.cumsum([len(b) for b in blocks], out=offsets[1:])
        task = TaskContext.get()
        beside = f"{path}.{task.taskAttemptId() if task else 0}"
        with store.open_output_stream(beside) as out:
            out.write(TokenFile.HEAD.pack(MAGIC, bits, total, len(lengths), len(blocks)))
            out.write(offsets.tobytes())
            out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
            out.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
            out.write(starts.tobytes())
            for b in blocks:
                out.write(b)
        store.move(beside, path)


def store_of(uri: str):
    """The file system of a folder's URI and the folder's path on it."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _write(path: str, end_id: int, folder: str, most: int):
    def run(batches):
        encoder = encoder_of(path)
        bits = width_of(max(encoder.tokenizer.get_vocab_size(), end_id + 1))
        small = np.dtype("<u2" if bits <= 16 else "<u4")
        end = np.array([end_id], small).tobytes()
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids, held = [], [], [], 0

        def flush():
            nonlocal doc_ids, lengths, ids, held, number
            name = f"part-{part:08d}-{number:06d}.tok"
            TokenFile.write(store, f"{root}/{name}", bits, doc_ids, lengths, ids)
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held], pa.int64())], names=["file", "ids"])
            doc_ids, lengths, ids, held, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            rows = [batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()]
            for docs, texts in slices(rows, [len(t) for t in rows[1]], SLICE):
                for doc, got in zip(docs, encoder.encode_all(texts), strict=True):
                    if encoder.kind != small:
                        got = np.frombuffer(got, encoder.kind).astype(small).tobytes()
                    doc_ids.append(doc)
                    ids.append(got + end)
                    lengths.append(len(ids[-1]) // small.itemsize)
                    held += lengths[-1]
                    if held >= most:
                        yield flush()
        if doc_ids:
            yield flush()
    return run


def _read(folder: str):
    def run(batches):
        store, root = store_of(folder)
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as source:
                    f = TokenFile(source)
                    crc, at, i = [], 0, 0
                    while i < f.docs:  # a run of documents at a time, each block unpacked about once
                        j = max(i + 1, int(np.searchsorted(f.starts, f.starts[i] + 32 * BLOCK, "right")) - 1)
                        run_ids, first = f.range(int(f.starts[i]), int(f.starts[j])).astype("<u4"), int(f.starts[i])
                        crc += [zlib.crc32(run_ids[int(f.starts[k]) - first:int(f.starts[k + 1]) - first].tobytes()) for k in range(i, j)]
                        i = j
                    starts = f.starts.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(f.doc_ids, mask=f.nulls.astype(bool)), pa.array(starts[:-1] + before), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str, most: int = 4_000_000) -> DataFrame:
    """Encodes ``docs(doc_id, text, ...)`` with the vocabulary file at ``path`` and writes token files to ``folder``.

    Rows are dealt by ranges of doc_id and sorted, so file names in order hold documents in ascending doc_id (null ids
    first, equal ids in either order). ``end_id`` follows every document; null texts are that id alone. A task closes a
    file at ``most`` ids, which bounds its memory (a single longer document makes a longer file). Returns ``(file, ids)``,
    already written; an empty table gives none.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return stash(ordered.mapInArrow(_write(path, end_id, folder, most), "file string, ids long"))


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone. ``start`` counts the ids of all files before.
    Running totals go over (file) rows in groups by partition number, pre-aggregated, never over documents."""
    group = F.substring_index("file", "-", 2)
    totals = files.groupBy(group.alias("g")).agg(F.sum("ids").alias("n"))
    before = totals.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("earlier"))
    within = files.select("file", group.alias("g"), (F.sum("ids").over(Window.partitionBy(group).orderBy("file")) - F.col("ids")).alias("inner"))
    placed = stash(within.join(before, "g").select("file", (F.col("earlier") + F.col("inner")).alias("before")))
    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(parts, "file").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, folder), folder)
