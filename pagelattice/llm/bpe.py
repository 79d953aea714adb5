"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import forgetting, table, text_or_empty
from pagelattice.llm.pretokens import PIECE, PIECE_CACHE, Units, added_pattern, read_bpe

LAST = 1 << 60


class SuffixAutomaton:
    """All substrings of a vocabulary. ``step`` follows a text byte by byte and knows its longest suffix that is a substring;
    the tokens that end there are on the chain of suffix links, longest first."""

    def __init__(self, words: list[bytes]):
        size, link, step = [0], [-1], [{}]

        def extend(last: int, c: int) -> int:
            known = step[last].get(c)
            if known is not None and size[known] == size[last] + 1:
                return known
            if known is not None:
                return clone(last, c, known)
            new = len(size)
            size.append(size[last] + 1)
            link.append(0)
            step.append({})
            at = last
            while at >= 0 and c not in step[at]:
                step[at][c] = new
                at = link[at]
            if at >= 0:
                to = step[at][c]
                link[new] = to if size[to] == size[at] + 1 else clone(at, c, to)
            return new

        def clone(at: int, c: int, to: int) -> int:
            new = len(size)
            size.append(size[at] + 1)
            link.append(link[to])
            step.append(dict(step[to]))
            link[to] = new
            while at >= 0 and step[at].get(c) == to:
                step[at][c] = new
                at = link[at]
            return new

        ends = {}
        for i, word in enumerate(words):
            at = 0
            for c in word:
                at = extend(at, c)
            if word:
                ends[word] = i
        token = [-1] * len(size)
        for word, i in ends.items():  # a whole word is the longest string of its state
            at = 0
            for c in word:
                at = step[at][c]
            token[at] = i
        self.size, self.link, self.token = size, link, token
        self.next = {s << 8 | c: to for s, out in enumerate(step) for c, to in out.items()}
        self.above = [0] * len(size)  # nearest state up the links that is a token
        for s in sorted(range(1, len(size)), key=size.__getitem__):
            self.above[s] = link[s] if link[s] > 0 and token[link[s]] >= 0 else self.above[link[s]] if link[s] > 0 else 0


class PrefixBpe:
    """The last token of a prefix's encoding is unique: the one token that ends the prefix, and fits the last token of what is
    before it. So one token is stored for each prefix, and the encoding is read off backwards."""

    def __init__(self, path: str):
        self.of, merges, self.added = read_bpe(path)
        self.rank = {a << 32 | b: r for r, (a, b, _) in enumerate(merges)}
        self.made = {new: (r, a, b) for r, (a, b, new) in reversed(list(enumerate(merges)))}
        added = set(self.added.values())
        self.auto = SuffixAutomaton([b"" if i in added else t for i, t in enumerate(self.of)])
        self.cut = added_pattern(self.added) if self.added else None
        self.code = "H" if len(self.of) <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        self.fit: dict[int, bool] = {}
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self.whole: dict[int, bool] = {}
        self.units = Units(self._pieces)
        self.names = [str(i) for i in range(len(self.of))]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The outermost part of a token from its byte up to itself, each with the rank of the merge that ends it."""
        memo = self.right if side else self.left
        if token not in memo:
            out, until, at = [], LAST, token
            while True:
                out.append((at, until))
                if at not in self.made:
                    break
                until, at = self.made[at][0], self.made[at][1 + side]
            memo[token] = out[::-1]
        return memo[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` comes before the merges that complete them. Equal merges go from the left."""
        xs, ys, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while True:
            x, rx = xs[i]
            y, ry = ys[j]
            across = self.rank.get(x << 32 | y, LAST)
            if across < rx and across <= ry:
                return False
            if rx == ry == LAST:
                return True
            if rx <= ry:
                i += 1
            else:
                j += 1

    def complete(self, token: int) -> bool:
        """Whether the token's own bytes encode to it: its halves do and fit until they merge."""
        if token not in self.whole:
            if token not in self.made:
                self.whole[token] = True
            else:
                rank, a, b = self.made[token]
                self.whole[token] = self.complete(a) and self.complete(b) and self._meet(a, b, rank)
        return self.whole[token]

    def _meet(self, a: int, b: int, rank: int) -> bool:
        xs, ys, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while True:
            x, rx = xs[i]
            y, ry = ys[j]
            if rx == ry == LAST:
                return self.rank.get(x << 32 | y) == rank
            across = self.rank.get(x << 32 | y, LAST)
            if across < rx and across <= ry:
                return False
            if rx <= ry:
                i += 1
            else:
                j += 1

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        auto, fit = self.auto, self.fit
        nxt, link, size, token, above = auto.next, auto.link, auto.size, auto.token, auto.above
        last = [0] * (len(raw) + 1)
        state = length = 0
        end = 0
        for c in raw:
            end += 1
            to = nxt.get(state << 8 | c)
            while to is None:
                state = link[state]
                length = size[state]
                to = nxt.get(state << 8 | c)
            state = to
            length += 1
            at = state if token[state] >= 0 and length >= size[state] else above[state]
            while True:
                t = token[at]
                start = end - size[at]
                key = (last[start] << 32 | t) if start else ~t
                good = fit.get(key)
                if good is None:
                    if len(fit) >= 2 * PIECE_CACHE:
                        fit.clear()
                    good = fit[key] = self.complete(t) and (not start or self.fits(last[start], t))
                if good:
                    break
                at = above[at]
            last[end] = t
        out, end = [], len(raw)
        while end:
            out.append(last[end])
            end -= len(self.of[last[end]])
        return out[::-1]

    def _pieces(self, text: str) -> bytes:
        if text[1:].isalpha() and text[0] == " ":  # one piece, by far the most frequent case
            return self.pack(self.piece(text.encode()))
        return b"".join([self.units[p[1:]] if p[0] == " " and p != text and p[1:].isalpha() else self.pack(self.piece(p.encode())) for p in PIECE.findall(text)])

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        parts = self.cut.split(text) if self.cut else [text]
        out = [self.pack([self.added[p]]) if i % 2 else self.units.whole(p) for i, p in enumerate(parts)]
        return np.frombuffer(b"".join(out), self.kind)

    def decode(self, ids) -> str:
        return b"".join(map(self.of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def bpe_of(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def _encode(path: str):
    def run(batches):
        bpe = bpe_of(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start in range(0, len(texts), 500):
                part = texts[start:start + 500]
                ids = [bpe.encode(t) for t in part]
                sizes = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                exact = [bpe.decode(i.tolist()) == t for i, t in zip(ids, part, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, 500), pa.array(np.diff(sizes), pa.int64()),
                                                  pa.ListArray.from_arrays(sizes, np.concatenate(ids).astype(np.int32)), pa.array(exact, pa.bool_())],
                                                 names=["doc_id", "n_tokens", "ids", "exact"])
        bpe.units.forget()
    return forgetting(run)


def _round_trip(path: str):
    def run(batches):
        bpe = bpe_of(path)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text).tolist()
                rows.append((len(ids), hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest(),
                             hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_tokens, ids, exact`` with the vocabulary file at ``path`` (a place every executor
    has); ``exact`` says that the decoded ids are the text.

    Null and empty texts give no ids; a null doc_id is passed on; repeated rows are encoded each; other columns are ignored; no row
    gives none. A text of any length is one row, encoded in time and memory that grow with it."""
    return _source(docs).mapInArrow(_encode(path), "doc_id long, n_tokens long, ids array<int>, exact boolean")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode``, and decoded again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, so that ids need not leave the task."""
    return _source(docs).mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
