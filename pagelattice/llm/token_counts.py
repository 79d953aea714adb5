"""Token counts under a unigram model: forward scores in a trie of distinct pre-tokens, once for each shared prefix."""

from __future__ import annotations

import math
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import table, text_or_empty
from pagelattice.llm.pretokens import PIECE, PIECE_CACHE, read_bpe

#: Trie nodes a worker holds before it starts anew (about 150 MB).
MOST_NODES = 400_000


def scores_of(path: str) -> dict[bytes, float]:
    """Log probabilities by Zipf's law over the vocabulary's ranks (ids), for entries of any length; single bytes are all in.
    The model is read from a public vocabulary, not trained."""
    of, _, added = read_bpe(path)
    hidden = set(added.values())
    entries = [(i, t) for i, t in enumerate(of) if i not in hidden and t]
    total = math.log(sum(1 / (i + 1) for i, _ in entries))
    return {t: -math.log(i + 1) - total for i, t in entries}


class CountingTrie:
    """A node is a prefix of some pre-token; it holds the best score of the prefix and the fewest tokens of that score, found from
    the nodes on its path. A pre-token's count stands at its last node. Entries that end at a byte are found by walking back over
    the text in a second trie, of the reversed entries, so no start is tried that no entry reaches."""

    def __init__(self, scores: dict[bytes, float], most: int = MOST_NODES):
        self.most = most
        self.back: dict[int, int] = {}
        self.scores: list[float | None] = [None]
        for entry, score in scores.items():
            at = 0
            for c in reversed(entry):
                key = at << 8 | c
                at = self.back.get(key, 0)
                if not at:
                    at = self.back[key] = len(self.scores)
                    self.scores.append(None)
            self.scores[at] = score
        self.known: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    def insert(self, raw: bytes) -> int:
        if len(self.best) >= self.most:
            self.clear()
        child, best, tokens, scores, back = self.child, self.best, self.tokens, self.scores, self.back.get
        path, at, end = [0], 0, 0
        for c in raw:
            end += 1
            key = at << 8 | c
            at = child.get(key)
            if at is None:
                top, fewest = -math.inf, 0
                entry, start = 0, end
                while start:
                    start -= 1
                    entry = back(entry << 8 | raw[start])
                    if entry is None:
                        break
                    score = scores[entry]
                    if score is not None:
                        from_ = path[start]
                        total, count = best[from_] + score, tokens[from_] + 1
                        if total > top or total == top and count < fewest:
                            top, fewest = total, count
                at = child[key] = len(best)
                best.append(top)
                tokens.append(fewest)
            path.append(at)
        return tokens[at]

    def count(self, pieces: list[str]) -> int:
        known, total = self.known, 0
        for p in pieces:
            n = known.get(p)
            if n is None:
                if len(known) >= PIECE_CACHE:
                    known.clear()
                n = known[p] = self.insert(p.encode())
            total += n
        return total


@lru_cache(2)
def trie_of(path: str) -> CountingTrie:
    return CountingTrie(scores_of(path))


def _count(path: str):
    def run(batches):
        trie = trie_of(path)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                pieces = PIECE.findall(text)
                rows.append((len(pieces), trie.count(pieces)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]],
                                             names=["doc_id", "n_pretokens", "n_tokens"])
    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_pretokens, n_tokens``: per text the pre-tokens and the tokens of their best
    segmentations (highest sum of scores, then fewest tokens).

    Texts stay where they are read; a task holds a bounded trie and starts a new one when it is full, which changes no count.
    Null and empty texts count 0; null ids are passed on, repeated rows counted each, other columns ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .mapInArrow(_count(path), "doc_id long, n_pretokens long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
