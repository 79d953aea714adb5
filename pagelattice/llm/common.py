"""Reading, intermediate tables and vectorised word hashing shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.session import cut_lineage

#: Words of this subpackage are runs of anything but the six ASCII white-space characters: what ``bytes.split()`` gives.
ODD_A = np.uint64(0x9E3779B97F4A7C15)
ODD_B = np.uint64(0xD1342543DE82EF95)
#: Distinct words a Python worker remembers before it starts anew (about 100 MB).
WORD_CACHE = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name below the folder of ``spark.checkpoint.dir``, which all executors see."""
    if spark.sparkContext.getCheckpointDir() is None:
        cut_lineage(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends, lost executors lose nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of an Arrow batch that are turned to Python objects at once.
THIN = 1000


def forget(*caches) -> None:
    """Empties a worker's caches and gives freed memory back to the system: workers go from stage to stage, and what they keep would
    add up beside an executor's heap."""
    for cache in caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def forgetting(run, *caches):
    """A task's function over thin slices of its batches, which forgets when it ends."""
    def wrapped(batches):
        try:
            yield from run(b.slice(i, THIN) for b in batches for i in range(0, b.num_rows, THIN))
        finally:
            forget(*caches)
    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * ODD_B
    x = x ^ (x >> np.uint64(29))
    x = x * ODD_A
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` values, built from runs of 1, 2, 4, ... by doubling."""
    if len(h) < k:
        return h[:0]
    total, done, power, size = None, 0, h, 1
    bits = k
    while True:
        if bits & 1:
            if total is None:
                total = power
            else:
                n = len(h) - done - size + 1
                total = total[:n] * _power(size) + power[done:done + n]
            done += size
        bits >>= 1
        if not bits:
            return mix(total[:len(h) - k + 1])
        power = power[:len(power) - size] * _power(size) + power[size:]
        size *= 2


def _power(size: int) -> np.uint64:
    return np.uint64(pow(int(ODD_A), size, 1 << 64))


def prefix_sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With these, ``span_hash`` gives the hash of any span in constant time."""
    n = len(h)
    up = np.ones(n + 1, np.uint64)
    up[1:] = ODD_A
    down = np.ones(n + 1, np.uint64)
    down[1:] = np.uint64(pow(int(ODD_A), -1, 1 << 64))
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:-1], dtype=np.uint64, out=total[1:])
    return total, down


def span_hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, down = sums
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over each window of ``width`` values, in log(width) steps."""
    size = 1
    while size * 2 <= width:
        x = best(x[:len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return best(x[:len(x) - rest], x[rest:]) if rest else x


def slices(columns: list[list], weights: list[int], most: int) -> Iterator[list[list]]:
    """Consecutive rows of some columns, so that the weights of a part sum to ``most`` or it is one row."""
    start, total = 0, 0
    for i, w in enumerate(weights):
        if i > start and total + w > most:
            yield [c[start:i] for c in columns]
            start, total = i, 0
        total += w
    if start < len(weights):
        yield [c[start:] for c in columns]


def buckets_for(n: int, rows: int, most: int) -> int:
    return int(min(most, max(1, math.ceil(n / rows))))
