"""Fingerprints of texts with very many paragraphs, and the paragraphs they recover."""

import random
import time
from collections import Counter

from pagelattice.llm import fingerprints


def test_changed_paragraphs_against_brute_force(spark):
    rnd = random.Random(12)
    pool = [f"line {i}" for i in range(40)] + ["x" * 700, "é😀", " "]
    rows = []
    for i in range(120):
        a = [rnd.choice(pool) for _ in range(rnd.randrange(0, 60))]
        b = list(a)
        for _ in range(rnd.choice([0, 1, 3, 40])):
            b.insert(rnd.randrange(len(b) + 1), rnd.choice(pool)) if rnd.random() < 0.6 or not b else b.pop(rnd.randrange(len(b)))
        rows.append((i, "\n".join(a), "\n".join(b)))
    rows += [(200, None, "a\nb"), (201, "", None), (202, "same", "same")]

    def parts(text):
        return Counter(line[i:i + 256] for line in (text or "").split("\n") for i in range(0, len(line), 256))

    want = sorted((i, side, p) for i, a, b in rows for side, x, y in ((1, a, b), (-1, b, a)) for p in (parts(x) - parts(y)).elements())
    got = fingerprints.changed_paragraphs(spark.createDataFrame(rows, "id long, text string, other string")).collect()
    assert sorted((r.id, r.side, r.paragraph) for r in got) == want


def test_a_hundred_thousand_lines(spark):
    lines = [f"line {i % 60_000}" for i in range(100_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[::-1])), (3, "\n".join(lines[:-1000] + [f"new {i}" for i in range(1000)])), (4, "a\n" * 100_000)]
    start = time.time()
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - start < 60
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0
    assert got[2].near_next == (200_000 - 2000) / (200_000 + 2000) and got[3].near_next == 0.0
