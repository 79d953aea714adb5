"""Spelling variants, importance resampling and main texts against brute force, with odd rows and tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelattice.llm import main_text, resampling, spelling

SCHEMA = "doc_id long, text string, word string, n string, key string, score string, rank string, part string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in rows], SCHEMA)


# ---- spelling -------------------------------------------------------------------------------------

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling_by_hand(rows, least=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}
    form, close = {}, {}
    for w, n in words.items():
        around = [v for v in words if one_edit(w, v)]
        close[w] = len(around)
        best = min(around, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, close[w], words.get(form[w])) for w, n in words.items()}


@pytest.fixture(scope="module")
def spelled():
    rnd = random.Random(6)
    base = ["letter", "harbour", "window", "naïve", "Éclairs", "aabbaa", "aabbcc", "abcdef", "zzzzz", "×÷×÷×"]
    rows = []
    for i in range(150):
        out = []
        for _ in range(60):
            w = rnd.choice(base)
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                at, c = rnd.randrange(len(w)), rnd.choice("abz é"[:4])
                w = rnd.choice([w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]])
            out.append(w.upper() if rnd.random() < 0.1 else w)
        rows.append((i, " ".join(out)))
    rows += [(200, None), (201, ""), (202, " \n1234 "), (203, rows[0][1]), (203, rows[0][1]), (None, rows[1][1])]
    long_word = "".join(rnd.choice("abcde") for _ in range(300))
    for k, w in enumerate([long_word, long_word[:120] + long_word[121:], long_word[:200] + "x" + long_word[201:], "q" * 63, "q" * 64, "q" * 65, "q" * 66]):
        rows.append((300 + k, " ".join([w] * (3 + 4 * (k % 3)))))
    return rows


def test_spelling_variants(spark, spelled):
    got = spelling.spelling_variants(table_of(spark, spelled))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == spelling_by_hand(spelled)
    assert any(r[1] and r[2] != r[1] for r in rows) and any(len(r[0]) > 100 and r[4] for r in rows)


def test_neighbour_pairs(spark, spelled):
    words = spelling.words_of(table_of(spark, spelled)).cache()
    listed = {r.word: r.n for r in words.collect()}
    got = [tuple(r) for r in spelling.neighbours(words).collect()]
    want = {(a, listed[a], b, listed[b]) for a in listed for b in listed if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_word_of_two_hundred_thousand_letters(spark):
    w = "ab" * 100_000
    rows = [(i, f"{w} {w} {w}") for i in range(2)] + [(9, f"{w}c {w}c {w}c")]
    got = {len(r.word): (r.form and len(r.form), r.n_near) for r in spelling.spelling_variants(table_of(spark, rows)).collect()}
    assert got == {200_000: (None, 1), 200_001: (200_000, 1)}
    assert spelling.spelling_variants(table_of(spark, [])).collect() == []


# ---- resampling -----------------------------------------------------------------------------------

def features_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def resampling_by_hand(rows, target, percent):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features_by_hand(text)[1])
    for text in target:
        t.update(features_by_hand(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        n, buckets = features_by_hand(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        out.append([i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_importance_resampling(spark, monkeypatch):
    rnd = random.Random(2)
    words = ["Alpha", "beta", "x1", "naïve", "日本", "don't", "a_b", "END.", "the", "of", "~`"]
    rows = [(i, rnd.choice(["  ", "\n", ""]) + " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 80)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " ,.\x00\t"), (203, rows[3][1]), (204, "w" * 70_000), (205, "é " * 30_000), (3, rows[3][1]), (None, rows[40][1])]
    target = [" ".join(rnd.choice(words[:4]) for _ in range(40)) for _ in range(10)] + [None, ""]
    monkeypatch.setattr(resampling, "RANGE_ROWS", 7)
    docs = table_of(spark, rows)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for percent in (5, 40):
        got = resampling.importance_resampled(docs, bench, percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == resampling_by_hand(rows, target, percent)
    assert resampling.importance_resampled(docs.limit(0), bench).collect() == []
    alone = resampling.importance_resampled(docs, bench.limit(0), 40)
    assert sorted((tuple(r) for r in alone.collect()), key=repr) == resampling_by_hand(rows, [], 40)


def test_checksums_of_spans_from_two_prefixes():
    rnd = random.Random(8)
    texts = [[bytes(rnd.choice(b"ab1\xc3\xa9z") for _ in range(rnd.choice([1, 2, 7, 300, 70_000]))) for _ in range(n)] for n in (0, 1, 2, 3, 9, 0)]
    for k, (h, owner) in enumerate(resampling.feature_hashes(texts), 1):
        want = [(zlib.crc32(b" ".join(t[i:i + k])), j) for j, t in enumerate(texts) for i in range(len(t) - k + 1)]
        assert list(zip(h.tolist(), owner.tolist(), strict=True)) == want


# ---- main text ------------------------------------------------------------------------------------

SAID = ["First, a paragraph of some length, with commas, that says a thing or two.", "Short.", "Another one, &amp; long enough &lt;to&gt; count, with <b>bold</b> and <a href='x'>a link</a> in it.", "End of it."]
PLAIN = ["First, a paragraph of some length, with commas, that says a thing or two.", "Short.", "Another one, & long enough <to> count, with bold and a link in it.", "End of it."]
NOISE = """<header class=top><h1>Site</h1><p>A slogan, of some length, with commas, for all.</p></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them, for you, and us, and others, always.</p></div>"""
AFTER = """<aside><p>Aside, from all that, here is more, and more, and more of it.</p></aside><div id="sidebar"><p>Side, by, side, text that is long enough to count.</p></div>
<form><p>Write to us, please, with your name, and address, and all.</p><input name=q><button>Send</button></form><div class="ad banner">Buy this, now, today, and tomorrow.</div>
<section id="comments"><h3>3 Comments</h3><p>Great, really, truly, a great article, thank you, so much.</p><p>I agree, with all of that, and more.</p></section><script>var a="<p>no, no, no</p>";</script><style>p{}</style><footer>Footer, all rights, reserved.</footer>"""


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div id=x><div>", "</div></div>")])
def test_the_article_alone_is_kept(around):
    body = "".join(f"<p>{p}\n" for p in SAID)
    page = f"<html><head><title>T</title></head><body>{NOISE}{around[0]}<h1>Title</h1>{body}{around[1]}{AFTER}</body></html>"
    assert main_text.main_text(page) == "\n\n".join(["Title", *PLAIN])


def test_blocks_white_space_and_references():
    page = "<article><p> a\t\n b&nbsp;c<br>d &#65;&eacute;&bogus; <ul><li>one<li>two <ol><li>in</ol></ul><table><tr><td>x<td>y</table><pre>p\n  q</pre><!-- no --></article>"
    assert main_text.main_text(page).split("\n\n") == ["a b c d Aé&bogus;", "one", "two", "in", "x", "y", "p q"]
    for odd, text in ((None, ""), ("", ""), ("<html></html>", ""), ("plain & 1 < 2", "plain & 1 < 2"), ("<p>cut <b>off", "cut off"), ("<p>cut <a hr", "cut"), ("<nav>menu</nav>", ""),
                      ("<body><form><p>All of the page, in a form.</p></form>", "All of the page, in a form."), ("<p hidden>x</p><p style='display:none'>y</p><p>z", "z")):
        assert main_text.main_text(odd) == text, odd


def test_main_texts_of_a_table(spark):
    page = f"<body>{NOISE}<article>{''.join(f'<p>{p}</p>' for p in SAID)}</article>{AFTER}"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<div>" * 3000 + "deep"), (4, "x", "<article>" + "<p>word, and more</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame([(i, u, h, "t", "n") for i, u, h in rows], "page_id long, url string, html string, text string, n_chars string")
    got = sorted((tuple(r) for r in main_text.main_texts(pages).collect()), key=repr)
    long_text = "\n\n".join(["word, and more"] * 20_000)
    want = ["\n\n".join(PLAIN)] * 2 + ["", "", "deep", long_text]
    assert got == sorted(((i, u, t, len(t)) for (i, u, _), t in zip(rows, want, strict=True)), key=repr)
    assert main_text.main_texts(pages.limit(0)).collect() == []


def test_pages_of_the_tables_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    inside = F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1)
    bare = F.regexp_replace(inside, "<[^>]*>|&[a-z]+;|&|\\s", "")
    found = main_text.main_texts(pages).join(pages.select("page_id", bare.alias("bare")), "page_id")
    odd = found.where(F.regexp_replace("text", "[&\"\\s]", "") != F.regexp_replace("bare", "[&\"]", ""))
    assert found.count() > 0 and odd.where(~F.col("bare").contains(";")).count() == 0


def test_hostile_pages_take_little_time():
    import time
    start = time.process_time()
    for s in ("<div>", "<i></i></i><b>", "<p><b>", "<ul><li><p>a", "<td>", "<a href=1>x</a> ", '<a b="', "<!--", "<h2>a</h2>", "&"):
        main_text.main_text(s * (200_000 // len(s)))
    assert time.process_time() - start < 60
