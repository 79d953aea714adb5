"""The queries of this subpackage, each an operator applied to its whole table, and SQL of those that SQL can express."""

from __future__ import annotations

from pagelattice.llm.bpe import op7_bpe_round_trip
from pagelattice.llm.embedding_dedup import op8_embedding_near_dedup
from pagelattice.llm.fingerprints import op4_document_fingerprints
from pagelattice.llm.main_text import op13_html_extraction
from pagelattice.llm.mixing import op3_source_mixing
from pagelattice.llm.near_dedup import op5_minhash_near_dedup
from pagelattice.llm.packing import op10_token_id_output
from pagelattice.llm.quality import op1_quality_classifier
from pagelattice.llm.resampling import op12_importance_resampling
from pagelattice.llm.secrets import op9_secret_scans
from pagelattice.llm.spelling import op11_spelling_variants
from pagelattice.llm.substring_dedup import op2_substring_dedup
from pagelattice.llm.token_counts import op6_token_counts

QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_substring_dedup, op3_source_mixing, op4_document_fingerprints, op5_minhash_near_dedup,
    op6_token_counts, op7_bpe_round_trip, op8_embedding_near_dedup, op9_secret_scans, op10_token_id_output,
    op11_spelling_variants, op12_importance_resampling, op13_html_extraction)}

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^ \t\n\x0B\f\r]+')"


def _nibble_steps() -> list[int]:
    """What four zero bits do to each low nibble of a checksum, from the polynomial of crc32."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def sql_crc32(text: str) -> str:
    """DuckDB has no crc32: the checksum of a string's UTF-8 bytes, nibble by nibble."""
    nibbles = f"list_transform(range(len(hex(encode({text})))), lambda i: instr('0123456789ABCDEF', substr(hex(encode({text})), xor(i, 1) + 1, 1)) - 1)"
    step = f"lambda c, n: xor(c >> 4, ({_nibble_steps()}::BIGINT[])[(xor(c, n) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {nibbles}), {step}), 4294967295)"


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_substring_dedup": f"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS gram FROM p),
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS at FROM g JOIN f USING (gram) WHERE first < doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.at) AS kept FROM
  (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM w) e ANTI JOIN c ON c.doc_id = e.doc_id AND c.at = e.at GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op5_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT a AS id, b AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT id, least(id, min(other)) AS low FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, w.doc_id) AS component_id, w.doc_id = coalesce(low, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT a AS id, b AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT id, least(id, min(other)) AS low FROM r GROUP BY id)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, vec_id = coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN m ON id = vec_id""",
    "op11_spelling_variants": f"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
c AS (SELECT run, k, {sql_crc32("run_key")} AS h FROM (SELECT run, k, doc_id || ':' || run AS run_key FROM r WHERE length(run) >= 5)),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM c),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS BIGINT) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.less = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.less = w.word),
b AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k FROM p),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN b ON b.word = w.word AND k = 1),
t AS (SELECT word, word AS at FROM f UNION SELECT t.word, f.form FROM t JOIN f ON f.word = t.at WHERE f.form IS NOT NULL),
e AS (SELECT t.word, t.at AS root FROM t JOIN f ON f.word = t.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN e ON e.word = f.word""",
    "op12_importance_resampling": f"""
WITH w AS (SELECT doc_id, 's' AS side, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
  UNION ALL SELECT NULL, 't', regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
g AS (SELECT doc_id, side, array_to_string(words[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, side, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k))),
h AS (SELECT gram, {sql_crc32("gram")} % 10000 AS bucket FROM (SELECT DISTINCT gram FROM g)),
b AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM g JOIN h USING (gram) GROUP BY bucket),
a AS (SELECT sum(s) AS sa, sum(t) AS ta FROM b),
q AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sa + 10000) AS DOUBLE) / CAST((s + 1) * (ta + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM b, a),
f AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM g JOIN h USING (gram) JOIN q USING (bucket) WHERE side = 's' GROUP BY doc_id),
z AS (SELECT doc_id, len(words) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN f USING (doc_id) WHERE side = 's'),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM z WHERE n >= 20)
SELECT z.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= 5 * able // 100 THEN rank END AS rank
FROM z LEFT JOIN o USING (doc_id)""",
}
