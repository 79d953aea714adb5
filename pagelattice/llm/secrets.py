"""Secret scans over a trigram inverted index, in DataFrame operations alone."""

from __future__ import annotations

import re._constants as sre
import re._parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import fresh, stash, table, text_or_empty

#: More alternatives of one literal run than this are not multiplied out further.
MOST_ALTERNATIVES = 8


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a regular expression that Python and Java read alike; matches whose ``group`` has under ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: What follows a private key's first line: all up to its END line if no other marker is between, or without one its header lines,
#: runs of 16 and more base64 digits between white space, quotation marks and escapes, and one shorter run that ends them.
#: Repeats are possessive, so that neither language goes deeper into its stack with a longer body.
PEM_GAP, PEM_DIGIT = r"""(?:[\s"'`>|#*,;.]|\\++[nrt]?|[+](?=\s))""", r"(?:[A-Za-z0-9+/=]|\\++/)"
PEM_BODY = rf"""(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----|(?:{PEM_GAP}*+(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,-]++)*+(?:(?:{PEM_GAP}*+{PEM_DIGIT}{{16,}}+)++(?:{PEM_GAP}++{PEM_DIGIT}++)?+)?+)"""

#: The three base kinds in their order, then the kinds that this method adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + PEM_BODY),
    Rule("hub", r"gh[opsu]_[A-Za-z0-9]{30,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def _exact(node) -> list[str] | None:
    """The few strings that a parsed node can match, or None."""
    op, value = node
    if op is sre.LITERAL:
        return [chr(value)]
    if op is sre.IN and all(o is sre.LITERAL for o, _ in value) and len(value) <= 5:
        return [chr(v) for _, v in value]
    if op is sre.SUBPATTERN:
        return _exact_all(value[3])
    if op is sre.BRANCH:
        parts = [_exact_all(p) for p in value[1]]
        return None if None in parts else sorted({s for p in parts for s in p})
    if op is sre.MAX_REPEAT and value[:2] == (0, 1):
        inner = _exact_all(value[2])
        return None if inner is None else ["", *inner]
    if op is sre.MAX_REPEAT and value[0] == value[1] <= 5:
        inner = _exact_all(value[2])
        return [s * value[0] for s in inner] if inner and len(inner) == 1 else None
    return None


def _exact_all(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        part = _exact(node)
        if part is None:
            return None
        out = [a + b for a in out for b in part]
    return out


def _and(x: set[frozenset], y: set[frozenset]) -> set[frozenset]:
    return _least({a | b for a in x for b in y})


def _least(x: set[frozenset]) -> set[frozenset]:
    return {a for a in x if not any(b < a for b in x)}


def trigram_query(pattern: str) -> set[frozenset]:
    """What every match must contain, as alternatives (or) of trigram sets (and), in lower case. ``{frozenset()}`` asks for nothing."""

    def of(nodes) -> set[frozenset]:
        asked, run = {frozenset()}, [""]

        def flush():
            nonlocal asked, run
            asked = _and(asked, _least({frozenset(s.lower()[i:i + 3] for i in range(len(s) - 2)) for s in run}))
            run = [""]

        for node in nodes:
            part = _exact(node)
            if part is not None:
                if len(run) * len(part) > MOST_ALTERNATIVES:
                    flush()
                if len(part) <= MOST_ALTERNATIVES:
                    run = [a + b for a in run for b in part]
                continue
            flush()
            op, value = node
            if op is sre.SUBPATTERN:
                asked = _and(asked, of(value[3]))
            elif op is sre.BRANCH:
                asked = _and(asked, _least({q for p in value[1] for q in of(p)}))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                asked = _and(asked, of(value[2]))
        flush()
        return asked

    return of(re._parser.parse(pattern))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Places of a rule's matches in code points: lengths of the pieces between them and of the matches themselves, summed up."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    gaps = F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.arrays_zip(hits.alias("hit"), judged.alias("judged")), gaps,
                       lambda m, gap: F.struct(F.char_length(gap).alias("gap"), F.char_length(m["hit"]).alias("size"), F.char_length(m["judged"]).alias("judged")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc, s):
        start = acc["at"] + s["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + s["size"]).alias("end"))
        keep = F.when(s["judged"] >= rule.least, F.array(span)).otherwise(none)
        return F.struct((start + s["size"]).alias("at"), F.concat(acc["spans"], keep).alias("spans"))

    found = F.aggregate(F.filter(steps, lambda s: s["size"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def _written(spans: Column, rules) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "found") -> DataFrame:
    """``docs`` -> its columns and ``into``: an array of (start, kind, end) in code points, end exclusive, by start and then rule.

    A posting (trigram, document) is made for each trigram that a rule asks for; postings are intersected per document by
    the rules' Boolean queries; only candidates of a rule are verified with its expression. Rules without a mandatory
    trigram are verified on every text. Documents are keyed by a hash of id and text: were two keys equal, both would only
    be verified for more rules. Null texts count as empty, texts of any length are scanned whole, equal rows each. A column of the
    name ``into`` is replaced, columns of other names stay. No row gives none.
    """
    if len(rules) > 62:
        raise ValueError("a scan takes 62 rules; give more in several scans")
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for alternative in q for g in alternative})
    docs = docs.drop(into)
    key, rules_of = fresh("_secret_key", docs.columns), fresh("_secret_rules", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    asks_nothing = [frozenset() in q for q in queries]
    always = sum(1 << i for i, free in enumerate(asks_nothing) if free)
    if grams:
        low = F.lower(F.col("text"))
        present = F.filter(F.transform(F.array(*[F.lit(g) for g in grams]), lambda g: F.when(F.contains(F.col("low"), g), g)), lambda g: g.isNotNull())
        postings = keyed.select(key, low.alias("low")).select(F.explode(present).alias("gram"), key)
        words = [grams[i:i + 63] for i in range(0, len(grams), 63)]  # bits of one long each
        bits = [F.create_map(*[x for i, g in enumerate(word) for x in (F.lit(g), F.lit(1 << i).cast("long"))]) for word in words]
        held = postings.groupBy(key).agg(*[F.coalesce(F.bit_or(bit[F.col("gram")]), F.lit(0)).cast("long").alias(f"held{i}") for i, bit in enumerate(bits)])

        def holds_all(alternative) -> Column:
            out = F.lit(True)
            for i, word in enumerate(words):
                mask = F.lit(sum(1 << word.index(g) for g in alternative if g in word)).cast("long")
                out = out & (F.col(f"held{i}").bitwiseAND(mask) == mask)
            return out

        wanted = F.lit(0).cast("long")
        for i, alternatives in enumerate(queries):
            if not asks_nothing[i]:
                holds = F.lit(False)
                for alternative in sorted(alternatives, key=sorted):
                    holds = holds | holds_all(alternative)
                wanted = wanted.bitwiseOR(F.when(holds, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        candidates = stash(held.select(key, wanted.alias(rules_of)).where(F.col(rules_of) > 0))
        keyed = keyed.join(candidates, key, "left")
    else:
        keyed = keyed.withColumn(rules_of, F.lit(None).cast("long"))
    asked = F.coalesce(F.col(rules_of), F.lit(0)).bitwiseOR(F.lit(always))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = F.array_sort(F.concat(*[F.when(asked.bitwiseAND(F.lit(1 << i)) > 0, _spans(text_or_empty(), r, i)).otherwise(none) for i, r in enumerate(rules)]))
    return keyed.withColumn(into, found).drop(key, rules_of)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask`` (overlapping spans by one); ``n_chars`` follows where it is there.
    Null texts stay null, texts without a secret unchanged, columns of any name as they are. Rows are neither lost nor added."""

    def step(acc, s):
        new = s["start"] >= acc["at"]
        text = F.when(new, F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), text.alias("out"))

    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    cut = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                      lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    out = secret_spans(rows, rules, "found").select("row", F.size("found").alias("n"), F.when(F.size("found") > 0, cut).otherwise(F.col("text")).alias("new"))

    def value(c: str) -> Column:
        old = F.col("row")[c]
        if c.lower() == "text":
            return F.col("new").alias(c)
        if c.lower() == "n_chars":
            return F.when(F.col("n") > 0, F.char_length("new").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return out.select(*[value(c) for c in docs.columns])


def _is(value: int):
    return lambda x: x == value


def scan_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, a count for each base kind, a digest of the base spans and all spans as text, one row per row of ``docs``."""
    base = [i for i, r in enumerate(rules) if r.base]
    found = secret_spans(docs.select("doc_id", "text"), rules).select("doc_id", "found")
    counts = [F.size(F.filter(F.col("found.kind"), _is(i))).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    kept = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(_written(kept, rules), 256).alias("base_sha256"), _written(F.col("found"), rules).alias("spans"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_report(table(spark, sf_dir, "documents"))
