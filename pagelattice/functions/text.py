"""String expressions for names, paths and dialogue text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEP = "\x01"


def natural_key(path: Column) -> Column:
    """Sort key: digit runs by value (length of the number, then its digits), text lower-cased."""
    runs = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    key = lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(number(x)).cast("string"), 5, "0"), number(x))).otherwise(F.lower(x))
    return F.array_join(F.transform(runs, key), SEP)


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# Scripts written without blanks between words, and joining marks.
CJK = r"一-鿿㐀-䶿豈-﫿぀-ゟ゠-ヿ가-힯ᄀ-ᇿ㄰-㆏\x{20000}-\x{2A6DF}"
JOINERS = r"\-—・"


def compose(lines: Column) -> Column:
    """Join an array of lines: blank lines skipped, no space between CJK characters or after a
    hyphen, dash or middle dot, otherwise one space."""
    parts = F.filter(F.transform(lines, strip), lambda x: x != "")

    # Only the characters on both sides of a seam decide, so each part is looked at once.
    def glued(x, before):
        last, first = F.right(before, F.lit(1)), F.substring(x, 1, 1)
        tight = (before == "") | last.rlike(f"[{JOINERS}]") | (last.rlike(f"[{CJK}]") & first.rlike(f"[{CJK}]"))
        return F.when(tight, x).otherwise(F.concat(F.lit(" "), x))

    return F.array_join(F.zip_with(parts, F.concat(F.array(F.lit("")), parts), glued), "")


def join_tight(lines: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), "")


# Repeated letters, stylised marks and full-width punctuation of source text.
REPEATS = r"([\p{IsHiragana}\p{IsKatakana}a-zA-Zー])\1{2,}"
STYLISED = r"(\S)([♡♥〜～♪])"
FULL_WIDTH = [("！", "!"), ("？", "?"), ("…", "..."), ("‥", ".."), ("～", "〜"), ("　", " ")]


def fold_punctuation(text: Column) -> Column:
    for wide, plain in FULL_WIDTH:
        text = F.replace(text, F.lit(wide), F.lit(plain))
    return text


def normalize_source(text: Column) -> Column:
    s = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    s = F.regexp_replace(s, REPEATS, "$1$1")
    s = F.regexp_replace(s, STYLISED, "$1 $2")
    return strip(fold_punctuation(s))


# Letters whose one-letter capital isn't what upper-casing a whole text gives (SS, or a letter and an iota).
_IOTA = [c for first in (0x1F80, 0x1F90, 0x1FA0) for c in range(first, first + 8)]
SMALL = "ß" + "".join(map(chr, _IOTA)) + "\u1fb3\u1fc3\u1ff3"
CAPITAL = "\u1e9e" + "".join(chr(c + 8) for c in _IOTA) + "\u1fbc\u1fcc\u1ffc"


def capital(letter: Column) -> Column:
    """The capital of one letter, always one letter; unchanged where there is none."""
    whole = F.upper(letter)
    return F.when(F.length(whole) <= 1, whole).otherwise(F.translate(letter, SMALL, CAPITAL))


def clean_target(text: Column) -> Column:
    """Capital first letter, no blank before punctuation, single blanks. Blank text is left alone."""
    s = F.concat(capital(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
    s = F.regexp_replace(s, r"\s+([!?,.:;])", "$1")
    return F.when(strip(text) == "", text).otherwise(strip(F.regexp_replace(s, r"\s+", " ")))


def title_from_path(path: Column) -> Column:
    """Second path segment (or the only one) without tag and generic chapter name."""
    parts = F.split(path, "/")
    segment = F.when(F.size(parts) >= 2, F.get(parts, 1)).otherwise(F.get(parts, 0))
    for noise in ("[Anthology]", "Chapter.cbz"):
        segment = F.replace(segment, F.lit(noise), F.lit(""))
    return strip(segment)


def safe_name(name: Column, limit: int = 180, default: str = "Translated Manga") -> Column:
    edge = lambda s: F.regexp_replace(s, r"^[ .\-]+|[ .\-]+$", "")
    s = F.replace(name, F.lit('"'), F.lit("'"))
    s = edge(F.regexp_replace(F.regexp_replace(s, r"[/\\:*?<>|]", "-"), r"\s+", " "))
    s = F.when(F.length(s) > limit, edge(F.substring(s, 1, limit))).otherwise(s)
    return F.when(strip(s) == "", F.lit(default)).otherwise(s)


CHAPTER = r"(?i)(?:Chapter|Ch\.?)\s*(\d+)"


def chapter_name(path: Column) -> Column:
    """Output file name: the file's own name when it holds a chapter number, for a generically
    named file the number or name of its folder, else the file's name."""
    file_name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    folder = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    number = F.regexp_extract(folder, CHAPTER, 1)
    generic = F.lower(file_name).isin("chapter", "chapter.cbz")
    named = F.when((strip(folder) != "") & (F.lower(folder) != "downloads"), folder).otherwise("Chapter")
    stem = F.when(~file_name.rlike(CHAPTER) & generic,
                  F.when(number != "", F.concat(F.lit("Chapter "), number)).otherwise(named)).otherwise(file_name)
    return F.concat(stem, F.lit(" Translated.cbz"))


def chapter_key(name: Column) -> Column:
    return F.regexp_extract(name, r"^(c\d+)_p\d+", 1)


def page_key(name: Column) -> Column:
    return F.regexp_extract(name, r"^c\d+_(p\d+)", 1)


def crop_key(file_name: Column) -> Column:
    """First three ``_`` parts of a file name without extension."""
    return F.substring_index(F.regexp_replace(file_name, r"\.[^.]*$", ""), "_", 3)
