"""Text scalars as Column expressions: cleaning, hashing forms, tokens, offsets, case ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

__all__ = [
    "case_circuit", "case_court", "case_state", "case_year", "case_year_month", "clean", "flesch", "match_starts", "money_text",
    "nfkc", "normalize_for_hash", "phrase_count", "section_headers", "slug", "strip_urls", "syllables", "token_at", "tokens", "urls", "words",
]


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Unicode NFKC; only texts beyond ASCII pay for the Python call. Null stays null."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.pandas_udf(_nfkc, StringType())(c)).otherwise(c)


# Typographic characters and what they become.
_PLAIN = (("“”„", '"'), ("‘’‚", "'"), ("–—―", "-"), (" ", " "), ("­", ""))


def _plain_marks(c: Column) -> Column:
    for chars, to in _PLAIN:
        c = F.regexp_replace(c, f"[{chars}]", to)
    return c


def clean(c: Column) -> Column:
    """Cleaned text (T1): page marks, boilerplate lines, citations and stray numbers go, paragraphs stay.

    Null stays null, a text of blanks becomes empty.
    """
    c = F.regexp_replace(c, r"(?md)^\s*Page \d+ of \d+\s*$", "")
    c = F.regexp_replace(c, r"(?md)^(?:Id\.|EPIC – CDD Complaint|Federal Trade Commission).*\n", "")
    c = F.regexp_replace(c, r"\s*\[\d+\]", "")
    c = _plain_marks(nfkc(c))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"(?md)^\s*\d+\s*$", "")
    c = F.regexp_replace(c, r"-\n", "")
    c = F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " ")
    c = F.regexp_replace(c, r"(?md)^[ \t]+", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(?md)[ \t]+$", "")
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.regexp_replace(c, r" {2,}", " ")


def normalize_for_hash(c: Column) -> Column:
    """The form under which texts are compared by hash (T4); null counts as empty."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)^\s+|\s+$", "")
    c = F.translate(c, "“”‘’–—", "\"\"''--")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"[.,;:!?]+$", "")


def tokens(c: Column) -> Column:
    """Tokens between white space (T5); an empty array for empty texts."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def words(c: Column) -> Column:
    """Lower-case words in the Unicode sense."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))


def token_at(c: Column, pos: Column) -> Column:
    """Number of tokens that start before the character offset ``pos``."""
    return F.regexp_count(F.substring(c, F.lit(1), pos), F.lit(r"\S+"))


def phrase_count(c: Column, phrase: str) -> Column:
    """Occurrences of a whole phrase, letter case ignored."""
    return F.regexp_count(F.lower(c), F.lit(rf"(?U)(?<!\w)\Q{phrase.lower()}\E(?!\w)"))


def syllables(word: Column) -> Column:
    """Vowel groups of a word, less a silent final e, at least one."""
    n = F.regexp_count(word, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), n - F.when(word.endswith("e"), 1).otherwise(0))


def flesch(c: Column) -> Column:
    """Flesch reading ease; null without words."""
    w = words(c)
    n = F.size(w)
    s = F.greatest(F.lit(1), F.size(F.filter(F.split(c, r"[.!?]+"), lambda x: F.trim(x) != "")))
    syl = F.aggregate(w, F.lit(0), lambda a, x: a + syllables(x))
    return F.when(n > 0, 206.835 - 1.015 * (n / s) - 84.6 * (syl / n))


def slug(c: Column) -> Column:
    """A name that is safe in file systems."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def case_court(c: Column) -> Column:
    """The part of a case id after its last underscore; null where there is none."""
    return F.when(c.contains("_"), F.element_at(F.split(c, "_"), -1))


def case_circuit(c: Column) -> Column:
    return F.regexp_replace(case_court(c), "[^a-z]", "")


def case_state(c: Column) -> Column:
    return F.upper(F.substring(case_court(c), 1, 2))


def case_year(c: Column, default: int = 2020) -> Column:
    """The filing year in a case id (T13): appellate form, then district form, then any four digits."""
    app = F.nullif(F.regexp_extract(c, r"^(\d{2})-\d+_ca\d+$", 1), F.lit("")).cast("int")
    dist = F.nullif(F.regexp_extract(c, r"\d+:(\d+)-", 1), F.lit("")).cast("int")
    four = F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit("")).cast("int")
    return F.coalesce(
        F.when(app <= 30, 2000 + app).otherwise(1900 + app),
        F.when(dist > 90, 1900 + dist).otherwise(2000 + dist),
        F.when(four.between(1950, 2030), four),
        F.lit(default),
    )


def case_year_month(c: Column) -> Column:
    """(year, month) named in a case id, else its year with June."""
    y = F.nullif(F.regexp_extract(c, r"(\d{4})[_-](\d{1,2})", 1), F.lit("")).cast("int")
    m = F.nullif(F.regexp_extract(c, r"(\d{4})[_-](\d{1,2})", 2), F.lit("")).cast("int")
    good = y.between(2000, 2025) & m.between(1, 12)
    return F.struct(F.when(good, y).otherwise(case_year(c)).alias("year"), F.when(good, m).otherwise(F.lit(6)).alias("month"))


def section_headers(c: Column) -> Column:
    """Distinct lines in capitals that look like headings; UNKNOWN where there is none."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?md)^(?:[IVX]+\.|\d+\.)?\s*([A-Z][A-Z ]{4,60})$"), F.lit(1)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("UNKNOWN")))


def urls(c: Column) -> Column:
    """All links of a text."""
    return F.regexp_extract_all(c, F.lit(r"https?://\S+"), F.lit(0))


def strip_urls(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"https?://\S+", ""))


def money_text(c: Column) -> Column:
    """Dollars with separators."""
    return F.concat(F.lit("$"), F.format_number(c, 2))


def match_starts(c: Column, pattern: str) -> Column:
    """Character offsets (from 0) of all matches of a pattern that cannot match the empty string."""
    parts = F.transform(F.split(c, pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.length)
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + x)
    return F.transform(hits, lambda _, i: total(parts, i + 1) + total(hits, i))
