"""Identifiers and fingerprints that depend on content alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_for_hash

__all__ = ["case_id", "doc_id", "fingerprint", "is_id", "quote_id", "text_hash", "text_hash_norm"]


def _short(key: Column) -> Column:
    """22 base64url characters of the first half of a SHA-256."""
    raw = F.base64(F.unhex(F.substring(F.sha2(key, 256), 1, 32)))
    return F.rtrim(F.translate(raw, "+/", "-_"), F.lit("="))


def _filled(*cs: Column) -> Column:
    ok = F.lit(True)
    for c in cs:
        ok = ok & F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    return ok


def doc_id(uri: Column, retrieved_at: Column, court: Column | None = None) -> Column:
    """doc_ and a hash of the uri without fragment, the time and the court; null without a uri."""
    key = F.concat_ws("|", F.lit("doc"), F.regexp_replace(uri, r"#.*$", ""), F.coalesce(retrieved_at, F.lit("")), F.coalesce(court if court is not None else F.lit(""), F.lit("")))
    return F.when(_filled(uri), F.concat(F.lit("doc_"), _short(key)))


def quote_id(doc: Column, start: Column, end: Column, text_norm: Column) -> Column:
    """q_ and a hash of document, span and text; null for empty parts or an impossible span."""
    key = F.concat_ws("|", F.lit("quote"), doc, start.cast("string"), end.cast("string"), F.trim(text_norm))
    return F.when(_filled(doc, text_norm) & (start >= 0) & (end >= start), F.concat(F.lit("q_"), _short(key)))


def case_id(court: Column, docket: Column) -> Column:
    """case_ and a hash of court and docket number; null where one is empty."""
    key = F.concat_ws("|", F.lit("case"), F.lower(F.trim(court)), F.trim(docket))
    return F.when(_filled(court, docket), F.concat(F.lit("case_"), _short(key)))


def is_id(c: Column, kind: str) -> Column:
    """Whether a value has the form of an id of ``kind`` (doc, q or case)."""
    return F.coalesce(c.rlike(rf"^{kind}_[A-Za-z0-9_-]{{22}}$"), F.lit(False))


def text_hash(c: Column) -> Column:
    return F.md5(c)


def text_hash_norm(c: Column) -> Column:
    return F.md5(normalize_for_hash(c))


def fingerprint(*parts: Column, text: Column) -> Column:
    """A merge key of several fields, the length of a text and its SHA-1."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.length(text).cast("string"), F.sha1(text))
