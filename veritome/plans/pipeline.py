"""The stages from landed documents to a case frame as one composition of DataFrame transformations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import cases, extraction, filters, splits

__all__ = ["case_dataset", "clean_documents", "quote_table"]


def clean_documents(docs: DataFrame, doc_id: str, raw: str) -> DataFrame:
    """Cleaned texts of documents that have one (stage 1)."""
    return docs.withColumn("text", text.clean(F.col(raw))).filter(F.col(doc_id).isNotNull() & (F.length("text") > 0))


def quote_table(docs: DataFrame, doc_id: str, raw: str, aliases: DataFrame | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    """Quotes with speaker and ids (stages 2 and 3).

    Quotes are taken from the raw text, whose blank lines part paragraphs, and cleaned afterwards.
    The speaker is the name before a verb of speech, else the smallest alias of the context.
    """
    q = extraction.quotes(docs, doc_id, raw).withColumn("speaker", extraction.speaker_by_verb(F.col("context")))
    if aliases is not None:
        found = extraction.alias_speaker(q.filter("speaker IS NULL").drop("speaker"), "context", aliases, "alias")
        q = q.filter("speaker IS NOT NULL").unionByName(found)
    q = filters.drop_values(q, "speaker", exclude)
    start = extraction.locate(F.col("context"), F.col("quote"))
    norm = text.normalize_for_hash(F.col("quote"))
    q = q.withColumn("quote_id", ids.quote_id(F.col("doc_id"), start, start + F.length("quote"), norm))
    return q.withColumn("text_hash_norm", F.md5(norm))


def case_dataset(quotes: DataFrame, case: str, record: str, year: str, outcome: str, folds: int = 3) -> DataFrame:
    """Cases with their first year, outcome, outcome class and the roles they play in each fold."""
    frame = cases.case_frame(quotes.filter(F.col(case).isNotNull()), case, record, year, outcome)
    frame = cases.quantile_label(frame, "outcome")
    return splits.rolling_folds(frame, case, "case_year", folds).join(frame, case)
