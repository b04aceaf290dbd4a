"""Row contracts: the columns of each model and the checks its rows must pass (1.3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["MODELS", "Contract", "validate"]


@dataclass(frozen=True)
class Contract:
    """Required columns with their types, SQL checks by name, and whether other columns are allowed."""

    columns: dict[str, str]
    checks: dict[str, str]
    strict: bool = False


def _filled(*cols: str) -> dict[str, str]:
    return {f"{c} is empty": f"length(trim({c})) > 0" for c in cols}


# The models, their enums and limits.
MODELS = {
    "span": Contract({"start": "int", "end": "int"}, {"start is negative": "start >= 0", "end before start": "end >= start"}, True),
    "doc": Contract({"doc_id": "string", "source_uri": "string", "retrieved_at": "timestamp", "raw_text": "string"}, _filled("doc_id", "raw_text"), True),
    "quote": Contract({"doc_id": "string", "text": "string"}, _filled("doc_id", "text")),
    "quote_row": Contract({"doc_id": "string", "stage": "int", "text": "string"}, _filled("doc_id", "text")),
    "response": Contract(
        {"http_status": "int", "sha256": "string"},
        {"sha256 malformed": "sha256 rlike '^[a-f0-9]{64}$'", "status out of range": "http_status IS NULL OR http_status BETWEEN 100 AND 599"},
        True,
    ),
    "outcome": Contract(
        {"case_id": "string", "label": "string", "label_source": "string"},
        {**_filled("case_id"), "label missing": "label IS NOT NULL", "source missing": "label_source IS NOT NULL"},
        True,
    ),
    "prediction": Contract(
        {"quote_id": "string", "case_id": "string", "proba": "double"},
        {"proba out of range": "proba BETWEEN 0 AND 1", "no id": "coalesce(quote_id, case_id) IS NOT NULL"},
    ),
    "case_prediction": Contract({"case_id": "string", "proba": "double"}, {**_filled("case_id"), "proba out of range": "proba BETWEEN 0 AND 1"}),
    "quote_features": Contract({"quote_id": "string", "vector": "array<double>"}, {**_filled("quote_id"), "vector is empty": "size(vector) > 0"}),
    "case_vector": Contract({"case_id": "string"}, _filled("case_id")),
}


def errors(df: DataFrame, contract: Contract) -> Column:
    """The names of the checks that a row fails; a check that is null fails."""
    have = set(df.columns)
    found = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in contract.checks.items()]
    if contract.strict:
        found += [F.when(F.col(f"`{c}`").isNotNull(), F.lit(f"extra field {c}")) for c in sorted(have - set(contract.columns))]
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def validate(df: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their ``errors``) of a model.

    Missing columns come in as nulls and present ones are softly cast. Strict models reject rows
    with a value in any other column; the others carry such columns along.
    """
    contract = MODELS[model]
    have = set(df.columns)
    for c, t in contract.columns.items():
        df = df.withColumn(c, F.expr(f"try_cast(`{c}` AS {t})") if c in have else F.lit(None).cast(t))
    checked = df.withColumn("errors", errors(df, contract))
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
