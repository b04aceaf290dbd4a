"""Row contracts: accepted and rejected rows."""

import pytest

from veritome.contracts import validate


@pytest.mark.parametrize(
    "model, schema, row, good",
    [
        ("span", "start int, end int", (10, 20), True),
        ("span", "start int, end int", (20, 10), False),
        ("span", "start int, end int", (-1, 10), False),
        ("span", "start int, end int, more string", (1, 2, "x"), False),
        ("doc", "doc_id string, raw_text string", (" ", "x"), False),
        ("doc", "doc_id string, raw_text string", ("d", "x"), True),
        ("prediction", "quote_id string, proba double", ("q", 1.2), False),
        ("prediction", "quote_id string, proba double", ("q", 0.2), True),
        ("prediction", "proba double", (0.2,), False),
        ("response", "http_status int, sha256 string", (99, "a" * 64), False),
        ("response", "http_status int, sha256 string", (200, "a" * 63), False),
        ("response", "http_status int, sha256 string", (None, "a" * 64), True),
        ("quote", "doc_id string, text string, extra int", ("d", "t", 1), True),
        ("quote", "doc_id string, text string", ("d", None), False),
    ],
)
def test_contract(spark, model, schema, row, good):
    valid, rejected = validate(spark.createDataFrame([row], schema), model)
    assert (valid.count(), rejected.count()) == ((1, 0) if good else (0, 1))
