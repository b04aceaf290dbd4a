"""Registered queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import load
from . import block_knn, bpe, eval_leaks, group_splits, ledger, name_variants, reading_level, scan_repair, split_overlap

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its statement."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query(
    "p4_found",
    r"""WITH RECURSIVE k AS (SELECT case_id FROM cases UNION SELECT case_id FROM quotes WHERE case_id IS NOT NULL),
        e AS (SELECT c.case_id AS a, k.case_id AS b FROM cases c JOIN k ON lower(trim(c.lead_case_id)) = lower(trim(k.case_id))
              UNION SELECT x.case_id, y.case_id FROM (SELECT DISTINCT doc_id, case_id FROM quotes WHERE case_id IS NOT NULL) x
                    JOIN (SELECT DISTINCT doc_id, case_id FROM quotes WHERE case_id IS NOT NULL) y ON x.doc_id = y.doc_id AND x.case_id < y.case_id),
        s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
        r AS (SELECT DISTINCT a AS n, a AS t FROM s UNION SELECT r.n, s.b FROM r JOIN s ON s.a = r.t)
        SELECT min(t) AS group_id, n AS case_id FROM r GROUP BY n HAVING min(t) <> n""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cases, quotes = load(spark, d, "cases", "quotes")
    g = group_splits.case_groups(cases, quotes)
    return g.filter(F.col("case_id") != F.col("group_id")).select("group_id", "case_id")


def _splits(spark: SparkSession, d: str) -> DataFrame:
    cases, quotes = load(spark, d, "cases", "quotes")
    return group_splits.assign_splits(group_splits.related_groups(cases, quotes))


@query("p4_splits")
def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d)


@query("p4_balance")
def p4_balance(spark: SparkSession, d: str) -> DataFrame:
    return group_splits.balance(_splits(spark, d))


_CANON = r"""lower(regexp_replace(text, '[^\p{L}\p{Nd}]+', '', 'g')) AS t,
  CASE WHEN meta IS NULL THEN NULL ELSE list_sort(list_transform(json_keys(meta), lambda k: concat(lower(k), '=', lower(regexp_replace(json_extract_string(meta, k), '[^\p{L}\p{Nd}]+', '', 'g'))))) END AS m"""


@query(
    "p5_found",
    f"""WITH c AS (SELECT record_id, {_CANON} FROM quotes),
        g AS (SELECT record_id, min(record_id) OVER (PARTITION BY t, m) AS keep_id FROM c)
        SELECT keep_id, record_id FROM g WHERE record_id <> keep_id""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ledger.copies_of(*ledger.collapse(load(spark, d, "quotes")))


@query(
    "p5_copies",
    f"""WITH c AS (SELECT record_id, ingested_at, {_CANON} FROM quotes)
        SELECT min(record_id) AS keep_id, count(*) AS copies, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM c GROUP BY t, m""",
)
def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    _, kept = ledger.collapse(load(spark, d, "quotes"))
    return kept.records().select("keep_id", "copies", "first_at", "last_at")


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = split_overlap.cross_split_pairs(load(spark, d, "quotes"))
    return pairs.select(F.least("eval_id", "train_id").alias("record_id_a"), F.greatest("eval_id", "train_id").alias("record_id_b"))


@query("p1_report")
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(load(spark, d, "quotes"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = block_knn.nearest(load(spark, d, "quote_vectors"), "record_id", "fused_emb", 64)
    return near.select(F.least("record_id", "other_id").alias("record_id_a"), F.greatest("record_id", "other_id").alias("record_id_b")).distinct()


@query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(load(spark, d, "documents"))


@query("p8_roundtrip", "SELECT count(*) AS n_docs, count(*) AS n_equal FROM documents")
def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = bpe.decode(bpe.encode(docs)).join(docs, "doc_id")
    return back.agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("decoded") == F.col("text")).cast("bigint")).alias("n_equal"))


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs, items = load(spark, d, "documents", "eval_items")
    return eval_leaks.leaks(docs, items)


@query("p9_clean")
def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    docs, items = load(spark, d, "documents", "eval_items")
    return eval_leaks.clean_corpus(docs, items).select("doc_id")


@query(
    "p9_matches",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM eval_items WHERE text IS NOT NULL),
        dg AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS p FROM d)),
        ig AS (SELECT item_id, p, array_to_string(w[p + 1:p + 5], ' ') AS g FROM (SELECT item_id, w, unnest(range(len(w) - 4)) AS p FROM i WHERE len(w) >= 15)),
        m AS (SELECT doc_id, item_id, ig.p AS ip, dg.p AS dp, dg.p - row_number() OVER (PARTITION BY doc_id, item_id, dg.p - ig.p ORDER BY dg.p) AS island FROM dg JOIN ig USING (g)),
        r AS (SELECT doc_id, item_id, count(*) + 4 AS n, min(ip) AS ip, min(dp) AS dp FROM m GROUP BY doc_id, item_id, dp - ip, island),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, ip, dp) AS k FROM r)
        SELECT doc_id, item_id, n AS n_words, ip AS item_pos, dp AS doc_pos FROM b WHERE k = 1""",
)
def p9_matches(spark: SparkSession, d: str) -> DataFrame:
    docs, items = load(spark, d, "documents", "eval_items")
    return eval_leaks.matches(docs, items)


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = load(spark, d, "documents", "reading_labels")
    levels = reading_level.profile(docs)
    return reading_level.score(levels, reading_level.fit(levels, labels))


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.findings(scan_repair.delivered_once(load(spark, d, "docket_entries")))


@query("p7_paragraphs")
def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.paragraphs(scan_repair.delivered_once(load(spark, d, "docket_entries")))


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.variant_pairs(load(spark, d, "quotes"))
