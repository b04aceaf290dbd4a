"""Registered queries of the core, with their SQL for the comparison engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import contracts
from .functions import features, ids, lexical, text, vectors
from .operators import cases, extraction, filters, hotkeys, splits, stats, tables
from .plans import pipeline
from .runtime import load

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
    "p3_found",
    """SELECT case_id FROM quotes WHERE case_id IS NOT NULL GROUP BY case_id
       HAVING count(*) >= 0.015 * (SELECT count(*) FROM quotes)""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.hot_keys(load(spark, d, "quotes"), "case_id", "speaker", 0.015).select("case_id")


@query(
    "p3_case_profile",
    """WITH f AS (SELECT case_id, speaker, count(*) AS c FROM quotes WHERE case_id IS NOT NULL AND speaker IS NOT NULL GROUP BY 1, 2),
       m AS (SELECT case_id, speaker, row_number() OVER (PARTITION BY case_id ORDER BY c DESC, speaker) AS r FROM f)
       SELECT q.case_id, count(*) AS n_rows, count(DISTINCT q.speaker) AS n_values, max(m.speaker) AS mode_value,
              min(q.ingested_at) AS first_at, max(q.ingested_at) AS last_at
       FROM quotes q LEFT JOIN m ON m.case_id = q.case_id AND m.r = 1 WHERE q.case_id IS NOT NULL GROUP BY q.case_id""",
)
def p3_case_profile(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.key_profile(load(spark, d, "quotes"), "case_id", "speaker", "ingested_at")


@query(
    "p3_case_percentiles",
    """WITH v AS (SELECT case_id, num_tokens, row_number() OVER (PARTITION BY case_id ORDER BY num_tokens) AS r,
                         count(*) OVER (PARTITION BY case_id) AS n
                  FROM quotes WHERE case_id IS NOT NULL AND num_tokens IS NOT NULL),
       s AS (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS share)
       SELECT case_id, share, CAST(num_tokens AS BIGINT) AS value FROM v, s WHERE r = greatest(1, ceil(share * n))""",
)
def p3_case_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.key_percentiles(load(spark, d, "quotes"), "case_id", "num_tokens", (0.1, 0.5, 0.9))


# --- text and ids -------------------------------------------------------------------------------

@query(
    "text_hash_norm",
    """SELECT record_id, md5(regexp_replace(regexp_replace(translate(regexp_replace(lower(coalesce(text, '')), '^[\\s  ]+|[\\s  ]+$', '', 'g'), '“”‘’–—', '""''''--'), '[\\s  ]+', ' ', 'g'), '[.,;:!?]+$', '')) AS h FROM quotes""",
)
def q_text_hash_norm(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "quotes").select("record_id", ids.text_hash_norm(F.col("text")).alias("h"))


@query(
    "case_id_parts",
    """WITH p AS (SELECT case_id, regexp_extract(case_id, '^(\\d{2})-\\d+_ca\\d+$', 1) AS a, regexp_extract(case_id, '\\d+:(\\d+)-', 1) AS b,
                      regexp_extract(case_id, '(\\d{4})', 1) AS c, split_part(case_id, '_', -1) AS court FROM cases)
       SELECT case_id, court, regexp_replace(court, '[^a-z]', '', 'g') AS circuit, upper(substr(court, 1, 2)) AS state,
              CASE WHEN a <> '' THEN CASE WHEN a::INT <= 30 THEN 2000 + a::INT ELSE 1900 + a::INT END
                   WHEN b <> '' THEN CASE WHEN b::INT > 90 THEN 1900 + b::INT ELSE 2000 + b::INT END
                   WHEN c <> '' AND c::INT BETWEEN 1950 AND 2030 THEN c::INT ELSE 2020 END AS year FROM p""",
)
def q_case_id_parts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("case_id")
    return load(spark, d, "cases").select("case_id", text.case_court(c).alias("court"), text.case_circuit(c).alias("circuit"), text.case_state(c).alias("state"), text.case_year(c).alias("year"))


@query(
    "token_counts",
    """SELECT record_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_tokens,
              len(regexp_extract_all(text, '\\$[0-9]')) AS n_money FROM quotes WHERE text IS NOT NULL""",
)
def q_token_counts(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "quotes").filter("text IS NOT NULL")
    return q.select("record_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"), F.regexp_count("text", F.lit(r"\$[0-9]")).alias("n_money"))


@query("clean_text", "SELECT count(*) AS n, count(*) AS n_single_spaced FROM documents WHERE text IS NOT NULL")
def q_clean_text(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").filter("text IS NOT NULL").select(text.clean(F.col("text")).alias("t"))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("t").contains("  ")).alias("n_single_spaced"))


@query("clean_text_rows")
def q_clean_text_rows(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


@query(
    "lexicon_rates",
    f"""WITH w AS (SELECT record_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM quotes WHERE text IS NOT NULL)
        SELECT record_id, len(list_filter(t, lambda x: x IN {lexical.DECEPTION})) AS n_deception, len(list_filter(t, lambda x: x IN {lexical.ATTRIBUTION_VERBS})) AS n_attribution,
               round(len(list_filter(t, lambda x: x IN {lexical.ATTRIBUTION_VERBS})) / greatest(len(t) / 100.0, 1), 6) AS density FROM w""",
)
def q_lexicon_rates(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "quotes").filter("text IS NOT NULL").select("record_id", text.words(F.col("text")).alias("t"))
    verbs = lexical.count_in(F.col("t"), lexical.ATTRIBUTION_VERBS)
    return q.select("record_id", lexical.count_in(F.col("t"), lexical.DECEPTION).alias("n_deception"), verbs.alias("n_attribution"), F.round(verbs / F.greatest(F.size("t") / 100.0, F.lit(1.0)), 6).alias("density"))


def _in(terms) -> str:
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


# tokens of quote and context, of the quote, their number, and by token whether it is in no lexicon
_TOKENS = rf"""WITH w AS (SELECT record_id, regexp_extract_all(lower(concat(coalesce(text, ''), ' [CONTEXT] ', coalesce(context, ''))), '[\p{{L}}\p{{N}}_]+') AS t,
                          regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS q FROM quotes),
       f AS (SELECT *, greatest(len(t), 1) AS n, list_transform(t, lambda x: x NOT IN {_in(features._RISK)}) AS calm FROM w)"""
_LEX = [(f"lex_{k}_{m}", e.format(_in(v))) for k, v in features.LEXICONS.items() for m, e in (
    ("count", "CAST(len(list_filter(t, lambda x: x IN {})) AS DOUBLE)"), ("norm", "round(len(list_filter(t, lambda x: x IN {})) / n, 9)"), ("present", "CAST(len(list_filter(t, lambda x: x IN {})) > 0 AS DOUBLE)"),
    ("quote_count", "CAST(len(list_filter(q, lambda x: x IN {})) AS DOUBLE)"), ("quote_norm", "round(len(list_filter(q, lambda x: x IN {})) / greatest(len(q), 1), 9)"))]


def _token_frame(spark: SparkSession, d: str) -> DataFrame:
    return features.token_frame(load(spark, d, "quotes"), "text", "context", ["record_id"])


@query("lexicon_matrix", f"{_TOKENS} SELECT record_id, {', '.join(f'{e} AS {c}' for c, e in _LEX)} FROM f")
def q_lexicon_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _token_frame(spark, d).select("record_id", *[F.round(e, 9).alias(c) for c, e in features.lexicon_columns().items()])


@query(
    "binary_features",
    f"""{_TOKENS},
       i AS (SELECT *, list_filter(range(len(t)), lambda i: t[i + 1] IN {_in(lexical.DECEPTION)}) AS d, list_filter(range(len(t)), lambda i: t[i + 1] IN {_in(lexical.ATTRIBUTION_VERBS)}) AS a,
                    list_filter(range(len(t) - 1), lambda i: calm[i + 1] AND calm[i + 2]) AS nn, greatest(1, CAST(floor(0.2 * len(t)) AS BIGINT)) AS h,
                    list_transform(t, lambda x: greatest(1, {' + '.join(f'CAST(x IN {_in(v)} AS INT)' for v in features.LEXICONS.values())})) AS c FROM f),
       j AS (SELECT *, greatest(h, CAST(floor(0.8 * len(t)) AS BIGINT)) AS s, list_sum(list_transform(range(len(t) - 1), lambda i: c[i + 1] * c[i + 2])) AS pairs,
                    list_min(list_filter(range(list_max(d) + 1, len(t) - 7), lambda s: len(list_filter(range(s, s + 8), lambda i: calm[i + 1])) >= 6)) AS settled FROM i)
       SELECT record_id, round(len(a) / greatest(n / 100.0, 1), 9) AS new_attribution_verb_density,
              round(CASE len(d) WHEN 0 THEN 0 WHEN 1 THEN 0.5 ELSE 1 - least(1, list_aggregate(list_transform(d, lambda i: i / n), 'stddev_pop')) END, 9) AS new2_deception_cluster_density,
              CAST(len(d) AS DOUBLE) AS lex_deception_count, round(len(nn) / greatest(coalesce(pairs, 0), 1), 9) AS seq_trans_neutral_to_neutral,
              round((len(list_filter(calm[1:h], lambda x: x)) / greatest(len(calm[1:h]), 1) + len(list_filter(calm[s + 1:], lambda x: x)) / greatest(len(calm[s + 1:]), 1)) / 2, 9) AS new3_neutral_edge_coverage,
              round(CASE len(a) WHEN 0 THEN 0 WHEN 1 THEN 0.5 ELSE 1 - least(1, list_aggregate(list_transform(a, lambda i: i / n), 'stddev_pop')) END, 9) AS new2_attribution_verb_clustering_score,
              round(CASE WHEN len(d) = 0 THEN 0 ELSE coalesce((settled - list_max(d)) / n, 1) END, 9) AS new5_deesc_half_life,
              round(len(list_filter(nn, lambda i: len(list_filter(a, lambda j: abs(i - j) <= 3)) > 0)) / greatest(len(nn), 1), 9) AS new2_attr_verb_near_neutral_transition,
              round(coalesce(len(list_filter(calm, lambda x: x)) / nullif(len(list_filter(range(len(t)), lambda i: calm[i + 1] AND (i = 0 OR NOT calm[greatest(i, 1)]))), 0), 0), 9) AS new2_neutral_run_mean,
              round(len(list_filter(d, lambda i: i > 0 AND calm[greatest(i, 1)])) / greatest(len(t) - 1, 1), 9) AS new2_neutral_to_deception_transition_rate FROM j""",
)
def q_binary_features(spark: SparkSession, d: str) -> DataFrame:
    return features.binary_features(_token_frame(spark, d)).select("record_id", *[F.round(c, 9).alias(c) for c in features.BINARY])


@query(
    "sequence_features",
    f"""{_TOKENS},
       p AS (SELECT *, list_transform(list_filter(range(len(t)), lambda i: NOT calm[i + 1]), lambda i: i / n) AS spots, list_filter(range(len(t)), lambda i: t[i + 1] IN {_in(lexical.DECEPTION)}) AS d,
                    list_filter(range(len(t)), lambda i: t[i + 1] IN {_in(lexical.ATTRIBUTION_VERBS)}) AS a FROM f)
       SELECT record_id, round(list_avg(spots), 9) AS seq_risk_mean_pos, round(list_aggregate(spots, 'stddev_pop'), 9) AS seq_risk_std_pos, round(spots[1], 9) AS seq_risk_first_pos, round(spots[-1], 9) AS seq_risk_last_pos,
              {', '.join(f"len(list_filter(t, lambda x: x IN {_in(v)})) AS seq_discourse_{k}" for k, v in features.DISCOURSE.items())},
              round(coalesce(least(30, list_min(flatten(list_transform(d, lambda i: list_transform(a, lambda j: abs(i - j)))))) / 30, 1), 9) AS new2_deception_attr_min_dist FROM p""",
)
def q_sequence_features(spark: SparkSession, d: str) -> DataFrame:
    rows = features.sequence_features(features.binary_features(_token_frame(spark, d)))
    places = [f"seq_risk_{m}_pos" for m in ("mean", "std", "first", "last")]
    return rows.select("record_id", *[F.round(c, 9).alias(c) for c in (*places, "new2_deception_attr_min_dist")], *[f"seq_discourse_{k}" for k in features.DISCOURSE])


_CATS = "list_filter([" + ", ".join(f"CASE WHEN x IN {_in(v)} THEN '{k}' END" for k, v in features.LEXICONS.items()) + "], lambda y: y IS NOT NULL)"


@query(
    "category_transitions",
    f"""{_TOKENS},
       c AS (SELECT record_id, list_transform(t, lambda x: CASE WHEN len({_CATS}) = 0 THEN ['neutral'] ELSE {_CATS} END) AS c FROM f),
       e AS (SELECT record_id, unnest(flatten(list_transform(range(len(c) - 1), lambda i: flatten(list_transform(c[i + 1], lambda p: list_transform(c[i + 2], lambda q: concat(p, '_to_', q))))))) AS pair FROM c)
       SELECT record_id, pair, round(count(*) / sum(count(*)) OVER (PARTITION BY record_id), 9) AS share FROM e GROUP BY 1, 2""",
)
def q_category_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = features.sequence_features(_token_frame(spark, d))
    return rows.select("record_id", F.explode("transitions").alias("pair", "share")).select("record_id", "pair", F.round("share", 9).alias("share"))


@query(
    "top_keywords",
    """WITH w AS (SELECT record_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM quotes WHERE text IS NOT NULL),
       e AS (SELECT record_id, unnest(t) AS word, generate_subscripts(t, 1) AS p FROM w),
       c AS (SELECT record_id, word, count(*) AS n, min(p) AS p FROM e WHERE length(word) > 2 AND word NOT IN ('the', 'and', 'was', 'for') GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY n DESC, p) AS rank FROM c)
       SELECT record_id, rank, word, n FROM r WHERE rank <= 5""",
)
def q_top_keywords(spark: SparkSession, d: str) -> DataFrame:
    return extraction.top_keywords(load(spark, d, "quotes"), "record_id", "text", ("the", "and", "was", "for"))


# --- extraction ---------------------------------------------------------------------------------


@query(
    "amount_scan",
    """WITH a AS (SELECT record_id, unnest(regexp_extract_all(text, '(?i)\\$[0-9]+(?:\\.[0-9]+)?\\s*(?:million|billion)\\b|\\b[0-9]+(?:\\.[0-9]+)?\\s*(?:million|billion)\\b|\\$[0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]{2})?|\\$[0-9]+(?:\\.[0-9]{2})?')) AS raw FROM quotes)
       SELECT record_id, raw, round(TRY_CAST(trim(regexp_replace(regexp_replace(lower(raw), '[,$]', '', 'g'), '\\s*(million|billion)', '', 'g')) AS DOUBLE)
              * CASE WHEN contains(lower(raw), 'million') THEN 1e6 WHEN contains(lower(raw), 'billion') THEN 1e9 ELSE 1 END, 2) AS value FROM a""",
)
def q_amount_scan(spark: SparkSession, d: str) -> DataFrame:
    return extraction.amounts(load(spark, d, "quotes"), "record_id", "text").select(F.col("doc_id").alias("record_id"), "raw", F.round("value", 2).alias("value"))


@query("amount_starts", "SELECT 0 AS n_wrong")
def q_amount_starts(spark: SparkSession, d: str) -> DataFrame:
    a = extraction.amounts(load(spark, d, "quotes"), "record_id", "text").withColumnRenamed("doc_id", "record_id")
    met = a.join(load(spark, d, "quotes").select("record_id", "text"), "record_id")
    wrong = F.substring("text", F.col("start") + 1, F.length("raw")) != F.col("raw")
    return met.agg(F.count_if(wrong).cast("int").alias("n_wrong"))


@query("document_quotes")
def q_document_quotes(spark: SparkSession, d: str) -> DataFrame:
    return extraction.quotes(load(spark, d, "documents"), "doc_id", "text").select("doc_id", "para", "pos", "quote")


@query("near_duplicate_quotes")
def q_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return extraction.near_duplicates(load(spark, d, "quotes").filter("text IS NOT NULL"), "record_id", "text")


@query(
    "docket_offsets",
    """WITH o AS (SELECT case_id, entry_id, doc_id, any_value(doc_text) AS t FROM docket_entries WHERE doc_text IS NOT NULL GROUP BY 1, 2, 3)
       SELECT doc_id, coalesce(sum(length(t) + 1) OVER w, 0)::BIGINT AS char_start FROM o
       WINDOW w AS (PARTITION BY case_id ORDER BY entry_id, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def q_docket_offsets(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "docket_entries").filter("doc_text IS NOT NULL").groupBy("case_id", "entry_id", "doc_id").agg(F.any_value("doc_text").alias("t"))
    e = e.withColumn("place", F.struct("entry_id", "doc_id"))
    return extraction.offsets(e, "case_id", "place", "t").select("doc_id", "char_start")


# --- filters ------------------------------------------------------------------------------------

_ROLES = ("Unknown", "Court", "Plaintiff", "State", "Commission", "Congress", "Circuit", "Defendant", "Witness")


@query("speaker_filter", f"SELECT record_id, speaker FROM quotes WHERE speaker IS NULL OR speaker NOT IN {_ROLES}")
def q_speaker_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.drop_values(load(spark, d, "quotes"), "speaker", _ROLES).select("record_id", "speaker")


@query(
    "filter_report",
    f"""SELECT count(*) AS n_before, count(*) FILTER (speaker IS NULL OR speaker NOT IN {_ROLES}) AS n_after, round(avg(num_tokens), 6) AS tokens_before,
        round(avg(num_tokens) FILTER (speaker IS NULL OR speaker NOT IN {_ROLES}), 6) AS tokens_after FROM quotes""",
)
def q_filter_report(spark: SparkSession, d: str) -> DataFrame:
    keep = ~F.coalesce(F.col("speaker").isin(*_ROLES), F.lit(False))
    r = filters.filter_report(load(spark, d, "quotes"), keep, ("tokens", F.col("num_tokens")))
    return r.select("n_before", "n_after", F.round("tokens_before", 6).alias("tokens_before"), F.round("tokens_after", 6).alias("tokens_after"))


@query(
    "valid_case_filter",
    """SELECT q.record_id FROM quotes q SEMI JOIN (SELECT case_id FROM quotes GROUP BY 1 HAVING bool_and(coalesce(speaker <> 'Court', FALSE))) v ON q.case_id = v.case_id""",
)
def q_valid_cases(spark: SparkSession, d: str) -> DataFrame:
    return filters.valid_groups(load(spark, d, "quotes"), "case_id", F.col("speaker") != "Court").select("record_id")


@query(
    "speaker_dominant_case",
    """WITH c AS (SELECT speaker, case_id, count(*) AS n FROM quotes WHERE speaker IS NOT NULL AND case_id IS NOT NULL GROUP BY 1, 2),
       b AS (SELECT speaker, case_id FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY n DESC, case_id) AS r FROM c) WHERE r = 1)
       SELECT q.record_id FROM quotes q JOIN b ON q.speaker = b.speaker AND q.case_id = b.case_id""",
)
def q_dominant(spark: SparkSession, d: str) -> DataFrame:
    return filters.dominant_key_rows(load(spark, d, "quotes"), "speaker", "case_id").select("record_id")


@query(
    "prefix_flags",
    """SELECT record_id, coalesce(docket_number <= greatest(1, floor(max(docket_number) OVER (PARTITION BY case_id) * 0.5)), FALSE) AS in_prefix,
              coalesce(record_id % 1000 + num_tokens <= 500, FALSE) AS in_budget FROM quotes""",
)
def q_prefix_flags(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "quotes").withColumn("start", F.col("record_id") % 1000)
    return filters.prefix_flags(q, "case_id", "docket_number", "start", "num_tokens", 0.5, 500).select("record_id", "in_prefix", "in_budget")


@query(
    "deflated_prices",
    """WITH ix AS (SELECT y AS year, m AS month, 100.0 + 10 * (y - 1992) + m AS cpi FROM range(1992, 1996) t(y), range(1, 13) s(m)),
       a AS (SELECT year, avg(cpi) AS cpi FROM ix GROUP BY 1)
       SELECT o_orderkey, round(coalesce(o_totalprice * 100 / coalesce(ix.cpi, a.cpi), o_totalprice), 4) AS real FROM orders
       LEFT JOIN ix ON ix.year = year(o_orderdate) AND ix.month = month(o_orderdate) LEFT JOIN a ON a.year = year(o_orderdate)""",
)
def q_deflated(spark: SparkSession, d: str) -> DataFrame:
    ix = spark.range(48).select((1992 + F.floor(F.col("id") / 12)).alias("year"), (F.col("id") % 12 + 1).alias("month"))
    ix = ix.withColumn("cpi", 100.0 + 10 * (F.col("year") - 1992) + F.col("month"))
    o = load(spark, d, "orders").withColumns({"y": F.year("o_orderdate"), "m": F.month("o_orderdate")})
    return filters.deflate(o, "o_totalprice", "y", "m", ix).select("o_orderkey", F.round("real", 4).alias("real"))


# --- cases --------------------------------------------------------------------------------------


@query(
    "case_features_docket_half",
    """WITH r AS (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)
       SELECT l_orderkey, count(*) AS n_quotes, count(*) FILTER (l_returnflag = 'R') AS n_flagged, round(avg(l_discount * 10), 6) AS mean_prob,
              round(sum(l_quantity), 6) AS n_tokens FROM r WHERE l_linenumber <= greatest(1, floor(m * 0.5)) GROUP BY 1""",
)
def q_case_features(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").withColumns({"p": F.col("l_discount") * 10, "f": F.col("l_returnflag") == "R", "s": F.col("l_linenumber") * 10})
    r = cases.case_features(li, "l_orderkey", "l_linenumber", "s", "l_quantity", "p", "f")
    return r.select("l_orderkey", "n_quotes", "n_flagged", F.round("mean_prob", 6).alias("mean_prob"), F.round("n_tokens", 6).alias("n_tokens"))


@query(
    "outcome_tertiles",
    """WITH e AS (SELECT quantile_cont(o_totalprice, 0.33) AS a, quantile_cont(o_totalprice, 0.66) AS b FROM orders)
       SELECT o_orderkey, CAST(o_totalprice > a AS INT) + CAST(o_totalprice > b AS INT) AS bucket FROM orders, e""",
)
def q_tertiles(spark: SparkSession, d: str) -> DataFrame:
    return cases.quantile_label(load(spark, d, "orders"), "o_totalprice").select("o_orderkey", "bucket")


@query(
    "case_summary",
    """SELECT case_id, count(*) AS n_rows, count(*) FILTER (score >= 0.5) AS n_matched, count(*) FILTER (NOT coalesce(score >= 0.5, FALSE)) AS n_unmatched,
              median(CASE WHEN score >= 0.5 THEN docket_number END) AS median_position, count(DISTINCT stage) > 1 AS conflict FROM quotes GROUP BY 1""",
)
def q_case_summary(spark: SparkSession, d: str) -> DataFrame:
    return cases.case_summary(load(spark, d, "quotes"), "case_id", F.col("score") >= 0.5, "docket_number", "stage")


@query(
    "case_probability_features",
    """WITH r AS (SELECT case_id, score, row_number() OVER (PARTITION BY case_id ORDER BY ingested_at NULLS FIRST, record_id) AS rn, count(*) OVER (PARTITION BY case_id) AS n,
                         row_number() OVER (PARTITION BY case_id ORDER BY score DESC NULLS LAST, ingested_at NULLS FIRST, record_id) AS t FROM quotes),
       p AS (SELECT *, CASE WHEN n > 1 THEN (rn - 1) / (n - 1)::DOUBLE ELSE 0 END AS pos FROM r)
       SELECT case_id, round(avg(CAST(score >= 0.8 AS DOUBLE)), 6) AS share_80, round(avg(score), 6) AS mean_prob, round(stddev_pop(score), 6) AS std_prob, max(score) AS max_prob,
              round(avg(score) FILTER (t <= 3), 6) AS top3_mean, round(avg(score) FILTER (pos <= 0.3), 6) AS early_mean, round(avg(score) FILTER (pos >= 0.7), 6) AS late_mean FROM p GROUP BY 1""",
)
def q_case_probs(spark: SparkSession, d: str) -> DataFrame:
    r = cases.case_probability_features(load(spark, d, "quotes"), "case_id", "score", "ingested_at", "record_id")
    return r.select("case_id", *[F.round(c, 6).alias(c) for c in ("share_80", "mean_prob", "std_prob")], "max_prob", *[F.round(c, 6).alias(c) for c in ("top3_mean", "early_mean", "late_mean")])


@query(
    "run_clusters",
    """WITH r AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem),
       f AS (SELECT l_orderkey, rn, rn - row_number() OVER (PARTITION BY l_orderkey ORDER BY rn) AS g FROM r WHERE l_returnflag = 'N')
       SELECT l_orderkey, min(rn) AS first_at, count(*) AS run_length FROM f GROUP BY l_orderkey, g""",
)
def q_runs(spark: SparkSession, d: str) -> DataFrame:
    return cases.run_clusters(load(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], F.col("l_returnflag") == "N")


@query(
    "case_frame",
    """SELECT case_id, coalesce(min(case_year), (SELECT min(case_year) FROM quotes)) AS case_year, arg_min(score, record_id) FILTER (score IS NOT NULL) AS outcome, count(*) AS n_rows FROM quotes GROUP BY 1""",
)
def q_case_frame(spark: SparkSession, d: str) -> DataFrame:
    return cases.case_frame(load(spark, d, "quotes"), "case_id", "record_id", "case_year", "score")


@query(
    "suppression_fallback",
    """WITH f AS (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1 HAVING count(*) >= 10), s AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1 HAVING count(*) >= 10)
       SELECT c_custkey, round(coalesce(f.m, s.m, (SELECT avg(c_acctbal) FROM customer)), 4) AS expected FROM customer c LEFT JOIN f USING (c_nationkey) LEFT JOIN s USING (c_mktsegment)""",
)
def q_fallback(spark: SparkSession, d: str) -> DataFrame:
    return cases.fallback_means(load(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal").select("c_custkey", F.round("expected", 4).alias("expected"))


@query(
    "outcome_distribution",
    """WITH m AS (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM orders)
       SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(max(sd), 4) AS std,
              round(avg(((o_totalprice - mu) / sd) ** 3), 6) AS skew, round(avg(((o_totalprice - mu) / sd) ** 4) - 3, 6) AS kurt, round(max(o_totalprice) - min(o_totalprice), 4) AS range FROM orders, m""",
)
def q_distribution(spark: SparkSession, d: str) -> DataFrame:
    r = cases.distribution(load(spark, d, "orders"), "o_totalprice")
    return r.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "range")], *[F.round(c, 6).alias(c) for c in ("skew", "kurt")])


@query(
    "gini_hhi",
    """WITH s AS (SELECT case_id, count(*)::DOUBLE AS x FROM quotes GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n, sum(x) OVER () AS t FROM s)
       SELECT max(n) AS n_groups, CAST(max(t) AS BIGINT) AS n_rows, round(2 * sum(i * x) / (max(n) * max(t)) - (max(n) + 1.0) / max(n), 6) AS gini, round(sum((x / t) ** 2), 6) AS hhi FROM r""",
)
def q_gini(spark: SparkSession, d: str) -> DataFrame:
    r = cases.gini(load(spark, d, "quotes"), "case_id")
    return r.select("n_groups", "n_rows", F.round("gini", 6).alias("gini"), F.round("hhi", 6).alias("hhi"))


@query(
    "state_bin_crosstab",
    """SELECT upper(substr(split_part(case_id, '_', -1), 1, 2)) AS state, count(*) FILTER (label = 'settled') AS label_settled, count(*) FILTER (label = 'dismissed') AS label_dismissed FROM cases GROUP BY 1""",
)
def q_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return cases.state_crosstab(load(spark, d, "cases").withColumn("state", text.case_state(F.col("case_id"))), "state", "label", ["settled", "dismissed"])


@query(
    "variance_ratio",
    "WITH g AS (SELECT case_id, avg(score) AS m, var_samp(score) AS v FROM quotes GROUP BY 1) SELECT round(var_samp(m) / avg(v), 6) AS ratio FROM g",
)
def q_variance(spark: SparkSession, d: str) -> DataFrame:
    return cases.variance_ratio(load(spark, d, "quotes"), "case_id", "score").select(F.round("ratio", 6).alias("ratio"))


@query(
    "fingerprint_merge",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY record_id) AS k FROM quotes WHERE record_id % 2 = 0),
            b AS (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY record_id) AS k FROM quotes WHERE record_id % 2 = 1)
       SELECT a.record_id, coalesce(a.score, b.score) AS score, coalesce(a.context, b.context) AS context FROM a LEFT JOIN b ON a.quote_id = b.quote_id AND a.k = b.k""",
)
def q_merge(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "quotes")
    return cases.fingerprint_merge(q.filter("record_id % 2 = 0"), q.filter("record_id % 2 = 1"), "quote_id", "record_id", ["score", "context"]).select("record_id", "score", "context")


@query(
    "fingerprint_merge_whole",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY record_id) AS k FROM quotes)
       SELECT a.record_id, coalesce(a.score, b.score) AS score, coalesce(a.context, b.context) AS context FROM a LEFT JOIN a b ON a.quote_id = b.quote_id AND a.k = b.k - 1""",
)
def q_merge_whole(spark: SparkSession, d: str) -> DataFrame:
    """All quotes, filled from the later deliveries of the same quote_id."""
    q = load(spark, d, "quotes")
    later = q.withColumn("_at", F.row_number().over(W.partitionBy("quote_id").orderBy("record_id"))).filter("_at > 1").drop("_at")
    return cases.fingerprint_merge(q, later, "quote_id", "record_id", ["score", "context"]).select("record_id", "score", "context")


@query(
    "quarterly_metrics",
    """SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS quarter, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1 HAVING count(*) >= 10""",
)
def q_quarters(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").groupBy(F.date_trunc("quarter", "o_orderdate").alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return o.filter("n >= 10")


# --- splits and weights -------------------------------------------------------------------------


@query(
    "time_blocks_qcut",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
       SELECT o_orderkey, CAST(greatest(0, ceil((rn - 1) * 4 / (n - 1)::DOUBLE) - 1) AS INT) AS block FROM r""",
)
def q_blocks(spark: SparkSession, d: str) -> DataFrame:
    return splits.quantile_blocks(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 4).select("o_orderkey", "block")


@query(
    "midpoint_tertiles",
    """WITH s AS (SELECT list_sort(list(o_totalprice)) AS a, count(*) AS n FROM orders)
       SELECT round((a[floor((n - 1) / 3.0)::INT + 1] + a[ceil((n - 1) / 3.0)::INT + 1]) / 2, 4) AS edge_1, round((a[floor((n - 1) * 2 / 3.0)::INT + 1] + a[ceil((n - 1) * 2 / 3.0)::INT + 1]) / 2, 4) AS edge_2 FROM s""",
)
def q_midpoint(spark: SparkSession, d: str) -> DataFrame:
    return splits.midpoint_edges(load(spark, d, "orders"), "o_totalprice").select(F.round("edge_1", 4).alias("edge_1"), F.round("edge_2", 4).alias("edge_2"))


@query("rolling_origin_folds")
def q_rolling(spark: SparkSession, d: str) -> DataFrame:
    return splits.rolling_folds(load(spark, d, "cases"), "case_id", "case_year")


@query(
    "stratified_folds",
    "SELECT case_id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(case_id), case_id) - 1) % 5 AS INT) AS fold FROM cases",
)
def q_stratified(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_folds(load(spark, d, "cases"), "case_id", ["label"]).select("case_id", "fold")


@query(
    "hash_purge_anti",
    """SELECT record_id FROM quotes WHERE lower(trim(split)) = 'train' AND (text_hash_norm IS NULL OR text_hash_norm NOT IN
       (SELECT text_hash_norm FROM quotes WHERE lower(trim(split)) IN ('val', 'test') AND text_hash_norm IS NOT NULL))""",
)
def q_purge(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "quotes").withColumn("s", F.lower(F.trim("split")))
    return splits.purge(q.filter("s = 'train'"), q.filter("s IN ('val', 'test')"), "text_hash_norm").select("record_id")


@query(
    "class_weights",
    "WITH c AS (SELECT label, count(*) AS n_c FROM cases WHERE label IS NOT NULL GROUP BY 1) SELECT label, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c)::DOUBLE, 6) AS weight FROM c",
)
def q_class_weights(spark: SparkSession, d: str) -> DataFrame:
    return splits.class_weights(load(spark, d, "cases"), "label").select("label", "n_c", F.round("weight", 6).alias("weight"))


@query(
    "support_weights",
    """WITH c AS (SELECT case_id, count(*) AS n_rows, least(greatest(1 / sqrt(count(*)), 0.25), 4.0) AS w FROM quotes GROUP BY 1) SELECT case_id, n_rows, round(w / avg(w) OVER (), 6) AS weight FROM c""",
)
def q_support(spark: SparkSession, d: str) -> DataFrame:
    return splits.support_weights(load(spark, d, "quotes"), "case_id").select("case_id", "n_rows", F.round("weight", 6).alias("weight"))


@query(
    "tempered_weights",
    """WITH w AS (SELECT record_id, (count(*) OVER (PARTITION BY stage)) ** -0.5 * (count(*) OVER (PARTITION BY case_id)) ** -0.5 AS w FROM quotes WHERE case_id IS NOT NULL AND stage IS NOT NULL)
       SELECT record_id, round(w / avg(w) OVER (), 6) AS weight FROM w""",
)
def q_tempered(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "quotes").filter("case_id IS NOT NULL AND stage IS NOT NULL")
    return splits.tempered_weights(q, "stage", "case_id").select("record_id", F.round("weight", 6).alias("weight"))


@query(
    "within_case_zscore",
    """SELECT record_id, round((score - avg(score) OVER w) / CASE WHEN stddev_samp(score) OVER w > 0 THEN stddev_samp(score) OVER w ELSE 1 END, 6) AS z FROM quotes WINDOW w AS (PARTITION BY case_id)""",
)
def q_zscore(spark: SparkSession, d: str) -> DataFrame:
    return splits.within_group_z(load(spark, d, "quotes"), "case_id", "score").select("record_id", F.round("z", 6).alias("z"))


@query(
    "early_prefix_p30",
    """WITH r AS (SELECT record_id, docket_number AS x, min(docket_number) OVER (PARTITION BY case_id) AS a, max(docket_number) OVER (PARTITION BY case_id) AS b FROM quotes)
       SELECT record_id FROM r WHERE x <= a + greatest((b - a) * 0.3, (b - a) * 0.01)""",
)
def q_early(spark: SparkSession, d: str) -> DataFrame:
    return splits.early_prefix(load(spark, d, "quotes"), "case_id", "docket_number", 0.3).select("record_id")


@query(
    "dedupe_first_within_case",
    "SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY case_id, text ORDER BY record_id) AS r FROM quotes) WHERE r = 1",
)
def q_first(spark: SparkSession, d: str) -> DataFrame:
    return splits.first_per_key(load(spark, d, "quotes"), ["case_id", "text"], ["record_id"]).select("record_id")


# --- statistics ---------------------------------------------------------------------------------

_LABELLED = "(SELECT l_discount * 10 AS s, CAST(l_returnflag = 'R' AS INT) AS y, l_linestatus AS g, l_quantity AS x FROM lineitem)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_linestatus").alias("g"), F.col("l_quantity").alias("x"))


@query(
    "auc_case_level",
    f"""WITH c AS (SELECT s, count(*) AS c, sum(y) AS p FROM {_LABELLED} GROUP BY 1), r AS (SELECT *, sum(c) OVER (ORDER BY s) - (c - 1) / 2.0 AS r FROM c)
        SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(c - p) AS BIGINT) AS n_neg, round((sum(r * p) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * sum(c - p)), 6) AS auc FROM r""",
)
def q_auc(spark: SparkSession, d: str) -> DataFrame:
    return stats.auc(_labelled(spark, d), "s", "y").select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@query(
    "ece_bins",
    f"""WITH b AS (SELECT ceil(s * 10) AS b, count(*) AS n, avg(s) AS c, avg(y) AS a FROM {_LABELLED} WHERE s > 0 AND s <= 1 GROUP BY 1) SELECT round(sum(abs(a - c) * n) / (SELECT count(*) FROM lineitem), 6) AS ece FROM b""",
)
def q_ece(spark: SparkSession, d: str) -> DataFrame:
    return stats.ece(_labelled(spark, d), "s", "y").select(F.round("ece", 6).alias("ece"))


@query(
    "mcc_threshold_grid",
    f"""WITH g AS (SELECT t FROM range(0, 21) r(t)), c AS (SELECT t, count(*) FILTER (y = 1 AND floor(s * 20) >= t) AS tp, count(*) FILTER (y = 0 AND floor(s * 20) >= t) AS fp,
           count(*) FILTER (y = 1 AND floor(s * 20) < t) AS fn, count(*) FILTER (y = 0 AND floor(s * 20) < t) AS tn FROM {_LABELLED}, g GROUP BY 1)
        SELECT t / 20.0 AS threshold, tp, fp, fn, tn, round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c""",
)
def q_mcc(spark: SparkSession, d: str) -> DataFrame:
    return stats.mcc_grid(_labelled(spark, d), "s", "y").withColumn("mcc", F.round("mcc", 6))


@query(
    "qwk",
    """WITH r AS (SELECT l_linenumber % 3 AS a, CAST(l_quantity AS BIGINT) % 3 AS b FROM lineitem), n AS (SELECT count(*)::DOUBLE AS t FROM r), x AS (SELECT a, count(*)::DOUBLE AS n FROM r GROUP BY 1),
            y AS (SELECT b, count(*)::DOUBLE AS n FROM r GROUP BY 1), o AS (SELECT sum(((a - b) ** 2) / 4.0) AS o FROM r), e AS (SELECT sum(((a - b) ** 2) / 4.0 * x.n * y.n) AS e FROM x, y)
       SELECT round(1 - o * t / e, 6) AS kappa FROM o, e, n""",
)
def q_qwk(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("a"), (F.col("l_quantity").cast("bigint") % 3).alias("b"))
    return stats.quadratic_kappa(li, "a", "b", 3).select(F.round("kappa", 6).alias("kappa"))


@query(
    "psi",
    f"""WITH l AS (SELECT min(x) AS lo, max(x) AS hi FROM {_LABELLED} WHERE g = 'F'), b AS (SELECT least(9, greatest(0, floor((x - lo) / ((hi - lo) / 10)))) AS b, count(*) FILTER (g = 'F') AS p, count(*) FILTER (g = 'O') AS q FROM {_LABELLED}, l GROUP BY 1),
            s AS (SELECT coalesce(nullif(p / sum(p) OVER (), 0), 0.001) AS p, coalesce(nullif(q / sum(q) OVER (), 0), 0.001) AS q FROM b)
        SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM s""",
)
def q_psi(spark: SparkSession, d: str) -> DataFrame:
    return stats.psi(_labelled(spark, d), "x", "g", "F", "O").select(F.round("psi", 6).alias("psi"))


@query(
    "mutual_info",
    """WITH j AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
            p AS (SELECT n / sum(n) OVER () AS p, n * sum(n) OVER () / (sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b)) AS r FROM j) SELECT round(sum(p * ln(r)), 6) AS mi FROM p""",
)
def q_mi(spark: SparkSession, d: str) -> DataFrame:
    return stats.mutual_information(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("mi", 6).alias("mi"))


@query(
    "spearman",
    """WITH a AS (SELECT l_quantity AS x, l_discount AS y FROM lineitem), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM a)
       SELECT round(corr(rx, ry), 6) AS rho FROM r""",
)
def q_spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(load(spark, d, "lineitem"), "l_quantity", "l_discount").select(F.round("rho", 6).alias("rho"))


@query(
    "kruskal_wallis",
    """WITH a AS (SELECT l_quantity AS x, l_returnflag AS g FROM lineitem), r AS (SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM a),
            s AS (SELECT g, sum(r)::DOUBLE AS rs, count(*)::DOUBLE AS n FROM r GROUP BY 1), t AS (SELECT sum(c ** 3 - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM a GROUP BY x))
       SELECT round((12 / (sum(n) * (sum(n) + 1)) * sum(rs * rs / n) - 3 * (sum(n) + 1)) / (1 - max(t) / (sum(n) ** 3 - sum(n))), 4) AS h, count(*) AS n_groups FROM s, t""",
)
def q_kw(spark: SparkSession, d: str) -> DataFrame:
    return stats.kruskal_wallis(load(spark, d, "lineitem"), "l_quantity", "l_returnflag").select(F.round("h", 4).alias("h"), "n_groups")


@query(
    "feature_screen",
    """SELECT 'score' AS feature, count(*) AS n, round(count(*) FILTER (score IS NULL) / count(*)::DOUBLE, 6) AS null_share, round(count(*) FILTER (score = 0) / count(*)::DOUBLE, 6) AS zero_share FROM quotes
       UNION ALL SELECT 'docket_number', count(*), round(count(*) FILTER (docket_number IS NULL) / count(*)::DOUBLE, 6), round(count(*) FILTER (docket_number = 0) / count(*)::DOUBLE, 6) FROM quotes""",
)
def q_screen(spark: SparkSession, d: str) -> DataFrame:
    r = stats.screen(load(spark, d, "quotes"), ["score", "docket_number"])
    return r.select("feature", "n", F.round("null_share", 6).alias("null_share"), F.round("zero_share", 6).alias("zero_share"))


# --- vectors ------------------------------------------------------------------------------------


@query(
    "bucket_centroids",
    """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) SELECT label, CAST(i - 1 AS INT) AS dim, round(avg(x::DOUBLE), 5) AS mean FROM e GROUP BY 1, 2""",
)
def q_centroids(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query(
    "distance_to_centroid",
    """WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2)
       SELECT vec_id, round(sqrt(sum((v - m) ** 2)), 4) AS l2, round(sum(abs(v - m)), 4) AS l1 FROM x JOIN c USING (label, i) GROUP BY 1""",
)
def q_distances(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    j = e.join(c, "label")
    return j.select("vec_id", F.round(vectors.l2(F.col("embedding"), F.col("c")), 4).alias("l2"), F.round(vectors.l1(F.col("embedding"), F.col("c")), 4).alias("l1"))


@query(
    "wl_buckets",
    """WITH h AS (SELECT DISTINCT p_type, md5(p_type) AS h FROM part) SELECT p_type, CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 2048 AS INT) AS bucket FROM h""",
)
def q_wl(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_type").distinct().select("p_type", vectors.wl_bucket(F.col("p_type")).alias("bucket"))


# --- events -------------------------------------------------------------------------------------


@query(
    "event_windows",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def q_events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query(
    "top_speakers",
    "SELECT speaker, count(*) AS n FROM quotes WHERE speaker IS NOT NULL GROUP BY 1 ORDER BY n DESC, speaker LIMIT 20",
)
def q_top_speakers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "quotes").filter("speaker IS NOT NULL").groupBy("speaker").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "speaker").limit(20)


@query("case_dataset")
def q_case_dataset(spark: SparkSession, d: str) -> DataFrame:
    r = pipeline.case_dataset(load(spark, d, "quotes").filter("case_year IS NOT NULL"), "case_id", "record_id", "case_year", "score")
    return r.select("case_id", "fold", "role", "case_year", "bucket")


@query("quote_pipeline")
def q_quote_pipeline(spark: SparkSession, d: str) -> DataFrame:
    r = pipeline.quote_table(load(spark, d, "documents"), "doc_id", "text")
    return r.select("doc_id", "para", "pos", "speaker", "quote", "quote_id")


@query(
    "valid_quotes",
    "SELECT record_id FROM quotes WHERE length(trim(doc_id)) > 0 AND length(trim(text)) > 0",
)
def q_valid_quotes(spark: SparkSession, d: str) -> DataFrame:
    return contracts.validate(load(spark, d, "quotes"), "quote")[0].select("record_id")


# --- joins, orders and summaries ------------------------------------------------------------------


@query(
    "latest_quote_of_document",
    """WITH l AS (SELECT doc_id, arg_max({'s': score, 'p': speaker}, record_id) AS x FROM quotes GROUP BY 1)
       SELECT e.doc_id, e.entry_id, x.s AS score, x.p AS speaker FROM docket_entries e LEFT JOIN l USING (doc_id)""",
)
def q_join_latest(spark: SparkSession, d: str) -> DataFrame:
    entries, quotes = load(spark, d, "docket_entries", "quotes")
    return tables.join_latest(entries, quotes, ["doc_id"], "record_id", ["score", "speaker"]).select("doc_id", "entry_id", "score", "speaker")


@query(
    "case_summary_with_counts",
    """WITH p AS (SELECT case_id, count(*) AS n_rows, count(*) FILTER (score >= 0.5) AS n_matched FROM quotes GROUP BY 1)
       SELECT c.case_id, c.final_judgement_real, coalesce(n_rows, 0) AS n_rows, coalesce(n_matched, 0) AS n_matched FROM cases c LEFT JOIN p USING (case_id)""",
)
def q_summary_counts(spark: SparkSession, d: str) -> DataFrame:
    c, q = load(spark, d, "cases", "quotes")
    return tables.summary_with_counts(c.select("case_id", "final_judgement_real"), q, "case_id", F.col("score") >= 0.5)


@query("shared_documents", "SELECT doc_id FROM quotes INTERSECT SELECT doc_id FROM docket_entries")
def q_overlap(spark: SparkSession, d: str) -> DataFrame:
    return tables.set_overlap(*load(spark, d, "quotes", "docket_entries"), "doc_id")


@query("documents_without_entry", "SELECT doc_id FROM quotes EXCEPT SELECT doc_id FROM docket_entries")
def q_difference(spark: SparkSession, d: str) -> DataFrame:
    return tables.set_difference(*load(spark, d, "quotes", "docket_entries"), "doc_id")


@query(
    "price_ranks",
    "SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS rank FROM orders",
)
def q_ranks(spark: SparkSession, d: str) -> DataFrame:
    return tables.rank_descending(load(spark, d, "orders"), "o_totalprice").select("o_orderkey", "rank")


@query(
    "position_in_case",
    """SELECT record_id, round(CASE WHEN count(*) OVER (PARTITION BY case_id) > 1 THEN (row_number() OVER (PARTITION BY case_id ORDER BY ingested_at NULLS FIRST, record_id) - 1) / (count(*) OVER (PARTITION BY case_id) - 1)::DOUBLE ELSE 0 END, 9) AS position FROM quotes""",
)
def q_position(spark: SparkSession, d: str) -> DataFrame:
    return tables.percent_position(load(spark, d, "quotes"), "case_id", ["ingested_at", "record_id"]).select("record_id", F.round("position", 9).alias("position"))


@query("top_tenth_of_prices", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.9) FROM orders)")
def q_top_share(spark: SparkSession, d: str) -> DataFrame:
    return tables.top_share(load(spark, d, "orders"), "o_totalprice", 0.1).select("o_orderkey")


@query("case_label", "SELECT case_id, CAST(round_even(avg(stage), 0) AS INT) AS label FROM quotes GROUP BY 1")
def q_case_label(spark: SparkSession, d: str) -> DataFrame:
    return tables.case_label(load(spark, d, "quotes"), "case_id", "stage")


@query(
    "column_summary",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n_values, round(1 - count({c}) / count(*), 9) AS missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS greatest FROM quotes" for c in ("score", "num_tokens", "case_year")),
)
def q_column_summary(spark: SparkSession, d: str) -> DataFrame:
    r = tables.column_summary(load(spark, d, "quotes"), ["score", "num_tokens", "case_year"])
    return r.withColumns({"missing": F.round("missing", 9), "mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    "size_buckets",
    """WITH p AS (SELECT case_id, count(*) AS n, sum(score) AS s, count(score) AS k FROM quotes GROUP BY 1)
       SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 7 THEN '4-7' ELSE '8+' END AS bucket, count(*) AS n_cases, CAST(sum(n) AS BIGINT) AS n_rows, round(sum(s) / nullif(sum(k), 0), 6) AS mean_value FROM p GROUP BY 1""",
)
def q_size_buckets(spark: SparkSession, d: str) -> DataFrame:
    return tables.size_bucket_report(load(spark, d, "quotes"), "case_id", "score").withColumn("mean_value", F.round("mean_value", 6))


@query(
    "class_sizes",
    """WITH p AS (SELECT stage, case_id, count(*) AS n FROM quotes GROUP BY 1, 2)
       SELECT stage, count(*) AS n_cases, CAST(sum(n) AS BIGINT) AS n_rows, round(avg(n), 6) AS mean_rows, min(n) AS least_rows, max(n) AS most_rows FROM p GROUP BY 1""",
)
def q_class_sizes(spark: SparkSession, d: str) -> DataFrame:
    return tables.class_sizes(load(spark, d, "quotes"), "case_id", "stage").withColumn("mean_rows", F.round("mean_rows", 6))


@query(
    "class_risk",
    """WITH p AS (SELECT stage, case_id, avg(score) AS m, max(score) AS x, avg(CAST(score >= 0.8 AS DOUBLE)) AS h FROM quotes GROUP BY 1, 2)
       SELECT stage, round(avg(m), 6) AS mean_risk, round(avg(x), 6) AS max_risk, round(avg(h), 6) AS high_share FROM p GROUP BY 1""",
)
def q_class_risk(spark: SparkSession, d: str) -> DataFrame:
    r = tables.class_risk(load(spark, d, "quotes"), "case_id", "stage", "score")
    return r.withColumns({c: F.round(c, 6) for c in ("mean_risk", "max_risk", "high_share")})


_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_LINE) for b in _LINE[i + 1 :]))
def q_correlations(spark: SparkSession, d: str) -> DataFrame:
    return tables.correlations(load(spark, d, "lineitem"), _LINE).withColumn("r", F.round("r", 6))
