"""The interpretable features of a quote as column expressions over its tokens (2.11, L1, L2, L7-L12, B1-B10)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexical
from .text import words

__all__ = ["BINARY", "DISCOURSE", "LEXICONS", "binary_features", "feature_matrix", "lexicon_columns", "sequence_features", "token_frame"]

# The lexicons. Terms of several words stand in none, as they equal no single token.
LEXICONS: dict[str, list[str]] = {
    "deception": list(lexical.DECEPTION),
    "compliance": "compliant adhere conform regulate standard ethical transparent disclose report audit verify certify accordance pursuant documented recorded filed submitted".split(),
    "positive_qualifiers": ["preliminary"],
    "scope_limiters": "only limited except excluding solely exclusively restricted".split(),
    "ambiguity": "reasonable substantially material approximately generally often typically vague uncertain ambiguous unclear indefinite unspecified".split(),
    "guarantee": "guarantee assure promise commit ensure warrant pledge vow swear certify will definitely certainly absolutely".split(),
    "pricing_claims": "free zero complimentary discount save bargain deal offer lowest cheapest reduced".split(),
    "reliability": "secure safe protected reliable trusted proven tested verified certified guaranteed foolproof".split(),
    "scienter": "knew aware conscious deliberate intentional willful reckless negligent malicious purposeful".split(),
    "superlatives": "best always never all every most least only unique exclusive unmatched unparalleled incomparable".split(),
    "hedges": "may might could possibly perhaps potential probable likely appear seem suggest indicate approximately about".split(),
    "disclaimers": "except excluding disclaimer".split(),
    "obligation": "must shall required obligated compelled mandatory compulsory binding duty obligation".split(),
    "permission": "may can permitted allowed optional discretionary eligible authorized entitled voluntary".split(),
    "clarity": "clear precise specific defined explicit exact detailed unambiguous definitive concrete".split(),
    "policy_procedure": "policy procedure guideline protocol standard framework methodology process workflow governance audit compliance oversight monitoring review".split(),
    "accountability": "accountable responsible liable answerable culpable ownership accountability responsibility liability fault".split(),
}
# Markers of discourse.
DISCOURSE: dict[str, list[str]] = {
    "causal": "because therefore thus hence consequently so".split(),
    "contrast": "however but although despite nevertheless yet".split(),
    "temporal": "then next after before subsequently meanwhile".split(),
    "conditional": "if unless provided assuming".split(),
    "additive": "moreover furthermore additionally also besides".split(),
}
# The features that binary models may use.
BINARY = (
    "new_attribution_verb_density", "new2_deception_cluster_density", "lex_deception_count", "seq_trans_neutral_to_neutral", "new3_neutral_edge_coverage",
    "new2_attribution_verb_clustering_score", "new5_deesc_half_life", "new2_attr_verb_near_neutral_transition", "new2_neutral_run_mean",
    "new2_neutral_to_deception_transition_rate",
)
_RISK = sorted({t for v in LEXICONS.values() for t in v})
_TIMES = {t: sum(t in v for v in LEXICONS.values()) for t in _RISK}


def token_frame(df: DataFrame, text: str, context: str, keep: Iterable[str]) -> DataFrame:
    """``keep``, then ``t`` (tokens of quote and context with the mark between them), ``q`` (of the quote), ``n``, and ``calm`` (in no lexicon) by token. Nulls read as empty texts."""
    quote = F.coalesce(F.col(text), F.lit(""))
    both = words(F.concat(quote, F.lit(" [CONTEXT] "), F.coalesce(F.col(context), F.lit(""))))
    rows = df.select(*keep, both.alias("t"), words(quote).alias("q"))
    return rows.select("*", F.greatest(F.size("t"), F.lit(1)).alias("n"), F.transform("t", lambda x: ~x.isin(_RISK)).alias("calm"))


def lexicon_columns(weights: Mapping[str, float] | None = None) -> dict[str, Column]:
    """Count, rate and presence over all tokens, count and rate over the quote, for every lexicon; over ``token_frame``."""
    out = {}
    for name, terms in LEXICONS.items():
        w = float((weights or {}).get(name, 1.0))
        c, q = lexical.count_in(F.col("t"), terms), lexical.count_in(F.col("q"), terms)
        out[f"lex_{name}_count"] = c * w
        out[f"lex_{name}_norm"] = c / F.col("n") * w
        out[f"lex_{name}_present"] = (c > 0).cast("double") * w
        out[f"lex_{name}_quote_count"] = q * w
        out[f"lex_{name}_quote_norm"] = q / F.greatest(F.size("q"), F.lit(1)) * w
    return out


_KINDS = [*LEXICONS, "neutral"]


def _categories(t: Column) -> Column:
    """The numbers of the lexicons that hold a token, else that of neutral."""
    found = F.filter(F.array(*[F.when(t.isin(terms), F.lit(i)) for i, terms in enumerate(LEXICONS.values())]), lambda i: i.isNotNull())
    return F.when(t.isin(_RISK), found).otherwise(F.array(F.lit(len(LEXICONS))))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pairs(a: Column, b: Column, f) -> Column:
    """f over each element of ``a`` and the one of ``b`` that follows it."""
    k = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), k), F.slice(b, F.lit(2), k), f)


def sequence_features(df: DataFrame) -> DataFrame:
    """``token_frame`` with ``transitions`` (share of every pair of neighbouring categories that occurs), place of risk words and counts of discourse markers.

    With fewer than two tokens there are no transitions, and with no risk word its places are null.
    """
    step = lambda x, y: F.flatten(F.transform(x, lambda p: F.transform(y, lambda q: p * len(_KINDS) + q)))
    name = lambda i: F.get(F.array(*map(F.lit, _KINDS)), i.cast("int"))
    label = lambda p: F.concat(name(F.floor(p / len(_KINDS))), F.lit("_to_"), name(p % len(_KINDS)))
    shares = lambda s: F.map_from_entries(F.transform(F.array_distinct(s), lambda p: F.struct(label(p).alias("key"), (F.size(F.filter(s, lambda x: x == p)) / F.size(s)).alias("value"))))
    # bound as variables, so that neither list is made more than once
    transitions = _let(F.transform("t", _categories), lambda c: _let(F.flatten(_pairs(c, c, step)), shares))
    at = F.filter(F.transform("calm", lambda c, i: F.when(~c, i / F.col("n"))), lambda i: i.isNotNull())
    rows = df.withColumns({"transitions": transitions, "_at": at})
    mean = F.aggregate("_at", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("_at"), F.lit(0))
    rows = rows.withColumn("seq_risk_mean_pos", mean)
    spread = F.sqrt(F.aggregate("_at", F.lit(0.0), lambda s, x: s + (x - F.col("seq_risk_mean_pos")) * (x - F.col("seq_risk_mean_pos"))) / F.nullif(F.size("_at"), F.lit(0)))
    marks = {f"seq_discourse_{k}": lexical.count_in(F.col("t"), v) for k, v in DISCOURSE.items()}
    return rows.withColumns({"seq_risk_std_pos": spread, "seq_risk_first_pos": F.get("_at", F.lit(0)), "seq_risk_last_pos": F.get("_at", F.size("_at") - 1), **marks}).drop("_at")


def binary_features(df: DataFrame) -> DataFrame:
    """``token_frame`` with the features of BINARY, and the run, entropy, distance and slope features beside them.

    Rates by transition have at least one as their base, so a quote without neighbours has 0.
    """
    deception = list(lexical.DECEPTION)
    rows = df.withColumns({"_d": lexical.indices(F.col("t"), deception), "_a": lexical.indices(F.col("t"), lexical.ATTRIBUTION_VERBS), "_k": F.greatest(F.size("t") - 1, F.lit(1))})
    both = _pairs(F.col("calm"), F.col("calm"), lambda x, y: x & y)
    rows = rows.withColumn("_nn", F.filter(F.transform(both, lambda b, i: F.when(b, i)), lambda i: i.isNotNull()))
    times = lambda t: F.when(t.isin([x for x, k in _TIMES.items() if k > 1]), F.coalesce(*[F.when(t.isin([x for x, k in _TIMES.items() if k == m]), F.lit(m)) for m in range(2, max(_TIMES.values()) + 1)])).otherwise(1)
    weights = F.transform("t", times)
    rows = rows.withColumn("_all", F.aggregate(_pairs(weights, weights, lambda x, y: x * y), F.lit(0), lambda s, x: s + x))
    into = F.size(F.filter(_pairs(F.col("calm"), F.transform("t", lambda x: x.isin(deception)), lambda x, y: x & y), lambda h: h))
    same, calm = lambda x: x, F.col("calm")
    # the first window of eight tokens after the last word of deception of which six are calm
    last = F.get("_d", F.size("_d") - 1)
    starts = F.when(F.size("t") - 8 > last, F.sequence(last + 1, F.size("t") - 8)).otherwise(F.array().cast("array<int>"))
    settled = F.array_min(F.filter(starts, lambda s: F.size(F.filter(F.slice(calm, s + 1, F.lit(8)), same)) >= 6))
    first = lambda t: F.coalesce(*[F.when(t.isin(v), F.lit(i)) for i, v in enumerate(LEXICONS.values())])
    kinds = F.filter(F.transform("t", first), lambda i: i.isNotNull())
    runs = F.aggregate(
        calm,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: F.struct(F.when(c, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["most"], F.when(c, s["now"] + 1).otherwise(0)).alias("most")),
        lambda s: s["most"],
    )
    return rows.withColumns(
        {
            "new_attribution_verb_density": F.size("_a") / F.greatest(F.col("n") / 100.0, F.lit(1.0)),
            "new2_deception_cluster_density": lexical.cluster(F.col("_d"), F.col("n")),
            "lex_deception_count": F.size("_d").cast("double"),
            "seq_trans_neutral_to_neutral": F.size("_nn") / F.greatest(F.col("_all"), F.lit(1)),
            "new3_neutral_edge_coverage": lexical.edge_share(calm, same),
            "new2_attribution_verb_clustering_score": lexical.cluster(F.col("_a"), F.col("n")),
            "new5_deesc_half_life": F.when(F.size("_d") == 0, 0.0).otherwise(F.coalesce((settled - last) / F.col("n"), F.lit(1.0))),
            "new2_attr_verb_near_neutral_transition": lexical.near_count(F.col("_nn"), F.col("_a"), 3) / F.greatest(F.size("_nn"), F.lit(1)),
            "new2_neutral_run_mean": lexical.run_mean(calm, same),
            "new2_neutral_to_deception_transition_rate": into / F.col("_k"),
            "new2_neutral_run_max_ratio": runs / F.col("n"),
            "new2_risk_category_entropy": lexical.entropy(F.transform(F.array_distinct(kinds), lambda k: F.size(F.filter(kinds, lambda x: x == k)).cast("double"))),
            "new2_deception_attr_min_dist": lexical.min_distance(F.col("_d"), F.col("_a")),
        }
    ).drop("_d", "_a", "_k", "_nn", "_all")


def feature_matrix(df: DataFrame, key: str, features: str, names: Iterable[str]) -> DataFrame:
    """One column for every name, in order of the names, from a map of features; what a row does not have is 0."""
    return df.select(key, *[F.coalesce(F.try_element_at(features, F.lit(n)), F.lit(0.0)).alias(n) for n in sorted(set(names))])
