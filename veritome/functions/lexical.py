"""Features over token arrays: lexicon rates, proximity, clusters, runs, edges, transitions (2.11)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["ATTRIBUTION_VERBS", "DECEPTION", "cluster", "count_in", "edge_share", "entropy", "indices", "min_distance", "near_count", "proximity_pairs", "run_mean", "transition_rate"]

# Words that speak of deception.
DECEPTION = (
    "misleading", "false", "deceptive", "misrepresent", "fabricate", "distort", "manipulate", "deceive", "fraud", "dishonest",
    "untrue", "inaccurate", "misstate", "conceal", "hide",
)
# Verbs that attribute a statement.
ATTRIBUTION_VERBS = (
    "said", "stated", "noted", "announced", "according", "reported", "indicated", "disclosed", "revealed", "mentioned", "confirmed",
    "declared", "asserted",
)


def count_in(tokens: Column, terms: Iterable[str]) -> Column:
    terms = list(terms)
    return F.size(F.filter(tokens, lambda t: t.isin(terms)))


def indices(tokens: Column, terms: Iterable[str]) -> Column:
    """Positions (from 0) of the tokens that are among the terms."""
    terms = list(terms)
    return F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(terms), i)), lambda i: i.isNotNull())


def proximity_pairs(a: Column, b: Column, radius: int) -> Column:
    """Pairs of positions, one of either list, at most ``radius`` apart."""
    return F.aggregate(a, F.lit(0), lambda s, i: s + F.size(F.filter(b, lambda j: F.abs(j - i) <= radius)))


def near_count(a: Column, b: Column, radius: int) -> Column:
    """Positions of ``a`` with any of ``b`` at most ``radius`` away."""
    return F.size(F.filter(a, lambda i: F.exists(b, lambda j: F.abs(j - i) <= radius)))


def cluster(idx: Column, n: Column) -> Column:
    """1 - min(1, population deviation of the relative positions); one position 0.5, none 0."""
    k = F.size(idx)
    rel = F.transform(idx, lambda i: i / F.greatest(n, F.lit(1)))
    mean = F.aggregate(rel, F.lit(0.0), lambda s, x: s + x) / k
    var = F.aggregate(rel, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / k
    return F.when(k >= 2, 1 - F.least(F.lit(1.0), F.sqrt(var))).when(k == 1, 0.5).otherwise(0.0)


def run_mean(tokens: Column, inside) -> Column:
    """Mean length of the maximal runs of tokens for which ``inside`` holds; 0 without a run."""
    zero = F.struct(F.lit(0).alias("runs"), F.lit(0).alias("total"), F.lit(False).alias("open"))
    step = lambda s, t: F.struct((s["runs"] + (inside(t) & ~s["open"]).cast("int")).alias("runs"), (s["total"] + inside(t).cast("int")).alias("total"), inside(t).alias("open"))
    return F.aggregate(tokens, zero, step, lambda s: F.when(s["runs"] > 0, s["total"] / s["runs"]).otherwise(0.0))


def edge_share(tokens: Column, inside) -> Column:
    """Mean of the shares in the first and the last fifth of the tokens; 0 for no tokens."""
    n = F.size(tokens)
    head = F.greatest(F.lit(1), F.floor(n * 0.2).cast("int"))
    tail = F.greatest(head, F.floor(n * 0.8).cast("int"))
    share = lambda a: F.coalesce(F.size(F.filter(a, inside)) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))
    return F.when(n > 0, (share(F.slice(tokens, F.lit(1), head)) + share(F.slice(tokens, tail + 1, F.greatest(n - tail, F.lit(0))))) / 2).otherwise(0.0)


def transition_rate(tokens: Column, a, b) -> Column:
    """Neighbouring tokens of which the first is in ``a`` and the second in ``b``, by all neighbours."""
    n = F.size(tokens)
    hit = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: a(x) & b(y))
    return F.size(F.filter(hit, lambda h: h)) / F.greatest(n - 1, F.lit(1))


def entropy(counts: Column) -> Column:
    """Entropy in nats of an array of counts; 0 for none."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, (x / total) * F.log(x / total)).otherwise(0.0))


def min_distance(a: Column, b: Column, cap: int = 30) -> Column:
    """Smallest distance between positions of two lists, capped and scaled to 0..1; 1 where one is empty."""
    each = F.flatten(F.transform(a, lambda i: F.transform(b, lambda j: F.abs(j - i))))
    return F.coalesce(F.least(F.array_min(each), F.lit(cap)) / cap, F.lit(1.0))
