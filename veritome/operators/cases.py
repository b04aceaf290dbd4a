"""From quotes to cases: positional features, summaries, outcome classes, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import group_quantiles, places, quantile_points, running_sums, top_per_group, with_group

__all__ = [
    "bucketize", "case_features", "case_frame", "case_probability_features", "case_summary", "distribution", "fallback_means",
    "fingerprint_merge", "gini", "nearest_rank", "quantile_label", "run_clusters", "state_crosstab", "variance_ratio",
]


def bucketize(c: Column, edges: Sequence[Column | float], closed: str = "right") -> Column:
    """The number of edges below a value; an edge belongs to the lower class when closed is right. Null stays null."""
    out = F.lit(0)
    for e in edges:
        e = e if isinstance(e, Column) else F.lit(e)
        out = out + F.when(c > e if closed == "right" else c >= e, 1).otherwise(0)
    return F.when(c.isNotNull(), out)


def case_features(df: DataFrame, key: str, number: str, start: str, length: str, prob: str, flag: str, rule: str = "docket_fraction", value: float = 0.5) -> DataFrame:
    """Counts, means and densities of the rows of a case within a positional threshold (A1).

    rule: complete; docket_fraction (number up to max(1, floor(largest * value))); token_fraction
    (end up to floor(last end * value)); token_budget (end up to value). Missing positions are
    outside. Cases of which nothing is inside do not appear.
    """
    end = F.col(start) + F.col(length)
    if rule in ("docket_fraction", "token_fraction"):
        df = with_group(df, [key], {"_last": F.max(number if rule == "docket_fraction" else end)})
    inside = {
        "complete": F.lit(True),
        "docket_fraction": F.col(number) <= F.greatest(F.lit(1), F.floor(F.col("_last") * value)) if rule == "docket_fraction" else None,
        "token_fraction": end <= F.floor(F.col("_last") * value) if rule == "token_fraction" else None,
        "token_budget": end <= value,
    }[rule]
    kept = df.withColumn("_in", F.coalesce(inside, F.lit(False))).filter("_in")
    return kept.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count_if(F.col(flag)).alias("n_flagged"),
        F.avg(prob).alias("mean_prob"),
        F.max(prob).alias("max_prob"),
        F.sum(length).alias("n_tokens"),
        (F.count_if(F.col(flag)) / F.nullif(F.sum(length), F.lit(0))).alias("density"),
    )


def quantile_label(df: DataFrame, value: str, shares: Sequence[float] = (0.33, 0.66), label: str = "bucket") -> DataFrame:
    """Class 0..k by exact quantiles with linear interpolation over the table (A2); null has none.

    The quantiles are one row that is joined to the table.
    """
    edges = quantile_points(df, value, shares).select(F.array(*[f"q_{i}" for i in range(len(shares))]).alias("_e"))
    named = df.join(F.broadcast(edges), F.lit(True))
    return named.withColumn(label, bucketize(F.col(value), [F.get("_e", F.lit(i)) for i in range(len(shares))])).drop("_e")


def case_summary(df: DataFrame, key: str, matched: Column, position: str, outcome: str) -> DataFrame:
    """Rows, matched and unmatched rows, median position of the matched, whether outcomes conflict (A3)."""
    per = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(matched).alias("n_matched"),
        F.count_if(~F.coalesce(matched, F.lit(False))).alias("n_unmatched"),
        (F.min(outcome) < F.max(outcome)).alias("_two"),
    )
    middle = group_quantiles(df.filter(matched).select(key, F.col(position).alias("_at")), [key], "_at", [0.5]).toDF("_key", "median_position")
    out = per.join(middle, F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.select(key, "n_rows", "n_matched", "n_unmatched", "median_position", F.coalesce("_two", F.lit(False)).alias("conflict"))


def case_probability_features(df: DataFrame, key: str, prob: str, order: str, tie: str) -> DataFrame:
    """Shares above thresholds, moments, top-3 mean and positional means of a case's probabilities (A4)."""
    slim = df.select(key, F.col(prob).alias("_p"), F.col(order).alias("_o"), F.col(tie).alias("_t"))
    rows = with_group(places(slim, [key], ["_o", "_t"]), [key], {"_n": F.count(F.lit(1))})
    rows = rows.withColumn("_pos", F.when(F.col("_n") > 1, (F.col("_rn") - 1) / (F.col("_n") - 1)).otherwise(0.0))
    best = top_per_group(slim, [key], [F.desc("_p"), F.col("_o"), F.col("_t")], 3).groupBy(F.col(key).alias("_key")).agg(F.avg("_p").alias("top3_mean"))
    p = F.col("_p")
    per = rows.groupBy(key).agg(
        F.avg((p >= 0.9).cast("double")).alias("share_90"),
        F.avg((p >= 0.8).cast("double")).alias("share_80"),
        F.avg(p).alias("mean_prob"),
        F.stddev_pop(p).alias("std_prob"),
        F.max(p).alias("max_prob"),
        F.avg(F.when(F.col("_pos") <= 0.3, p)).alias("early_mean"),
        F.avg(F.when(F.col("_pos") >= 0.7, p)).alias("late_mean"),
    )
    return per.join(best, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def run_clusters(df: DataFrame, key: str, order: Sequence[str], flag: Column) -> DataFrame:
    """Maximal runs of flagged rows in order: one row per run with its first place and length."""
    rows = df.select(key, *order, flag.alias("_flag"))
    rows = running_sums(rows, [key], order, {"_rn": F.lit(1).cast("bigint"), "_fn": F.col("_flag").cast("bigint")}).filter("_flag")
    rows = rows.withColumn("_island", F.col("_rn") - F.col("_fn"))
    return rows.groupBy(key, "_island").agg(F.min("_rn").alias("first_at"), F.count(F.lit(1)).alias("run_length")).drop("_island")


def case_frame(df: DataFrame, key: str, record: str, year: str, outcome: str) -> DataFrame:
    """Per case: first year, first known outcome by record, rows; a missing year is the smallest of all."""
    per = df.groupBy(key).agg(
        F.min(year).alias("case_year"),
        F.min_by(outcome, F.when(F.col(outcome).isNotNull(), F.col(record))).alias("outcome"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    least = df.agg(F.min(year).alias("_least"))
    return per.join(F.broadcast(least), F.lit(True)).withColumn("case_year", F.coalesce("case_year", "_least")).drop("_least")


def fallback_means(df: DataFrame, fine: str, coarse: str, value: str, least: int = 10) -> DataFrame:
    """``expected``: the mean of the fine group, else of the coarse one, else of all, by size.

    Group means are computed once and joined; AQE broadcasts them while they are small.
    """
    f = df.groupBy(fine).agg(F.avg(value).alias("_f"), F.count(value).alias("_fn")).filter(F.col("_fn") >= least).select(fine, "_f")
    c = df.groupBy(coarse).agg(F.avg(value).alias("_c"), F.count(value).alias("_cn")).filter(F.col("_cn") >= least).select(coarse, "_c")
    g = df.agg(F.avg(value).alias("_g"))
    out = df.join(f, fine, "left").join(c, coarse, "left").join(F.broadcast(g), F.lit(True))
    return out.withColumn("expected", F.coalesce("_f", "_c", "_g")).drop("_f", "_c", "_g")


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Mean, median, population deviation, skewness and kurtosis (biased), range of a column."""
    whole = df.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.skewness(value).alias("skew"),
        F.kurtosis(value).alias("kurt"),
        (F.max(value) - F.min(value)).alias("range"),
    )
    return whole.join(quantile_points(df, value, [0.5]).select(F.col("q_0").alias("median")), F.lit(True))  # one row each


def nearest_rank(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """Percentiles that are values of the column."""
    return quantile_points(df, value, shares).select(*[F.col(f"disc_{i}").alias(f"p{round(100 * s)}") for i, s in enumerate(shares)])


def gini(df: DataFrame, key: str) -> DataFrame:
    """Gini coefficient and Herfindahl index of the sizes of groups.

    Sizes are first reduced to how often each size occurs, so the ordered pass sees one row per
    distinct size, however many groups there are.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("k"))
    w = W.orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    ranked = sizes.withColumn("_below", F.coalesce(F.sum("k").over(w), F.lit(0)))
    # the ranks of k equal sizes above b others sum to k * b + k (k + 1) / 2
    rank_sum = F.sum(F.col("size") * (F.col("k") * F.col("_below") + F.col("k") * (F.col("k") + 1) / 2))
    n, total = F.sum("k"), F.sum(F.col("k") * F.col("size"))
    return ranked.agg(
        n.alias("n_groups"),
        total.alias("n_rows"),
        (2 * rank_sum / (n * total) - (n + 1) / n).alias("gini"),
        (F.sum(F.col("k") * F.col("size") * F.col("size")) / (total * total)).alias("hhi"),
    )


def state_crosstab(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Counts of a column's values per group, one column each."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(f"{col}_{v}") for v in values])


def variance_ratio(df: DataFrame, key: str, value: str) -> DataFrame:
    """Variance of the group means by the mean variance within groups of two or more."""
    per = df.groupBy(key).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    return per.agg((F.var_samp("m") / F.nullif(F.avg("v"), F.lit(0.0))).alias("ratio"))


def fingerprint_merge(dest: DataFrame, source: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """Fill nulls of ``cols`` from the source row with the same key, the k-th with the k-th (J10); nothing is overwritten."""
    a = places(dest, [key], [order], "_k")
    b = places(source.select(key, order, *[c for c in cols if c not in (key, order)]), [key], [order], "_k").select(key, "_k", *[F.col(c).alias(f"_s_{c}") for c in cols])
    out = a.join(b, [key, "_k"], "left")
    return out.withColumns({c: F.coalesce(c, f"_s_{c}") for c in cols}).drop("_k", *[f"_s_{c}" for c in cols])
