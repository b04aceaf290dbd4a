"""Joins, orders and summaries over cases and quotes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import places, quantile_points, running_sums, with_group

__all__ = [
    "bootstrap_mean", "case_label", "class_risk", "class_sizes", "column_summary", "correlations", "inflation", "join_latest", "percent_position",
    "prune_correlated", "rank_descending", "seeded_sample", "set_difference", "set_overlap", "size_bucket_report", "summary_with_counts", "top_share",
]


def join_latest(df: DataFrame, source: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """Every row with ``cols`` from the last row of the source with its keys, null where there is none."""
    last = source.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_last"))
    return df.drop(*cols).join(last, list(keys), "left").select("*", *[F.col(f"_last.{c}").alias(c) for c in cols]).drop("_last")


def summary_with_counts(cases: DataFrame, rows: DataFrame, key: str, matched: Column) -> DataFrame:
    """Every case with the number of its rows and of the matched ones; 0 where it has none."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(matched).alias("n_matched"))
    return cases.join(per, key, "left").na.fill(0, ["n_rows", "n_matched"])


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of either table that stand in both."""
    return a.select(key).intersect(b.select(key))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the first table that do not stand in the second."""
    return a.select(key).subtract(b.select(key))


def rank_descending(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """The average rank of each row's value, the largest first (W3); null for null. Ranks come from the counts of distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = running_sums(counts.withColumn("_o", -F.col("_v")), [], ["_o"], {"_upto": F.col("_c")})
    ranks = run.select("_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def percent_position(df: DataFrame, key: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """(place - 1) / (rows - 1) of each row in its group; 0 in a group of one."""
    rows = with_group(places(df, [key], order), [key], {"_n": F.count(F.lit(1))})
    return rows.withColumn(name, F.when(F.col("_n") > 1, (F.col("_rn") - 1) / (F.col("_n") - 1)).otherwise(0.0)).drop("_rn", "_n")


def top_share(df: DataFrame, value: str, share: float) -> DataFrame:
    """Rows whose value reaches the quantile 1 - share of the table, with ``threshold``."""
    edge = quantile_points(df, value, [1 - share]).select(F.col("q_0").alias("threshold"))
    return df.join(F.broadcast(edge), F.col(value) >= F.col("threshold"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of the hash of their key and a seed (O7): the same for the same rows."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def case_label(df: DataFrame, key: str, outcome: str) -> DataFrame:
    """The mean outcome of each case, rounded half to even (A5)."""
    return df.groupBy(key).agg(F.bround(F.avg(outcome)).cast("int").alias("label"))


def column_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: values, share missing, mean, sample deviation, least and greatest (A14), from one pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.struct(F.lit(c).alias("column"), F.count(v).alias("n_values"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("greatest")).alias(f"s{i}")]
    one = df.agg(*aggs).select("n", F.explode(F.array(*[f"s{i}" for i in range(len(cols))])).alias("s"))
    return one.select("s.column", "s.n_values", (1 - F.col("s.n_values") / F.nullif(F.col("n"), F.lit(0))).alias("missing"), "s.mean", "s.std", "s.least", "s.greatest")


def _size_bucket(n: Column) -> Column:
    return F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 7, "4-7").otherwise("8+")


def size_bucket_report(df: DataFrame, key: str, value: str) -> DataFrame:
    """Cases, rows and mean value by the number of rows of a case: 1, 2-3, 4-7, 8+."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.count(value).alias("k"))
    return per.groupBy(_size_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_cases"), F.sum("n").alias("n_rows"), (F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("mean_value"))


def class_sizes(df: DataFrame, key: str, label: str) -> DataFrame:
    """Per class: cases, rows, and rows a case on average, at least and at most."""
    per = df.groupBy(label, key).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(label).agg(F.count(F.lit(1)).alias("n_cases"), F.sum("n").alias("n_rows"), F.avg("n").alias("mean_rows"), F.min("n").alias("least_rows"), F.max("n").alias("most_rows"))


def class_risk(df: DataFrame, key: str, label: str, prob: str, high: float = 0.8) -> DataFrame:
    """Per class the means over its cases of mean and largest probability and of the share of high ones."""
    per = df.groupBy(label, key).agg(F.avg(prob).alias("m"), F.max(prob).alias("x"), F.avg((F.col(prob) >= high).cast("double")).alias("h"))
    return per.groupBy(label).agg(F.avg("m").alias("mean_risk"), F.avg("x").alias("max_risk"), F.avg("h").alias("high_share"))


def bootstrap_mean(df: DataFrame, key: str, value: str, draws: int = 100, seed: int = 0, level: float = 0.95) -> DataFrame:
    """The mean of the means of cases and its bootstrap interval (V8).

    A case enters each replicate as often as a Poisson draw from the hash of its key says, so all
    replicates come out of one pass and the draw of a case is the same in whatever order it is read.
    """
    per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("m")).filter("m IS NOT NULL")
    steps, p, total = [], 1 / np.e, 0.0
    for k in range(9):
        total += p
        steps.append(total)
        p /= k + 1
    u = lambda r: F.pmod(F.xxhash64(F.col(key), F.lit(seed * draws + r)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.transform(F.array(*[u(r) for r in range(draws)]), lambda x: sum([(x >= s).cast("int") for s in steps], F.lit(0)))
    rows = per.select("m", F.posexplode(times).alias("r", "w"))
    reps = rows.groupBy("r").agg((F.sum(F.col("m") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    tail = (1 - level) / 2
    ends = reps.agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))
    return per.agg(F.avg("m").alias("mean"), F.count(F.lit(1)).alias("n_cases")).join(ends, F.lit(True))


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``a, b, r``: the correlation of every two columns, from one pass over the rows in which both stand."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")


def prune_correlated(df: DataFrame, cols: Sequence[str], score: dict[str, float], most: float = 0.9) -> list[str]:
    """The columns that are left when of every two that correlate by more than ``most`` the one with the lower score goes."""
    gone: set[str] = set()
    for r in sorted(correlations(df, cols).collect(), key=lambda r: (r["a"], r["b"])):  # one row a pair of columns
        if r["r"] is not None and abs(r["r"]) > most and not {r["a"], r["b"]} & gone:
            gone.add(min((r["a"], r["b"]), key=lambda c: (score.get(c, 0.0), c)))
    return [c for c in cols if c not in gone]


def inflation(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """The variance inflation factor of each column: the diagonal of the inverse correlation matrix."""
    m = np.eye(len(cols))
    at = {c: i for i, c in enumerate(cols)}
    for r in correlations(df, cols).collect():
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["r"] if r["r"] is not None else 0.0
    return dict(zip(cols, np.diag(np.linalg.pinv(m)).tolist()))
