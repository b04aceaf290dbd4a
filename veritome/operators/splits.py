"""Leakage-safe temporal splits and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import places, quantile_points, with_group

__all__ = [
    "class_weights", "early_prefix", "embargo", "first_per_key", "fold_overlap", "fold_report", "midpoint_edges", "purge", "quantile_blocks",
    "rolling_folds", "stratified_folds", "support_bias_weights", "support_weights", "tempered_weights", "within_group_z",
]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a given order."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def quantile_blocks(df: DataFrame, order: Sequence[str], k: int, name: str = "block") -> DataFrame:
    """Block 0..k-1 by equal shares of the ranks in a total order.

    The edge of a block is the linear quantile of the ranks 1..n; the order has to be total.
    """
    ranked = places(df, [], order)
    ranked = ranked.join(F.broadcast(ranked.agg(F.count(F.lit(1)).alias("_n"))), F.lit(True))
    block = F.when(F.col("_n") <= 1, 0).otherwise(F.greatest(F.lit(0), F.ceil((F.col("_rn") - 1) * k / (F.col("_n") - 1)) - 1))
    return ranked.withColumn(name, block.cast("int")).drop("_rn", "_n")


def midpoint_edges(df: DataFrame, value: str, shares: Sequence[float] = (1 / 3, 2 / 3)) -> DataFrame:
    """One row of quantiles halfway between the two values around each place (V1).

    The counts of distinct values are enough: a cumulative count finds the values at a rank.
    """
    return quantile_points(df, value, shares).select(*[F.col(f"mid_{i}").alias(f"edge_{i + 1}") for i in range(len(shares))])


def rolling_folds(cases: DataFrame, key: str, year: str, k: int = 3) -> DataFrame:
    """``fold, role, key``: block j+1 is evaluated after training on all cases of years before its first.

    Blocks are those of ``quantile_blocks`` over (year, key). Within the evaluated block cases
    alternate by the hash of their key between val and test. Cases without a year take no part.
    """
    blocks = quantile_blocks(cases.filter(F.col(year).isNotNull()).select(key, year), [year, key], k + 1)
    starts = blocks.groupBy("block").agg(F.min(year).alias("_from")).filter("block > 0")
    train = blocks.join(F.broadcast(starts.select(F.col("block").alias("_b"), "_from")), F.col(year) < F.col("_from"))
    train = train.select((F.col("_b") - 1).alias("fold"), F.lit("train").alias("role"), key)
    odd = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int") % 2
    ev = blocks.filter("block > 0").select((F.col("block") - 1).alias("fold"), F.when(odd == 0, "val").otherwise("test").alias("role"), key)
    return train.union(ev)


def stratified_folds(cases: DataFrame, key: str, strata: Sequence[str], k: int = 5) -> DataFrame:
    """``fold`` by the place within a stratum in hash order, modulo k (V5)."""
    rows = places(cases.withColumn("_h", F.md5(F.col(key).cast("string"))), strata, ["_h", key])
    return rows.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_h", "_rn")


def purge(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Training rows whose hash does not occur in what is held out (J9); null hashes stay."""
    return train.join(held_out.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def embargo(train: DataFrame, held_out: DataFrame, at: str, days: int) -> DataFrame:
    """Training rows that lie more than some days before all that is held out (V6)."""
    first = held_out.agg(F.min(at).alias("_first"))
    return train.join(F.broadcast(first), F.lit(True)).filter(F.col(at) <= F.col("_first") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("_first")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``n / (k * n_c)`` per class."""
    per = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = W.partitionBy()
    return per.select(label, "n_c", (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def support_weights(df: DataFrame, key: str, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """Per case 1 / sqrt(rows), clipped and scaled to a mean of one over cases."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    per = per.withColumn("_w", F.least(F.greatest(1 / F.sqrt("n_rows"), F.lit(low)), F.lit(high)))
    mean = per.agg(F.avg("_w").alias("_m"))
    return per.join(F.broadcast(mean), F.lit(True)).select(key, "n_rows", (F.col("_w") / F.col("_m")).alias("weight"))


def tempered_weights(df: DataFrame, label: str, key: str, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """Row weights (class share)^-alpha (case rows)^-beta, scaled to a mean of one (A10)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    s = df.groupBy(key).agg(F.count(F.lit(1)).alias("_s"))
    rows = df.join(c, label).join(s, key).withColumn("_w", F.pow("_c", F.lit(-alpha)) * F.pow("_s", F.lit(-beta)))
    mean = rows.agg(F.avg("_w").alias("_m"))
    return rows.join(F.broadcast(mean), F.lit(True)).withColumn("weight", F.col("_w") / F.col("_m")).drop("_c", "_s", "_w", "_m")


def support_bias_weights(df: DataFrame, key: str, outcome: str) -> DataFrame:
    """Per case 1 / (1 + (rows / mean rows - 1) / 2), the weight of each of its rows, and the correlation of size and outcome.

    The mean and the correlation are over cases with an outcome, which is the same in all rows of a case.
    """
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.max(outcome).alias("_y"))
    known = F.col("_y").isNotNull()
    whole = per.agg(F.avg(F.when(known, F.col("n_rows"))).alias("_m"), F.corr(F.when(known, F.col("n_rows")), F.col("_y")).alias("size_outcome"))
    weight = 1 / (1 + 0.5 * (F.col("n_rows") / F.col("_m") - 1))
    return per.join(F.broadcast(whole), F.lit(True)).select(key, "n_rows", weight.alias("weight"), (weight / F.col("n_rows")).alias("row_weight"), "size_outcome")


def fold_report(df: DataFrame, fold: str, role: str, key: str, label: str) -> DataFrame:
    """Rows and cases of every label in every fold and role."""
    return df.groupBy(fold, role, label).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_cases"))


def fold_overlap(df: DataFrame, fold: str, value: str) -> DataFrame:
    """``fold_a, fold_b, jaccard``: shared values by all values of every two folds (A22); nulls count for nothing, two folds without values are equal."""
    has = df.select(F.col(fold).alias("f"), F.col(value).alias("v")).distinct()
    size = has.groupBy("f").agg(F.count("v").alias("n"))
    both = has.toDF("fold_a", "v").join(has.toDF("fold_b", "v"), "v").groupBy("fold_a", "fold_b").agg(F.count(F.lit(1)).alias("k"))
    pairs = size.toDF("fold_a", "n_a").join(size.toDF("fold_b", "n_b"), F.col("fold_a") < F.col("fold_b")).join(both, ["fold_a", "fold_b"], "left").na.fill(0, ["k"])
    whole = F.col("n_a") + F.col("n_b") - F.col("k")
    return pairs.select("fold_a", "fold_b", F.when(whole == 0, 1.0).otherwise(F.col("k") / F.nullif(whole, F.lit(0))).alias("jaccard"))


def early_prefix(df: DataFrame, key: str, at: str, share: float) -> DataFrame:
    """Rows within the first share of the span of their case, at least one hundredth of it."""
    span = (F.col("_hi") - F.col("_lo"))
    rows = with_group(df, [key], {"_lo": F.min(at), "_hi": F.max(at)})
    return rows.filter(F.col(at) <= F.col("_lo") + F.greatest(span * share, span * 0.01)).drop("_lo", "_hi")


def within_group_z(df: DataFrame, key: str, value: str, name: str = "z") -> DataFrame:
    """Value less the mean of its group by the sample deviation, where a deviation of 0 or none counts as 1."""
    rows = with_group(df, [key], {"_sd": F.stddev_samp(value), "_mean": F.avg(value)})
    return rows.withColumn(name, (F.col(value) - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)).drop("_sd", "_mean")
