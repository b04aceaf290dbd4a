"""Ordered results per group without a task that holds a whole group.

A window over a case puts all its rows into one task, and a window without a partition the whole
table. Here a range partitioning cuts the order into slices of about equal size, however the rows
are spread over groups; a window runs within each slice, and what a group has in earlier slices is
added. Only groups that cross a border of slices have such a rest, so there are fewer of them than
slices, and they are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import stored

__all__ = ["group_quantiles", "places", "quantile_points", "running_sums", "top_per_group", "with_group"]


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """The frame with the sums of ``sums`` up to and with each row, by group and in order.

    The order has to be total within a group. Null keys are a group; nulls in a value add nothing.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    rows = stored(rows.repartitionByRange(parts, *keys, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    per = rows.groupBy("_slice", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    rest = per.select(F.col("_slice").alias("_s"), *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], *[F.sum(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in sums])
    rest = rest.filter(F.col(f"_b_{next(iter(sums))}").isNotNull())  # fewer rows than slices
    within = W.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(within) for n in sums})
    met = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        met = met & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(F.broadcast(rest), met, "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in sums], *[(F.col(f"_l_{n}") + F.coalesce(f"_b_{n}", F.lit(0))).alias(n) for n in sums])


def places(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_rn") -> DataFrame:
    """``name``: the place (from 1) of each row in its group."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")})


def with_group(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """The frame with aggregates of each row's group: combined on the map side, then joined, so adaptive execution can split a hot group."""
    per = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    per = per.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], *aggs)
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    return df.join(per, met).drop(*[f"_k{i}" for i in range(len(keys))])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; every task keeps k rows a group before anything is shuffled."""
    return df.withColumn("_top", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_top") <= k).drop("_top")


def _runs(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values with the ranks (from 0) below and up to them: ``v, lo, hi, n``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    run = running_sums(counts, keys, ["v"], {"hi": F.col("c")}).withColumn("lo", F.col("hi") - F.col("c"))
    return with_group(run, keys, {"n": F.sum("c")}) if keys else run.join(F.broadcast(run.agg(F.sum("c").alias("n"))), F.lit(True))


def _points(run: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    at = lambda h: F.max(F.when((F.col("lo") <= h) & (F.col("hi") > h), F.col("v")))
    out = [F.max("n").alias("n")]
    for i, s in enumerate(shares):
        h = (F.col("n") - 1) * F.lit(float(s))
        out += [at(F.floor(h)).alias(f"low_{i}"), at(F.ceil(h)).alias(f"high_{i}"), at(F.greatest(F.lit(1), F.ceil(F.lit(float(s)) * F.col("n"))) - 1).alias(f"disc_{i}")]
    return run.groupBy(*keys).agg(*out)


def _linear(i: int, s: float) -> Column:
    h = (F.col("n") - 1) * F.lit(float(s))
    low, high = F.col(f"low_{i}").cast("double"), F.col(f"high_{i}").cast("double")
    return low + (high - low) * (h - F.floor(h))


def quantile_points(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """One row of ``q_i`` (linear interpolation), ``mid_i`` (halfway between the two neighbours) and ``disc_i`` (nearest rank) for every share; null for a table without values."""
    p = _points(_runs(df, [], value), [], shares)
    cols = [c for i, s in enumerate(shares) for c in (_linear(i, s).alias(f"q_{i}"), ((F.col(f"low_{i}") + F.col(f"high_{i}")) / 2).alias(f"mid_{i}"), F.col(f"disc_{i}"))]
    return p.select("n", *cols)


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Per group with a value: ``q_i`` for every share, by linear interpolation."""
    p = _points(_runs(df, keys, value), keys, shares)
    return p.select(*keys, *[_linear(i, s).alias(f"q_{i}") for i, s in enumerate(shares)])
