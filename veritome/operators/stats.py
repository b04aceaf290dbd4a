"""Validation statistics by ranks and bins; only aggregated rows ever meet one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import running_sums

__all__ = [
    "auc", "average_ranks", "benjamini_hochberg", "brier", "cliffs_delta", "confusion_metrics", "ece", "kruskal_wallis", "mcc_grid",
    "mutual_information", "psi", "quadratic_kappa", "regression_report", "screen", "spearman",
]


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct value (and group): rows ``c`` and the average rank ``r`` of its ties."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return running_sums(counts, by, ["v"], {"upto": F.col("c")}).withColumn("r", F.col("upto") - (F.col("c") - 1) / 2).drop("upto")


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums, with average ranks of ties (V7); 0.5 for a single class."""
    per = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("v"))
    per = per.agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(label) == 1).alias("p"))
    per = running_sums(per, by, ["v"], {"upto": F.col("c")}).withColumn("r", F.col("upto") - (F.col("c") - 1) / 2)
    agg = per.groupBy(*by).agg(F.sum(F.col("r") * F.col("p")).alias("rs"), F.sum("p").alias("n1"), F.sum(F.col("c") - F.col("p")).alias("n0"))
    value = F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).otherwise(0.5)
    return agg.select(*by, F.col("n1").alias("n_pos"), F.col("n0").alias("n_neg"), value.alias("auc"))


def ece(df: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over left-open bins (V9); probability 0 lies in none."""
    b = df.filter((F.col(prob) > 0) & (F.col(prob) <= 1)).groupBy(F.ceil(F.col(prob) * bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("conf"), F.avg(F.col(label).cast("double")).alias("acc"))
    total = df.agg(F.count(F.lit(1)).alias("all"))
    return b.join(F.broadcast(total), F.lit(True)).agg(F.coalesce(F.sum(F.abs(F.col("acc") - F.col("conf")) * F.col("n") / F.col("all")), F.lit(0.0)).alias("ece"))


def brier(df: DataFrame, prob: str, label: str) -> DataFrame:
    d = F.col(prob) - F.col(label).cast("double")
    return df.agg(F.avg(d * d).alias("brier"))


def mcc_grid(df: DataFrame, prob: str, label: str, steps: int = 20) -> DataFrame:
    """Confusion counts and MCC at thresholds 0, 1/steps, ..., 1.

    Rows are counted once per cell of the grid; the counts at a threshold are sums over cells.
    """
    cell = F.floor(F.col(prob) * steps).cast("int")
    cells = df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull()).groupBy(cell.alias("cell")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("t"))
    at = grid.join(F.broadcast(cells), F.lit(True), "left").groupBy("t").agg(
        F.sum(F.when(F.col("cell") >= F.col("t"), F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("cell") >= F.col("t"), F.col("q")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("cell") < F.col("t"), F.col("p")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("cell") < F.col("t"), F.col("q")).otherwise(0)).alias("tn"),
    )
    d = {c: F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")}
    den = F.sqrt((d["tp"] + d["fp"]) * (d["tp"] + d["fn"]) * (d["tn"] + d["fp"]) * (d["tn"] + d["fn"]))
    return at.select((F.col("t") / steps).alias("threshold"), "tp", "fp", "fn", "tn", F.when(den > 0, (d["tp"] * d["tn"] - d["fp"] * d["fn"]) / den).otherwise(0.0).alias("mcc"))


def confusion_metrics(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of 0/1 predictions."""
    tp, fp = F.count_if((F.col(pred) == 1) & (F.col(label) == 1)), F.count_if((F.col(pred) == 1) & (F.col(label) == 0))
    fn, tn = F.count_if((F.col(pred) == 0) & (F.col(label) == 1)), F.count_if((F.col(pred) == 0) & (F.col(label) == 0))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return df.agg(ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def regression_report(df: DataFrame, pred: str, label: str) -> DataFrame:
    """MAE, RMSE, share within a hundredth, share of rows with a prediction."""
    d = F.col(pred) - F.col(label)
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg((F.abs(d) < 0.01).cast("double")).alias("exact"), F.avg(F.col(pred).isNotNull().cast("double")).alias("coverage"))


def quadratic_kappa(df: DataFrame, a: str, b: str, classes: int) -> DataFrame:
    """Quadratically weighted kappa of two ratings 0..classes-1 (V12); 0 where chance explains all."""
    cell = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rx = cell.groupBy(F.col("x").alias("i")).agg(F.sum("n").alias("nx"))
    ry = cell.groupBy(F.col("y").alias("j")).agg(F.sum("n").alias("ny"))
    d2 = (F.col("i") - F.col("j")) * (F.col("i") - F.col("j")) / ((classes - 1) ** 2)
    full = rx.join(F.broadcast(ry), F.lit(True)).join(cell, (F.col("i") == F.col("x")) & (F.col("j") == F.col("y")), "left")
    agg = full.agg(F.sum(d2 * F.coalesce("n", F.lit(0))).alias("o"), F.sum(d2 * F.col("nx") * F.col("ny")).alias("e"), F.sum(F.coalesce("n", F.lit(0))).alias("t"))
    return agg.select(F.when(F.col("e") > 0, 1 - F.col("o") * F.col("t") / F.col("e")).otherwise(0.0).alias("kappa"))


def psi(df: DataFrame, value: str, group: str, base, other, bins: int = 10) -> DataFrame:
    """Population stability index over equal-width bins of the base group; empty shares count 0.001."""
    lim = df.filter(F.col(group) == base).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = df.filter(F.col(group).isin(base, other) & F.col(value).isNotNull()).join(F.broadcast(lim), F.lit(True))
    bin_ = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))))
    c = rows.groupBy(bin_.alias("bin")).agg(F.count_if(F.col(group) == base).alias("a"), F.count_if(F.col(group) == other).alias("b"))
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    w = W.partitionBy()
    s = grid.join(c, "bin", "left").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    s = s.select((F.col("a") / F.sum("a").over(w)).alias("p"), (F.col("b") / F.sum("b").over(w)).alias("q"))
    p, q = F.when(F.col("p") > 0, F.col("p")).otherwise(0.001), F.when(F.col("q") > 0, F.col("q")).otherwise(0.001)
    return s.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def cliffs_delta(df: DataFrame, value: str, label: str) -> DataFrame:
    """Cliff's delta between class 1 and class 0, which is 2 AUC - 1."""
    return auc(df, value, label).select((2 * F.col("auc") - 1).alias("delta"))


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """The H statistic with the correction for ties, and the number of groups."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    per = rows.groupBy(F.col(value).alias("v"), F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    ranks = average_ranks(rows, value).select(F.col("v").alias("v2"), "r", F.col("c").alias("ties"))
    sums = per.join(ranks, F.col("v") == F.col("v2")).groupBy("g").agg(F.sum(F.col("r") * F.col("c")).alias("rs"), F.sum("c").alias("n_g"))
    h = sums.agg(F.sum(F.col("rs") * F.col("rs") / F.col("n_g")).alias("s"), F.sum("n_g").cast("double").alias("n"), F.count(F.lit(1)).alias("k"))
    t = ranks.agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t"))
    raw = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)
    return h.join(F.broadcast(t), F.lit(True)).select((raw / (1 - F.col("t") / (F.pow("n", F.lit(3)) - F.col("n")))).alias("h"), F.col("k").alias("n_groups"))


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """``q``: p-values adjusted for the false discovery rate (V14). One row per test."""
    m, rank = F.count(p).over(W.partitionBy()), F.row_number().over(W.orderBy(p))
    rows = df.withColumn("_raw", F.col(p) * m / rank)
    return rows.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(W.orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)))).drop("_raw")


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information in nats of two discrete columns."""
    j = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    nx, ny, n = F.sum("n").over(W.partitionBy("x")), F.sum("n").over(W.partitionBy("y")), F.sum("n").over(W.partitionBy())
    rows = j.select((F.col("n") / n).alias("p"), F.log(F.col("n") * n / (nx * ny)).alias("l"))
    return rows.agg(F.coalesce(F.sum(F.col("p") * F.col("l")), F.lit(0.0)).alias("mi"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks (V12). Ranks come from counts of distinct values."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rank = lambda c: running_sums(rows.groupBy(c).agg(F.sum("n").alias("c")), [], [c], {"upto": F.col("c")}).select(c, (F.col("upto") - (F.col("c") - 1) / 2).alias(f"r{c}"))
    a, b = rank("x"), rank("y")
    s = rows.join(a, "x").join(b, "y")
    n, sx, sy = F.sum("n"), F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    cov = F.sum(F.col("n") * F.col("rx") * F.col("ry")) - sx * sy / n
    vx, vy = F.sum(F.col("n") * F.col("rx") * F.col("rx")) - sx * sx / n, F.sum(F.col("n") * F.col("ry") * F.col("ry")) - sy * sy / n
    return s.agg((cov / F.sqrt(vx * vy)).alias("rho"))


def screen(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows, null share, zero share and about how many distinct values every feature has, in one pass over the data."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(features):
        aggs += [F.count_if(F.col(f).isNull()).alias(f"m{i}"), F.count_if(F.col(f) == 0).alias(f"z{i}"), F.approx_count_distinct(f).alias(f"d{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("m"), F.col(f"z{i}").alias("z"), F.col(f"d{i}").alias("d")) for i, f in enumerate(features)])
    return wide.select("n", F.explode(rows).alias("r")).select("r.feature", "n", (F.col("r.m") / F.col("n")).alias("null_share"), (F.col("r.z") / F.col("n")).alias("zero_share"), F.col("r.d").alias("n_distinct"))


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-squared distribution with k degrees of freedom."""
    if x <= 0:
        return 1.0
    a, t = k / 2, x / 2
    if t < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= t / n
            total += term
        return 1 - total * math.exp(-t + a * math.log(t) - math.lgamma(a))
    b = t + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-t + a * math.log(t) - math.lgamma(a))
