"""Filters and projections over quotes and cases."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_group

__all__ = [
    "deflate", "dominant_key_rows", "drop_outliers", "drop_values", "filter_report", "governed_columns", "label_margin", "padded_select",
    "prefix_flags", "rates", "sharpen", "training_columns", "transforms", "valid_groups", "with_metadata",
]


def padded_select(df: DataFrame, schema: Sequence[tuple[str, str]]) -> DataFrame:
    """The named columns with soft casts; a missing column comes out as a typed null (F1)."""
    have = set(df.columns)
    return df.select(*[(F.expr(f"try_cast(`{c}` AS {t})") if c in have else F.lit(None).cast(t)).alias(c) for c, t in schema])


def drop_values(df: DataFrame, col: str, values: Iterable[str], substring: bool = False) -> DataFrame:
    """Rows whose value is none of those listed; null stays."""
    values = list(values)
    hit = F.col(col).isin(values)
    if substring:
        hit = F.lit(False)
        for v in values:
            hit = hit | F.col(col).contains(v)
    return df.filter(~F.coalesce(hit, F.lit(False)))


def filter_report(df: DataFrame, keep: Column, *measures: tuple[str, Column]) -> DataFrame:
    """Before and after a filter in one pass: rows and means of measures."""
    kept = F.coalesce(keep, F.lit(False))
    aggs = [F.count(F.lit(1)).alias("n_before"), F.count_if(kept).alias("n_after")]
    for name, m in measures:
        aggs += [F.avg(m).alias(f"{name}_before"), F.avg(F.when(kept, m)).alias(f"{name}_after")]
    return df.agg(*aggs)


def valid_groups(df: DataFrame, key: str, good: Column) -> DataFrame:
    """Rows of the groups in which ``good`` holds for every row: one aggregation and a semi join."""
    ok = df.groupBy(key).agg(F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("ok")).filter("ok = 1").select(key)
    return df.join(ok, key, "left_semi")


def dominant_key_rows(df: DataFrame, owner: str, key: str) -> DataFrame:
    """Rows of each owner's most frequent key; ties go to the smaller key (F8)."""
    counts = df.filter(F.col(owner).isNotNull() & F.col(key).isNotNull()).groupBy(owner, key).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(owner).agg(F.min_by(key, F.struct(-F.col("n"), F.col(key))).alias(key))
    return df.join(best, [owner, key], "left_semi")


def drop_outliers(df: DataFrame, col: str, most: float, missing: bool = True) -> DataFrame:
    """Rows up to a limit; null stays unless ``missing`` is off."""
    return df.filter(F.coalesce(F.col(col) <= most, F.lit(missing)))


def with_metadata(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Columns that must not be learned from get a marked name."""
    return df.withColumnsRenamed({c: f"_metadata_{c.lstrip('_')}" for c in cols})


def training_columns(df: DataFrame, never: Iterable[str] = (), patterns: Iterable[str] = (), system: Iterable[str] = ()) -> list[str]:
    """Numeric and boolean columns that no name and no pattern (matched from the start) rules out."""
    out = set(never) | set(system)
    kinds = ("int", "bigint", "smallint", "tinyint", "float", "double", "boolean", "decimal")
    return [c for c, t in df.dtypes if t.startswith(kinds) and c not in out and not any(re.match(p, c) for p in patterns)]


def governed_columns(cols: Iterable[str], allowed: Iterable[str], blocked: Iterable[str], prefixes: Sequence[str] = ("interpretable_", "int_")) -> list[str]:
    """Allowed columns in order; a blocked one is an error."""
    cols, blocked, allowed = list(cols), set(blocked), set(allowed)
    bad = [c for c in cols if c in blocked]
    if bad:
        raise ValueError(f"blocked columns: {bad}")
    return [c for c in cols if c in allowed or c.startswith(tuple(prefixes))]


def rates(df: DataFrame, counts: Iterable[str], size: str, per: float = 1000.0) -> DataFrame:
    """A rate and a flag for every count (F16)."""
    new = {}
    for c in counts:
        new[f"{c}_rate"] = F.col(c) * per / F.greatest(F.col(size), F.lit(1))
        new[f"{c}_present"] = F.coalesce(F.col(c) > 0, F.lit(False)).cast("int")
    return df.withColumns(new)


def label_margin(c: Column, edges: Sequence[float], margin: float = 0.03) -> Column:
    """Whether a value lies away from every edge by more than a share of it."""
    ok = F.lit(True)
    for e in edges:
        ok = ok & (F.abs(c - e) > abs(e) * margin)
    return ok


def sharpen(df: DataFrame, col: str, edges: Sequence[float], margin: float = 0.03) -> DataFrame:
    """Rows whose label is not close to an edge."""
    return df.filter(label_margin(F.col(col), edges, margin))


def prefix_flags(df: DataFrame, key: str, number: str, start: str, length: str, share: float, budget: float) -> DataFrame:
    """Whether a row is within the first share of its group's numbers, and within a token budget.

    The share admits numbers up to max(1, floor(share * largest)); what is missing is outside.
    """
    df = with_group(df, [key], {"_last": F.max(number)})
    within = F.coalesce(F.col(number) <= F.greatest(F.lit(1), F.floor(F.col("_last") * share)), F.lit(False))
    fits = F.coalesce(F.col(start) + F.col(length) <= budget, F.lit(False))
    return df.withColumns({"in_prefix": within, "in_budget": fits}).drop("_last")


def transforms(c: Column, cap: float | None = None) -> dict[str, Column]:
    """Presence, log1p, asinh(3000 x) and a value capped at ``cap``."""
    out = {"present": (c > 0).cast("int"), "log1p": F.log1p(c), "asinh": F.asinh(c * 3000)}
    if cap is not None:
        out["capped"] = F.least(c, F.lit(cap))
    return out


def deflate(df: DataFrame, amount: str, year: str, month: str, index: DataFrame) -> DataFrame:
    """``real``: amounts at the price level 100 of an index by year and month.

    Without the month the mean of the year counts, without the year the amount stays as it is. An
    index holds a few hundred rows by nature; it is broadcast.
    """
    monthly = index.select(F.col("year").alias("ix_y"), F.col("month").alias("ix_m"), F.col("cpi").alias("ix_month"))
    annual = index.groupBy(F.col("year").alias("ix_y2")).agg(F.avg("cpi").alias("ix_year"))
    out = df.join(F.broadcast(monthly), (F.col(year) == F.col("ix_y")) & (F.col(month) == F.col("ix_m")), "left").join(F.broadcast(annual), F.col(year) == F.col("ix_y2"), "left")
    level = F.coalesce("ix_month", "ix_year")
    return out.withColumn("real", F.coalesce(F.col(amount) * 100 / level, F.col(amount))).drop("ix_y", "ix_m", "ix_y2", "ix_month", "ix_year")
