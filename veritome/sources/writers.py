"""Sinks: stages, folds, flat CSV, merged files, outcome rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["flat_csv", "merge_update", "predictions", "stage", "with_outcome", "write_folds"]


def stage(df: DataFrame, path: str, n: int, fmt: str = "json") -> None:
    """Append rows of a stage; the stage is a partition column."""
    df.withColumn("stage", F.lit(n)).write.mode("append").partitionBy("stage").format(fmt).save(path)


def with_outcome(df: DataFrame, outcomes: DataFrame, key: str, col: str) -> DataFrame:
    """Every record of a case with the outcome of the case (K2)."""
    return df.drop(col).join(outcomes.select(key, col), key, "left")


def merge_update(dest: DataFrame, fresh: DataFrame, keys: Sequence[str], path: str) -> None:
    """Rows of ``fresh`` replace those with the same key; written to a new path as a whole."""
    kept = dest.join(fresh.select(*keys), list(keys), "left_anti")
    kept.unionByName(fresh, allowMissingColumns=True).write.parquet(path)


def write_folds(df: DataFrame, path: str) -> None:
    """One folder per fold and split (K4)."""
    df.write.mode("overwrite").partitionBy("fold", "split").parquet(path)


def flat_csv(df: DataFrame, path: str) -> None:
    """Nested columns as JSON text, then CSV (K5)."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", "true").csv(path)


def predictions(df: DataFrame, path: str, fmt: str = "parquet", cols: Sequence[str] | None = None) -> None:
    """Predictions with all or only the named columns, in any format."""
    (df.select(*cols) if cols else df).write.mode("overwrite").format(fmt).save(path)
