"""Per-key results that a handful of hot keys cannot hold up.

Rows are first compressed to one row per (key, value) with its frequency. That grouping
spreads a hot key over as many tasks as it has values and combines on the map side, so the
second grouping by key alone sees one row per distinct value instead of one per record.
Counts, exact distinct counts, modes and weighted percentiles all follow from the
frequencies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

__all__ = ["compress", "hot_keys", "key_profile", "key_percentiles"]

#: Bits resolved by each level of the percentile search: a level holds at most 2**13 cells a key.
_LEVELS = (51, 38, 25, 12, 0)


def compress(df: DataFrame, key: str, value: str, at: str | None = None) -> DataFrame:
    """One row per (key, value): ``vf_n`` records, and the range of ``at`` where given.

    Null keys and null values are groups of their own. Extra columns are ignored.
    """
    aggs = [F.count(F.lit(1)).alias("vf_n")]
    if at is not None:
        aggs += [F.min(F.col(at)).alias("vf_first"), F.max(F.col(at)).alias("vf_last")]
    return df.groupBy(F.col(key).alias("vf_key"), F.col(value).alias("vf_value")).agg(*aggs)


def key_profile(df: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Per non-null key: rows, exact distinct non-null values, the modal value, first and last time.

    Ties of the mode go to the smallest value; a key whose values are all null has a null
    mode and no distinct value. An empty table gives no rows.
    """
    freq = compress(df, key, value, at).filter(F.col("vf_key").isNotNull())
    known = F.col("vf_value").isNotNull()
    best = F.min(F.when(known, F.struct((-F.col("vf_n")).alias("c"), F.col("vf_value").alias("v"))))
    return freq.groupBy(F.col("vf_key").alias(key)).agg(
        F.sum("vf_n").alias("n_rows"),
        F.count("vf_value").alias("n_values"),
        best.getField("v").alias("mode_value"),
        F.min("vf_first").alias("first_at"),
        F.max("vf_last").alias("last_at"),
    )


def hot_keys(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """Non-null keys that hold at least ``share`` of all rows, null keys counting in the whole.

    The whole is summed from the same compressed rows and meets them as a single row.
    """
    per_key = compress(df, key, value).groupBy("vf_key").agg(F.sum("vf_n").alias("n_rows"))
    whole = per_key.agg(F.sum("n_rows").alias("vf_all"))
    joined = per_key.join(F.broadcast(whole), F.lit(True))
    return joined.filter(F.col("vf_key").isNotNull() & (F.col("n_rows") >= F.col("vf_all") * F.lit(float(share)))).select(F.col("vf_key").alias(key), "n_rows")


def _sortable(c: Column) -> Column:
    """A whole number as 64 bits whose unsigned order is the number's order."""
    return c.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))


def key_percentiles(df: DataFrame, key: str, value: str, shares: Sequence[float]) -> DataFrame:
    """Exact nearest-rank percentiles of a whole-number column, per key, by weighted radix search.

    (key, value) frequencies are descended 13 bits at a time: each level counts the rows of at
    most 2**13 cells per key, finds the cell that holds the wanted rank and goes on inside it.
    No task ever holds the values of a key, however many it has. The rank of share p among n
    non-null values is ceil(p * n), at least 1. Keys without values, and null keys, are left out.
    """
    base = (
        df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
        .groupBy(F.col(key).alias("vf_key"), _sortable(F.col(value)).alias("vf_bits"))
        .agg(F.count(F.lit(1)).alias("vf_n"))
    )
    base = cut(base)
    want = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("vf_share")
    state = base.groupBy("vf_key").agg(F.sum("vf_n").alias("n")).select("vf_key", want, "n")
    state = state.select("vf_key", "vf_share", F.greatest(F.lit(1), F.ceil(F.col("vf_share") * F.col("n"))).alias("vf_rank"), F.lit(None).cast("bigint").alias("vf_at"))
    above = 64
    for low in _LEVELS:
        cell = F.shiftrightunsigned("vf_bits", low) if low else F.col("vf_bits")
        parent = F.lit(None).cast("bigint") if above == 64 else F.shiftrightunsigned("vf_bits", above)
        cells = base.groupBy("vf_key", parent.alias("vf_up"), cell.alias("vf_cell")).agg(F.sum("vf_n").alias("c"))
        met = state.join(cells.withColumnRenamed("vf_key", "vf_key2"), [F.col("vf_key2") == F.col("vf_key"), F.col("vf_up").eqNullSafe(F.col("vf_at"))])
        order = "CASE WHEN vf_cell >= 0 THEN 0 ELSE 1 END, vf_cell"  # unsigned order of whole 64-bit cells
        met = met.withColumn("upto", F.expr(f"sum(c) OVER (PARTITION BY vf_key, vf_share ORDER BY {order})"))
        met = met.filter((F.col("upto") >= F.col("vf_rank")) & (F.col("upto") - F.col("c") < F.col("vf_rank")))
        state = met.select("vf_key", "vf_share", (F.col("vf_rank") - (F.col("upto") - F.col("c"))).alias("vf_rank"), F.col("vf_cell").alias("vf_at"))
        above = low
    return state.select(F.col("vf_key").alias(key), F.col("vf_share").alias("share"), F.col("vf_at").bitwiseXOR(F.lit(-(1 << 63))).alias("value"))
