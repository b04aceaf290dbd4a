"""Splits that keep related cases together: components, then a component swap search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import cut

__all__ = ["assign_splits", "balance", "case_groups", "related_groups"]

#: Components with at least this share of the rows are moved one by one, so there are at most
#: 1 / UNIT_SHARE of them; all smaller ones are hashed into BUNDLES bundles that move whole.
UNIT_SHARE = 1 / 2048
BUNDLES = 1024
#: Different labels at most; with more the balance of labels would mean nothing.
MAX_LABELS = 64
TRAIN_FOLDS = 5
CHAINS = 12
STEPS = 12_000


def _squeezed(c: str):
    return F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))


def case_groups(cases: DataFrame, quotes: DataFrame) -> DataFrame:
    """``case_id, group_id`` for every case that is related to another one.

    Cases are related when one names the other in lead_case_id (letter case and padding
    ignored) or when quotes with the same doc_id stand under both; the relation passes on. A
    lead that is no case of either table, and a case that names itself, relate nothing. Null
    ids are ignored. group_id is the smallest case_id of the set. Columns beyond those named
    are never read.
    """
    under = quotes.select("doc_id", "case_id").filter(F.col("case_id").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id", "case_id").agg(F.count(F.lit(1)).alias("n"))
    first = under.groupBy("doc_id").agg(F.min("case_id").alias("low"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared = under.join(first, "doc_id").filter(F.col("case_id") != F.col("low")).select(F.col("case_id").alias("a"), F.col("low").alias("b"))
    known = cases.select("case_id").union(under.select("case_id")).filter(F.col("case_id").isNotNull()).distinct().select(F.col("case_id").alias("b"), _squeezed("case_id").alias("name"))
    leads = cases.filter(F.col("case_id").isNotNull() & F.col("lead_case_id").isNotNull()).select(F.col("case_id").alias("a"), _squeezed("lead_case_id").alias("name"))
    named = leads.join(known, "name").select("a", "b")
    found = connected_components(shared.union(named), "a", "b")
    return found.select(F.col("node").alias("case_id"), F.col("component").alias("group_id"))


def related_groups(cases: DataFrame, quotes: DataFrame) -> DataFrame:
    """``record_id, unit, label`` of every quote: the set of records that must stay together.

    A quote with a case belongs to the group of its case. A quote without one belongs to the
    case group that its doc_id stands under, else to its doc_id, else it stands alone.
    """
    groups = case_groups(cases, quotes)
    labels = cases.filter(F.col("case_id").isNotNull()).groupBy("case_id").agg(F.min("label").alias("label"))
    owner = quotes.filter(F.col("case_id").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("case_id").alias("doc_case"))
    orphan = quotes.filter(F.col("case_id").isNull()).select("record_id", "doc_id").join(owner, "doc_id", "left").select("record_id", F.col("doc_case").alias("case_id"), "doc_id")
    rows = quotes.filter(F.col("case_id").isNotNull()).select("record_id", "case_id", "doc_id").unionByName(orphan)
    rows = rows.join(groups, "case_id", "left").join(labels, "case_id", "left")
    unit = F.coalesce(
        F.concat(F.lit("c:"), F.coalesce("group_id", "case_id")),
        F.concat(F.lit("d:"), "doc_id"),
        F.concat(F.lit("r:"), F.col("record_id").cast("string")),
    )
    return rows.select("record_id", unit.alias("unit"), "label")


def _targets(shares: dict[str, float]) -> tuple[np.ndarray, list[tuple[str, int | None]]]:
    bins: list[tuple[str, int | None]] = [("train", f) for f in range(TRAIN_FOLDS)] + [("val", TRAIN_FOLDS), ("test", None)]
    return np.array([shares["train"] / TRAIN_FOLDS] * TRAIN_FOLDS + [shares["val"], shares["test"]]), bins


def _cost(load: np.ndarray, target: np.ndarray, mix: np.ndarray) -> float:
    """load: bins x (rows, labels) as shares of all rows. The split totals weigh most."""
    size = load[:, 0]
    total = size[:TRAIN_FOLDS].sum() - target[:TRAIN_FOLDS].sum()
    split = total**2 + ((size[TRAIN_FOLDS:] - target[TRAIN_FOLDS:]) ** 2).sum()
    folds = ((size - target) ** 2).sum()
    label = ((load[:, 1:] - target[:, None] * mix[None, :]) ** 2).sum()
    return float(100 * split + folds + 0.2 * label)


def _anneal(seed: int, w: np.ndarray, start: np.ndarray, target: np.ndarray, mix: np.ndarray) -> tuple[float, np.ndarray]:
    """One chain: moves and swaps of whole units under a falling temperature; its best state."""
    rng = np.random.default_rng(seed)
    at = start.copy()
    nb, n = len(target), len(w)
    load = np.zeros((nb, w.shape[1]))
    np.add.at(load, at, w)
    cost = _cost(load, target, mix)
    best, kept = cost, at.copy()
    # a big unit is picked as often as all the small ones together, else it would hardly move
    p = 0.5 * w[:, 0] / max(w[:, 0].sum(), 1e-12) + 0.5 / n
    picks = rng.choice(n, size=(STEPS, 2), p=p / p.sum())
    bins, kind, luck = rng.integers(0, nb, STEPS), rng.random(STEPS) < 0.5, rng.random(STEPS)
    hot = max(cost, 1e-9)
    for t in range(STEPS):
        i, j = picks[t]
        a = at[i]
        b = at[j] if kind[t] else bins[t]
        if a == b:
            continue
        delta = w[i] - w[j] if kind[t] else w[i]
        load[a] -= delta
        load[b] += delta
        new = _cost(load, target, mix)
        heat = hot * 0.1 * (1 - t / STEPS) ** 4 * 1e-2
        if new <= cost or (heat > 0 and luck[t] < np.exp(-(new - cost) / heat)):
            at[i] = b
            if kind[t]:
                at[j] = a
            cost = new
            if cost < best:
                best, kept = cost, at.copy()
        else:
            load[a] += delta
            load[b] -= delta
    return best, kept


def assign_splits(rows: DataFrame, shares: dict[str, float] | None = None, seed: int = 7) -> DataFrame:
    """``record_id, unit, split, fold`` from ``record_id, unit, label``.

    Start: each bundle or big component goes to a bin by hash. Then CHAINS annealing chains run
    in parallel as Spark tasks over the bounded unit table (at most 2048 big components and
    1024 bundles), and the best end state wins. Bins are five train folds, val (fold 5) and
    test (fold null). A unit never straddles two bins, whatever its size; an empty table gives
    no rows. A null label is a label; more than MAX_LABELS labels are refused. Components below
    1/2048 of the rows move in hashed bundles of about 1/1024 of them, so the shares come out as near
    as a bundle, or as the components above that size, allow.
    """
    spark = rows.sparkSession
    target, bins = _targets(shares or {"train": 0.70, "val": 0.15, "test": 0.15})
    rows = cut(rows)
    labels = [r["label"] for r in rows.select("label").distinct().orderBy("label").limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    cells = [F.count_if(F.col("label").eqNullSafe(x)).alias(f"l{k}") for k, x in enumerate(labels)]
    comps = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), *cells)
    whole = rows.agg(F.count(F.lit(1)).alias("all"))
    comps = comps.join(F.broadcast(whole), F.lit(True))
    big = F.col("n") >= F.col("all") * F.lit(UNIT_SHARE)
    comps = cut(comps.withColumn("mover", F.when(big, F.concat(F.lit("u:"), F.col("unit"))).otherwise(F.concat(F.lit("b:"), F.pmod(F.xxhash64("unit"), F.lit(BUNDLES)).cast("string")))))
    movers = comps.groupBy("mover").agg(F.sum("n").alias("n"), *[F.sum(f"l{k}").alias(f"l{k}") for k in range(len(labels))]).orderBy("mover").toPandas()
    if movers.empty:
        return rows.select("record_id", "unit", F.lit(None).cast("string").alias("split"), F.lit(None).cast("int").alias("fold"))
    w = movers[["n", *[f"l{k}" for k in range(len(labels))]]].to_numpy(float)
    w /= w[:, 0].sum()
    mix = w[:, 1:].sum(axis=0)
    edges = np.cumsum(target)
    hashed = np.array([int(h, 16) / 16**8 for h in movers["mover"].map(lambda m: f"{pd.util.hash_array(np.array([m], dtype=object))[0] >> 32:08x}")])
    start = np.minimum(np.searchsorted(edges, hashed, side="right"), len(target) - 1)

    def chains(batches):
        for pdf in batches:
            for c in pdf["id"]:
                cost, at = _anneal(seed + int(c), w, start, target, mix)
                yield pd.DataFrame({"chain": [int(c)], "cost": [cost], "at": [at.tolist()]})

    best = spark.range(0, CHAINS, 1, CHAINS).mapInPandas(chains, "chain long, cost double, at array<int>").orderBy("cost", "chain").first()
    placed = pd.DataFrame({"mover": movers["mover"], "split": [bins[k][0] for k in best["at"]], "fold": [-1 if bins[k][1] is None else bins[k][1] for k in best["at"]]})
    table = spark.createDataFrame(placed, "mover string, split string, fold int").withColumn("fold", F.when(F.col("fold") >= 0, F.col("fold")))
    where = comps.select("unit", "mover").join(F.broadcast(table), "mover").select("unit", "split", "fold")
    return rows.select("record_id", "unit").join(where, "unit").select("record_id", "unit", "split", "fold")


def balance(assigned: DataFrame) -> DataFrame:
    """Rows, units and share of every split."""
    per = assigned.groupBy("split", "unit").agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_units"))
    whole = per.agg(F.sum("n_rows").alias("all"))
    return per.join(F.broadcast(whole), F.lit(True)).select("split", "n_rows", "n_units", F.round(F.col("n_rows") / F.col("all"), 6).alias("share"))
