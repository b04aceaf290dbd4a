"""Reading level of documents from vocabulary coverage and sentence complexity.

The words of all English documents are counted and ranked by frequency. For a document the smallest frequency-ranked vocabulary that covers a given
share of its words ends at that share's quantile of its word ranks. These coverage ranks and
simple measures of words and sentences are calibrated on human grades by linear discriminants
whose sums come from one SQL aggregation over all grades.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import stored

__all__ = ["FEATURES", "fit", "is_english", "profile", "score"]

#: Words whose ranks are broadcast at most; those of rarer words meet the documents in a join.
HEAD = 1 << 18
SHARES = (0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9)
MIN_WORDS = 40
FEATURES = (*[f"cover_{round(100 * s)}" for s in SHARES], "mean_len", "share_10", "share_13", "share_4", "stops", "commas")
_WORD = r"\p{L}+"


def is_english(lang: Column) -> Column:
    """en, eng or English in any letter case, padded or with a region; null is not."""
    return F.coalesce(F.lower(F.trim(lang)).rlike(r"^(en|eng|english)([-_].*)?$"), F.lit(False))


def profile(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id`` and FEATURES of every English document of MIN_WORDS or more words.

    Words for that minimum are separated by white space. Null texts, and texts without a letter,
    have no level. The result is stored, as fitting and scoring both read it. Repeated ids keep
    all their rows.
    """
    kept = docs.filter(is_english(F.col(lang)) & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kept = kept.filter(F.size(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")) >= MIN_WORDS)
    words = kept.select("doc_id", "text", F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    share = lambda cond: F.size(F.filter(F.col("len"), cond)) / n
    marks = lambda p: F.length(F.regexp_replace("text", p, "")) / n
    base = words.select("doc_id", "text", "w", F.transform("w", F.length).alias("len"), F.transform("w", lambda x: F.xxhash64(x)).alias("code"))
    base = base.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "code",
        (F.aggregate("len", F.lit(0), lambda a, x: a + x) / n).alias("mean_len"),
        share(lambda x: x >= 10).alias("share_10"),
        share(lambda x: x >= 13).alias("share_13"),
        share(lambda x: x <= 4).alias("share_4"),
        marks(r"[^.!?;]+").alias("stops"),
        marks(r"[^,]+").alias("commas"),
    )
    base = stored(base, "reading")
    ranks, beyond = _ranks(base)
    tokens = base.select("row", F.explode("code").alias("c"))
    each = tokens.join(F.broadcast(ranks), "c", "left")
    if beyond is not None:
        each = each.filter("rank IS NOT NULL").select("row", "rank").union(each.filter("rank IS NULL").select("row", "c").join(beyond, "c").select("row", "rank"))
    sorted_ranks = each.groupBy("row").agg(F.sort_array(F.collect_list("rank")).alias("r"))
    cover = [F.log(F.element_at("r", F.greatest(F.lit(1), F.ceil(F.lit(s) * F.size("r"))).cast("int")).cast("double")).alias(f"cover_{round(100 * s)}") for s in SHARES]
    full = base.drop("code").join(sorted_ranks.select("row", *cover), "row")
    return stored(full.select("doc_id", *FEATURES), "levels")


def _ranks(base: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``c, rank`` of the at most HEAD most frequent words by their 64-bit code, and of all others if there are any.

    A word's rank is one more than the number of words that are more frequent, so it follows from its
    count alone: the running number of words by count has one row for each count that occurs.
    """
    counts = stored(base.select(F.explode("code").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")), "words")
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counts.join(by_count.select("n", upto.alias("upto"), (upto - F.col("k") + 1).alias("rank")), "n")
    head = ranked.filter(F.col("upto") <= HEAD).select("c", "rank")
    if counts.count() <= HEAD:
        return head, None
    return head, ranked.filter(F.col("upto") > HEAD).select("c", "rank")


def fit(levels: DataFrame, labels: DataFrame, doc_id: str = "doc_id", band: str = "band") -> dict[int, tuple[list[float], float]] | None:
    """Linear discriminants by band from the grades: weights of FEATURES and an offset.

    Every non-null grade counts, a document graded twice counts twice. The means and the pooled
    covariance follow from sums that one aggregation takes over all grades; only those sums (one
    row per band) reach the driver. None where no grade meets a document.
    """
    graded = labels.filter(F.col(band).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(band).cast("int").alias("band")).join(levels, "doc_id")
    k = len(FEATURES)
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    prods = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    rows = graded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *sums, *prods).orderBy("band").collect()
    if not rows:
        return None
    total = sum(r["n"] for r in rows)
    pooled, means = np.zeros((k, k)), {}
    for r in rows:
        s = np.array([r[f"s{i}"] for i in range(k)])
        p = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        means[r["band"]] = s / r["n"]
        pooled += p - np.outer(s, s) / r["n"]
    pooled = pooled / max(1, total - len(rows))
    ridge = 1e-3 * np.diag(np.maximum(np.diag(pooled), 1e-6))
    inv = np.linalg.pinv(pooled + ridge)
    out = {}
    for r in rows:
        w = inv @ means[r["band"]]
        out[r["band"]] = (w.tolist(), float(math.log(r["n"] / total) - 0.5 * means[r["band"]] @ w))
    return out


def score(levels: DataFrame, model: dict[int, tuple[list[float], float]] | None) -> DataFrame:
    """``doc_id, band``: the band with the highest discriminant; ties go to the easier band. Without a model null."""
    if not model:
        return levels.select("doc_id", F.lit(None).cast("int").alias("band"))
    cases = []
    for band, (w, offset) in sorted(model.items()):
        value = F.lit(offset)
        for f, x in zip(FEATURES, w):
            value = value + F.lit(x) * F.col(f)
        cases.append(F.struct(value.alias("v"), F.lit(-band).alias("b")))
    best = F.greatest(*cases) if len(cases) > 1 else cases[0]
    return levels.select("doc_id", (-best["b"]).alias("band"))
