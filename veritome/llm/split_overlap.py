"""Same or near-same records across splits: a weighted cosine join between splits.

A text is a set of terms: its runs of SHINGLE words (with marks before the first and after the
last word), a repeated run counting as a term of its own each time. A term weighs the more, the
rarer it is in the whole corpus. Changing, adding or dropping one word touches at most SHINGLE
terms of either text, so two texts of which k words are touched share at least the weight that
a text keeps when its SHINGLE * k heaviest terms go: this lower bound on the dot product holds
for any weights, and it drives everything below.

* Inverted lists hold, per text, only its SHINGLE * K + EXTRA heaviest terms in one global order:
  the residual norm of the lighter rest bounds what they can add, so a pair that reaches the
  bound must share at least a known weight within the lists.
* Where lists of the evaluation side meet lists of the training side, the shared weights of each
  pair are summed, and the pair is dropped where the sum and the residual norm stay below the
  bound of either text.
* For the pairs that are left the dot product is taken exactly over all terms, and those that
  reach both bounds are aligned word by word.

Texts that are equal word by word are one entry throughout; copies never meet in the join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored

__all__ = ["cross_split_pairs", "distinct_texts", "near_text_links", "overlap_report", "split_name", "words_of"]

#: Cells of the table of term frequencies. It is counted over every text; terms that share a cell
#: share a frequency, which changes how selective a term is thought to be, never the result.
CELLS = 1 << 20
_BLOCK = 1 << 12
#: Tasks whose counts are added up in one group of the first round.
_ROUND = 512
#: Words in a term.
SHINGLE = 3
#: Terms in a list beyond those that a pair could lose: with more of them fewer false pairs get through.
EXTRA = 4
#: One word in TOUCH of the longer text may differ.
TOUCH = 10
_WORD = r"[\p{L}\p{Nd}]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(c: Column) -> Column:
    """The words of a text, joined by single blanks: runs of letters and digits in lower case."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0)), " ")


def split_name(c: Column) -> Column:
    """train, val or test whatever the letter case and padding; all else is null."""
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(s.isin("train", "val", "test"), s)


def _hash_words(words: np.ndarray) -> np.ndarray:
    codes, uniques = pd.factorize(words)
    return pd.util.hash_array(np.asarray(uniques, dtype=object), categorize=False)[codes]


def _flat(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and the number of words of each text."""
    lists = [t.split(" ") for t in texts]
    n = np.fromiter((len(x) for x in lists), dtype=np.int64, count=len(lists))
    if not len(lists):
        return np.empty(0, np.uint64), n
    return _hash_words(np.array([w for x in lists for w in x], dtype=object)), n


def term_frequencies(texts: DataFrame) -> np.ndarray:
    """How many terms of the corpus fall into each of CELLS cells: a table of fixed size.

    Each task counts into one array and hands it on in blocks, which are added up in two rounds, so
    that no group grows with the number of tasks but by its square root.
    """

    def count(batches):
        total = np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            h, n = _flat(b.column(0).to_pandas())
            if len(n):
                term, *_ = _terms(h, n, None)
                total += np.bincount((term % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        blocks = total.reshape(-1, _BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([blocks[u].tobytes() for u in used], pa.binary())], names=["block", "counts"])

    def add(table):
        total = sum(np.frombuffer(x, dtype=np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = texts.select("words").mapInArrow(count, "block int, counts binary").withColumn("part", F.floor(F.spark_partition_id() / _ROUND))
    rows = "block int, counts binary"
    got = parts.groupBy("part", "block").applyInArrow(add, rows).groupBy("block").applyInArrow(add, rows).collect()  # CELLS numbers at most
    table = np.ones(CELLS)
    for r in got:
        table[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.maximum(1, np.frombuffer(r["counts"], dtype=np.int64))
    return table


def distinct_texts(rows: DataFrame) -> DataFrame:
    """``key, tid, words, in_train, in_eval`` from ``record_id, words, key, split``: one row per distinct text.

    The only shuffle that carries texts; the result is stored, as everything after reads it.
    """
    train = F.col("split") == "train"
    texts = rows.groupBy("key").agg(F.min("record_id").alias("tid"), F.first("words").alias("words"), F.max(train).alias("in_train"), F.max(~train).alias("in_eval"))
    return stored(texts, "texts")


def _terms(h: np.ndarray, n: np.ndarray, freq: np.ndarray | None):
    """Flat term hashes, squared weights and owners of a batch; n words make n + SHINGLE - 1 terms."""
    rows = len(n)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    count = n + SHINGLE - 1
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    owner = np.repeat(np.arange(rows), count)
    pos = np.arange(count.sum()) - start[owner]
    term = np.zeros(len(owner), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for s in range(SHINGLE):
            at = pos - (SHINGLE - 1) + s
            inside = (at >= 0) & (at < n[owner])
            word = np.where(inside, h[np.clip(first[owner] + at, 0, len(h) - 1)], np.uint64(7))
            term = (term ^ word) * _MIX
            term ^= term >> np.uint64(32)
    sq = np.ones(len(term)) if freq is None else 1.0 + np.log(freq.sum() / freq[(term % np.uint64(CELLS)).astype(np.int64)])
    if freq is None:
        return term, sq, owner, start, count
    # a repeated term becomes a term of its own: number the repeats within each text
    order = np.lexsort((term, owner))
    t, o = term[order], owner[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
    run = np.arange(len(t)) - np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    with np.errstate(over="ignore"):
        term[order] = t + run.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return term, sq, owner, start, count


def _postings(texts: DataFrame, box) -> DataFrame:
    """``term, tid, n, need, sq``: the inverted lists of texts long enough to allow a change.

    need is the weight that a partner must share within the lists at least.
    """

    def lists(batches):
        table = box.value
        for b in batches:
            tid = b.column(0).to_numpy()
            h, n = _flat(b.column(1).to_pandas())
            if not len(n):
                continue
            k = n // (TOUCH - 1)  # the longer text has at most n / 0.9 words
            term, sq, owner, start, count = _terms(h, n, table)
            order = np.lexsort((term, -sq, owner))
            term, sq, owner = term[order], sq[order], owner[order]
            upto = np.cumsum(sq)
            before = np.concatenate([[0.0], upto])[start]
            total = upto[start + count - 1] - before
            rank = np.arange(len(term)) - start[owner]
            cut_at = np.minimum(SHINGLE * k, count)
            lost = upto[start + cut_at - 1] - before
            listed = np.minimum(cut_at + EXTRA, count)
            rest = total - (upto[start + listed - 1] - before)
            # the factor covers the rounding of float32 sums
            need = np.maximum((total - lost - rest) * 0.9999, 0.5)
            keep = (rank < listed[owner]) & (k[owner] > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(term[keep].view(np.int64)), pa.array(tid[owner[keep]]), pa.array(n[owner[keep]].astype(np.int32)), pa.array(need[owner[keep]].astype(np.float32)), pa.array(sq[keep].astype(np.float32))],
                names=["term", "tid", "n", "need", "sq"],
            )

    return texts.select("tid", "words").mapInArrow(lists, "term long, tid long, n int, need float, sq float")


def _candidates(texts: DataFrame, box) -> DataFrame:
    """``ta, tb``: distinct texts, one of train and one of an evaluation split, that pass the bounds."""
    a = _postings(texts.filter("in_eval"), box).toDF("term", "ta", "na", "need_a", "sq")
    b = _postings(texts.filter("in_train"), box).drop("sq").toDF("term", "tb", "nb", "need_b")
    close = F.abs(F.col("na") - F.col("nb")) <= F.floor(F.greatest("na", "nb") / TOUCH)
    met = a.join(b, "term").filter((F.col("ta") != F.col("tb")) & close)
    pairs = met.groupBy("ta", "tb").agg(F.sum("sq").alias("shared"), F.max(F.greatest("need_a", "need_b")).alias("need"))
    return pairs.filter("shared >= need").select("ta", "tb")


def _edit_within(wa: list[list[str]], wb: list[list[str]]) -> np.ndarray:
    """Whether each pair of word lists differs in at most a tenth of the longer one: banded, all pairs at once."""
    p = len(wa)
    na = np.array([len(x) for x in wa])
    nb = np.array([len(x) for x in wb])
    k = np.maximum(na, nb) // TOUCH
    ok = np.abs(na - nb) <= k
    if not p or not ok.any():
        return ok
    flat = np.array([w for x in wa for w in x] + [w for x in wb for w in x], dtype=object)
    codes = pd.factorize(flat)[0]
    la, lb, band = na.max(), nb.max(), int(k.max())
    A = np.full((p, la), -1)
    B = np.full((p, lb + 2 * band + 2), -2)
    A[np.arange(la)[None, :] < na[:, None]] = codes[: na.sum()]
    inside = (np.arange(B.shape[1])[None, :] >= band) & (np.arange(B.shape[1])[None, :] < band + nb[:, None])
    B[inside] = codes[na.sum() :]
    width = 2 * band + 1
    far = 1 << 20
    row = np.full((p, width), far)
    row[:, band:] = np.arange(width - band)[None, :]  # i = 0: j = d - band edits
    done = np.full(p, far)
    reached = na == 0
    rows_all = np.arange(p)
    done[reached] = row[rows_all, np.clip(nb - na + band, 0, width - 1)][reached]
    for i in range(1, la + 1):
        new = np.full((p, width), far)
        hit = B[:, i - 1 : i - 1 + width] == A[:, i - 1 : i]
        new = np.minimum(row + np.where(hit, 0, 1), np.concatenate([row[:, 1:] + 1, np.full((p, 1), far)], axis=1))
        j = i + np.arange(width) - band
        new[:, j < 0] = far
        if band >= i:
            new[:, band - i] = i
        for c in range(1, width):
            np.minimum(new[:, c], new[:, c - 1] + 1, out=new[:, c])
        row = new
        reached = na == i
        if reached.any():
            done[reached] = row[rows_all, np.clip(nb - na + band, 0, width - 1)][reached]
    return ok & (done <= k)


def _dots(ta: pd.Series, tb: pd.Series, freq: np.ndarray) -> np.ndarray:
    """Whether the exact dot product of each pair reaches the bounds of both texts."""
    p = len(ta)
    if not p:
        return np.zeros(0, bool)
    h, n = _flat(pd.concat([ta, tb]))
    term, sq, owner, start, count = _terms(h, n, freq)
    order = np.lexsort((term, -sq, owner))
    s = sq[order]
    upto = np.concatenate([[0.0], np.cumsum(s)])
    total = upto[start + count] - upto[start]
    pair = owner % p
    k2 = SHINGLE * (np.maximum(n[:p], n[p:]) // TOUCH)
    lost = upto[start + np.minimum(np.concatenate([k2, k2]), count)] - upto[start]
    o = np.lexsort((term, pair))
    t, q, w = term[o], pair[o], sq[o]
    both = np.zeros(len(t), bool)
    both[1:] = (t[1:] == t[:-1]) & (q[1:] == q[:-1])
    dot = np.bincount(q[both], weights=w[both], minlength=p)
    floor = np.maximum((total - lost)[:p], (total - lost)[p:])
    return dot >= floor - 1e-6 * np.abs(floor) - 1e-9


def near_text_links(texts: DataFrame) -> DataFrame:
    """``ta, tb``: pairs of different texts (evaluation, training) that are nearly the same.

    ``texts`` is the frame of ``distinct_texts``. At most one word in ten of the longer text may
    be changed, added or dropped. A text without words matches nothing.
    """
    box = texts.sparkSession.sparkContext.broadcast(term_frequencies(texts))  # CELLS doubles, eight megabytes
    pairs = _candidates(texts, box)
    left = texts.filter("in_eval").select(F.col("tid").alias("ta"), F.col("words").alias("wa"))
    right = texts.filter("in_train").select(F.col("tid").alias("tb"), F.col("words").alias("wb"))
    full = pairs.join(left, "ta").join(right, "tb").select("ta", "tb", "wa", "wb")

    def settle(batches):
        for b in batches:
            pdf = b.to_pandas()
            pdf = pdf[_dots(pdf["wa"], pdf["wb"], box.value)]
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                good = part[_edit_within([w.split(" ") for w in part["wa"]], [w.split(" ") for w in part["wb"]])]
                yield pa.RecordBatch.from_arrays([pa.array(good["ta"].to_numpy(np.int64)), pa.array(good["tb"].to_numpy(np.int64))], names=["ta", "tb"])

    return full.mapInArrow(settle, "ta long, tb long")


def prepared(df: DataFrame, *more: Column, id_col: str = "record_id", text: str = "text", split: str = "split") -> DataFrame:
    """``record_id, words, key, split`` of the rows that have a known split and at least one word."""
    rows = df.select(F.col(id_col).alias("record_id"), words_of(F.col(text)).alias("words"), split_name(F.col(split)).alias("split"), *more)
    rows = rows.filter(F.col("split").isNotNull() & (F.col("words") != ""))
    return rows.withColumn("key", F.unhex(F.md5("words")))


def cross_split_pairs(df: DataFrame) -> DataFrame:
    """``eval_id, train_id, split``: all pairs of records with the same or nearly the same text.

    One record stands in train, the other in val or test. Rows whose text is null or without
    words, or whose split is null or unknown, pair with nothing. Repeated rows are rows.
    """
    rows = prepared(df)
    texts = distinct_texts(rows)
    same = texts.filter("in_train AND in_eval").select(F.col("tid").alias("ta"), F.col("tid").alias("tb"))
    links = same.union(near_text_links(texts))
    member = rows.select("record_id", "key", "split").join(texts.select("tid", "key"), "key").select("record_id", "tid", "split")
    ev = member.filter("split <> 'train'").select(F.col("tid").alias("ta"), F.col("record_id").alias("eval_id"), "split")
    tr = member.filter("split = 'train'").select(F.col("tid").alias("tb"), F.col("record_id").alias("train_id"))
    return links.join(ev, "ta").join(tr, "tb").select("eval_id", "train_id", "split")


def overlap_report(df: DataFrame, source: str = "source") -> DataFrame:
    """Per evaluation split and source: rows, rows that overlap train, and overlapping pairs.

    Pairs are counted from the number of training records behind each text, never by listing
    them. A null source is a group of its own.
    """
    rows = prepared(df, F.col(source).alias("source"))
    texts = distinct_texts(rows)
    same = texts.filter("in_train AND in_eval").select(F.col("tid").alias("ta"), F.col("tid").alias("tb"))
    links = same.union(near_text_links(texts))
    per = rows.groupBy("key", "split", "source").agg(F.count(F.lit(1)).alias("n")).join(texts.select("tid", "key"), "key")
    train = per.filter("split = 'train'").groupBy(F.col("tid").alias("tb")).agg(F.sum("n").alias("n_train"))
    hits = links.join(train, "tb").groupBy("ta").agg(F.sum("n_train").alias("partners"))
    ev = per.filter("split <> 'train'").join(hits.withColumnRenamed("ta", "tid"), "tid", "left")
    return ev.groupBy("split", "source").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("partners").isNotNull(), F.col("n")).otherwise(0)).alias("n_overlapping"),
        F.coalesce(F.sum(F.col("n") * F.col("partners")), F.lit(0)).alias("n_pairs"),
    )
