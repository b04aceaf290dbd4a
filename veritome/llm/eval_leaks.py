"""Evaluation texts that leak into a corpus: suffix arrays over shards of the corpus.

Every shard (a run of documents of bounded size within a partition) gets a suffix array over
its word codes: the positions whose first two words start some item suffix, in the order of
their first SEED words. Every suffix of every evaluation item is searched in it by binary
search, which yields all places that agree with it in at least SEED words. Each place is taken to
the full length of its verbatim match on both sides; ``matches`` reports the longest ones with
their positions. A match of MIN_WORDS words is a leak by itself; a shorter one is taken on across
changed, added or dropped words.

A stretch of L >= MIN_WORDS item words with at most one in SLACK touched always holds a verbatim
run of SEED words: with e <= L / 8 edits some run has at least (L - e) / (e + 1) >= 5 words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored

__all__ = ["clean_corpus", "leaks", "matches"]

MIN_WORDS = 15
SLACK = 8
SEED = 5
#: Words of a shard, and words of the evaluation items that one pass holds; both bound memory.
SHARD_WORDS = 1 << 20
ITEM_WORDS = 1 << 21
#: Pairs of an item suffix and a place that are compared at once.
PAIRS = 1 << 20
_WORD = re.compile(r"[^\W_]+")
#: Numbers that are no digits, such as fractions: \w takes them in.
_ODD = frozenset(chr(c) for c in range(0x20000) if unicodedata.category(chr(c)) in ("No", "Nl"))


def _words(t: str) -> list[str]:
    """The runs of letters and digits of a text."""
    if not t.isascii() and not _ODD.isdisjoint(t):
        t = "".join(" " if c in _ODD else c for c in t)
    return _WORD.findall(t)



def _bounds(codes: np.ndarray, sa: np.ndarray, pattern: np.ndarray, length: int, after: bool) -> np.ndarray:
    """Binary search of all rows of ``pattern`` (m x length) at once: first suffix not below it, or above it."""
    m, n = len(pattern), len(codes)
    lo, hi = np.zeros(m, dtype=np.int64), np.full(m, len(sa), dtype=np.int64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        at = sa[np.minimum(mid, len(sa) - 1)]
        cmp = np.zeros(m, dtype=np.int8)
        for d in range(length):
            here = np.where(at + d < n, codes[np.minimum(at + d, n - 1)], -1)
            cmp = np.where(cmp == 0, np.sign(here - pattern[:, d]).astype(np.int8), cmp)
        below = (cmp < 0) | ((cmp == 0) if after else False)
        lo = np.where(open_ & below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)


def _holds(item: np.ndarray, doc: np.ndarray, di: int, ii: int) -> bool:
    """Whether an allowed stretch of the item, passing through the seed at (ii, di), stands in the document.

    Extends the seed to both sides: for each number of edits the farthest item position that can
    be reached, by diagonals. The stretch may end anywhere, so the reach for every number of edits counts.
    """
    top = len(item) // SLACK

    def reach(a: np.ndarray, b: np.ndarray) -> list[int]:
        # far[e]: most words of a consumed with e edits, over all diagonals
        far: dict[int, int] = {0: 0}
        out = []
        for e in range(top + 1):
            if e:
                new: dict[int, int] = {}
                for d, x in far.items():
                    for nd, nx in ((d, x + 1), (d - 1, x + 1), (d + 1, x)):
                        if nx <= len(a) and nx + nd <= len(b) and nx + nd >= 0 and nx > new.get(nd, -1):
                            new[nd] = nx
                for d, x in far.items():
                    if x > new.get(d, -1):
                        new[d] = x
                far = new
            for d, x in far.items():
                y = x + d
                while x < len(a) and y < len(b) and a[x] == b[y]:
                    x += 1
                    y += 1
                far[d] = x
            out.append(max(far.values()))
        return out

    fw = reach(item[ii:], doc[di : di + 2 * len(item)])
    bw = reach(item[:ii][::-1], doc[max(0, di - 2 * len(item)) : di][::-1])
    # fewer words of the item at the same edits are always possible, so the longest stretch decides
    return any(f + b >= MIN_WORDS and (ef + eb) * SLACK <= f + b for ef, f in enumerate(fw) for eb, b in enumerate(bw))


class _Items:
    """The evaluation items as word codes, and all their suffixes of SEED words."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, code = [], [], {}
        for i, t in rows:
            w = _words(t)
            if len(w) >= MIN_WORDS:
                self.ids.append(i)
                self.words.append(np.array([code.setdefault(x, len(code)) for x in w], dtype=np.int64))
        self.code = code
        pat, own, pos = [], [], []
        for k, w in enumerate(self.words):
            for p in range(len(w) - SEED + 1):
                pat.append(w[p : p + SEED])
                own.append(k)
                pos.append(p)
        self.pattern = np.array(pat, dtype=np.int64).reshape(-1, SEED)
        self.owner, self.pos = np.array(own, dtype=np.int64), np.array(pos, dtype=np.int64)
        firsts = {tuple(p[:2]) for p in pat}
        self.pairs = np.array(sorted(a * (len(code) + 1) + b for a, b in firsts), dtype=np.int64)
        self.runs, self.which = np.unique(self.pattern, axis=0, return_inverse=True) if len(pat) else (self.pattern, self.owner)
        self.which = np.asarray(self.which).ravel()
        # all items in one array, set apart by a code that no word has
        self.start = np.cumsum([0] + [len(w) + 1 for w in self.words])
        self.flat = np.full(self.start[-1], -9, dtype=np.int64)
        for at, w in zip(self.start, self.words):
            self.flat[at : at + len(w)] = w
        self.by_run = np.argsort(self.which, kind="stable")
        self.run_start = np.searchsorted(self.which[self.by_run], np.arange(len(self.runs) + 1))


def _verbatim(docs: list[np.ndarray], items: _Items) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc, item, place in the doc, place in the item, words) of all verbatim matches of SEED or more words that reach as far as they can, in parts."""
    if not docs or not len(items.pattern):
        return
    # documents are set apart by -1, other words are negative too
    start = np.cumsum([0] + [len(d) + 1 for d in docs])
    codes = np.full(start[-1], -1, dtype=np.int64)
    for s, d in zip(start, docs):
        codes[s : s + len(d)] = d
    # only suffixes that begin like some item's can match: the array holds these and no others
    pair = codes[:-1] * (len(items.code) + 1) + codes[1:]
    cand = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0) & np.isin(pair, items.pairs))
    if not len(cand):
        return
    order = _order(codes, cand, SEED)
    lo = _bounds(codes, order, items.runs, SEED, False)
    hi = _bounds(codes, order, items.runs, SEED, True)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def settle():
        at, seed = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        own = items.start[items.owner[seed]] + items.pos[seed]
        # a match is reported by its first suffix alone
        first = (items.pos[seed] == 0) | (at == 0) | (codes[at - 1] != items.flat[own - 1])
        at, seed, own = at[first], seed[first], own[first]
        n = np.full(len(at), SEED)
        live = np.arange(len(at))
        while len(live):
            x = at[live] + n[live]
            same = codes[np.minimum(x, len(codes) - 1)] == items.flat[own[live] + n[live]]
            live = live[same & (x < len(codes))]
            n[live] += 1
        doc = np.searchsorted(start, at, side="right") - 1
        return doc, items.owner[seed], at - start[doc], items.pos[seed], n

    for run in np.flatnonzero(hi > lo):
        seeds = items.by_run[items.run_start[run] : items.run_start[run + 1]]
        for k in range(lo[run], hi[run], max(1, PAIRS // len(seeds))):
            places = order[k : min(hi[run], k + max(1, PAIRS // len(seeds)))]
            parts.append((np.repeat(places, len(seeds)), np.tile(seeds, len(places))))
            size += len(places) * len(seeds)
            if size >= PAIRS:
                yield settle()
                parts, size = [], 0
    if parts:
        yield settle()


def _shard(ids: list[int], docs: list[np.ndarray], items: _Items) -> set[tuple[int, int]]:
    """(doc, item) pairs of one shard that are leaks."""
    found: set[tuple[int, int]] = set()
    for doc, item, at, pos, n in _verbatim(docs, items):
        long_ = n >= MIN_WORDS
        found.update((ids[d], items.ids[i]) for d, i in zip(doc[long_].tolist(), item[long_].tolist()))
        rest = ~long_
        for d, i, a, p in zip(doc[rest].tolist(), item[rest].tolist(), at[rest].tolist(), pos[rest].tolist()):
            if (ids[d], items.ids[i]) not in found and _holds(items.words[i], docs[d], a, p):
                found.add((ids[d], items.ids[i]))
    return found


def _longest(ids: list[int], docs: list[np.ndarray], items: _Items) -> list[tuple[int, int, int, int, int]]:
    """(doc, item, words, place in the item, place in the doc) of the longest match of every pair of one shard; of equal ones the first."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for doc, item, at, pos, n in _verbatim(docs, items):
        for d, i, a, p, k in zip(doc.tolist(), item.tolist(), at.tolist(), pos.tolist(), n.tolist()):
            key = (d, i)
            if key not in best or (-k, p, a) < best[key]:
                best[key] = (-k, p, a)
    return [(ids[d], items.ids[i], -k, p, a) for (d, i), (k, p, a) in best.items()]


def _order(codes: np.ndarray, cand: np.ndarray, depth: int) -> np.ndarray:
    """The candidate positions in the order of their suffixes over ``depth`` words."""
    n = len(codes)
    keys = [np.where(cand + d < n, codes[np.minimum(cand + d, n - 1)], -1) for d in range(depth)]
    return cand[np.lexsort(keys[::-1])]


def _over(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, search, schema: str) -> DataFrame:
    """The rows that ``search`` finds in all shards, over all passes of items.

    A pass holds about ITEM_WORDS words of items, told apart by the hash of their texts; only one
    pass is on the driver and on the executors at a time. Its rows are stored before the next one.
    """
    spark = docs.sparkSession
    want = items.filter(F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.lower(text).alias("t"))
    words = want.agg(F.coalesce(F.sum(F.length("t") / 4), F.lit(0.0)).alias("n")).first()["n"]
    passes = max(1, math.ceil(words / ITEM_WORDS))
    corpus = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.lower(text).alias("text"))
    out = None
    for k in range(passes):
        part = want.filter(F.pmod(F.xxhash64("t", "i"), F.lit(passes)) == k)
        box = spark.sparkContext.broadcast(_Items([(r["i"], r["t"]) for r in part.toLocalIterator()]))
        found = corpus.mapInArrow(_search(box, search, schema), schema)
        if passes > 1:
            found = stored(found, "leaks")
            box.unpersist()
        out = found if out is None else out.union(found)
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id``: every document with an item of which it holds a long enough stretch.

    Null, empty and short texts hold nothing and are held by nothing; whole texts are searched,
    whatever their length. Repeated documents and items each come out; equal pairs come out once.
    """
    return _over(docs, items, doc_id, item_id, text, _shard, "doc_id long, item_id long").distinct()


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_words, item_pos, doc_pos``: the longest verbatim match of every document and item that share SEED words or more.

    Positions count words from 0; of equally long matches the first in the item, then in the
    document. Items of fewer than MIN_WORDS words take no part. A repeated id has its longest match.
    """
    rows = _over(docs, items, doc_id, item_id, text, _longest, "doc_id long, item_id long, n_words long, item_pos long, doc_pos long")
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "item_pos", "doc_pos")).alias("b")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.n")).alias("n_words"), "b.item_pos", "b.doc_pos")


def _search(box, search, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        items = box.value
        code = items.code
        ids: list[int] = []
        docs: list[np.ndarray] = []
        size = 0

        def close():
            rows = sorted(search(ids, docs, items))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = [code.get(x, -2) for x in _words(t)]
                if len(w) < SEED:
                    continue
                ids.append(i)
                docs.append(np.array(w, dtype=np.int64))
                size += len(w)
                if size >= SHARD_WORDS:
                    yield close()
                    ids, docs, size = [], [], 0
        yield close()

    return run


def clean_corpus(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The corpus without the documents that hold a leak; documents with a null id stay."""
    bad = leaks(docs, items, doc_id).select(F.col("doc_id").alias("leaky")).distinct()
    return docs.join(bad, F.col(doc_id) == F.col("leaky"), "left_anti")
