"""Most similar vectors for every vector by a block matrix join.

A block holds the vectors that are nearest to one pivot; pivots are a sample of the vectors, one
for CELL_ROWS of them. Every vector is a member of the block of its nearest pivot and visits
those of the next nearest, PROBES blocks in all; a block with its members and visitors is one
tile. Inside a tile the unit vectors are quantised to int8 with a scale of their own, and products
of the quantised vectors give every cosine up to a bound that follows from the two quantisation
residuals. Only pairs whose upper bound reaches the running k-th best of either side are
recomputed in double precision, and the best k per vector are kept and merged over tiles.

The blocks are an index: every vector is in it, and a pair is seen where either of the two visits
the block of the other. With as many probes as blocks the result is exact. The work grows with
the number of vectors times the rows of a block, that of all pairs with its square.

Vectors that are equal in every component form a class that enters the join once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut, stored

__all__ = ["CELL_ROWS", "PROBES", "nearest", "usable"]

#: Vectors for one pivot, blocks that a vector meets, and pivots at most (beyond it blocks grow): 16 MB at 64 floats.
CELL_ROWS, PROBES, MAX_PIVOTS = 4096, 3, 1 << 16
#: Members of one tile at most. A larger block is cut into parts; all parts of a block meet each other.
TILE_ROWS = 1 << 15
#: Groups of pivots whose pivots are compared one by one with a vector.
NEAR_GROUPS = 8
#: Tables of at most so many rows of a few numbers are broadcast, after they were counted.
SMALL_ROWS = 1_000_000
_ROWS, _COLS = 1024, 512


def usable(c: Column, width: int) -> Column:
    """Not null, of the given width, without null, NaN or infinite parts, and not all zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(c) == width) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


class _Best:
    """The k best (similarity, id) of each row of a block; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.sim = np.full((n, k), -2.0)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def threshold(self) -> np.ndarray:
        return self.sim[:, -1]

    def offer(self, row: np.ndarray, sim: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        hit = np.unique(row)
        r = np.concatenate([np.repeat(hit, self.k), row])
        s = np.concatenate([self.sim[hit].ravel(), sim])
        i = np.concatenate([self.ids[hit].ravel(), ids])
        o = np.lexsort((i, -s, r))
        r, s, i = r[o], s[o], i[o]
        new = np.ones(len(r), bool)
        new[1:] = r[1:] != r[:-1]
        at = np.flatnonzero(new)
        take = at[:, None] + np.arange(self.k)[None, :]
        self.sim[hit], self.ids[hit] = s[take], i[take]


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, their int8 quantisation scaled back to float32, and the residual norms."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    scale = np.abs(u).max(axis=1, keepdims=True) / 127.0
    q = np.rint(u / scale).astype(np.int8)
    back = (q.astype(np.float32) * scale.astype(np.float32)).astype(np.float32)
    return u, back, np.sqrt(((u - back) ** 2).sum(axis=1))


def _start(p: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, a first threshold for rows that have none."""
    if p.shape[1] < k:
        return np.full(p.shape[0], -2.0)
    return np.partition(p, p.shape[1] - k, axis=1)[:, p.shape[1] - k].astype(np.float64)


def _tile(ids_a, va, ids_b, vb, k: int, same: bool) -> tuple[_Best, _Best | None]:
    ua, qa, ea = _units(va)
    ub, qb, eb = (ua, qa, ea) if same else _units(vb)
    left = _Best(len(ua), k)
    right = None if same else _Best(len(ub), k)
    slack = 2e-6  # float32 rounding of the products, and the rounding of similarities

    def settle(best, rows0, p, err, own_u, own_ids, other_u, other_ids, other0):
        """Rows of p against the running thresholds of ``best``; p is owners x others."""
        thr = best.threshold()[rows0 : rows0 + p.shape[0]]
        fresh = thr <= -2.0
        if fresh.any():
            thr = thr.copy()
            # a vector's own entry may stand among the first k + 1
            thr[fresh] = _start(p[fresh], k + 1) - err
        low = (thr - err).astype(np.float32)
        hot = np.flatnonzero(p.max(axis=1) >= low)
        if not len(hot):
            return
        r, c = np.nonzero(p[hot] >= low[hot, None])
        r = hot[r] + rows0
        c = c + other0
        if same:
            keep = r != c
            r, c = r[keep], c[keep]
        for at in range(0, len(r), 1 << 18):
            rr, cc = r[at : at + (1 << 18)], c[at : at + (1 << 18)]
            sim = np.round(np.einsum("ij,ij->i", own_u[rr], other_u[cc]), 9)
            best.offer(rr, sim, other_ids[cc])

    for a in range(0, len(ua), _ROWS):
        x = qa[a : a + _ROWS]
        for b in range(0, len(ub), _COLS):
            y = qb[b : b + _COLS]
            p = x @ y.T
            ma, mb = ea[a : a + _ROWS].max(), eb[b : b + _COLS].max()
            err = ma + (1 + ma) * mb + slack
            settle(left, a, p, err, ua, ids_a, ub, ids_b, b)
            if right is not None:
                settle(right, b, np.ascontiguousarray(p.T), err, ub, ids_b, ua, ids_a, a)
    return left, right


def _tile_task(k: int):
    def run(table):
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        ids = table.column("rep").to_numpy()
        flat = table.column("vec").chunk(0)
        vec = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        done = []
        if len(a):
            done.append((ids[a], _tile(ids[a], vec[a], ids[a], vec[a], k, True)[0]))
        if len(a) and len(b):
            done += zip((ids[a], ids[b]), _tile(ids[a], vec[a], ids[b], vec[b], k, False))
        if not done:
            return pa.table({"owner": pa.array([], pa.int64()), "others": pa.array([], pa.list_(pa.int64())), "sims": pa.array([], pa.list_(pa.float64()))})
        owner = np.concatenate([o for o, _ in done])
        oi, os_ = np.concatenate([x.ids for _, x in done]), np.concatenate([x.sim for _, x in done])
        real = os_ > -2.0
        off = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
        return pa.table({"owner": owner, "others": pa.ListArray.from_arrays(off, oi[real]), "sims": pa.ListArray.from_arrays(off, os_[real])})

    return run


class _Pivots:
    """Pivots in groups by the nearest of some leading pivots, so that a vector is compared with few of them."""

    def __init__(self, v: np.ndarray):
        self.n = len(v)
        u = _units(v)[0].astype(np.float32)
        heads = max(1, int(math.sqrt(len(u)))) if len(u) > 64 * NEAR_GROUPS else 1
        self.heads = u[:heads]
        group = np.concatenate([(u[at : at + 8192] @ self.heads.T).argmax(axis=1) for at in range(0, len(u), 8192)])
        self.members = [np.flatnonzero(group == g) for g in range(heads)]
        self.units = [u[m] for m in self.members]

    def nearest(self, v: np.ndarray, probes: int) -> np.ndarray:
        """The numbers of the ``probes`` nearest pivots of every row, nearest first; -1 where there are no more."""
        u = _units(v)[0].astype(np.float32)
        n, probes = len(u), min(probes, self.n)
        # with more groups the probes may lie in more of them
        near = min(len(self.heads), max(NEAR_GROUPS, probes))
        g = u @ self.heads.T
        groups = np.argpartition(-g, near - 1, axis=1)[:, :near] if near < g.shape[1] else np.tile(np.arange(g.shape[1]), (n, 1))
        sim, at = np.full((n, probes), -3.0, np.float32), np.full((n, probes), -1)
        for k in range(len(self.heads)):
            rows = np.flatnonzero((groups == k).any(axis=1))
            if not len(rows) or not len(self.members[k]):
                continue
            s = np.concatenate([sim[rows], u[rows] @ self.units[k].T], axis=1)
            i = np.concatenate([at[rows], np.broadcast_to(self.members[k], (len(rows), len(self.members[k])))], axis=1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            sim[rows], at[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        return at


def _visits(box, probes: int):
    """Rows of cell, visit (whether the vector only visits it), rep, vec: the blocks of every vector."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1)
            at = box.value.nearest(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1), probes)
            for p in range(at.shape[1]):
                keep = np.flatnonzero(at[:, p] >= 0)
                if len(keep):
                    part = b.take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([pa.array(at[keep, p].astype(np.int32)), pa.array(np.full(len(keep), p > 0)), part.column(0), part.column(1)], names=["cell", "visit", "rep", "vec"])

    return run


def _tiles(heads: DataFrame, width: int, k: int, cell_rows: int, probes: int) -> DataFrame:
    """``owner, others, sims``: the best of every vector within each tile."""
    spark = heads.sparkSession
    n = heads.count()
    pivots = min(MAX_PIVOTS, max(1, math.ceil(n / cell_rows)))
    sample = heads.orderBy(F.xxhash64("rep"), "rep").limit(pivots).select("vec").toArrow().column("vec").combine_chunks()
    v = sample.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
    box = spark.sparkContext.broadcast(_Pivots(v if len(v) else np.ones((1, width), np.float32)))
    placed = heads.select("rep", "vec").mapInArrow(_visits(box, probes), "cell int, visit boolean, rep long, vec array<float>")
    # most blocks are one part; all parts of a larger one are met by each other and by its visitors
    crowd = heads.select("rep", "vec").mapInArrow(_counts(box), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    large = {r["cell"]: math.ceil(r["n"] / TILE_ROWS) for r in crowd.filter(F.col("n") > TILE_ROWS).collect()}  # at most n / TILE_ROWS rows
    parts = F.lit(1)
    if large:
        parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for e in large.items() for x in e]), F.col("cell")), parts)
    part = F.when(F.col("visit"), -1).otherwise(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = placed.withColumn("parts", parts).withColumn("part", part)
    # a member meets its own part as owner and, as a visitor, the parts after it
    to = F.explode(F.sequence(F.greatest(F.col("part"), F.lit(0)), F.col("parts") - 1)).alias("tile")
    sent = rows.select("cell", "part", "rep", "vec", to)
    sent = sent.select("cell", "tile", F.when(F.col("part") == F.col("tile"), 0).otherwise(1).cast("int").alias("side"), "rep", "vec")
    return sent.groupBy("cell", "tile").applyInArrow(_tile_task(k), "owner long, others array<long>, sims array<double>")


def _counts(box):
    """Rows of cell, n: members by block, counted within each task."""

    def run(batches):
        total = np.zeros(box.value.n, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                flat = b.column(1)
                total += np.bincount(box.value.nearest(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1), 1)[:, 0], minlength=box.value.n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["cell", "n"])

    return run


def nearest(df: DataFrame, id_col: str, vec: str, width: int, k: int = 5, cell_rows: int = CELL_ROWS, probes: int = PROBES) -> DataFrame:
    """``record_id, other_id, sim``: the k most similar other vectors of every usable vector.

    Similarity is the cosine in double precision, rounded to nine decimals; ties go to the
    smaller id. Vectors that are null, empty, all zero, not finite or of another width have no
    neighbours and are none. With fewer than k other vectors all of them come out. Of a class of
    equal vectors only the k + 1 smallest ids can be anyone's neighbours, so no more are kept.
    A neighbour is missed where neither vector visits the block of the other (see above). The frame is
    read several times and must give the same rows each time.
    """
    rows = df.select(F.col(id_col).alias("record_id"), F.col(vec).cast("array<float>").alias("vec")).filter(usable(F.col("vec"), width))
    # classes of equal vectors are told apart by 96 bits of hash; the vectors themselves are not shuffled for it
    keyed = stored(rows.select("record_id", F.xxhash64("vec").alias("k1"), F.hash("vec").alias("k2")), "vector-keys")
    order = F.row_number().over(W.partitionBy("k1", "k2").orderBy("record_id"))
    few = keyed.select("record_id", "k1", "k2").withColumn("at", order).filter(F.col("at") <= k + 1)
    multi = few.groupBy("k1", "k2").agg(F.min("record_id").alias("rep"), F.sort_array(F.collect_list("record_id")).alias("ids")).filter(F.size("ids") > 1)
    multi = cut(multi)
    small = multi.count() <= SMALL_ROWS
    near_side = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    twin = keyed.select("record_id", "k1", "k2").join(near_side(multi), ["k1", "k2"])
    twin = cut(twin)
    copies = twin.filter(F.col("record_id") != F.col("rep")).select("record_id")
    few_copies = copies.count() <= SMALL_ROWS
    heads = rows.join(F.broadcast(copies) if few_copies else copies, "record_id", "left_anti").withColumnRenamed("record_id", "rep")
    if not few_copies:
        heads = stored(heads, "heads")
    part = _tiles(heads, width, k, cell_rows, probes)
    pairs = F.flatten(F.collect_list(F.zip_with("sims", "others", lambda s, o: F.struct((-s).alias("s"), o.alias("o")))))
    # two vectors that visit each other meet twice
    best = stored(part.groupBy("owner").agg(F.slice(F.array_sort(F.array_distinct(pairs)), 1, k).alias("best")), "neighbours")

    # of the classes among the neighbours all members that can matter come in
    flat = best.select("owner", F.explode("best").alias("e")).select("owner", F.col("e.s").alias("s"), F.col("e.o").alias("o"))
    ids_of = near_side(multi.select(F.col("rep").alias("o"), F.col("ids").alias("o_ids")))
    flat = flat.join(ids_of, "o", "left").select("owner", "s", F.explode(F.coalesce("o_ids", F.array("o"))).alias("o"))
    merged = flat.groupBy("owner").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "o"))), 1, k).alias("best"))
    reps = near_side(multi.select(F.col("rep").alias("owner"), "ids"))
    single = merged.join(reps.select("owner"), "owner", "left_anti").select(F.col("owner").alias("record_id"), F.explode("best").alias("e"))
    none = F.array().cast("array<struct<s:double,o:bigint>>")
    whole = multi.select(F.col("rep").alias("owner"), "ids").join(merged, "owner", "left")
    whole = whole.select(F.col("owner").alias("rep"), F.array_sort(F.concat(F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("s"), i.alias("o"))), F.coalesce("best", none))).alias("all"))
    member = twin.select("record_id", "rep").join(whole, "rep")
    own = member.select("record_id", F.explode(F.slice(F.expr("filter(all, e -> e.o != record_id)"), 1, k)).alias("e"))
    return single.union(own).select("record_id", F.col("e.o").alias("other_id"), (-F.col("e.s")).alias("sim"))
