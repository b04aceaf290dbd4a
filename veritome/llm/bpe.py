"""Byte-level BPE of a public tokenizer with Spark's higher-order functions.

The rank file becomes a literal map inside the plan: levels of slots addressed by a checksum,
so a look-up costs a constant number of comparisons. Documents are split into words once, and a
word that is a token itself becomes its id there. All other words are gathered with their
counts, and each distinct one is encoded once by folding ranked merges over the array of its
bytes. The most frequent of these return to the documents as a second literal table of bounded
size; only documents that hold a rarer word take part in a join.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored

__all__ = ["DEFAULT_RANKS", "PATTERN", "decode", "encode"]

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges. (?U) gives \s its Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded words that return as a literal, and the bytes that such a word has at most: both bound its size.
HEAD, HEAD_BYTES = 1 << 16, 64
#: A longer word is merged by a heap of ranks, which takes n log n steps; the fold takes their square.
LONG = 128
_BITS = (17, 15, 13)
#: Distinct unknown words of a document up to which their places are searched one after the other.
FEW = 256


def _slots(entries: dict[bytes, dict]) -> list[list[dict | None]]:
    """The entries (each with its key) placed in levels by bits of their checksum; the last level is a plain list of what is left."""
    left, levels = entries, []
    for n, bits in enumerate(_BITS):
        slots: list[dict | None] = [None] * (1 << bits)
        over = {}
        for key, e in left.items():
            h = zlib.crc32(bytes([n]) * n + key) & ((1 << bits) - 1)
            if slots[h] is None:
                slots[h] = e
            else:
                over[key] = e
        levels.append(slots)
        left = over
    return [*levels, list(left.values())]


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def _is_text(b: bytes) -> bool:
    try:
        b.decode()
    except UnicodeDecodeError:
        return False
    return True


def _literal(levels: list[list[dict | None]], kind: str) -> Column:
    """A struct of the levels l0, l1, ... as one literal; an entry is a struct of its key k and what stands for it, v."""
    return F.struct(*[F.from_json(F.lit(json.dumps(x)), f"array<struct<{kind}>>").alias(f"l{n}") for n, x in enumerate(levels)])


@lru_cache(maxsize=4)
def _byte_levels(path: str):
    return _slots({k: {"k": base64.b64encode(k).decode(), "v": r} for k, r in _ranks(path).items()})


@lru_cache(maxsize=4)
def _text_levels(path: str):
    """Of the tokens that are text by themselves: no other can be a whole word."""
    return _slots({k: {"k": k.decode(), "v": r} for k, r in _ranks(path).items() if _is_text(k)})


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_table(table: Column, body) -> Column:
    """``body(slot, value)`` over a literal map: slot finds the first-level entry of a key, value what stands for a key, given that entry."""

    def bound(t: Column) -> Column:
        def slot(c: Column, n: int = 0) -> Column:
            raw = c.cast("binary")
            return F.get(t[f"l{n}"], F.crc32(F.concat(F.lit(bytes([n]) * n), raw) if n else raw).bitwiseAND(F.lit((1 << _BITS[n]) - 1)).cast("int"))

        def value(c: Column, first: Column) -> Column:
            more = [F.when(s["k"] == c, s["v"]) for s in (slot(c, n) for n in range(1, len(_BITS)))]
            left = F.get(F.filter(t[f"l{len(_BITS)}"], lambda e: e["k"] == c), F.lit(0))["v"]
            return F.when(first["k"] == c, first["v"]).otherwise(F.coalesce(*more, left))

        return body(slot, value)

    return _let(table, bound)


def _fold(word: Column, ranks: Column) -> Column:
    """The ids of one word: ranked merges folded over its bytes.

    The state is the list of parts, each with the rank of joining it to the next one. A round
    joins the leftmost pair of the lowest rank and looks up the two pairs that are new; once no
    pair is a token the rounds that are left pass the list on.
    """
    raw = word.cast("binary")
    n = F.octet_length(raw)

    def body(slot, value):
        rank = lambda c: value(c, slot(c))
        part = lambda b, r: F.struct(b.alias("b"), r.alias("r"))
        single = F.transform(F.sequence(F.lit(1), n), lambda i: raw.substr(i, F.lit(1)))
        start = _let(single, lambda s: F.transform(s, lambda b, i: part(b, rank(F.concat(b, F.get(s, i + 1))))))

        def joined(acc: Column, at: Column) -> Column:
            left, right = F.get(acc, at - 2), F.get(acc, at + 1)
            both = F.concat(F.get(acc, at - 1)["b"], F.get(acc, at)["b"])
            new = _let(both, lambda m: F.concat(
                F.when(at > 1, F.array(part(left["b"], rank(F.concat(left["b"], m))))).otherwise(F.slice(acc, 1, 0)),
                F.array(part(m, rank(F.concat(m, right["b"])))),
            ))
            return F.concat(F.slice(acc, F.lit(1), F.greatest(at - 2, F.lit(0))), new, F.slice(acc, at + 2, F.size(acc)))

        def once(acc: Column, _: Column) -> Column:
            return _let(acc["r"], lambda r: F.when(F.array_min(r).isNull(), acc).otherwise(_let(F.array_position(r, F.array_min(r)).cast("int"), lambda at: joined(acc, at))))

        done = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, once)
        return F.transform(done["b"], rank)

    return _with_table(ranks, body)


def _merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by a heap of (rank, place): the same merges in the same order as the fold."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(r, i, i + 1) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, j = heapq.heappop(heap)
        # stale where one of the two has been merged since
        if parts[i] is None or after[i] != j or j >= len(parts) or ranks.get(parts[i] + parts[j]) != r:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, b))
    return [ranks[p] for p in parts if p is not None]


def _coded(words: DataFrame, path: str) -> DataFrame:
    """``word, n, ids`` of distinct words: short ones by the fold, long ones by the heap."""
    long_ = F.octet_length("word") > LONG
    box = words.sparkSession.sparkContext.broadcast(_ranks(path))  # the vocabulary

    def heaps(batches):
        for b in batches:
            ids = [_merge(w.encode(), box.value) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    short = words.filter(~long_).select("word", "n", _fold(F.col("word"), _literal(_byte_levels(path), "k:binary,v:int")).alias("ids"))
    return short.union(words.filter(long_).select("word", "n").mapInArrow(heaps, "word string, n long, ids array<int>"))


def encode(df: DataFrame, id_col: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``doc_id, ids``: the token ids of every document, without special tokens.

    Null and empty texts have an empty list. Strings that spell a special token are ordinary
    text. Every row comes out once; a repeated id keeps all its rows.
    """
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0)).alias("w"))
    # the entries of the first level stand in a list of their own, so the checksum of a word is taken once
    found = _with_table(_literal(_text_levels(ranks), "k:string,v:int"), lambda slot, value: F.zip_with("w", F.transform("w", lambda c: slot(c)), value))
    known = docs.select("row", "doc_id", "w", found.alias("i"))
    rest = known.select("*", F.array_distinct(F.filter("w", lambda _, k: F.get(F.col("i"), k).isNull())).alias("rest"))
    # an unknown word stands as minus its place in the list of these; of a document with many they stand in line with the ids
    few = F.size("rest") <= FEW
    toks = F.when(few, F.transform("i", lambda x, k: F.coalesce(x, -F.array_position("rest", F.get(F.col("w"), k)).cast("int")))).otherwise(F.transform("i", lambda x: F.coalesce(x, F.lit(-1))))
    line = F.when(~few, F.zip_with("i", "w", lambda x, c: F.when(x.isNull(), c)))
    base = stored(rest.select("row", "doc_id", toks.alias("toks"), "rest", line.alias("line"), F.exists("rest", lambda c: F.octet_length(c) > HEAD_BYTES).alias("long")), "bpe")

    words = base.select(F.explode("rest").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # few bytes but much work a word: a fixed number of partitions, which adaptive execution does not coalesce
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    coded = stored(_coded(words.repartition(parts), ranks), "bpe-words")
    fit = coded.filter(F.octet_length("word") <= HEAD_BYTES)
    top = fit.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    head = _slots({r["word"].encode(): {"k": r["word"], "v": r["ids"]} for r in top})

    def filled(slot, value):
        gap = lambda t, code: F.when(t >= 0, F.array(t)).otherwise(code)
        by_place = _let(F.transform("rest", lambda c: value(c, slot(c))), lambda codes: F.flatten(F.transform("toks", lambda t: gap(t, F.get(codes, -t - 1)))))
        in_line = F.flatten(F.zip_with("toks", "line", lambda t, c: gap(t, value(c, slot(c)))))
        return F.when(F.col("line").isNull(), by_place).otherwise(in_line)

    # null where a word is not among the frequent ones
    ids = _with_table(_literal(head, "k:string,v:array<int>"), filled).alias("ids")
    cols = ["row", "doc_id", "toks", "rest", "line"]
    if fit.count() == len(top):  # then only long words can be missing, and their documents are known
        full, rare = base.filter("NOT long").select("doc_id", ids), base.filter("long").select(*cols)
    else:
        full = base.select(*cols, ids)
        full = stored(full.withColumns({c: F.when(F.col("ids").isNull(), F.col(c)) for c in cols[2:]}), "bpe-docs")
        full, rare = full.filter("ids IS NOT NULL").select("doc_id", "ids"), full.filter("ids IS NULL").select(*cols)
    word = lambda t, k: F.when(F.col("line").isNull(), F.get("rest", -t - 1)).otherwise(F.get("line", k))
    gaps = rare.select("row", F.explode(F.filter(F.transform("toks", lambda t, k: F.when(t < 0, F.struct(k.alias("k"), word(t, k).alias("w")))), lambda e: e.isNotNull())).alias("g"))
    back = gaps.select("row", "g.k", F.col("g.w").alias("word")).join(coded.select("word", "ids"), "word")
    back = back.groupBy("row").agg(F.collect_list(F.struct("k", F.col("ids").alias("v"))).alias("codes"))
    own = F.filter(F.transform("toks", lambda t, k: F.when(t >= 0, F.struct(k.alias("k"), F.array(t).alias("v")))), lambda e: e.isNotNull())
    ids = F.flatten(F.transform(F.array_sort(F.concat(own, "codes")), lambda e: e["v"]))
    return full.union(rare.join(back, "row").select("doc_id", ids.alias("ids")))


def decode(df: DataFrame, ids: str = "ids", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """The frame with the column ``decoded``: the bytes of the ids joined and read as UTF-8.

    Null ids give null, no ids the empty text, and an id outside the vocabulary fails.
    """
    by_id: list[str | None] = [None] * (max(_ranks(ranks).values()) + 1)
    for k, r in _ranks(ranks).items():
        by_id[r] = k.hex()
    pieces = _let(F.from_json(F.lit(json.dumps(by_id)), "array<string>"), lambda t: F.transform(F.col(ids), lambda i: F.coalesce(F.get(t, i), F.raise_error(F.lit("an id outside the vocabulary")).cast("string"))))
    return df.withColumn("decoded", F.decode(F.unhex(F.array_join(pieces, "")), "UTF-8"))
