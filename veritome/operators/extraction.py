"""Table-generating operators over documents: quotes, speakers, amounts, positions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import match_starts, tokens, urls, words
from .ordered import running_sums

__all__ = [
    "alias_speaker", "amount_value", "amounts", "first_candidates", "hamming", "locate", "merge_adjacent", "near_duplicates", "offsets",
    "quotes", "simhash", "speaker_by_verb", "top_keywords",
]

# What counts as an amount of dollars, from the most to the least specific form.
AMOUNT = (
    r"(?i)\$[0-9]+(?:\.[0-9]+)?\s*(?:million|billion)\b|\b[0-9]+(?:\.[0-9]+)?\s*(?:million|billion)\b|"
    r"\$[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{2})?|\$[0-9]+(?:\.[0-9]{2})?"
)
# Verbs of speech between a name and its quote.
SPEECH = (
    "said", "stated", "noted", "blogged", "posted", "wrote", "quoted", "according to", "testif(?:y|ied)", "deposed", "swor(?:e|n)", "submitted",
    "annonce(?:d|ment)", "privacy policy", "public statements?",
)


def quotes(docs: DataFrame, doc_id: str, text: str, least: int = 20, most: int = 600) -> DataFrame:
    """``doc_id, para, pos, quote, context, urls``: quoted passages of each paragraph.

    Paragraphs are parted by a blank line. A passage has ``least`` to ``most`` characters, does not
    begin with a digit and holds a letter; links go to a column of their own. Null texts have none.
    """
    paras = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), r"\n\n")).alias("para", "context"))
    pat = r'(?s)“(.*?)”|"(.*?)"'
    found = F.zip_with(F.regexp_extract_all("context", F.lit(pat), F.lit(1)), F.regexp_extract_all("context", F.lit(pat), F.lit(2)), lambda a, b: F.when(a != "", a).otherwise(b))
    rows = paras.select("doc_id", "para", "context", F.posexplode(found).alias("pos", "quote"))
    rows = rows.withColumn("urls", urls(F.col("context"))).withColumn("quote", F.trim(F.regexp_replace("quote", r"https?://\S+", "")))
    size = F.length("quote")
    return rows.filter((size >= least) & (size <= most) & ~F.col("quote").rlike(r"^[\d\W]+$") & ~F.col("quote").rlike(r"^\d")).select("doc_id", "para", "pos", "quote", "context", "urls")


def simhash(c: Column) -> Column:
    """64-bit SimHash over the last 64 bits of the MD5 of each word (X3); 0 without words."""
    hashes = F.transform(words(c), lambda w: F.conv(F.substring(F.md5(w), 17, 16), 16, -10).cast("bigint"))
    bits = F.sequence(F.lit(0), F.lit(63))

    def fold(h: Column) -> Column:
        votes = lambda b: F.aggregate(h, F.lit(0), lambda s, x: s + F.call_function("shiftrightunsigned", x, b).bitwiseAND(F.lit(1)).cast("int") * 2 - 1)
        return F.aggregate(bits, F.expr("0L"), lambda s, b: s.bitwiseOR(F.when(votes(b) > 0, F.call_function("shiftleft", F.expr("1L"), b)).otherwise(F.expr("0L"))))

    # the array of one makes the hashes a bound value, else every bit would compute them again
    return F.get(F.transform(F.array(hashes), fold), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_duplicates(df: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """``key_a, key_b, distance`` of texts whose SimHash differs in few bits.

    The 64 bits are cut into most + 3 pieces, of which three are equal at least: hashes meet in the
    bits of three pieces, about half of all bits with three differing ones. Texts with the same hash
    meet as one entry: only the smallest key of a hash takes part, and the others hang on it.
    """
    hashed = df.select(F.col(key).alias("k"), simhash(F.col(text)).alias("h"))
    heads = hashed.groupBy("h").agg(F.min("k").alias("k"))
    edges = [64 * i // (most + 3) for i in range(most + 4)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in three) for three in combinations(range(most + 3), 3)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("h").bitwiseAND(F.lit(m).cast("bigint")).alias("v")) for i, m in enumerate(masks)]))
    bands = heads.select("k", "h", band.alias("b"))
    a = bands.select(F.col("k").alias("key_a"), F.col("h").alias("ha"), "b")
    b = bands.select(F.col("k").alias("key_b"), F.col("h").alias("hb"), "b")
    close = a.join(b, "b").filter(F.col("key_a") < F.col("key_b")).withColumn("distance", hamming(F.col("ha"), F.col("hb"))).filter(F.col("distance") <= most).select("key_a", "key_b", "distance").distinct()
    same = hashed.join(heads.withColumnRenamed("k", "head"), "h").filter(F.col("k") != F.col("head")).select(F.col("head").alias("key_a"), F.col("k").alias("key_b"), F.lit(0).alias("distance"))
    return close.union(same)


def merge_adjacent(df: DataFrame, key: str, order: str, quote: str, context: str) -> DataFrame:
    """Neighbouring quotes of one context are one when the next begins with the last token before."""
    w = W.partitionBy(key).orderBy(order)
    last = F.element_at(F.split(F.lag(quote).over(w), r"\s+"), -1)
    go_on = F.coalesce((F.lag(context).over(w) == F.col(context)) & F.startswith(F.col(quote), last), F.lit(False))
    rows = df.withColumn("_new", (~go_on).cast("int")).withColumn("_grp", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(quote).alias("q"))))
    return rows.groupBy(key, "_grp").agg(F.min(order).alias(order), F.first(context).alias(context), parts.alias("_p")).select(key, order, F.array_join(F.transform("_p", lambda p: p["q"]), " ").alias(quote), context)


def speaker_by_verb(context: Column) -> Column:
    """The capitalised word before a verb of speech that a quotation mark follows, at most one of : , - between them (X5); null where there is none."""
    return F.nullif(F.regexp_extract(context, rf"([A-Z][a-z]+)\s+\b(?i:{'|'.join(SPEECH)})\b\s*[:,-]?\s*[\"“][^\"”]+[\"”]", 1), F.lit(""))


def alias_speaker(df: DataFrame, context: str, aliases: DataFrame, alias: str) -> DataFrame:
    """``speaker``: the smallest alias that occurs in the context, in title case; other rows are dropped.

    Aliases of a single word meet the words of the context in an equi join; only aliases of several
    words, which a word cannot find, are looked up by their first word and then checked as a whole.
    """
    a = aliases.select(F.lower(alias).alias("_alias")).filter(F.length("_alias") > 0).distinct().withColumn("_first", F.get(words(F.col("_alias")), F.lit(0)))
    rows = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_low", F.lower(context))
    hits = rows.select("_row", "_low", F.explode(F.array_distinct(words(F.col("_low")))).alias("_first")).join(a, "_first").filter(F.contains("_low", "_alias"))
    best = hits.groupBy("_row").agg(F.initcap(F.min("_alias")).alias("speaker"))
    return rows.join(best, "_row").drop("_row", "_low")


def amount_value(raw: Column) -> Column:
    """Dollars of an amount as written (X8, X10); null where it cannot be read."""
    low = F.lower(raw)
    plain = F.regexp_replace(F.regexp_replace(low, r"[,$]|usd?", ""), r"\s*(million|billion)", "")
    n = F.trim(plain).try_cast("double")
    return n * F.when(low.contains("million"), 1e6).when(low.contains("billion"), 1e9).otherwise(1.0)


def amounts(docs: DataFrame, doc_id: str, text: str, around: int = 100) -> DataFrame:
    """``doc_id, start, raw, value, context``: every amount with its place and surroundings."""
    hits = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(AMOUNT), F.lit(0)).alias("raw"), match_starts(F.col(text), AMOUNT).alias("start"))
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"), F.explode(hits).alias("h"))
    frm = F.greatest(F.lit(1), F.col("h.start") + 1 - around)
    ctx = F.substring("_t", frm, F.col("h.start") + F.length("h.raw") + around - frm + 1)
    return rows.select("doc_id", F.col("h.start").alias("start"), F.col("h.raw").alias("raw"), amount_value(F.col("h.raw")).alias("value"), F.regexp_replace(ctx, r"\n", " ").alias("context"))


def first_candidates(df: DataFrame, key: str, raw: str, context: str, order: Sequence[str]) -> DataFrame:
    """Of candidates with the same amount and beginning of context the first of a case."""
    same = F.concat_ws(":", F.col(raw), F.substring(context, 1, 60))
    rn = F.row_number().over(W.partitionBy(key, same).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def offsets(docs: DataFrame, case: str, order: str, text: str) -> DataFrame:
    """``char_start, token_start`` of each document in the joined text of its case."""
    own = {"char_start": (F.length(text) + 1).cast("bigint"), "token_start": F.size(tokens(F.col(text))).cast("bigint")}
    sized = docs.withColumns({f"_n_{n}": F.coalesce(c, F.lit(0)) for n, c in own.items()})
    rows = running_sums(sized, [case], [order], {n: F.col(f"_n_{n}") for n in own})
    return rows.withColumns({n: F.col(n) - F.col(f"_n_{n}") for n in own}).drop(*[f"_n_{n}" for n in own])


def locate(text: Column, quote: Column) -> Column:
    """Offset of a quote in a text: exact, else letter case ignored, else any white space (X30); -1 where absent."""
    exact = F.instr(text, quote)
    loose = F.instr(F.lower(text), F.lower(quote))
    # the words of the quote as they are, with any white space between them
    word = lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit("(?i)"), F.array_join(F.transform(tokens(quote), word), r"\s+"))
    wide = F.when(F.size(tokens(quote)) > 0, F.regexp_instr(text, pattern))
    return F.coalesce(F.when(exact > 0, exact - 1).when(loose > 0, loose - 1).when(wide > 0, wide - 1), F.lit(-1))


def top_keywords(docs: DataFrame, key: str, text: str, stop: Sequence[str], k: int = 5) -> DataFrame:
    """The most frequent words of more than two letters that are no stop words (T15); ties by first place."""
    w = docs.select(F.col(key).alias("key"), F.posexplode(words(F.col(text))).alias("p", "word")).filter((F.length("word") > 2) & ~F.col("word").isin(list(stop)))
    c = w.groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"))
    rn = F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "p"))
    return c.withColumn("rank", rn).filter(F.col("rank") <= k).select(F.col("key").alias(key), "rank", "word", "n")
