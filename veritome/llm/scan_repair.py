"""Repair of text from scanned pages.

Lines are labelled by a hidden Markov model with the states body, title (a line of text that
stands alone), furniture (running headers, footers, page numbers, stamps) and break. What it
sees of a line is its shape, how often the line comes back within the document, the gaps before
and after it, and how it begins and ends; each of these is emitted by itself, so that context,
recurrence and gaps together can overrule the shape. The model starts from the shapes and is
fitted to all documents in ROUNDS of Viterbi paths, each of which counts in one aggregation.

Words continued on the next line of text are joined, also across page furniture. Misread words
are found among the distinct words of the corpus: undoing one or two of the known confusions of
a rare word must give a word that is much more frequent.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored

__all__ = ["delivered_once", "findings", "paragraphs", "repair"]

# What a scanner reads, and what stood there.
CONFUSIONS = {
    "c": "e", "f": "t", "!": "i", "@": "a", "ri": "n", "0": "o", "5": "s", "1": "l", "|": "l", "cl": "d", "e": "c",
    "ii": "u", "rn": "m", "b": "h", "q": "g", "vv": "w", "n": "ri", "ﬁ": "fi", "ﬂ": "fl", "ı": "i",
}
#: Characters that no word holds by itself: they are undone even in a word never seen elsewhere.
FOREIGN = {"!": "i", "@": "a", "0": "o", "5": "s", "1": "l", "|": "l", "ﬁ": "fi", "ﬂ": "fl", "ı": "i"}
#: A right word is at least so many times as frequent as its misreading, and seen so often.
RATIO, SEEN = 6, 3
#: Distinct words whose spelling is taken for granted are the most frequent ones, at most so many: it bounds what is broadcast.
TRUSTED = 1 << 16
_HYPHENS = "-‐­¬"
_EDGE = "\"'`.,;:?()[]{}<>‘’“”…*_~§"
_D = r"[\dlIO|]"
_SHAPES = [
    (1, re.compile(rf"^[\[\(~\-–\s]*(?:p\.|pg\.|page|poge|pagc)?\s*{_D}{{1,4}}(?:\s+[o0]f\s+{_D}{{1,4}})?[\]\)~\-–\s]*$", re.I)),
    (2, re.compile(rf"^\w{{2,6}}\.?\s+(?:{_D}:)?{_D}{{2}}-(?:\w{{2}}-)?{_D}{{4,6}}(?:\s.*)?$")),
    (3, re.compile(rf"^(?:{_D}{{1,3}}\s+)?[A-Z]\S*(?:\s+[A-Z]\S*){{0,5}}\s+[vV]\.\s+[A-Z]\S*(?:\s+[A-Z]\S*){{0,3}}(?:\s+{_D}{{1,3}})?$")),
    (4, re.compile(rf"^(?:[A-Zl0-9@!|]{{6,}}\s+{_D}{{4,6}}|[A-Zl0-9@!|]+(?:\s+[A-Zl0-9@!|]+)*\s{{2,}}{_D}{{1,3}}|{_D}{{1,3}}\s{{2,}}[A-Zl0-9@!|]+(?:\s+[A-Zl0-9@!|]+)*)$")),
    (5, re.compile(r"^(?:\d+\.\s+)?[A-Zl0-9@!|]+(?:\s+[A-Zl0-9@!|]+)*$")),
    (7, re.compile(r"^\d+\s+[a-z@!0-9]+(?:\s+[a-z@!0-9]+){0,3}$")),
]
#: Levels of what is seen of a line: shape, recurrence, gaps, ends.
_LEVELS = (9, 3, 4, 4)
_SYMBOLS = 9 * 3 * 4 * 4
_BODY, _FURN, _BREAK, _TITLE = 0, 1, 2, 3
_STATE_OF_SHAPE = np.array([_BREAK, _FURN, _FURN, _FURN, _FURN, _TITLE, _BODY, _TITLE, _BODY])
#: Rounds of fitting; lines that each state is given beforehand, in its own shapes; share of other shapes,
#: which a misread character can give to a line (set, not fitted: else a state takes over the lines of another).
ROUNDS, PRIOR, STRAY = 4, 20.0, 0.0004
_CAPITALS = re.compile(r"(?=.*[A-Z].*[A-Z])[A-Zl0-9@!'-]+")
_FLAT = str.maketrans("0123456789lIO|", "99999999999999")


def _shape(s: str) -> int:
    if not s:
        return 0
    if len(s) > 110:
        return 8
    if s[-1] != "." or s[0] in "[(~-pP":
        for c, p in _SHAPES:
            if p.match(s):
                return c
    return 6 if len(s) < 40 else 8


def _symbols(lines: list[str]) -> np.ndarray:
    """What is seen of every line, as one number; 0 for a blank one."""
    flat = [x.translate(_FLAT).lower() for x in lines]
    seen = Counter(flat)
    out = np.zeros(len(lines), dtype=np.uint16)
    for k, x in enumerate(lines):
        if x:
            gaps = 2 * (k == 0 or not lines[k - 1]) + (k + 1 == len(lines) or not lines[k + 1])
            ends = 2 * x[0].islower() + (x[-1] in '.?!"”')
            out[k] = ((_shape(x) * 3 + min(2, seen[flat[k]] - 1)) * 4 + gaps) * 4 + ends
    return out


def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.split("\n")]


def _first_guess(symbols: np.ndarray) -> np.ndarray:
    return _STATE_OF_SHAPE[symbols.astype(np.int64) // 48]


class _Model:
    """Log probabilities of the hidden Markov model, from counts of (state, symbol) and (state, state)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        c = emit.astype(float).reshape(4, *_LEVELS)
        self.emit = np.zeros((4, *_LEVELS))
        for k, levels in enumerate(_LEVELS):
            n = c.sum(axis=tuple(j + 1 for j in range(4) if j != k))
            if k:
                n = n + 1
            else:
                own = _STATE_OF_SHAPE[None, :] == np.arange(4)[:, None]
                n = n * own + PRIOR * own / own.sum(axis=1, keepdims=True)
            p = n / n.sum(axis=1, keepdims=True)
            if k == 0:
                p = (1 - STRAY) * p + STRAY / levels
            self.emit += np.log(p).reshape(4, *[levels if j == k else 1 for j in range(4)])
        self.emit = self.emit.reshape(4, _SYMBOLS)
        # a blank line is a break, and nothing else is
        self.emit[_BREAK, 48:], self.emit[:, :48] = -1e6, -1e6
        self.emit[_BREAK, :48] = 0
        self.move = np.log((move + 1) / (move + 1).sum(axis=1, keepdims=True))

    def label(self, symbols: list[np.ndarray]) -> list[np.ndarray]:
        """The Viterbi paths of many documents, taken step by step side by side."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(symbols)
        size = np.array([len(x) for x in symbols], dtype=np.int64)
        order = np.argsort(size, kind="stable")[::-1]
        at = 0
        while at < len(order) and size[order[at]]:
            t = int(size[order[at]])
            own = order[at : at + max(1, min(512, (1 << 22) // t))]
            own = own[size[own] > 0]
            at += len(own)
            x = np.zeros((t, len(own)), dtype=np.int64)
            for j, d in enumerate(own):
                x[: size[d], j] = symbols[d]
            v = self.emit[:, x[0]].T
            back = np.tile(np.arange(4, dtype=np.int8), (t, len(own), 1))
            for k in range(1, t):
                live = int(np.searchsorted(-size[own], -k, side="left"))  # the longest stand first
                s = v[:live, :, None] + self.move[None]
                back[k, :live] = s.argmax(axis=1)
                v[:live] = s.max(axis=1) + self.emit[:, x[k, :live]].T
            now = v.argmax(axis=1)
            path = np.zeros((t, len(own)), dtype=np.int8)
            for k in range(t - 1, -1, -1):
                path[k] = now
                now = back[k, np.arange(len(own)), now]
            for j, d in enumerate(own):
                out[d] = path[: size[d], j]
        return out


def _is_text(labels) -> list[bool]:
    return [s == _BODY or s == _TITLE for s in labels]


def _plain(token: str) -> str:
    """A token without the punctuation around it, in lower case.

    A capital I inside a word becomes |, a small l among capitals becomes ı: both are misread.
    """
    w = token.strip(_EDGE).rstrip("!")
    if "l" in w and _CAPITALS.fullmatch(w):
        w = w.replace("l", "ı")
    if len(w) > 1 and not w.isupper() and "I" in w:
        # at the start a capital may be right, inside a word it is none
        w = w[0] + w[1:].replace("I", "|")
    return w.lower()


def _join(a: str, b: str) -> tuple[str, str]:
    """The two halves of a continued word as one, without and with the hyphen."""
    return _plain(a[:-1] + b), _plain(a[:-1] + "-" + b)


def _splits(lines: list[str], labels: list[int]):
    """(line, next line, first half with its hyphen, second half) of every continued word."""
    body = [k for k, s in enumerate(labels) if s in (_BODY, _TITLE) and lines[k]]
    for k, nxt in zip(body, body[1:]):
        a = lines[k].rsplit(None, 1)[-1]
        if len(a) > 1 and a[-1] in _HYPHENS and a[-2].isalnum() or (len(a) > 1 and a[-1] in _HYPHENS and a[-2] in "!@|"):
            yield k, nxt, a, lines[nxt].split(None, 1)[0]


def delivered_once(entries: DataFrame, doc_id: str = "doc_id", text: str = "doc_text", at: str = "retrieved_at") -> DataFrame:
    """``doc_id, text, symbols`` of every document, from its earliest delivery with a text; stored.

    Null ids are left out, as are documents without any text.
    """
    rows = entries.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    once = rows.groupBy(F.col(doc_id).alias("doc_id")).agg(F.min_by(text, F.struct(F.col(at), F.col(text))).alias("text"))
    return stored(_seen(once), "scans")


def _seen(docs: DataFrame) -> DataFrame:
    """``doc_id, text, symbols``: documents with what the line model sees of their lines, two bytes a line."""

    def run(batches):
        for b in batches:
            sym = [_symbols(_lines(t)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sym, pa.binary())], names=["doc_id", "text", "symbols"])

    if "symbols" in docs.columns:
        return docs
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id string, text string, symbols binary")


def _unpacked(column) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint16) for x in column.to_pylist()]


def _paths(model: _Model | None):
    """Counts of (state, symbol) and (state, state) along the paths, or along the first guess without a model."""

    def run(batches):
        emit, move = np.zeros((4, _SYMBOLS), np.int64), np.zeros((4, 4), np.int64)
        for b in batches:
            symbols = _unpacked(b.column(0))
            for sym, lab in zip(symbols, model.label(symbols) if model else map(_first_guess, symbols)):
                np.add.at(emit, (lab, sym), 1)
                np.add.at(move, (lab[:-1], lab[1:]), 1)
        both = np.concatenate([emit, move], axis=1)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both[i, j])], names=["i", "j", "n"])

    return run


def line_model(docs: DataFrame, rounds: int = ROUNDS) -> tuple[_Model, int]:
    """The model of lines fitted to ``symbols``, and the lines that its last paths label otherwise than their shape does."""
    model, emit = None, np.zeros((4, _SYMBOLS))
    for _ in range(rounds + 1):
        rows = docs.select("symbols").mapInArrow(_paths(model), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 4 x 436 rows at most
        both = np.zeros((4, _SYMBOLS + 4))
        for r in rows:
            both[r["i"], r["j"]] = r["n"]
        emit = both[:, :_SYMBOLS]
        model = _Model(emit, both[:, _SYMBOLS:])
    guess = _first_guess(np.arange(_SYMBOLS))
    return model, int(emit.sum() - emit[guess, np.arange(_SYMBOLS)].sum())


def _count(model: _Model):
    """Counts of the words of the text."""

    def run(batches):
        raw: Counter = Counter()
        words: Counter = Counter()
        for b in batches:
            for text, lab in zip(b.column(0).to_pylist(), model.label(_unpacked(b.column(1)))):
                lines = _lines(text)
                halves = list(_splits(lines, lab))
                cut_end = {h[0] for h in halves}
                cut_start = {h[1] for h in halves}
                for _, _, a, c in halves:
                    words[_join(a, c)[0]] += 1
                for k, of_text in enumerate(_is_text(lab)):
                    if of_text:
                        w = lines[k].split()
                        raw.update(w[int(k in cut_start) : len(w) - int(k in cut_end)])
        for t, n in raw.items():
            words[_plain(t)] += n
        out = [(w, n) for w, n in words.items() if w]
        for k in range(0, len(out), 20000):
            part = out[k : k + 20000]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part]) for i in range(2)], names=["word", "n"])

    return run


def _undone(w: str) -> dict[str, int]:
    """Every word that ``w`` may be a misreading of, by the number of confusions undone (at most two)."""
    out: dict[str, int] = {}
    last = {w: 0}
    for step in (1, 2):
        new: dict[str, int] = {}
        for x, lo in last.items():
            for k in range(lo, len(x)):
                for wrong, right in CONFUSIONS.items():
                    if x.startswith(wrong, k):
                        new.setdefault(x[:k] + right + x[k + len(wrong) :], k + len(right))
                if k == 0 and x[0] == "i":
                    new.setdefault("l" + x[1:], 1)
        for x in new:
            out.setdefault(x, step)
        last = new
    out.pop(w, None)
    return out


def _numeric(w: str) -> bool:
    return bool(re.fullmatch(r"\W*[\dloi|][\d.,:/\-loi|]*[a-z%]{0,2}\W*", w)) and sum(c.isdigit() for c in w) >= 1 and not re.search(r"[a-hj-km-np-z]{2}", w)


def _by_force(w: str) -> str:
    """``w`` with its foreign characters undone."""
    for wrong, right in FOREIGN.items():
        w = w.replace(wrong, right)
    return w


def _corrections(words: DataFrame) -> DataFrame:
    """``wrong, right`` for every distinct misread word. Candidates meet the vocabulary in a join."""

    def candidates(batches):
        for b in batches:
            out = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                odd = any(c in FOREIGN for c in w)
                if _numeric(w):
                    fixed = w.replace("l", "1").replace("|", "1").replace("o", "0")
                    if fixed != w and sum(c.isdigit() for c in w) >= 2:
                        out.append((w, n, fixed, 0, True))
                    continue
                if not any(c.isalpha() for c in w) or len(w) < 2 or len(w) > 40:
                    continue
                for x, step in _undone(w).items():
                    if not any(c in FOREIGN for c in x):
                        out.append((w, n, x, step, odd))
                if odd and re.fullmatch(r"[a-z!@051|ﬁﬂı'-]+", w) and sum(c.isalpha() and c not in FOREIGN for c in w) >= 2:
                    out.append((w, n, _by_force(w), 9, True))
            for k in range(0, len(out), 20000):
                part = out[k : k + 20000]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part]) for i in range(5)], names=["wrong", "n", "x", "step", "odd"])

    found = words.mapInArrow(candidates, "wrong string, n long, x string, step long, odd boolean")
    known = words.select(F.col("word").alias("x"), F.col("n").alias("seen"))
    met = found.join(known, "x", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    # a foreign character is wrong whatever the counts; letters alone need a much more frequent word
    sure = F.col("odd") & ((F.col("seen") > 0) | F.col("step").isin(0, 9))
    likely = (F.col("seen") >= SEEN) & (F.col("seen") >= RATIO * F.col("n"))
    order = F.struct(F.when(F.col("seen") >= SEEN, 0).otherwise(1), F.col("step"), -F.col("seen"), F.col("x"))
    return met.filter(sure | likely).groupBy("wrong").agg(F.min_by("x", order).alias("right")).filter("wrong <> right")


def _fit(docs: DataFrame):
    """The model of lines, and all words with their counts (stored)."""
    model, _ = line_model(docs)
    counts = docs.select("text", "symbols").mapInArrow(_count(model), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return model, stored(counts, "scan-words")


def _trusted(words: DataFrame, wrong: DataFrame) -> dict[str, int]:
    """The TRUSTED most frequent words that are no misreading, with their counts."""
    top = words.join(wrong.select(F.col("wrong").alias("word")), "word", "left_anti").orderBy(F.desc("n"), "word").limit(TRUSTED)
    return {r["word"]: r["n"] for r in top.collect()}


def _dashed(words: DataFrame, wrong: DataFrame) -> DataFrame:
    """``word, forms``: every word that is more frequent with a hyphen, with its forms with one. Misreadings count for nothing."""
    right = words.join(wrong.select(F.col("wrong").alias("word")), "word", "left_anti")
    at = F.posexplode(F.split("word", "")).alias("at", "c")
    each = right.filter(F.col("word").contains("-")).select("word", "n", at).filter("c = '-'")
    each = each.select(F.expr("concat(substring(word, 1, at), substring(word, at + 2))").alias("plain"), F.col("word").alias("form"), "n")
    met = each.join(right.toDF("plain", "seen"), "plain", "left").filter("n > coalesce(seen, 0)")
    return met.groupBy(F.col("plain").alias("word")).agg(F.collect_set("form").alias("forms"))


def _read(model: _Model, known: dict[str, int]):
    """Rows of doc_id, line, kind, word, dashed, half: furniture, continued words and words that are not trusted."""

    def run(batches):
        memo: dict[str, str | None] = {}

        def suspect(t: str) -> str | None:
            if t not in memo:
                w = _plain(t)
                memo[t] = None if not w or w in known or w.isdigit() else w
                if len(memo) > 2_000_000:
                    memo.clear()
                    return None if not w or w in known else w
            return memo[t]

        for b in batches:
            out = []
            for doc, text, lab in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), model.label(_unpacked(b.column(2)))):
                lines = _lines(text)
                halves = list(_splits(lines, lab))
                cut_end = {h[0] for h in halves}
                cut_start = {h[1] for h in halves}
                for k, nxt, a, c in halves:
                    out.append((doc, k + 1, "split_word", *_join(a, c), _plain(a[:-1]), nxt + 1))
                for k, s in enumerate(lab):
                    if s == _FURN:
                        out.append((doc, k + 1, "furniture", "", None, None, None))
                    elif s != _BREAK:
                        w = lines[k].split()
                        for t in w[int(k in cut_start) : len(w) - int(k in cut_end)]:
                            x = suspect(t)
                            if x is not None:
                                out.append((doc, k + 1, "misread", x, None, None, None))
            for k in range(0, len(out), 20000):
                part = out[k : k + 20000]
                types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], types[i]) for i in range(7)], names=["doc_id", "line_no", "kind", "word", "dashed", "half", "next_no"])

    return run


def repair(docs: DataFrame):
    """What a corpus needs for its repair: line model, misread and hyphenated words (stored) and trusted words, which only save work."""
    model, words = _fit(_seen(docs))
    wrong = stored(_corrections(words), "misread")
    fixes = wrong.withColumnRenamed("wrong", "word").join(_dashed(words, wrong), "word", "full")
    return model, stored(fixes, "fixes"), _trusted(words, wrong)


_ROWS = "doc_id string, line_no int, kind string, word string, dashed string, half string, next_no int"


def _fixed(docs: DataFrame, fitted) -> DataFrame:
    """The rows of ``_read`` with ``right`` for misread words; a continued word has its hyphen where that form is the more frequent one."""
    model, fixes, known = fitted
    rows = _seen(docs).select("doc_id", "text", "symbols").mapInArrow(_read(model, known), _ROWS).join(fixes, "word", "left")
    keeps = F.coalesce(F.array_contains("forms", F.col("dashed")), F.lit(False))
    return rows.withColumns({"keeps": keeps, "word": F.when(keeps, F.col("dashed")).otherwise(F.col("word")), "right": F.when(~keeps, F.col("right"))})


def findings(docs: DataFrame, fitted=None) -> DataFrame:
    """``doc_id, line_no, kind, fixed`` from ``doc_id, text``: all that has to be repaired.

    Lines count from 1 and end with LF. kind is furniture (fixed is empty), split_word (the whole
    word) or misread (the right word, in lower case without the punctuation around it). A word that
    is both continued and misread is reported as both, the misreading on the line that shows it.
    Empty texts have nothing to repair; equal rows come out once.
    """
    rows = _fixed(docs, fitted or repair(docs)).filter("kind <> 'misread' OR right IS NOT NULL")
    starts = F.col("right").startswith(F.col("half"))
    ends = F.col("right").endswith(F.expr("substring(word, length(half) + 1)"))
    both = F.array(
        F.struct(F.col("line_no"), F.col("kind"), F.coalesce("right", "word").alias("fixed")),
        F.when((F.col("kind") == "split_word") & F.col("right").isNotNull() & ~starts, F.struct(F.col("line_no"), F.lit("misread").alias("kind"), F.col("right").alias("fixed"))),
        F.when((F.col("kind") == "split_word") & F.col("right").isNotNull() & ~ends, F.struct(F.col("next_no").alias("line_no"), F.lit("misread").alias("kind"), F.col("right").alias("fixed"))),
    )
    flat = rows.select("doc_id", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("r"))
    return flat.select("doc_id", "r.line_no", "r.kind", "r.fixed").distinct()


def paragraphs(docs: DataFrame, fitted=None) -> DataFrame:
    """``doc_id, para_no, text``: the readable paragraphs, without furniture, with words made whole.

    A blank line between lines of text ends a paragraph unless the text before it is cut within a
    sentence at a page edge. A corrected word keeps its punctuation, and its capital where it had one.
    """
    fitted = fitted or repair(docs)
    model = fitted[0]
    # a continued word that keeps its hyphen stands for itself
    rows = _fixed(docs, fitted).filter("keeps OR right IS NOT NULL").select("doc_id", F.struct("word", F.when(~F.col("keeps"), F.col("right")).alias("right"), "keeps").alias("fix"))
    fixes = rows.groupBy("doc_id").agg(F.collect_set("fix").alias("f"))

    def run(batches):
        for b in batches:
            out = []
            for doc, text, fix, lab in zip(*(b.column(i).to_pylist() for i in range(3)), model.label(_unpacked(b.column(3)))):
                table = {x["word"]: x["right"] for x in fix or [] if not x["keeps"]}
                dashes = {x["word"] for x in fix or [] if x["keeps"]}
                lines = _lines(text)
                joins = {k: (nxt, a, c) for k, nxt, a, c in _splits(lines, lab)}
                paras: list[list[str]] = [[]]
                skip, edge = False, False
                for k, s in enumerate(lab):
                    if s in (_FURN, _BREAK):
                        edge |= s == _FURN
                        gap = bool(paras[-1]) and not (edge and paras[-1][-1][-1:] not in ".?!:\"”") and s == _BREAK
                        if gap and not skip:
                            paras.append([])
                        continue
                    edge = False
                    w = lines[k].split()
                    if skip:
                        w = w[1:]
                    skip = k in joins
                    if skip:
                        _, a, c = joins[k]
                        w[-1:] = [(a[:-1] + ("-" if _join(a, c)[1] in dashes else "") + c)]
                    for t in w:
                        p = _plain(t)
                        if p in table:
                            core = t.strip(_EDGE).rstrip("!")
                            right = table[p].upper() if core.isupper() and len(core) > 1 else table[p].capitalize() if core[:1].isupper() else table[p]
                            t = t.replace(core, right)
                        paras[-1].append(t)
                out += [(doc, n + 1, " ".join(p)) for n, p in enumerate(x for x in paras if x)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string())], names=["doc_id", "para_no", "text"])

    return _seen(docs).join(fixes, "doc_id", "left").select("doc_id", "text", "f", "symbols").mapInArrow(run, "doc_id string, para_no int, text string")
