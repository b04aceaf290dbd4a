"""Operators for training data against brute force, exact round trips and edge cases."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritome.llm import block_knn, bpe, eval_leaks, group_splits, ledger, name_variants, reading_level, scan_repair, split_overlap

Q = "record_id long, text string, split string, source string"


def _words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def _edit(x, y):
    p = list(range(len(y) + 1))
    for i, u in enumerate(x, 1):
        q = [i]
        for j, v in enumerate(y, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (u != v)))
        p = q
    return p[-1]


# --- 1


def _quotes(seed=3, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    rows, k = [], 0
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 5, 9, 10, 20, 33, 50]))]
        for _ in range(rng.choice([1, 2, 4])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(t) + 1)
                kind = rng.choice("cad")
                if kind == "a":
                    t.insert(at, rng.choice(vocab))
                elif t and at < len(t):
                    t[at : at + 1] = [rng.choice(vocab)] if kind == "c" else []
            sep = rng.choice([" ", "  ", ", ", "\n"])
            rows.append((k, sep.join(t).upper() if rng.random() < 0.3 else sep.join(t), rng.choice(["train", " TRAIN ", "val", "Test", None, "other"]), rng.choice(["a", None])))
            k += 1
    return rows + [(k, None, "train", "a"), (k + 1, "", "val", "a"), (k + 2, " ... ", "train", "a"), (k + 3, "— !", "test", "a")]


def test_cross_split_pairs_equal_brute_force(spark):
    rows = _quotes()
    ok = [(i, _words(t), (s or "").strip().lower()) for i, t, s, _ in rows]
    ok = [r for r in ok if r[1] and r[2] in ("train", "val", "test")]
    want = {(a[0], b[0]) for a in ok for b in ok if a[2] != "train" and b[2] == "train" and _edit(a[1], b[1]) <= max(len(a[1]), len(b[1])) // 10}
    df = spark.createDataFrame(rows, Q).withColumns({"words": F.lit(1), "key": F.lit("x"), "tid": F.lit(0)})
    got = [(r.eval_id, r.train_id) for r in split_overlap.cross_split_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    rep = split_overlap.overlap_report(df).collect()
    assert sum(r.n_pairs for r in rep) == len(want) and sum(r.n_overlapping for r in rep) == len({a for a, _ in want})
    assert split_overlap.cross_split_pairs(df.filter("false")).count() == 0


# --- 2


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Thomas Rokuzon", "ROKUZON, THOMAS A.", True),
        ("Thomas Rokuzon", "Esther Rokuzon", False),
        ("Eshter Rokuzon", "Esther Rokuzon", True),
        ("T. Rokuzon", "Thomas Rokuzon", True),
        ("TA Rokuzon", "Thomas Rokuzon", True),
        ("Bill Cudotan", "William Cudtan", True),
        ("Har. Tawamilt", "Harold Tawamilt", True),
        ("Dr. Harold Tridogur", "Harold Tridogur (CEO)", True),
        ("Harold Tridogur", "Gerald Tridogur", False),
        ("Libisagen Bros. Co.", "The Libisagen Brothers Company", True),
        ("Engineering, Stecobetec Inc", "Stecobetec Engineering", True),
        ("Rihawadyne Transportation LLC", "Rihawadune Technologies Corp", False),
        ("José Pebujum", "jose  pebujum", True),
        ("Al Leduflen", "Albert Leduflen", True),
        ("Leduflen, Ed", "Ed Leduflen", True),
        ("Chief Scientist Judith Gelahend", "Judith Gelahend", True),
        ("VP Sales Amanda Tripagror", "Amanda Tripagror (VP Sales)", True),
    ],
)
def test_same_name(a, b, same):
    for x, y in ((a, b), (b, a)):
        assert bool(name_variants.same_name(name_variants.parse_name(x), name_variants.parse_name(y), {"harold", "gerald"})) == same


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Maria Bill Juana Dolores Rokuzon", "Maria William Jauna Dolores Rokuzon", True),
        ("Maria Pilar Juana D. Rokuzon Tridogur", "Rokuzon Tridogur, Maria Pilar Juana Dolores", True),
        ("Maria Pilar Juana Dolores Rokuzon", "Maria Pilar Juana Esther Rokuzon", False),
        (" ".join(["Nana"] * 30), " ".join(["Nana"] * 29 + ["Nanna"]), True),
    ],
)
def test_same_name_of_many_tokens(a, b, same):
    assert (name_variants.same_name(name_variants.parse_name(a), name_variants.parse_name(b), set()) is not None) == same


def test_variant_pairs(spark):
    names = ["Thomas Rokuzon", "thomas rokuzon", "Rokuzon, Thomas", "Esther Rokuzon", "Thomsa Rokuzon", "T. Rokuzon", "E. Rokuzon", "Unknown", "unknown ", None, "", "...", "Court"]
    df = spark.createDataFrame([(n,) for n in names for _ in range(2)], "speaker string").withColumn("name", F.lit(1))
    got = {(r.speaker_a, r.speaker_b) for r in name_variants.variant_pairs(df).collect()}
    one = ["Rokuzon, Thomas", "T. Rokuzon", "Thomas Rokuzon", "Thomsa Rokuzon", "thomas rokuzon"]
    two = ["E. Rokuzon", "Esther Rokuzon"]
    assert got == {(a, b) for g in (one, two) for a in g for b in g if a < b}
    assert name_variants.variant_pairs(df.filter("false")).count() == 0


def test_frequent_misspellings_link_at_every_size(spark, monkeypatch):
    # "waltter" and "walter" both stand beside many surnames, as in a large corpus; albert and robert are as frequent as each other
    ends = [x * 3 + y * 3 for x in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va", "we", "zi") for y in ("tak", "bev", "gorl", "zind", "pruf", "hesk", "lomn", "vick", "quar", "nyst", "dwel", "sharm")]
    names = [f"Walter {e}" for e in ends] + [f"Waltter {e}" for e in ends[::12]] + [f"Qalter {ends[0]}"]
    names += [f"{g} {e}" for g in ("Albert", "Robert") for e in ends[:24]]
    df = spark.createDataFrame([(n,) for n in names], "speaker string")
    got = {(r.speaker_a, r.speaker_b) for r in name_variants.variant_pairs(df).collect()}
    want = {(f"Walter {e}", f"Waltter {e}") for e in ends[::12]} | {(f"Qalter {ends[0]}", f"{g} {ends[0]}") for g in ("Walter", "Waltter")}
    assert got == want
    for anchor in (0, 1_000_000):  # where names meet does not change what is linked
        monkeypatch.setattr(name_variants, "ANCHOR", anchor)
        assert {(r.speaker_a, r.speaker_b) for r in name_variants.variant_pairs(df).collect()} == want


def test_no_plan_of_name_variants_is_large(spark, monkeypatch):
    # the driver's memory goes with the size of the largest plan
    joins = []

    def counted(f):
        def run(df, *rest):
            joins.append(len(re.findall(r"\bJoin (?:Inner|LeftOuter|LeftSemi|LeftAnti)", df._jdf.queryExecution().optimizedPlan().toString())))
            return f(df, *rest)

        return run

    for name in ("cut", "stored"):
        monkeypatch.setattr(name_variants, name, counted(getattr(name_variants, name)))
    df = spark.createDataFrame([(n,) for n in ("Thomas Rokuzon", "Thomsa Rokuzon", "T. Rokuzon", "Esther Rokuzon")], "speaker string")
    assert name_variants.variant_pairs(df).count() == 3
    assert 2 <= max(joins) <= 8, joins


def _invented(rng, n):
    syl = ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va", "we", "zi", "tra", "plo", "sku", "bre", "gli", "dro"]
    out = set()
    while len(out) < n:
        out.add("".join(rng.choice(syl) for _ in range(rng.choice([3, 4]))) + rng.choice(["n", "r", "t", "lk", "x"]))
    return sorted(out)


@pytest.mark.parametrize("n", [12, 120])
def test_recall_of_names_at_growing_size(spark, n):
    # as many given names as it takes: every surname stands beside many of them, typos are rare
    rng = random.Random(n)
    given, last = _invented(rng, 12 + n // 4), _invented(rng, n)
    entity = {}
    for k, s in enumerate(last):
        for g in rng.sample(given, 5):
            for form in (f"{g} {s}", f"{g.upper()} {s.upper()}", f"{s}, {g}", f"Dr. {g} {s}", f"{g} {s}, Vice President Sales"):
                entity[form.title() if not form.isupper() else form] = (g, s)
            if k % 4 == 0:
                at = rng.randrange(1, len(s) - 1)
                entity[f"{g} {s[:at]}{s[at + 1]}{s[at]}{s[at + 2:]}".title()] = (g, s)
    df = spark.createDataFrame([(x,) for x in entity], "speaker string")
    got = {(r.speaker_a, r.speaker_b) for r in name_variants.variant_pairs(df).collect()}
    groups = {}
    for x, e in entity.items():
        groups.setdefault(e, []).append(x)
    want = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


# --- 4


def test_splits_keep_groups_together(spark):
    cases = spark.createDataFrame([(f"c{i}", " C0 " if 0 < i < 4 else "c9" if i == 9 else "absent" if i in (5, 6) else None, "x") for i in range(30)] + [(None, "c1", None)], "case_id string, lead_case_id string, label string")
    rows = [(k, f"c{k % 30}" if k % 11 else None, f"d{k % 45}" if k % 13 else None) for k in range(600)] + [(1000 + k, "c7", "d7") for k in range(250)] + [(2000, None, None)]
    quotes = spark.createDataFrame(rows, "record_id long, case_id string, doc_id string").withColumn("unit", F.lit("clash"))
    g = {r.case_id: r.group_id for r in group_splits.case_groups(cases, quotes).collect()}
    out = group_splits.assign_splits(group_splits.related_groups(cases, quotes)).collect()
    assert len(out) == len(rows) and {r.record_id for r in out} == {r[0] for r in rows}
    where = {}
    for r in out:
        assert where.setdefault(r.unit, (r.split, r.fold)) == (r.split, r.fold)
    case_of = {i: c for i, c, _ in rows}
    by_group = {}
    for r in out:
        if case_of[r.record_id]:
            key = g.get(case_of[r.record_id], case_of[r.record_id])
            assert by_group.setdefault(key, r.split) == r.split
    assert g["c1"] == g["c2"] == g["c3"] == "c0"


def test_split_shares(spark):
    rows = spark.range(3000).select(F.col("id").alias("record_id"), F.concat(F.lit("u"), (F.col("id") % 300).cast("string")).alias("unit"), F.when(F.col("id") % 4 > 0, (F.col("id") % 3).cast("string")).alias("label"))
    share = {r.split: r.share for r in group_splits.balance(group_splits.assign_splits(rows)).collect()}
    assert abs(share["train"] - 0.7) < 0.01 and abs(share["val"] - 0.15) < 0.01 and abs(share["test"] - 0.15) < 0.01
    assert group_splits.assign_splits(rows.filter("false")).count() == 0
    with pytest.raises(ValueError):
        group_splits.assign_splits(rows.withColumn("label", F.col("record_id").cast("string")))


# --- 5


def test_ledger(spark):
    m = '{"court": "x", "party": "A v. B"}'
    rows = [
        (5, "Hello, World 1!", m, "2024-01-02"), (2, "hello world 1", '{"party":"a v b","court":" X"}', "2024-02-02"), (9, "HELLO​  world-1", m, None),
        (3, "Hello world 1", None, "2024-01-01"), (4, "hello world1", None, "2024-03-01"), (6, "hello world 2", m, "2024-01-01"), (7, None, m, "2024-01-01"),
        (8, None, m, "2024-01-05"), (10, "", m, "2024-01-01"), (11, "…", m, "2024-04-01"), (12, "x", "not json", "2024-01-01"), (13, "X", "NOT  JSON", "2024-01-01"),
    ]
    df = spark.createDataFrame(rows, "record_id long, text string, meta string, at string").withColumn("ingested_at", F.to_timestamp("at")).withColumns({"key": F.lit(1), "bucket": F.lit(2)})
    for batches in (1, 2, 5):
        keyed, kept = ledger.collapse(df, batches=batches)
        got = {(r.keep_id, r.record_id) for r in ledger.copies_of(keyed, kept).collect()}
        assert got == {(2, 5), (2, 9), (3, 4), (7, 8), (10, 11), (12, 13)}
        assert sum(r.copies for r in kept.records().collect()) == len(rows)
    keyed, kept = ledger.collapse(df.filter("false"))
    assert kept.records().count() == 0 and ledger.copies_of(keyed, kept).count() == 0


def test_ledger_reopens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "BUCKET_ROWS", 16)
    path = str(tmp_path / "ledger")
    part = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("record_id"), F.unhex(F.md5((F.col("id") % 90).cast("string"))).alias("key"), F.timestamp_seconds("id").alias("at"))
    state = lambda x: sorted((bytes(r.key), r.copies, r.keep_id, r.first_at, r.last_at) for r in x.records().collect())
    first = ledger.DedupLedger(spark, path)
    assert first.update(part(100, 200), "a") and first.state["buckets"] > 1
    again = ledger.DedupLedger(spark, path)
    assert state(again) == state(first) and again.batches == ["a"]
    assert not again.update(part(100, 200), "a") and sum(r[1] for r in state(again)) == 100
    # dies after the data and before the manifest
    with monkeypatch.context() as m:
        m.setattr(ledger._Folder, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ledger.DedupLedger(spark, path).update(part(0, 100), "b")
    third = ledger.DedupLedger(spark, path)
    assert state(third) == state(again) and third.batches == ["a"]
    assert third.update(part(0, 100), "b") and third.update(part(200, 203), "c") and third.update(part(0, 0), "d")
    whole = ledger.DedupLedger(spark, str(tmp_path / "whole"))
    whole.update(part(0, 203))
    assert state(ledger.DedupLedger(spark, path)) == state(whole)
    kept = {f"bucket={b}" for b, v in third.state["at"].items() if v == 1}
    assert len(third.folder.names("manifest")) == 2 and {d for d in third.folder.names("v1") if d.startswith("bucket=")} == kept
    with pytest.raises(FileExistsError):
        first.update(part(0, 1), "late")


# --- 6


@pytest.mark.parametrize("cell_rows, tile_rows, groups", [(10_000, 10_000, 8), (20, 10_000, 8), (20, 7, 8), (1, 10_000, 2)])
def test_nearest_equals_brute_force(spark, monkeypatch, cell_rows, tile_rows, groups):
    monkeypatch.setattr(block_knn, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(block_knn, "NEAR_GROUPS", groups)
    rng = np.random.default_rng(5)
    X = rng.normal(size=(200, 8)).astype(np.float32)
    X[20:40] = X[0:20] * 3
    X[50] = X[51] = X[52] = X[53]
    X[60:75] = X[60]
    ids = rng.permutation(1000)[:200]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, X)] + [(5001, None), (5002, []), (5003, [0.0] * 8), (5004, [1.0] * 4), (5005, [float("nan")] * 8), (5006, [None] * 8)]
    df = spark.createDataFrame(rows, "record_id long, v array<float>").withColumn("rep", F.lit(1))
    U = X.astype(float) / np.linalg.norm(X.astype(float), axis=1)[:, None]
    S = np.round(U @ U.T, 9)
    want = set()
    for a in range(len(X)):
        o = [b for b in np.lexsort((ids, -S[a])) if b != a][:5]
        want |= {(int(ids[a]), int(ids[b])) for b in o}
    got = {(r.record_id, r.other_id) for r in block_knn.nearest(df, "record_id", "v", 8, cell_rows=cell_rows, probes=1000).collect()}
    assert got == want  # with as many probes as blocks
    assert block_knn.nearest(df.filter("record_id > 5000"), "record_id", "v", 8).count() == 0
    assert block_knn.nearest(df.filter(df.record_id == int(ids[0])), "record_id", "v", 8).count() == 0


def test_nearest_recall_of_the_index(spark):
    rng = np.random.default_rng(8)
    X = np.repeat(rng.normal(size=(600, 16)), 8, axis=0) + 0.15 * rng.normal(size=(4800, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(X)], "record_id long, v array<float>")
    U = X / np.linalg.norm(X, axis=1)[:, None]
    S = U @ U.T
    np.fill_diagonal(S, -2)
    want = {(a, int(b)) for a in range(len(X)) for b in np.argpartition(-S[a], 5)[:5]}
    got = {(r.record_id, r.other_id) for r in block_knn.nearest(df, "record_id", "v", 16, cell_rows=100).collect()}
    assert len(got & want) >= 0.9 * len(want)


# --- 7


def test_scan_repair(spark):
    good = "the court found that the claim was within the statute and the director signed every notice before trial".split()
    text = "No. 1:10-cv-12345\nthe court found fhat the cla-\n- 1 -\n\x0cAcme Holdings v. Brown\n\nim was vvithin the sta¬\ntute and the direct0r\r\nsigned every self-\nexecuting notice.\n\n274 units\nPage 2 of 2"
    many = [(f"d{k}", k, "\n".join([" ".join(good)] * 6 + ["a self-executing notice came."] * 2), None) for k in range(12)]
    rows = [("x", 1, text, None), ("x", 1, text, None), ("n", 1, None, None), ("e", 1, "", None), (None, 1, "x", None), *many]
    df = spark.createDataFrame(rows, "doc_id string, entry_id int, doc_text string, retrieved_at timestamp").withColumns({"text": F.lit(1), "word": F.lit(2)})
    docs = scan_repair.delivered_once(df)
    fitted = scan_repair.repair(docs)
    got = {(r.line_no, r.kind, r.fixed) for r in scan_repair.findings(docs, fitted).collect() if r.doc_id == "x"}
    assert got == {
        (1, "furniture", ""), (3, "furniture", ""), (4, "furniture", ""), (12, "furniture", ""), (2, "misread", "that"), (2, "split_word", "claim"),
        (6, "misread", "within"), (6, "split_word", "statute"), (7, "misread", "director"), (8, "split_word", "self-executing"),
    }
    p = [r.text for r in scan_repair.paragraphs(docs, fitted).filter("doc_id = 'x'").orderBy("para_no").collect()]
    assert p[0] == "the court found that the claim was within the statute and the director signed every self-executing notice." and p[1] == "274 units"
    none = scan_repair.delivered_once(df.filter("false"))
    assert scan_repair.findings(none).count() == 0


def test_context_overrules_the_shape(spark):
    rng = random.Random(4)
    body = lambda: " ".join(rng.choice("court claim found notice that was within statute the signed every trial".split()) for _ in range(9)) + rng.choice([" the", "."])
    page = lambda head, n: [head, *[body() for _ in range(12)], f"- {n} -"]
    docs = [(f"d{k}", "\n".join(x for n in (1, 2, 3) for x in page(f"Acme{chr(97 + k % 20)} Holdings v. Brown        {n}", n))) for k in range(150)]
    # a misread letter hides the shape of the header, its place and its coming back do not change
    odd = "Gowema lnsurance v. Zadriz        "
    docs.append(("x", "\n".join(x for n in (1, 2, 3) for x in page(f"{odd}{n}", n))))
    table = scan_repair._seen(spark.createDataFrame(docs, "doc_id string, text string"))
    model, changed = scan_repair.line_model(table)
    assert {scan_repair._STATE_OF_SHAPE[scan_repair._shape(f"{odd}1")]} == {scan_repair._BODY} and changed == 3
    got = {r.line_no for r in scan_repair.findings(table).filter("doc_id = 'x' AND kind = 'furniture'").collect()}
    assert got == {1, 14, 15, 28, 29, 42}


def test_hyphens_beyond_the_trusted_words(spark, monkeypatch):
    monkeypatch.setattr(scan_repair, "TRUSTED", 5)
    common = "the court found that claim was"
    docs = spark.createDataFrame([("a", f"{common}\n" * 9 + "a cross-motion came before it was heard.\n" * 3), ("b", "the court found that the cross-\nmotion was a cla-\nim and nothing more.")], "doc_id string, text string")
    fitted = scan_repair.repair(docs)
    got = {(r.line_no, r.fixed) for r in scan_repair.findings(docs, fitted).filter("doc_id = 'b' AND kind = 'split_word'").collect()}
    assert got == {(1, "cross-motion"), (2, "claim")}
    assert [r.text for r in scan_repair.paragraphs(docs, fitted).filter("doc_id = 'b'").collect()] == ["the court found that the cross-motion was a claim and nothing more."]


# --- 8


@pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_RANKS), reason="no vocabulary file")
@pytest.mark.parametrize("head, few, long_", [(bpe.HEAD, bpe.FEW, bpe.LONG), (2, 0, 4), (2, 256, 4)])
def test_bpe_round_trip_and_library(spark, monkeypatch, head, few, long_):
    # where a word is encoded and how it returns does not change its ids
    for name, v in (("HEAD", head), ("FEW", few), ("LONG", long_)):
        monkeypatch.setattr(bpe, name, v)
    tokenizers = pytest.importorskip("tokenizers")
    tk = tokenizers.Tokenizer.from_file(bpe.DEFAULT_RANKS.replace(".tiktoken", ".json"))
    tk.encode_special_tokens = True
    texts = [None, "", " ", "\n\n  x", "aaaaaaaaaaaaa", "Hello world's  best <|endoftext|> naïve 東京 👍🏽", "x" * 300 + " Zqxjv 12345678901", "  a\tb\r\n", "don't I'll WE'VE", "hello hello hello", "zyxw" * 50_000 + " end", " ".join(f"q{k}zx" for k in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"w": F.lit(1), "row": F.lit(2)})
    enc = bpe.encode(df)
    got = {r.doc_id: list(r.ids) for r in enc.collect()}
    assert got == {i: tk.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.decoded for r in bpe.decode(enc).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(df.filter("false")).count() == 0


# --- 9


def _leaky(item, doc):
    for s in range(len(item) - 14):
        row = [0] * (len(doc) + 1)
        for e in range(s, len(item)):
            new = [row[0] + 1]
            for j, v in enumerate(doc, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (v != item[e])))
            row = new
            if e - s + 1 >= 15 and min(row) * 8 <= e - s + 1:
                return True
    return False


@pytest.mark.parametrize("item_words, pairs, shard", [(eval_leaks.ITEM_WORDS, eval_leaks.PAIRS, eval_leaks.SHARD_WORDS), (100, 3, 200)])
def test_leaks_equal_brute_force(spark, monkeypatch, item_words, pairs, shard):
    for name, v in (("ITEM_WORDS", item_words), ("PAIRS", pairs), ("SHARD_WORDS", shard)):
        monkeypatch.setattr(eval_leaks, name, v)
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([8, 15, 20, 30])))) for i in range(12)] + [(90, None), (91, ""), (92, items_text := "a b c")]
    docs = []
    for k in range(60):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 10, 40]))]
        piece = _words(rng.choice(items[:12])[1])
        a = rng.randrange(max(1, len(piece) - 14))
        piece = piece[a : a + rng.choice([14, 15, 16, 17, 24, 30])]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(piece))
            kind = rng.choice("cad")
            piece[at : at + 1] = {"c": ["zz"], "a": [piece[at], "zz"], "d": []}[kind] or ["zz"] * (len(piece) == 1)
        docs.append((k, " ".join(w + piece + w[:5]).upper().replace(" ", rng.choice([" ", ",\n", " - "]))))
    docs += [(900, None), (901, ""), (902, items_text)]
    want = {(d, i) for d, t in docs for i, x in items if _leaky(_words(x), _words(t))}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in eval_leaks.leaks(df, it).collect()}
    assert got == want and want
    same = {}
    for d, t in docs:
        for i, x in items:
            a, b = _words(x), _words(t)
            runs = [(-n, p, q) for p in range(len(a)) for q in range(len(b)) if (p == 0 or q == 0 or a[p - 1] != b[q - 1]) and (n := next((k for k in range(len(a)) if p + k >= len(a) or q + k >= len(b) or a[p + k] != b[q + k]), len(a))) >= 5]
            if runs and len(a) >= 15:
                same[d, i] = (-min(runs)[0], *min(runs)[1:])
    assert {(r.doc_id, r.item_id): (r.n_words, r.item_pos, r.doc_pos) for r in eval_leaks.matches(df, it).collect()} == same
    assert {r.doc_id for r in eval_leaks.clean_corpus(df, it).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert eval_leaks.leaks(df.filter("false"), it).count() == eval_leaks.leaks(df, it.filter("false")).count() == 0


# --- 10


@pytest.mark.parametrize("head", [reading_level.HEAD, 4])
def test_reading_level_held_out(spark, monkeypatch, head):
    monkeypatch.setattr(reading_level, "HEAD", head)  # where a rank comes from does not change it
    rng = random.Random(2)
    easy, hard = ["the", "cat", "sat", "dog", "ran", "a"], ["jurisdictional", "notwithstanding", "extraterritoriality", "the", "of"]
    docs = []
    for k in range(120):
        p = (k % 3) / 2
        docs.append((k, " ".join(rng.choice(hard if rng.random() < p else easy) + ("." if rng.random() < 0.1 else "") for _ in range(60)), rng.choice(["en", "EN", "en-US", " eng "])))
    docs += [(900, None, "en"), (901, "", "en"), (902, "short text", "en"), (903, docs[0][1], None), (904, docs[0][1], "de"), (905, "1 2 " * 40, "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"row": F.lit(1), "band": F.lit(9)})
    labels = spark.createDataFrame([(k, 1 + k % 3) for k in range(0, 120, 2)] + [(1, None)], "doc_id long, band int")
    levels = reading_level.profile(df)
    got = {r.doc_id: r.band for r in reading_level.score(levels, reading_level.fit(levels, labels)).collect()}
    assert set(got) == set(range(120))
    assert sum(got[k] == 1 + k % 3 for k in range(1, 120, 2)) >= 54
    assert {r.band for r in reading_level.score(levels, reading_level.fit(levels, labels.filter("false"))).collect()} == {None}
    assert reading_level.profile(df.filter("false")).count() == 0
