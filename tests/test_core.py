"""Operators of the core against small fixtures."""

import datetime as dt
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from veritome import queries
from veritome.functions import features, ids, lexical, text, vectors
from veritome.operators import cases, extraction, filters, hotkeys, models, ordered, splits, stats, tables
from veritome.operators.components import connected_components
from veritome.sources import readers, writers
from veritome.streaming import streams


def one(spark, expr, **cols):
    """The value of an expression over one row of columns."""
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in cols.items()))
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Hello   world\n\nwith  extra    spaces.", "Hello world\n\nwith extra spaces."),
        ("", ""),
        ("   ", ""),
        ("\n\t  \n", ""),
        ("word1\t\tword2", "word1 word2"),
        ("Page 1 of 2\nbody text [35] goes on", "body text goes on"),
        ("guaran-\ntee", "guarantee"),
        ("Café “x” – y", 'Café "x" - y'),
        (None, None),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, text.clean(F.col("t")), t=raw) == want


def _cleaned(t):
    """The cleaner in plain Python."""
    if t is None:
        return None
    t = re.sub(r"(?m)^\s*Page \d+ of \d+\s*$", "", t)
    t = re.sub(r"(?m)^(?:Id\.|Federal Trade Commission).*\n", "", t)
    t = re.sub(r"[ \t]+", " ", re.sub(r"\s*\[\d+\]", "", t))
    t = re.sub(r"(?m)^\s*\d+\s*$", "", t).replace("-\n", "")
    t = re.sub(r"(?m)^[ \t]+", "", re.sub(r"(?<!\n)\n(?!\n)", " ", t))
    return re.sub(r" {2,}", " ", re.sub(r"(?m)[ \t]+$", "", re.sub(r"\n{3,}", "\n\n", t)).strip())


def test_clean_text_rows(spark, tmp_path):
    rows = [(1, "Page 1 of 2\nThe  court [3] held\nthat it was guar-\nanteed.\n\n\n\n 12 \n\nNext   one."), (2, None), (3, ""), (4, "Id. at 5\nkept\tall"), (5, "  plain text  ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in queries.QUERIES["clean_text_rows"](spark, str(tmp_path)).collect()}
    assert got == {i: _cleaned(t) for i, t in rows}


def test_text_scalars(spark):
    assert one(spark, text.normalize_for_hash(F.col("t")), t="  “Hi”  there!?") == '"hi" there'
    assert one(spark, text.normalize_for_hash(F.col("t")), t=None) == ""
    assert one(spark, text.words(F.col("t")), t="café naïve x") == ["café", "naïve", "x"]
    assert one(spark, text.phrase_count(F.col("t"), "safe harbor"), t="Safe harbor, unsafe harbor; safe harbors") == 1
    assert one(spark, text.match_starts(F.col("t"), r"\d+"), t="1a22b333") == [0, 2, 5]
    assert one(spark, text.slug(F.col("t")), t=" A & B, Inc. ") == "a-b-inc"
    assert one(spark, text.case_year(F.col("t")), t="24-10951_ca5") == 2024
    assert one(spark, text.case_year(F.col("t")), t="1:99-cv-01234_nysd") == 1999
    assert one(spark, text.case_year(F.col("t")), t="none") == 2020
    assert one(spark, text.section_headers(F.col("t")), t="x\nTHE PARTIES\ny") == ["THE PARTIES"]


def test_ids(spark):
    a = one(spark, ids.doc_id(F.col("u"), F.col("r")), u="https://example.com/case1#top", r="2024-01-01T00:00:00Z")
    b = one(spark, ids.doc_id(F.col("u"), F.col("r")), u="https://example.com/case1", r="2024-01-01T00:00:00Z")
    assert a == b and len(a) == 26 and one(spark, ids.is_id(F.col("u"), "doc"), u=a)
    assert one(spark, ids.doc_id(F.col("u"), F.col("r")), u="", r="x") is None
    assert one(spark, ids.case_id(F.col("c"), F.col("d")), c=" NYSD ", d="1") == one(spark, ids.case_id(F.col("c"), F.col("d")), c="nysd", d="1")


def test_vectors_and_lexical(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    r = df.select(vectors.dot("a", "b").alias("d"), vectors.cosine("a", "a").alias("c"), vectors.l1("a", "b").alias("l1"), vectors.linf("a", "b").alias("li"), vectors.softmax(F.col("a")).alias("s")).first()
    assert (r.d, r.c, r.l1, r.li) == (0.0, 1.0, 3.0, 2.0) and abs(sum(r.s) - 1) < 1e-12
    t = spark.createDataFrame([(["a", "false", "b", "false", "said"],)], "t array<string>")
    inside = lambda x: x == "false"
    r = t.select(lexical.indices(F.col("t"), ["false"]).alias("i"), lexical.run_mean(F.col("t"), inside).alias("m"), lexical.transition_rate(F.col("t"), lambda x: x == "a", inside).alias("q")).first()
    assert r.i == [1, 3] and r.m == 1.0 and r.q == 0.25


def test_hot_keys(spark):
    rows = [("a", f"s{i % 7}", i) for i in range(60)] + [("b", None, 5)] * 3 + [(None, "x", 1)] * 37
    df = spark.createDataFrame(rows, "case_id string, speaker string, n int")
    assert [r.case_id for r in hotkeys.hot_keys(df, "case_id", "speaker", 0.1).collect()] == ["a"]
    p = {r.case_id: r for r in hotkeys.key_profile(df, "case_id", "speaker", "n").collect()}
    assert p["a"].n_rows == 60 and p["a"].n_values == 7 and p["a"].mode_value == "s0" and p["b"].mode_value is None and None not in p
    q = {(r.case_id, r.share): r.value for r in hotkeys.key_percentiles(df, "case_id", "n", (0.5, 1.0)).collect()}
    assert q[("a", 0.5)] == 29 and q[("a", 1.0)] == 59 and q[("b", 0.5)] == 5
    neg = spark.createDataFrame([("k", v) for v in (-5, -1, 0, 3, 2**40)], "k string, v bigint")
    assert {r.share: r.value for r in hotkeys.key_percentiles(neg, "k", "v", (0.2, 0.4, 1.0)).collect()} == {0.2: -5, 0.4: -1, 1.0: 2**40}
    empty = df.filter("false")
    assert hotkeys.hot_keys(empty, "case_id", "speaker", 0.1).count() == hotkeys.key_profile(empty, "case_id", "speaker", "n").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 101), (None, 5), (200, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 100}
    hub = [(0, i) for i in range(1, 300)]
    assert {r.component for r in connected_components(spark.createDataFrame(hub, "a int, b int"), "a", "b").collect()} == {0}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_filters(spark):
    df = spark.createDataFrame([("a", "Court", 1.0), ("a", None, 2.0), ("b", "x", None)], "k string, speaker string, v double")
    assert filters.drop_values(df, "speaker", ["Court"]).count() == 2
    assert [r.k for r in filters.valid_groups(df, "k", F.col("v") > 0).collect()] == ["a", "a"]
    assert filters.drop_outliers(df, "v", 1.5).count() == 2
    assert filters.padded_select(df, [("v", "int"), ("z", "string")]).first().asDict() == {"v": 1, "z": None}
    assert filters.training_columns(df, patterns=["x"]) == ["v"]
    with pytest.raises(ValueError):
        filters.governed_columns(["a"], ["a"], ["a"])


def test_extraction(spark):
    t = 'He said, "We have not sold any data and never will." See https://x.y/z\n\nNo quote here. "short"'
    docs = spark.createDataFrame([("d", t), ("e", None)], "doc_id string, text string")
    q = extraction.quotes(docs, "doc_id", "text").collect()
    assert [r.quote for r in q] == ["We have not sold any data and never will."] and q[0].urls == ["https://x.y/z"]
    m = spark.createDataFrame([("d", "paid $1,234.50, then $5.2 million and 3 billion")], "doc_id string, text string")
    assert [r.value for r in extraction.amounts(m, "doc_id", "text").orderBy("start").collect()] == [1234.5, 5.2e6, 3e9]
    s = spark.createDataFrame([("a", "the quick brown fox jumps over the lazy dog"), ("b", "the quick brown fox jumps over the lazy dog"), ("c", "entirely different words stand in this one")], "k string, t string")
    assert [(r.key_a, r.key_b, r.distance) for r in extraction.near_duplicates(s, "k", "t").collect()] == [("a", "b", 0)]
    al = extraction.alias_speaker(spark.createDataFrame([("then Acme Corp spoke",), ("nobody",)], "c string"), "c", spark.createDataFrame([("acme corp",), ("zeta",)], "a string"), "a")
    assert [r.speaker for r in al.collect()] == ["Acme Corp"]
    mg = spark.createDataFrame([("k", 1, "one two", "c"), ("k", 2, "two three", "c"), ("k", 3, "four", "c")], "k string, o int, q string, c string")
    assert sorted(r.q for r in extraction.merge_adjacent(mg, "k", "o", "q", "c").collect()) == ["four", "one two two three"]
    assert one(spark, extraction.locate(F.col("t"), F.col("q")), t="ab CD ef", q="cd") == 3
    assert one(spark, extraction.locate(F.col("t"), F.col("q")), t="a  b\n\nshe  said (no)\tmore", q="Said (no) more") == 11
    assert one(spark, extraction.locate(F.col("t"), F.col("q")), t="abc", q="x y") == -1
    assert one(spark, extraction.speaker_by_verb(F.col("t")), t='Then Carol said, "Our product is safe."') == "Carol"
    assert one(spark, extraction.speaker_by_verb(F.col("t")), t='Carol said so before the word "safe" came up.') is None


def test_near_duplicates_equal_brute_force(spark):
    hashes = [0, 1, 7, 15, -1, -8, 1 << 40, (1 << 40) | 3, 1 << 63, (1 << 63) | (1 << 20) | 5]
    hashes = [h - (1 << 64) if h >= 1 << 63 else h for h in hashes]
    df = spark.createDataFrame(list(enumerate(hashes)), "k int, h long")
    want = {(a, b, d) for a, x in enumerate(hashes) for b, y in enumerate(hashes) if a < b and (d := bin((x ^ y) & ((1 << 64) - 1)).count("1")) <= 3}
    before, extraction.simhash = extraction.simhash, lambda c: c
    try:
        got = {(r.key_a, r.key_b, r.distance) for r in extraction.near_duplicates(df, "k", "h").collect()}
    finally:
        extraction.simhash = before
    assert got == want


def test_ordered_results_of_a_hot_group(spark):
    rows = [("hot", i % 50, i, i % 7) for i in range(900)] + [(f"k{i % 40}", i % 3, i, 1) for i in range(100)] + [(None, 1, 7, 2), (None, 0, 9, 3)]
    df = spark.createDataFrame(rows, "k string, o int, t int, v int")
    got = {(r.k, r.o, r.t): (r.n, r.s) for r in ordered.running_sums(df, ["k"], ["o", "t"], {"n": F.lit(1), "s": F.col("v")}).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]), 1):
            total += r[3]
            want[r[:3]] = (n, total)
    assert got == want
    q = {r.k: r.q_0 for r in ordered.group_quantiles(df, ["k"], "v", [0.5]).collect()}
    assert q["hot"] == 3.0 and q[None] == 2.5
    assert ordered.places(df.filter("false"), ["k"], ["o"]).count() == 0 and ordered.quantile_points(df.filter("false"), "v", [0.5]).first().q_0 is None
    plan = ordered.with_group(df, ["k"], {"m": F.max("v")})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_tables(spark):
    df = spark.createDataFrame([(f"c{i % 30}", float(i), 2.0 * i + 1, float((i * 37) % 11)) for i in range(300)], "k string, a double, b double, c double")
    r = tables.bootstrap_mean(df, "k", "a", 200).first()
    assert r.n_cases == 30 and r.low < r.mean < r.high and 143 < r.low and r.high < 156
    assert tables.prune_correlated(df, ["a", "b", "c"], {"a": 0.7, "b": 0.6}) == ["a", "c"]
    v = tables.inflation(df, ["a", "c"])
    assert all(1 <= x < 1.1 for x in v.values())
    assert [x.a for x in tables.seeded_sample(df, "a", 5, 3).collect()] == [x.a for x in tables.seeded_sample(df.repartition(5), "a", 5, 3).collect()]
    none = features.token_frame(spark.createDataFrame([(1, None, None), (2, "Misleading, false and may be false", "It said so")], "i int, t string, c string"), "t", "c", ["i"])
    rows = {x.i: x for x in features.binary_features(none).collect()}
    assert rows[1].lex_deception_count == 0 and rows[2].lex_deception_count == 3 and rows[1].new5_deesc_half_life == 0
    maps = {x.i: x.transitions for x in features.sequence_features(none).collect()}
    assert maps[1] == {} and abs(sum(maps[2].values()) - 1) < 1e-9
    m = features.feature_matrix(spark.createDataFrame([(1, {"x": 2.0})], "i int, f map<string,double>"), "i", "f", ["y", "x"]).first()
    assert m.asDict() == {"i": 1, "x": 2.0, "y": 0.0}


def test_cases_and_splits(spark):
    df = spark.createDataFrame([("c1", i, i * 10.0) for i in range(1, 9)] + [("c2", 1, None)], "k string, n int, v double")
    assert {r.k: r.n_quotes for r in cases.case_features(df.withColumns({"s": F.col("n") * 100, "l": F.lit(50), "p": F.col("v"), "f": F.col("n") > 2}), "k", "n", "s", "l", "p", "f").collect()} == {"c1": 4, "c2": 1}
    f = splits.rolling_folds(spark.createDataFrame([(f"c{i}", 2000 + i // 3) for i in range(24)], "case_id string, year int"), "case_id", "year", 3)
    rows = f.collect()
    for k in range(3):
        train = {r.case_id for r in rows if r.fold == k and r.role == "train"}
        held = {r.case_id for r in rows if r.fold == k and r.role != "train"}
        assert train and held and not train & held
    at = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (1, 10, 20)], "at date")
    assert splits.embargo(at, spark.createDataFrame([(dt.date(2020, 1, 25),)], "at date"), "at", 10).count() == 2


def test_support_bias_and_fold_overlap(spark):
    rows = [("a", 1.0)] * 3 + [("b", 0.0)] + [("c", None)] * 2
    got = {r.k: r for r in splits.support_bias_weights(spark.createDataFrame(rows, "k string, y double"), "k", "y").collect()}
    assert {k: round(r.weight, 6) for k, r in got.items()} == {"a": 0.8, "b": 1.333333, "c": 1.0}
    assert round(got["a"].row_weight, 6) == 0.266667 and abs(got["a"].size_outcome - 1) < 1e-9
    df = spark.createDataFrame([(0, "train", "a", "x"), (0, "train", "a", "y"), (1, "train", "b", "y"), (1, "test", "c", "z"), (2, "train", "d", None), (3, "train", "e", None)], "fold int, role string, k string, s string")
    assert {(r.fold_a, r.fold_b): round(r.jaccard, 6) for r in splits.fold_overlap(df, "fold", "s").collect()} == {(0, 1): 0.333333, (0, 2): 0.0, (0, 3): 0.0, (1, 2): 0.0, (1, 3): 0.0, (2, 3): 1.0}
    assert {(r.fold, r.role, r.k): (r.n_rows, r.n_cases) for r in splits.fold_report(df, "fold", "role", "k", "k").collect()}[0, "train", "a"] == (2, 1)


def test_merge_of_whole_tables(spark, tmp_path):
    rows = [(1, "a", None, "x"), (2, "a", 0.5, None), (3, "a", 0.7, "z"), (4, "b", None, None), (5, None, None, "y"), (7, None, 0.1, "w")]
    spark.createDataFrame(rows, "record_id long, quote_id string, score double, context string").write.parquet(str(tmp_path / "quotes.parquet"))
    got = {tuple(r) for r in queries.QUERIES["fingerprint_merge_whole"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0.5, "x"), (2, 0.5, "z"), (3, 0.7, "z"), (4, None, None), (5, None, "y"), (7, 0.1, "w")}


def test_stats(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert stats.auc(df, "s", "y").first().auc == 0.75
    assert stats.auc(df.filter("y = 1"), "s", "y").first().auc == 0.5
    assert abs(stats.cliffs_delta(df, "s", "y").first().delta - 0.5) < 1e-12
    assert abs(stats.chi2_sf(3.841459, 1) - 0.05) < 1e-6
    p = spark.createDataFrame([(0.01,), (0.02,), (0.9,)], "p double")
    assert [round(r.q, 4) for r in stats.benjamini_hochberg(p, "p").orderBy("p").collect()] == [0.03, 0.03, 0.9]


def test_models(spark):
    df = spark.createDataFrame([(float(i), i % 3 + 0.1 * (i % 7), min(2, i // 20)) for i in range(60)], "a double, b double, y int")
    out = models.ordinal_probs(df, models.ordinal_fit(df, ["a", "b"], "y", 3)).collect()
    assert all(abs(sum(r.class_probs) - 1) < 1e-9 and min(r.class_probs) >= 0 for r in out)
    assert sum(max(range(3), key=lambda k: r.class_probs[k]) == r.y for r in out) > 50
    lin = models.regressor(["a"], "t").fit(df.withColumn("t", F.col("a") * 2 + 1)).stages[-1]
    assert math.isclose(lin.coefficients[0], 2, rel_tol=1e-6)


def test_sources_and_sinks(spark, tmp_path):
    d = tmp_path / "rss" / "acme"
    d.mkdir(parents=True)
    (d / "e.json").write_text(json.dumps({"id": "1", "title": "T", "summary": " ", "content": "C"}))
    r = readers.feed_entries(spark, str(tmp_path)).collect()
    assert [(x.text, x.speaker) for x in r] == [("T C", "ACME")]
    (tmp_path / "m.csv").write_text('k,v\na,"1,200"\nb,null\n')
    assert [x.v for x in readers.csv_money(spark, str(tmp_path / "m.csv"), ["v"]).orderBy("k").collect()] == [1200.0, 0.0]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "j" / "b.jsonl").write_text('{"x": 3}\nbad\n')
    assert sorted(x.x for x in readers.json_any(spark, str(tmp_path / "j"), "x int").collect()) == [1, 2, 3]
    writers.stage(spark.range(3), str(tmp_path / "st"), 4)
    assert spark.read.json(str(tmp_path / "st")).filter("stage = 4").count() == 3
    writers.flat_csv(spark.createDataFrame([(1, [1, 2])], "a int, b array<int>"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().b == "[1,2]"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 1, 1))], "id string, at timestamp").coalesce(1).write.parquet(src)
    s = streams.dedupe_entries(streams.parquet_stream(spark, src, "id string, at timestamp"), "id", "at")
    q = streams.available_now(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_plans_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("k", "v", 1)], "case_id string, speaker string, n int")
    plan = hotkeys.hot_keys(df, "case_id", "speaker", 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
