"""Single operators on small frames: the cases that the driver's tables lack."""

import itertools
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import jsonfix, scalars
from tessera.functions import text as T
from tessera.operators import confidence, evaluate, evidence, labels, layout, ranges, review
from tessera import sources


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("given_", "want"), [("물리학 Ⅱ", "물리학2"), ("물리학II", "물리학2"), ("If is", "ifis"), (None, ""), ("사회･문화", "사회문화"), ("a\tb", "a\tb")])
def test_norm(spark, given_, want):
    assert one(spark, given_, T.norm) == want


def test_nfc(spark):
    assert one(spark, unicodedata.normalize("NFD", "한글"), T.nfc) == "한글"


def test_boundaries(spark):
    rows = [("정규분포", "정규"), ("정규 분포", "정규"), ("비정규", "정규")]
    df = spark.createDataFrame(rows, "t string, k string").select(T.ends_word(F.col("t"), F.col("k")).alias("e"), T.stands_alone(F.col("t"), F.col("k")).alias("a"))
    assert [(r.e, r.a) for r in df.collect()] == [(False, False), (True, True), (True, False)]


@pytest.mark.parametrize(("line", "want"), [("[3 ~ 5] x", (3, 5)), ("[5~3]", None), ("[1~9]", None), (" [10～12]", (10, 12)), ("x [1~2]", None), ("[3점]", None)])
def test_set_range(spark, line, want):
    got = one(spark, line, T.set_range)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("line", "want"), [("12. a", 12), ("[7] b", 7), ("3번", 3), ("2.5", 2), ("x 1.", None)])
def test_problem_number(spark, line, want):
    assert one(spark, line, T.problem_number) == want


def test_cleaning(spark):
    assert one(spark, "a  b\n\n\n\nc", T.clean_prompt) == "a b\n\nc"
    assert one(spark, "   ", T.clean_transcription) == ""
    assert one(spark, "x​  y ", T.clean_transcription) == "x□ y"
    assert one(spark, ["1. a", "b", "2. c"], T.structured, "array<string>") == ["1. a", "b", "", "2. c"]
    assert one(spark, "A. B! C", T.sentences) == ["A.", "B!", "C"]


@pytest.mark.parametrize(("said", "want"), [("85", 0.85), ("8.5", 0.85), ("0.85", 0.85), ("-1", 0.0), ("sure", 0.0), (None, 0.0), ("500", 1.0)])
def test_confidence_scale(spark, said, want):
    assert one(spark, said, scalars.norm_confidence) == pytest.approx(want)


@pytest.mark.parametrize(("said", "want"), [("4.5", 4), ("5.5", 6), ("99", 10), ("x", 5), ("-3", 1), (None, 5)])
def test_score(spark, said, want):
    assert one(spark, said, scalars.clamp_score) == want


@pytest.mark.parametrize(
    ("reply", "want"),
    [('{"a": 1}', {"a": 1}), ('```json\n{"a": {"b": 2}}\n```', {"a": {"b": 2}}), ('so {"a": "x } y"} end', {"a": "x } y"}), ('{"a": [1, 2,], // no\n}', {"a": [1, 2]}), ("{'a': True, 'b': None}", {"a": True, "b": None}), ('{"a": "http://x" /* c */}', {"a": "http://x"})],
)
def test_lenient_json(reply, want):
    assert jsonfix.parse(reply) == want


@pytest.mark.parametrize("reply", ["none", "{", '{"a": ', "[1]", ""])
def test_json_errors(reply):
    with pytest.raises(ValueError):
        jsonfix.parse(reply)


def test_labels(spark):
    rows = [("Science", "Physics II"), ("physics 1", ""), ("x", "my physics"), ("MATHS", "?"), (None, None), (" German ", "")]
    df = spark.createDataFrame(rows, "s string, c string").select(labels.reconcile(F.col("s"), F.col("c")).alias("l"))
    assert [tuple(r.l) for r in df.collect()] == [("Science", "Physics 2"), ("Science", "Physics 1"), ("Science", "Physics 1"), ("Mathematics", "Other"), ("Unclassified", "Other"), ("German", "Other")]


def fold(spark, subject, sub, raw, items, weights=None):
    kind = "subject string, sub_subject string, raw_confidence double, evidence array<struct<rank:int,scan:string,keyword:string,polarity:string,targets:array<string>,confidence:double,source:string,guard:boolean>>"
    rows = [(subject, sub, raw, [(i, "s", f"k{i}", p, t, c, src, False) for i, (p, t, c, src) in enumerate(items)])]
    return confidence.fold(spark.createDataFrame(rows, kind), weights).first()


def test_fold_plain(spark):
    r = fold(spark, "Science", "Physics 2", 0.8, [("pro", ["Physics 2"], 0.9, "ocr")])
    assert r.confidence == pytest.approx(0.845) and (r.pro_match, r.anti_match) == (1, 0)
    r = fold(spark, "Science", "Other", 0.8, [("pro", ["German"], 0.7, "filename"), ("pro", ["German"], 0.69, "ocr"), ("anti", ["Unclassified"], 0.7, "meta")])
    assert (r.competing, r.anti_match) == (1, 1) and r.confidence == pytest.approx(0.8 - 0.12 - 0.08 * 1.05 - 0.12)
    r = fold(spark, "Unclassified", "Other", 0.8, [("anti", ["Unclassified"], 0.7, "meta")])
    assert (r.pro_match, r.confidence) == (1, 0.25)
    assert fold(spark, "Science", "Physics 2", 0.5, []).confidence == 0.5


def test_fold_conflict_and_weights(spark):
    items = [("pro", ["Physics 2", "x"], 0.9, "ocr"), ("anti", ["x"], 0.5, "ocr")]
    assert fold(spark, "Science", "Physics 2", 0.8, items).rule_conflict
    w = {"source": "gold", "intercept": 0.0, "coefficients": {"pro_match": 1.0}}
    assert fold(spark, "Science", "Physics 2", 0.8, items, w).confidence == pytest.approx(1 / (1 + 2.718281828459045**-1))
    assert fold(spark, "Science", "Physics 2", 0.8, items, w | {"source": "self"}).confidence == fold(spark, "Science", "Physics 2", 0.8, items).confidence


def best_run(seq):
    return max((len(c) for n in range(len(seq) + 1) for c in itertools.combinations(seq, n) if all(a < b for a, b in itertools.pairwise(c))), default=0)


def test_lis(spark):
    seqs = [[], [3], [1, 2, 3], [3, 2, 1], [2, 2], [1, 9, 2, 3, 8, 4], [5, 1, 6, 2, 7, 3]]
    df = spark.createDataFrame([(s,) for s in seqs], "s array<bigint>").select("s", layout.lis(F.col("s")).alias("k"), layout.chain(F.col("s")).alias("c"), layout.spaced(F.col("s").cast("array<double>"), 2.0).alias("d"))
    for r in df.collect():
        kept = [r.s[i] for i in r.k]
        assert len(kept) == best_run(r.s) and kept == sorted(set(kept))
    assert {tuple(r.s): r.c for r in df.collect()}[(1, 9, 2, 3, 8, 4)] == 4
    assert {tuple(r.s): r.d for r in df.collect()}[(5, 1, 6, 2, 7, 3)] == [5.0, 7.0]


def test_columns_split_only_above_the_gap(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 15.0), ("b", 0.0), ("b", 15.1), ("b", 90.0)], "p string, x double")
    got = layout.columns(df, ["p"], "x", F.lit(100.0)).groupBy("p").count().collect()
    assert {r.p: r["count"] for r in got} == {"a": 1, "b": 3}


def test_upsert_keeps_human_columns_and_repeats(spark):
    kind = "source string, page int, num int, reason string, confidence double, resolved boolean, gold_subject string"
    log = spark.createDataFrame([("a", 1, 1, "old", 0.1, True, "Gold"), ("a", 1, 2, "old", 0.2, False, "")], kind)
    batch = spark.createDataFrame([("a", 1, 1, "new", 0.9), ("b", 1, 1, "new", None)], "source string, page int, num int, reason string, confidence double")
    once = review.upsert(log, batch)
    rows = {(r.source, r.num): (r.reason, r.confidence, r.resolved, r.gold_subject) for r in once.collect()}
    assert rows == {("a", 1): ("new", 0.9, True, "Gold"), ("a", 2): ("old", 0.2, False, ""), ("b", 1): ("new", None, False, "")}
    assert sorted(map(tuple, review.upsert(once, batch).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    assert [r.num for r in review.queue(once.withColumn("created_at", F.lit(1))).collect()] == [1, 2]


def test_evict_keeps_the_newest(spark):
    cache = spark.createDataFrame([("a", 50, 1), ("b", 30, 2), ("c", 900, 3)], "key string, nbytes int, ts int")
    assert [r.key for r in review.evict(cache, 100).collect()] == ["c"]


def test_ranges(spark):
    rg = spark.createDataFrame([("d", 1, 3, 1)], "doc string, s long, e long, rpage long")
    it = spark.createDataFrame([("d", 1, 1), ("d", 2, 3), ("d", 3, 4), ("d", 9, 1)], "doc string, num long, page long")
    assert sorted(r.num for r in ranges.members(rg, it).collect()) == [1, 2]
    assert [r.num for r in ranges.missing(rg, it).collect()] == [3]
    assert ranges.members(rg, it.where("num = 1")).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('# c\n\n{"k": 1, "v": "a"}\nbroken\n{"k": 1, "v": "b"}\n')
    assert sources.last_per_key(spark, str(tmp_path / "m.jsonl"), "k int, v string", ["k"]).first().v == "b"
    assert sources.manifest(spark, str(tmp_path / "m.jsonl"), "k int, v string").where("k = 1").count() == 2
    with pytest.raises(ValueError):
        sources.read(spark, "x.xyz")


def test_calibration_needs_both_classes(spark):
    rows = spark.createDataFrame([(float(i), i % 2) for i in range(12)], "f double, label int")
    assert evaluate.fit_calibration(rows.where("label = 1"), ["f"]) is None
    assert evaluate.fit_calibration(rows.limit(3), ["f"]) is None
    assert evaluate.fit_calibration(rows, ["f"])["source"] == "gold"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("ab ", max_size=5), st.text("abc", max_size=5)), min_size=1, max_size=4))
def test_bag_is_the_multiset_overlap(spark, pairs):
    from collections import Counter

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.common for r in evaluate.bag(df, "i", "a", "b").collect()}
    for i, (a, b) in enumerate(pairs):
        assert got.get(i, 0) == sum((Counter(a.replace(" ", "")) & Counter(b)).values())


def test_english(spark):
    text = "The cat and the dog went to that house with the ball for this and from what they have been told about it."
    assert one(spark, text, evidence.english) and not one(spark, "Der Hund und die Katze gehen nach Hause und spielen dort mit dem Ball den ganzen Tag lang.", evidence.english)
    assert one(spark, None, evidence.english) is False
