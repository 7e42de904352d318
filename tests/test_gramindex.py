"""The index of grams against plain containment: short, long, odd and common keys, long texts, and rule tables of any length."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence, gramindex


def pairs(spark, texts, keys):
    t = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").repartition(3, "uid")
    k = spark.createDataFrame([(x,) for x in keys], "key string").repartition(2)
    return sorted((r.uid, r["key"]) for r in gramindex.holding(t, k).collect())


def brute(texts, keys):
    return sorted((i, k) for i, t in enumerate(texts) for k in {x for x in keys if x} if t is not None and k in t)


@pytest.mark.parametrize("part", [1 << 20, 50])
def test_equals_containment(spark, monkeypatch, part):
    monkeypatch.setattr(gramindex, "PART", part)
    rng = random.Random(part)
    word = lambda n: "".join(rng.choice("abc é한") for _ in range(n))
    texts = [None, "", "a", "é", "한", *(word(rng.randrange(120)) for _ in range(150)), "ab" * 400, "common line " + word(20)]
    keys = ["", None, "a", "é", "한", "common line", "zzz", *(word(rng.randint(1, 14)) for _ in range(300)), *(t[3:30] for t in texts[5:60]), "ab" * 200, "common line"]
    assert pairs(spark, texts, keys) == brute(texts, keys) != []


def test_no_keys_or_texts(spark):
    assert pairs(spark, [], ["a"]) == [] == pairs(spark, ["a"], []) == pairs(spark, ["a"], ["", None])


def test_a_crowded_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(gramindex, "BITS", (1 << 15, 1 << 15))
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcd") for _ in range(80)) for _ in range(60)]
    keys = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    assert pairs(spark, texts, keys) == brute(texts, keys)


def rules(spark, keys):
    rows = [(k % 3, f"s{k % 3}", key, "pro", ["x"], 0.5, "ocr", k % 2 == 0) for k, key in enumerate(keys)]
    kind = "rank int, scan string, keyword string, polarity string, targets array<string>, confidence double, source string, guard boolean"
    return evidence.prepared(spark.createDataFrame(rows, kind))


def test_long_rule_tables_give_what_short_ones_give(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(i, t) for i, t in enumerate([None, "", "Go to AB.", "xab", *(" ".join(rng.choice(["Ab", "go", "KEY one", "Zebra"]) for _ in range(9)) for _ in range(30))])]
    df = spark.createDataFrame(texts, "uid long, text string")
    table = rules(spark, ["a b", "AB", "go", "key ONE", "bra", "one Z", "none", " "])
    show = lambda d: sorted((r.uid, [tuple(map(str, e)) for e in r.evidence]) for r in d.collect())
    literal = show(evidence.scan(df, rules=table))
    monkeypatch.setattr(evidence, "LITERAL_RULES", 3)
    assert show(evidence.scan(df, rules=table)) == literal
    given = df.select("uid", "text", F.lit("n").alias("name"), F.lit("").alias("cover"))
    joined = show(evidence.pre_classify(given, "text", "name", "cover", table))
    monkeypatch.setattr(evidence, "LITERAL_RULES", 100)
    assert show(evidence.pre_classify(given, "text", "name", "cover", table)) == joined


def test_texts_are_written_once_and_rules_moved_without_what_they_share(spark):
    from pathlib import Path

    from tessera.plans import problems as catalogue

    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(base.glob("library-*"))
    df = catalogue.QUERIES["rule_index"](spark, "/root/testdata/sf0.001")
    new = set(base.glob("library-*")) - before
    assert sum("tn" in spark.read.parquet(str(p)).columns for p in new) == 1
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    gathered = plan[plan.index("collect_list(") :].split("\n")[0]
    assert "polarity" not in gathered and "key" in gathered


def test_shared_fields_come_back(spark):
    kind = "rank int, scan string, keyword string, polarity string, targets array<string>, confidence double, source string, guard boolean"
    table = lambda *rows: evidence.prepared(spark.createDataFrame(list(rows), kind))
    df = evidence.normalised(spark.createDataFrame([(1, "Go to AB."), (2, "xab"), (3, None)], "id int, text string"), F.col("text"), "tn")
    show = lambda rows, over: sorted((r.id, [tuple(map(str, h)) for h in r.hits]) for r in rows.withColumn("hits", over).collect())
    for t in (table((0, "s", "A b", "pro", [], 0.5, "ocr", True), (0, "t", "ab", "pro", [], 0.5, "ocr", True)), table((0, "s", "ab", None, None, None, "ocr", False), (1, "s", "go", "anti", ["x"], 0.1, None, False))):
        want = show(df, evidence.hits(F.col("tn"), evidence.table_rules(t)))
        assert show(evidence.indexed(df, "tn", t, "hits"), F.col("hits")) == want and any(h for _, h in want)


def test_a_hundred_thousand_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    keys = docs.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(700)), lambda i: F.substring("text", i * 3, 13))).alias("key")).where("length(key) = 13").distinct()
    assert keys.count() > 50_000
    got = gramindex.holding(docs.select(F.col("doc_id").alias("uid"), "text"), keys).groupBy("uid").agg(F.count("*").alias("n"))
    have = {r.uid: r.n for r in got.collect()}
    wanted = {r["key"] for r in keys.collect()}
    want = {r.doc_id: len({r.text[i : i + 13] for i in range(len(r.text) - 12)} & wanted) for r in docs.collect() if r.text}
    assert have == {k: n for k, n in want.items() if n}
