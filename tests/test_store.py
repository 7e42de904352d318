"""The log-structured store against a dictionary, what a batch writes, replays and compactions; the model stage with a model that counts its calls."""

import collections
import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera import streaming
from tessera.operators import analysis, classify, model
from tessera.sources.store import Store

KIND = "k string, page long, a string, n long"
HUMAN = {"resolved": ("boolean", False), "gold": ("string", "")}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "log"), KIND, ["k", "page"], HUMAN, buckets=3, most=3)


def state(store):
    return {(r.k, r.page): (r.a, r.n, r.resolved, r.gold) for r in store.read().collect()}


@pytest.mark.parametrize("seed", [1])
def test_equals_a_dictionary(spark, store, seed):
    rng, want = random.Random(seed), {}
    some = lambda n: {(rng.choice("xyz"), rng.choice([1, 2, None, 4])) for _ in range(n)}
    for batch in range(9):
        kind, keys = rng.choice(["put", "put", "amend", "remove"]), some(4)
        if kind == "put":
            rows = [(*k, rng.choice(["p", "q", None]), rng.randrange(9)) for k in keys]
            again = lambda rows=rows, batch=batch: store.put(batch, spark.createDataFrame(rows, KIND))
            want |= {(k, p): (a, n, *want.get((k, p), (0, 0, False, ""))[2:]) for k, p, a, n in rows}
        elif kind == "amend":
            rows = [(*k, True, f"g{batch}") for k in keys]
            again = lambda rows=rows, batch=batch: store.amend(batch, spark.createDataFrame(rows, "k string, page long, resolved boolean, gold string"))
            want |= {(k, p): (*want[k, p][:2], r, g) for k, p, r, g in rows if (k, p) in want}
        else:
            again = lambda keys=keys, batch=batch: store.remove(batch, spark.createDataFrame(list(keys), "k string, page long"))
            want = {k: v for k, v in want.items() if k not in keys}
        again()
        again()
        assert state(store) == want
        if batch % 4 == 3:
            store.compact(force=batch % 8 == 7)
            assert state(store) == want
            again()
            assert state(store) == want
        if batch == 7:
            store.vacuum()
            assert state(store) == want


def test_a_batch_writes_its_own_rows_and_buckets_are_compacted(spark, store):
    def size(folder):
        return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))

    store.put(0, spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("page"), F.sha2(F.col("id").cast("string"), 256).alias("a"), F.col("id").alias("n")))
    first = size(store.folder)
    due = []
    for batch in range(1, 8):
        before = size(store.folder)
        store.put(batch, spark.createDataFrame([("k", batch, "new", 0)], KIND))
        assert size(store.folder) - before < first / 50
        due.append(store.compact())
    assert any(due) and not all(due) and max(map(len, due)) <= 3
    assert store.read().count() == 20_000 and state(store)[("k", 5)] == ("new", 0, False, "")
    store.compact(force=True)
    store.vacuum()
    assert store.batches() == [] and store.read().count() == 20_000
    store.put(8, spark.createDataFrame([("k", 5, "newest", 1)], KIND))
    assert state(store)[("k", 5)] == ("newest", 1, False, "")


def test_streaming_upserts_may_be_run_twice(spark, tmp_path):
    empty = spark.createDataFrame([], "source string, page long, num string, reason string, resolved boolean, gold_subject string")
    sink, log = streaming.upserting(spark, str(tmp_path / "log"), empty)
    a = spark.createDataFrame([("s", 1, "1", "x"), ("s", 1, "1", "w"), ("s", 1, "2", "x")], "source string, page long, num string, reason string")
    for batch, k in ((a, 0), (a.limit(1).withColumn("reason", F.lit("y")), 1), (a.limit(1).withColumn("reason", F.lit("y")), 1)):
        sink(batch, k)
    assert sorted((r.num, r.reason, r.resolved) for r in log().collect()) == [("1", "y", False), ("2", "x", False)]


# --- the model stage ------------------------------------------------------------------------------------------------


def counting_model(folder):
    """A handle that writes down every row it is asked, and in a file of its own that it was made."""

    def opener():
        open(f"{folder}/made-{uuid.uuid4().hex}", "w").close()

        def reply(rows, budget):
            if len(rows) > 1 and any(r["need"] == 13 for r in rows):
                raise ValueError("as a batch")
            with open(f"{folder}/asked-{uuid.uuid4().hex}", "w") as f:
                f.writelines(json.dumps([r["key"], budget]) + "\n" for r in rows)
            if rows[0]["need"] == 13:
                raise ValueError("this one")
            return [f"{r['key']} at {budget}" if r["need"] <= budget else [None, "", " \n"][r["need"] % 3] for r in rows]

        return reply

    return opener


def asked(folder):
    return collections.Counter(tuple(json.loads(line)) for name in os.listdir(folder) if name.startswith("asked") for line in open(f"{folder}/{name}"))


def test_each_key_is_asked_once_and_only_failures_climb(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    known = model.cache(spark, str(tmp_path / "cache"))
    need = {"a": 1, "b": 5, "c": 9, "d": 99, "e": 13, "f": 2}
    rows = [(k, n) for k, n in need.items() for _ in range(7)] + [(None, 1)]
    requests = spark.createDataFrame(rows, "key string, need long").repartition(4)
    known.put(0, spark.createDataFrame([("f", "known", 2, 5)], "key string, reply string, budget int, nbytes long").withColumn("ts", F.current_timestamp()))
    opener = counting_model(str(calls))
    got = {r["key"]: (r.reply, r.budget, r.problem, r.cached) for r in model.ask(requests, opener, str(calls), known, (3, 6, 10)).collect()}
    assert got["f"] == ("known", 2, None, True) and None not in got
    assert [got[k][:3] for k in "abc"] == [("a at 3", 3, None), ("b at 6", 6, None), ("c at 10", 10, None)]
    assert got["d"][:3] == ("", 10, None) or got["d"][0] is None or not got["d"][0].strip()
    assert got["e"] == (None, 10, "ValueError: this one", False)
    want = {("a", 3): 1, ("b", 3): 1, ("b", 6): 1} | {(k, b): 1 for k in "cde" for b in (3, 6, 10)}
    assert asked(calls) == want
    assert len([n for n in os.listdir(calls) if n.startswith("made")]) <= 8  # one a worker, not one a task
    again = {r["key"]: r.cached for r in model.ask(requests, opener, str(calls), known, (3,)).collect()}
    assert again == {"a": True, "b": True, "c": True, "d": False, "e": False, "f": True}
    assert asked(calls) == want | {("d", 3): 2, ("e", 3): 2}
    assert {r["key"] for r in known.read().collect()} == set("abcf")


def test_the_stage_in_plans(spark, tmp_path):
    def opener():
        return lambda rows, budget: [json.dumps({"subject": "German", "confidence": 0.9, "title": r["text"][:3]}) if r["text"] else None for r in rows]

    known = model.cache(spark, str(tmp_path / "cache"))
    stage = model.stage(opener, "plan", known, F.sha2("text", 256), {"text": F.col("text")})
    rows = [("s.pdf", 1, "1", "der Text", ""), ("s.pdf", 1, "2", "der Text", ""), ("s.pdf", 2, "3", "", ""), ("s.pdf", 2, "4", None, "")]
    df = spark.createDataFrame(rows, "source string, page long, num string, text string, cover string")
    out = {r.num: r.subject for r in classify.classify(df, model=stage).collect()}
    assert out["1"] == out["2"] != out["3"] == out["4"]
    assert known.read().count() == 1
    said = analysis.analysed(df, stage).where("num = '1'").first()
    assert said.analysis.title == "der" and said.markdown.startswith("# der")


def test_no_requests(spark, tmp_path):
    known = model.cache(spark, str(tmp_path / "cache"))
    none = spark.createDataFrame([], "key string, need long")
    assert model.ask(none, counting_model(str(tmp_path)), "none", known).count() == 0 == known.read().count()
