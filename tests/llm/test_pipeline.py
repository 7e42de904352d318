"""The whole pipeline against a plain version of its stages, on a small folder of tables with planted cases."""

import hashlib
import random

import corpus_pipeline
import numpy as np
from tessera.llm import pii, toxicity
from tests.llm.test_operators import brute_classes, brute_hits


def tables(spark, folder):
    rng = random.Random(8)
    plain = ["".join(rng.choice(["tion", "er", "an", "the", "ou", "ble", "in"]) for _ in range(rng.randint(2, 5))) for _ in range(3000)]
    text = lambda n: [rng.choice(plain) for _ in range(n)]
    items = [(k, " ".join(f"item{k}x{i}" for i in range(14))) for k in range(3)]
    docs, marks = [], []
    for i in range(300):
        w = text(50)
        if i % 5 == 0:
            for _ in range(4):
                w[rng.randrange(50)] = rng.choice(["qwixzard", "vrodnik", "zzkuhm"])
        if i % 7 == 1:
            w[20:20] = items[i % 3][1].split()
        if i % 11 == 2:
            w[5] = f"me{i}@mail.example.com"
        docs.append((i, " ".join(w)))
        marks.append((i, 1, int(i % 5 == 0)))
    for i in range(300, 320):
        w = docs[i - 300 + 1 + (i % 5 == 4)][1].split()
        w[30] = "changed"
        docs.append((i, " ".join(w)))
    docs += [(400, None), (401, ""), (402, items[0][1])]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_pipeline_equals_the_plain_stages(spark, tmp_path):
    docs, items = tables(spark, str(tmp_path))
    model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    judge = toxicity.Judge(model)
    kept = [(i, t) for i, t in docs if judge.score(np.frombuffer((t or "").encode(), np.uint8)) < 0.5]
    assert len([i for i, _ in kept if i % 5 == 0 and i < 300]) <= 3 and len(kept) > 200
    kept = [kept[min(c)] for c in brute_classes(kept)]
    out = {}
    for i, t in kept:
        n, hit, own = brute_hits(t, items)
        if n and hit > 0.5 * n:
            continue
        for name, item in items:
            if str(name) in own:
                a = t.index(item)
                t = t[:a] + "\n" + t[a + len(item) :]
        t = pii.mask(t or "", pii.Finder().spans(t or ""))
        out[i] = hashlib.sha256(t.encode()).hexdigest()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == out and all(r.lossless for r in got)
    assert 402 not in out and len(got) == len(out)


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, repeated rows, ties, and extra columns with names that the operators use."""
    from pyspark.sql import functions as F

    docs, _ = tables(spark, str(tmp_path / "a"))
    odd = [(None, "x y z"), (None, "another text"), (7, "a " * 60_000), (7, "twice"), (7, "twice"), (8, None), (9, ""), (9, None), (10, "中" * 30_000)]
    names = ("score", "row", "key", "digest", "id", "kept", "root", "again", "spans", "words", "uid", "akey", "seed", "text_")
    own = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in docs[:40] + odd], "doc_id long, text string, lang string, source string, n_chars long")
    own = own.withColumns({c: F.lit("clash") for c in names})
    seen = own
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.written(spark, stage(spark, seen, str(tmp_path / "a")))
        assert seen.columns == own.columns and seen.where("score <> 'clash' OR row <> 'clash'").count() == 0
    kept = seen.collect()
    assert sum(r.doc_id is None for r in kept) == 2 and sum(r.doc_id == 7 for r in kept) == 3 and sum(not r.text for r in kept) == 1
    assert all(r.n_chars == len(r.text or "") for r in kept)
    last = corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path / "a")).collect()
    assert len(last) == len(kept) and all(r.lossless for r in last)


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
