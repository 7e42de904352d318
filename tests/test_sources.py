"""Readers by suffix, tables made once, last lines over several files, batches of windows."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import sources
from tessera.operators import evaluate, review


def test_readers_by_suffix(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "c.csv").write_text("x,y\n1,z\n")
    (tmp_path / "d.png").write_bytes(b"\x89PNG")
    spark.range(3).write.parquet(str(tmp_path / "e.parquet"))
    spark.range(2).write.orc(str(tmp_path / "f.orc"))
    read = lambda name: sources.read(spark, str(tmp_path / name))
    assert [r.value for r in read("a.txt").collect()] == ["one\ntwo"]
    assert sorted(r.x for r in read("b.jsonl").collect()) == [1, 2]
    assert [tuple(r) for r in read("c.csv").collect()] == [(1, "z")]
    assert bytes(read("d.png").first().content) == b"\x89PNG"
    assert (read("e.parquet").count(), read("f.orc").count()) == (3, 2)
    with pytest.raises(ValueError, match="no reader"):
        read("g.xyz")


def test_tables_are_made_once(spark, tmp_path):
    assert sorted(review.create(spark, str(tmp_path / "db"))) == sorted(review.TABLES)
    spark.createDataFrame([("k", "r", 1, 2, None)], review.TABLES["cache"]).write.mode("append").parquet(str(tmp_path / "db/cache"))
    assert review.create(spark, str(tmp_path / "db")) == []
    assert spark.read.parquet(str(tmp_path / "db/cache")).count() == 1


def test_the_last_line_is_that_of_the_last_file(spark, tmp_path):
    line = lambda k, v: json.dumps({"k": k, "v": v}) + "\n"
    (tmp_path / "b.jsonl").write_text(line("x", "b1") + line("y", "b2") + line("x", "b3") + "broken\n")
    (tmp_path / "a.jsonl").write_text(line("x", "a1") * 50 + line("z", "a2"))
    (tmp_path / "c.jsonl").write_text(line("y", "c1"))
    got = {r.k: r.v for r in sources.last_per_key(spark, f"{tmp_path}/*.jsonl", "k string, v string", ["k"]).collect()}
    assert got == {"x": "b3", "y": "c1", "z": "a2"}


def test_a_batch_of_windows_is_the_same_again(spark):
    windows = evaluate.byte_windows(spark.createDataFrame([(i, "some text " * 3) for i in range(5)], "doc_id long, text string"), "doc_id", "text", 2)
    draw = lambda df, seed: [(r.doc_id, r.pos, r.ctx, r.y) for r in evaluate.some(df, 7, seed, "doc_id").collect()]
    assert draw(windows, 1) == draw(windows.repartition(5), 1) != draw(windows, 2)
    assert len(draw(windows, 1)) == 7


def test_evictions_by_timestamps(spark):
    rows = spark.range(20).select(F.col("id").cast("string").alias("key"), F.lit(10).alias("nbytes"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    assert sorted(int(r["key"]) for r in review.evict(rows, 45).collect()) == [16, 17, 18, 19]
    assert review.evict(rows, 1).count() == 1
    ntz = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(int(r["key"]) for r in review.evict(ntz, 45).collect()) == [16, 17, 18, 19]
