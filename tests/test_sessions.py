"""Sessions of a stream, over batches that come out of order, against those of the table."""

import random

from pyspark.sql import functions as F

from tessera.streaming import sessions


def test_streamed_sessions_equal_those_of_the_table(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b"]), float(rng.randrange(0, 50_000)), float(i)) for i in range(400)]
    rows.sort(key=lambda r: r[1] + rng.randrange(3000))  # up to 3000 seconds out of order
    rows.append(("z", 200_000.0, 1.0))  # moves the watermark past all others
    kind = "user string, s double, value double"
    for k in range(0, len(rows), 81):
        spark.createDataFrame(rows[k : k + 81], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k:05d}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*").withColumn("ts", F.timestamp_seconds("s"))
    out = sessions.sessions(stream, ["user"], "ts", "value", 300_000, "2 hours")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r.user, r.start, r.end, r.n, r.total) for r in df.collect())
    table = spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds("s"))
    whole = [r for r in key(sessions.of_table(table, ["user"], "ts", "value", 300_000)) if r[0] != "z"]
    assert key(spark.read.parquet(f"{tmp_path}/out")) == whole and len(whole) > 40
    want = {}
    for u in "ab":
        want[u] = sessions.joined([(int(s * 1000), int(s * 1000), 1, v) for x, s, v in rows if x == u], 300_000)
    assert [(r[1], r[2], r[3]) for r in whole if r[0] == "a"] == [x[:3] for x in want["a"]]


def test_spans_are_joined_over_the_gap():
    assert sessions.joined([(10, 10, 1, 1.0), (0, 2, 2, 3.0), (7, 7, 1, 1.0)], 4) == [(0, 2, 2, 3.0), (7, 10, 2, 2.0)]
    assert sessions.joined([(0, 9, 3, 1.0), (4, 5, 1, 1.0), (13, 13, 1, 1.0)], 4) == [(0, 13, 5, 3.0)]
