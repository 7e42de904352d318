"""Windows of bytes are counted before they are rows, and a key's open sessions share one timer."""

from pyspark.sql import functions as F

from tessera.operators import evaluate
from tessera.plans import problems as catalogue
from tessera.streaming.sessions import Sessions


def test_counts_equal_those_of_windows(spark):
    rows = [(1, "abcabc"), (2, None), (3, ""), (4, "é한a"), (5, "a"), (6, "abcd"), (None, "xyz xyz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for size in (1, 2, 5):
        want = evaluate.byte_windows(df, "doc_id", "text", size).groupBy("ctx", "y").agg(F.count("*").alias("n"))
        got = evaluate.byte_counts(df, "text", size).select("ctx", "y", "n")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    held = F.col("doc_id") % 2 == 1
    a = evaluate.bits_of_counts(evaluate.byte_counts(df, "text", 1, held)).collect()
    assert a == evaluate.bits_per_byte(evaluate.byte_windows(df, "doc_id", "text", 1), held).collect()
    assert a == evaluate.bits_of_counts(evaluate.byte_counts(df.where("doc_id IS NOT NULL"), "text", 1, held)).collect() and a[0].n == 5


def test_no_row_for_each_byte(spark):
    for name in ("byte_windows", "bits_per_byte"):
        assert "Generate" not in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_one_timer_for_many_sessions():
    class Handle:
        timers: list = []

        def listTimers(self):  # noqa: N802
            return list(self.timers)

        def deleteTimer(self, t):  # noqa: N802
            self.timers.remove(t)

        def registerTimer(self, t):  # noqa: N802
            self.timers.append(t)

    class State:
        def put(self, spans):
            self.spans = spans

    s = Sessions(["k"], 10)
    s.handle, s.open = Handle(), State()
    s._keep([(0, 5, 2, 1.0), (100, 130, 3, 1.0), (300, 300, 1, 1.0)])
    assert s.handle.timers == [16] and len(s.open.spans) == 3
