"""Prefix scans against plain Python, over one key that holds all rows, equal keys, nulls and many ranges."""

import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import prefix


@pytest.fixture(params=[1, 7])
def ranges(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def made(rng, n, groups, width=50):
    return [(rng.choice(groups), rng.randrange(width), i, rng.choice([None, 1, 2, 3])) for i in range(n)]


def test_running_values(spark, ranges):
    rows = made(random.Random(ranges), 900, ["a", None, "b"])
    df = spark.createDataFrame(rows, "g string, t int, i int, v int").repartition(5)
    for back in (False, True):
        r = prefix.ranged(df, ["g"], ["t", "i"]).running(back=back, s=("sum", F.col("v"), True), lo=("min", F.col("v"), False), hi=("max", F.col("v"), True), last=("last", F.col("v"), False))
        got = {(x.g, x.i): (x.s, x.lo, x.hi, x.last) for x in r.rows.collect()}
        want = {}
        for g in ("a", None, "b"):
            seen = []
            for _, t, i, v in sorted((x for x in rows if x[0] == g), key=lambda x: x[1:3], reverse=back):
                full = [x for x in seen if x is not None]
                own = full + ([v] if v is not None else [])
                want[g, i] = (sum(own), min(full, default=None), max(own, default=None), full[-1] if full else None)
                seen.append(v)
        assert got == want


def test_islands_columns_and_runs(spark, ranges):
    rng = random.Random(3)
    rows = [("k", float(rng.choice([0, 1, 2, 30, 31, 60, 90])) + rng.random(), rng.choice(["x", "y", None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, v string, i int")
    xs = sorted(r[1] for r in rows)
    cut = [0]
    for a, b in zip(xs, xs[1:], strict=False):
        cut.append(cut[-1] + (b - a > 5))
    assert [r.island for r in prefix.islands(df, ["g"], "x", F.lit(5.0)).orderBy("x").collect()] == cut
    cols = [(c.island, c.n, c.low, c.left, c.right) for c in prefix.columns(df, ["g"], "x", F.lit(100.0), 0.05).orderBy("island").collect()]
    parts = [[x for x, k in zip(xs, cut, strict=True) if k == i] for i in range(cut[-1] + 1)]
    want = [(i, len(p), p[0], 0.0 if i == 0 else p[0] - 10, (p[-1] + parts[i + 1][0]) / 2 if i + 1 < len(parts) else 100.0) for i, p in enumerate(parts)]
    assert cols == want
    values = [v for _, _, v, _ in rows]
    run = [1]
    for a, b in zip(values, values[1:], strict=False):
        run.append(run[-1] + (a != b))
    assert [r.run for r in prefix.runs(df, ["g"], ["i"], "v").orderBy("i").collect()] == run
    made_edges = sorted((r.src, r.dst) for r in prefix.edges(df.where("i < 40"), ["g"], "i", "i").collect())
    assert made_edges == [(i, i + 1) for i in range(39)]


def test_asof_next_and_best(spark, ranges):
    rng = random.Random(9)
    events = [("k", rng.randrange(200), i) for i in range(300)] + [("z", 5, 999)]
    marks = [("k", rng.randrange(200)) for _ in range(40)]
    e, m = spark.createDataFrame(events, "g string, t int, i int"), spark.createDataFrame(marks, "g string, t int")
    at = sorted(t for _, t in marks)
    nxt = lambda t: at[k] if (k := bisect.bisect_right(at, t)) < len(at) else None
    assert {r.i: r.next for r in prefix.asof_next(e, m, "g", "t", "t").collect()} == {i: nxt(t) if g == "k" else None for g, t, i in events}
    best, want = None, {}
    for _, v, i in sorted((x for x in events if x[0] == "k"), key=lambda x: x[2]):
        want[i] = (best, best is None or v < best)
        best = v if best is None else min(best, v)
    got = {r.i: (r.best, r.kept) for r in prefix.best_so_far(e.where("g = 'k'"), ["g"], "i", "t").collect()}
    assert got == want


def test_one_key_and_one_place_for_all_rows_is_split(spark):
    df = spark.range(100_000).select(F.lit("k").alias("g"), F.lit(1).alias("t"), F.col("id"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    try:
        r = prefix.ranged(df, ["g"], ["t"])
        sizes = [x["count"] for x in r.df.groupBy("part_").count().collect()]
        out = r.running(n=("sum", F.lit(1), True)).rows
        assert max(sizes) < 40_000 and len(sizes) == 8
        assert out.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()[:] == (1, 100_000, 100_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_window_over_rows_is_by_the_key_alone(spark):
    df = spark.createDataFrame([("a", 1, 2)], "g string, t int, v int")
    plan = prefix.runs(df, ["g"], ["t"], "v")._jdf.queryExecution().optimizedPlan().toString()
    kept = [w for w in re.findall(r"Window \[.*", plan) if "total_" not in w]
    assert kept and all("part_" in w for w in kept)


@pytest.mark.parametrize("least", [0.1, 18.0, 0.0, 1e9])
def test_spacing_equals_the_fold(spark, least):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None, "b"]), rng.choice([round(rng.uniform(-5, 100), 1), round(rng.uniform(0, 3), 1), None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, x double")
    want = []
    for g in ("a", None, "b"):
        last = None
        for x in sorted(x for k, x in rows if k == g and x is not None):
            if last is None or x - last >= least:
                want.append((str(g), x))
                last = x
    assert sorted((str(r.g), r.x) for r in prefix.spaced(df, ["g"], "x", least).collect()) == sorted(want)
