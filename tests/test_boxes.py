"""Points in boxes of any size, longest rising runs by patience, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import layout, pages, ranges

BOX = "g int, x1 double, y1 double, x2 double, y2 double, b int"


def made(rng, n, wide):
    out = []
    for i in range(n):
        x, y = rng.uniform(-50, 900), rng.uniform(-50, 900)
        w, h = rng.choice(wide), rng.choice(wide)
        out.append((rng.randrange(2), x, y, x + w, y + h, i))
    return out


@pytest.mark.parametrize("wide", [(0.0, 3.0), (1.0, 5.0, 64.0, 1000.0), (-1.0, 0.4, 1e9)])
def test_meet_and_outside_equal_brute_force(spark, wide):
    rng = random.Random(len(wide))
    boxes = [*made(rng, 120, wide), (0, None, 1.0, 2.0, 3.0, 900), (1, 5.0, 5.0, 5.0, 5.0, 901)]
    points = [(rng.randrange(3), float(rng.randrange(-60, 1000)), rng.uniform(-60, 1000), i) for i in range(300)] + [(1, 5.0, 5.0, 998), (0, None, 4.0, 999), (0, None, 4.0, 999)]
    p, b = spark.createDataFrame(points, "g int, x double, y double, i int").repartition(3), spark.createDataFrame(boxes, BOX)
    holds = lambda q, c: q[0] == c[0] and None not in (*q, *c) and c[1] <= q[1] <= c[3] and c[2] <= q[2] <= c[4]
    assert sorted((r.i, r.b) for r in ranges.meet(p, b, ["g"]).collect()) == sorted((q[3], c[5]) for q in points for c in boxes if holds(q, c))
    assert sorted(r.i for r in ranges.outside(p, b, ["g"]).collect()) == sorted(q[3] for q in points if not any(holds(q, c) for c in boxes))


def test_a_box_as_large_as_a_page_beside_many_small_ones(spark):
    small = spark.range(100_000).select(F.lit(1).alias("g"), (F.col("id") % 1000).cast("double").alias("x1"), F.floor(F.col("id") / 1000).cast("double").alias("y1"))
    boxes = small.select("g", "x1", "y1", (F.col("x1") + 0.5).alias("x2"), (F.col("y1") + 0.5).alias("y2")).union(spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 100.0)], "g int, x1 double, y1 double, x2 double, y2 double"))
    cells = ranges._cells(boxes, 1.0)
    assert cells.count() <= 4 * 100_001 and cells.where("x2 - x1 > 10").count() <= 4
    points = spark.range(2000).select(F.lit(1).alias("g"), (F.col("id") % 1000 + 0.25).alias("x"), (F.floor(F.col("id") / 20) + 0.75).cast("double").alias("y"), "id")
    assert ranges.meet(points, boxes, ["g"]).count() == 2000  # the large box alone
    assert ranges.outside(points, boxes.where("x2 - x1 < 10"), ["g"]).count() == 2000
    assert ranges.outside(points, boxes, ["g"]).count() == 0


def test_no_boxes_or_points(spark):
    p, b = spark.createDataFrame([(1, 2.0, 3.0, 4)], "g int, x double, y double, i int"), spark.createDataFrame([], BOX)
    assert ranges.outside(p, b, ["g"]).count() == 1 and ranges.meet(p, b, ["g"]).count() == 0
    assert ranges.outside(p.limit(0), b, ["g"]).count() == 0


def test_clipped_text_of_pages_with_and_without_words(spark):
    boxes = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 100.0, 50.0), (1, 1, "b", 0.0, 60.0, 10.0, 70.0), (1, 2, "c", 0.0, 0.0, 9.0, 9.0)], "doc int, page int, num string, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([(1, 1, 50.0, 10.0, 60.0, 15.0, "two"), (1, 1, -2.0, 9.9, 5.0, 15.0, "one"), (1, 1, 90.0, 40.0, 103.0, 45.0, "out"), (1, 1, 3.0, 40.0, 102.0, 52.0, "three")], "doc int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    sizes = spark.createDataFrame([(1, 1, 500.0), (1, 2, 500.0)], "doc int, page int, height double")
    assert {r.num: r.text for r in pages.clip_text(boxes, words, sizes).collect()} == {"a": "one\ntwo\nthree", "b": "", "c": None}


def quadratic(seq):
    """Lengths by their earliest best predecessor, then the first of the longest."""
    best, before = [], []
    for i, v in enumerate(seq):
        found = [(best[j], -j) for j in range(i) if v is not None and seq[j] is not None and seq[j] < v]
        n, j = max(found, default=(0, 1))
        best.append(n + 1)
        before.append(-j if found else -1)
    out, at = [], best.index(max(best)) if best else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def test_rising_runs_by_patience(spark):
    rng = random.Random(2)
    seqs = [[], [None], [None, 3], [3, None, 3], [5, 4, 3], [1, 1, 1], *([rng.choice([None, *range(9)]) if rng.random() < 0.9 else rng.randrange(30) for _ in range(rng.randrange(25))] for _ in range(300))]
    assert [layout.lis_of(s) for s in seqs] == [quadratic(s) for s in seqs]
    df = spark.createDataFrame(list(enumerate([*seqs, None])), "i int, s array<bigint>")
    got = {r.i: r.p for r in df.select("i", layout.lis(F.col("s")).alias("p")).collect()}
    assert got == {i: quadratic(s) for i, s in enumerate(seqs)} | {len(seqs): None}


def test_a_long_sequence_is_soon_done():
    rng = random.Random(1)
    seq = [rng.randrange(10**6) for _ in range(200_000)]
    at = layout.lis_of(seq)
    assert len(at) > 700 and all(a < b and seq[a] < seq[b] for a, b in zip(at, at[1:], strict=False))
