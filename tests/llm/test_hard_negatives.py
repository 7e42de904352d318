"""Hard negatives against brute force in Python's integers, over ties, repeated and odd rows."""

import math
import random

import duckdb
import numpy as np
import pytest

from tessera.llm import hard_negatives

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, label int, embedding array<double>, score string, anchor_id string"
FIELDS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
TOP = 2**63 - 1


def brute(rows):
    """The contract, a row at a time; rows are (id, label, vector)."""
    table = []
    for i, lab, v in rows:
        if lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        table.append((i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * x) for x in v]))
    dot = lambda a, b: max(-TOP, min(TOP, sum(x * y for x, y in zip(a, b, strict=False))))
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for at, (i, lab, v) in enumerate(table):
        if i is None or i % 100:
            continue
        scored = [(j, dot(v, w), own == lab) for k, (j, own, w) in enumerate(table) if k != at]
        for j, p, _ in sorted((x for x in scored if x[2]), key=order)[:5]:
            far = sorted((x for x in scored if not x[2] and 80 * p <= 100 * x[1] <= 100 * p), key=order)[:5]
            out += [(i, j, r + 1, n, p, s) for r, (n, s, _) in enumerate(far)]
    return sorted(out, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, lab, v, "clash", "clash") for i, lab, v in rows], KIND).repartition(3)
    return sorted((tuple(r[f] for f in FIELDS) for r in hard_negatives.mine(df, **more).collect()), key=str)


def made(rng, n, dims, values, first=0):
    return [(first + i, rng.randrange(3), [rng.choice(values) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("values", [(0.0, 0.01, -0.01), (0.3, -0.2, 0.11, 0.07, 0.5), (1.0,)])
def test_equals_brute_force_with_ties(spark, values):
    rows = made(random.Random(3), 330, 6, values)
    assert got(spark, rows) == brute(rows) != []


def test_small_blocks_and_tiles_give_the_same(spark, monkeypatch):
    rows = made(random.Random(4), 820, 4, (0.3, -0.2, 0.11, 0.5))
    want = brute(rows)
    assert got(spark, rows) == want
    monkeypatch.setattr(hard_negatives, "BLOCK_VALUES", 16)
    assert got(spark, rows) == want


def test_odd_rows(spark):
    rng = random.Random(6)
    rows = made(rng, 40, 3, (0.4, 0.3, 0.2), 80) + [
        (100, 1, [0.4, 0.4, 0.4]), (100, 1, [0.4, 0.4, 0.4]), (100, 1, [0.4, 0.3, 0.4]), (None, 1, [0.4, 0.4, 0.4]), (None, 2, [0.4, 0.4, 0.3]), (101, None, [1.0, 1.0, 1.0]),
        (102, 1, None), (103, 1, [None, 1.0, 1.0]), (104, 1, [math.nan, 1.0, 1.0]), (105, 1, [math.inf, 1.0, 1.0]), (200, 2, []), (300, 2, [0.4, 0.4, 0.4, 0.4, 0.4]), (-100, 0, [0.4, 0.1, 0.4]),
        (400, 1, [0.4] * 70_000),
    ]
    assert got(spark, rows) == brute(rows) != []
    assert got(spark, []) == [] == got(spark, [(1, 1, [0.5])]) == got(spark, [(100, 1, [0.5])])


def test_beyond_the_exact_range_of_doubles(spark):
    rng = random.Random(7)
    rows = [(i, i % 2, [float(rng.randrange(2**24)), float(rng.randrange(2**20)), 1.0]) for i in range(95, 180)]
    assert got(spark, rows) == brute(rows) != []
    rows = [(i, i % 2, [1e300 * (i % 3), 1.0]) for i in range(95, 120)]
    assert got(spark, rows) == brute(rows) != []


def test_first_takes_ties_from_the_left():
    rng = np.random.default_rng(1)
    for _ in range(50):
        s = rng.integers(0, 4, (7, rng.integers(1, 30)))
        s[rng.random(s.shape) < 0.3] = hard_negatives.NONE
        row, col = hard_negatives.first(s, 5)
        for r in range(7):
            want = sorted((c for c in range(s.shape[1]) if s[r, c] != hard_negatives.NONE), key=lambda c: (-s[r, c], c))[:5]
            assert sorted(col[row == r].tolist()) == sorted(want)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(hard_negatives.SQL).df()[list(FIELDS)]
    have = hard_negatives.query(spark, SF).toPandas()[list(FIELDS)]
    assert sorted(map(tuple, want.values.tolist())) == sorted(map(tuple, have.values.tolist()))
