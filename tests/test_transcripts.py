"""Digests of whole documents: equal to the joined text's, whatever the number and length of pages, and to the SQL where a document has no paragraph."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from tessera.operators import pages
from tessera.plans import problems as catalogue


def test_digests_are_of_the_joined_text(spark):
    rng = random.Random(3)
    rows = [(d, p, [rng.choice(["", "a", "é한", "3. x"]) for _ in range(rng.randrange(4))]) for d in (1, 2, None) for p in range(60)] + [(7, p, ["long " * 20_000, "", "end"]) for p in range(40)] + [(8, p, []) for p in range(3)]
    df = spark.createDataFrame(rows, "doc int, page long, paragraphs array<string>").orderBy(F.rand(1))
    want = {}
    for d in (1, 2, None, 7, 8):
        own = [x for e, _, ps in sorted((r for r in rows if r[0] == d), key=lambda r: r[1]) for x in ps]
        want[d] = (sum(r[0] == d for r in rows), sum(x != "" for x in own), hashlib.sha256("\n".join(own).encode()).hexdigest() if own else None)
    assert {r.doc: tuple(r)[1:] for r in pages.transcript_digests(df).collect()} == want
    whole = {r.doc: (r.pages, r.paragraphs, hashlib.sha256(r.text.encode()).hexdigest() if r.text else None) for r in pages.transcript(df).collect()}
    assert whole == want


def test_a_document_without_paragraphs_has_no_digest(spark, tmp_path):
    rows = [(8, 1, 3, 1, 5.0, 900.0, "A"), (15, 1, 3, 1, 6.0, 500.0, "N"), (9, 2, 4, 1, 7.0, 100.0, "R"), (9, 5, 4, 2, 9.0, 8000.0, "R")]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(path)
    got = sorted(map(tuple, catalogue.QUERIES["transcript_totals"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert got == sorted(con.execute(catalogue.SQL["transcript_totals"]).fetchall())
    assert got[0] == (1, 2, 0, None) and got[1][3]


def test_no_document_is_gathered_in_one_row(spark):
    plan = catalogue.QUERIES["transcript_totals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
