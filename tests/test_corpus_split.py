"""The corpus as bytes, cut once, against a plain cut of the joined texts."""

import pytest

from tessera import sources


@pytest.mark.parametrize("share", [0.0, 0.37, 0.9, 1.0])
def test_equals_one_cut_of_all_bytes(spark, share):
    rows = [(3, "cé"), (None, "nül"), (1, None), (2, ""), (5, "same"), (5, "same"), (5, "same"), (4, "x" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [(r.doc_id, r.text, bytes(r.train), bytes(r.held)) for r in sources.split_corpus(df, "doc_id", "text", share).collect()]
    assert len(out) == len(rows) and all(a + b == (t or "").encode() for _, t, a, b in out)
    total = sum(len((t or "").encode()) for _, t in rows)
    order = sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, -len(r[2])))
    assert sum(len(a) for *_, a, _ in out) == int(total * share)
    assert b"".join(r[2] for r in order) == b"".join(r[2] + r[3] for r in order)[: int(total * share)]


def test_nothing(spark):
    assert sources.split_corpus(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
