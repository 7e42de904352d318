import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import piece_sampling as ps


@pytest.fixture(scope="module")
def v():
    return ps.Vocabulary()


def run(v, texts, keys):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, ends, *_ = ps.encode(v, np.frombuffer(b"".join(raw), np.uint8), offsets, np.array(keys, np.uint64))
    return [ids[a:b].tolist() for a, b in itertools.pairwise(ends)]


VOCABULARY = ps.Vocabulary()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=90) | st.text("ab ▁\n中é\U0001f600", max_size=90), max_size=6))
def test_lossless_and_independent_of_neighbours(texts):
    keys = list(range(7, 7 + len(texts)))
    got = run(VOCABULARY, texts, keys)
    for t, k, ids in zip(texts, keys, got, strict=True):
        assert VOCABULARY.decode(np.array(ids, np.int64)).tobytes()[1:].decode() == t
        assert run(VOCABULARY, [t], [k]) == [ids]


def all_paths(v, chunk):
    if not chunk:
        yield (), 0.0
    for n in range(1, len(chunk) + 1):
        p = v.table.get(chunk[:n])
        if p is not None:
            for rest, w in all_paths(v, chunk[n:]):
                yield (p, *rest), w + v.log_weight[p]


@pytest.mark.parametrize("sampler", ["chunks", "long"])
def test_frequencies_follow_the_lattice(v, sampler):
    chunk = b" thing"
    paths = {p: math.exp(w) for p, w in all_paths(v, chunk)}
    total = sum(paths.values())
    n = 20_000
    seeds = ps.mix(np.arange(n, dtype=np.uint64))
    if sampler == "chunks":
        ids, count = ps.sample_chunks(v, np.frombuffer(chunk, np.uint8), np.array([0, len(chunk)]), np.zeros(n, np.int64), seeds)
        ends = np.concatenate([[0], np.cumsum(count)])
        got = [tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(ends)]
    else:
        n = 3000
        got = [tuple(ps.sample_long(v, np.frombuffer(chunk, np.uint8), int(s)).tolist()) for s in seeds[:n]]
    assert set(got) <= set(paths)
    for p, w in paths.items():
        share = w / total
        assert abs(got.count(p) / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-3


def test_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "x y", 0), (3, "same text here", 0), (3, "same text here", 1), (4, "a" * 5000 + " " * 300 + "中" * 400, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int")
    got = ps.report(df).collect()
    assert all(r.lossless for r in got) and len(got) == 6
    assert {r.n_pieces for r in got if r.doc_id in (1, 2)} == {0}
    assert len({r.pieces_sha256 for r in got if r.doc_id == 3}) == 1
    assert ps.report(df.limit(0)).count() == 0
    enc = ps.encode_column(df)
    assert {r.t for r in enc.select(ps.decode_column(enc.pieces).alias("t")).collect()} == {r[1] or "" for r in rows}


def test_unbroken_text_is_cut_where_no_piece_crosses(v):
    """Segments of a long chunk have the lattice's own frequencies: a place that all paths share parts them."""
    text = "中文字符没有空格" * 12
    raw = np.frombuffer(text.encode(), np.uint8)
    free = ps.free_places(v, raw)
    a, b, _ = ps.edges(v, raw, np.array([0, len(raw)]))
    assert free.tolist() == [not ((a < k) & (k < b)).any() for k in range(len(raw) + 1)] and free.sum() > 20
    got = run(v, [text] * 300, range(300))
    assert all(v.decode(np.array(g)).tobytes()[1:].decode() == text for g in got)
    mixed = run(v, ["unbroken" * 20] * 50, range(50))
    assert len({tuple(g) for g in mixed}) > 10 and all(v.decode(np.array(g)).tobytes()[1:].decode() == "unbroken" * 20 for g in mixed)


def test_very_long_texts_in_bounded_parts(v, monkeypatch):
    import time
    import tracemalloc

    monkeypatch.setattr(ps, "BLOCK", 1 << 16)
    rng = np.random.default_rng(3)
    words = np.array(["".join(chr(0x4E00 + c) for c in rng.integers(0, 3000, 9)) for _ in range(500)])
    cjk = "".join(words[rng.integers(0, 500, 20_000)])[:170_000]
    for text in (cjk, "z" * 200_000, "word " * 60_000, "aGVsbG8gd29ybGQ" * 20_000):
        raw = np.frombuffer(text.encode(), np.uint8)
        cuts = ps.parts(v, raw)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(raw) and all(b == c for (_, b), (c, _) in itertools.pairwise(cuts))
        began = time.perf_counter()
        tracemalloc.start()
        ids = np.concatenate([ps.encode(v, raw[a:b], np.array([0, b - a]), np.array([5], np.uint64), k)[0] for k, (a, b) in enumerate(cuts)])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert v.decode(ids).tobytes()[1:].decode() == text
        assert peak < 120 << 20 and time.perf_counter() - began < 30


def test_long_texts_as_rows(spark, monkeypatch):
    rows = [(1, "中文没有空格" * 120_000, 0), (2, "ab " * 300_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int")
    got = {r.doc_id: r for r in ps.report(df).collect()}
    pieces = {r.doc_id: len(r.pieces) for r in ps.encode_column(df).collect()}
    assert all(r.lossless for r in got.values()) and {i: r.n_pieces for i, r in got.items()} == pieces
