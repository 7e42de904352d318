"""The manifest against a plain tree in Python, over odd and repeated rows, and against SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tessera.llm import merkle

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, hash string, n long, path string"
FIELDS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Last node of a list of digests, and for each of them its path of (before, after)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, i in enumerate(at):
            run = runs[i // 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        at = [i // 8 for i in at]
        level = [sha(*run) for run in runs]
    return level[0], paths


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    ends = []
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        ends.append(climb([leaf(r) for r in trees[lang]]))
    out = []
    if rows:
        root, over = climb([e[0] for e in ends])
    for (sub, paths), lang, up in zip(ends, langs, over if rows else [], strict=True):
        for r, path in zip(trees[lang], paths, strict=True):
            given = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                given = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            h, path = leaf(given), path + up
            for a, b in path:
                h = sha(a, h, b)
            out.append((r[0], leaf(r), sub, root, sha(*(a + b for a, b in path)), h, h == root))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, "clash", 1, "clash") for r in rows], KIND).repartition(3)
    return sorted((tuple(r[f] for f in FIELDS) for r in merkle.manifest(df).collect()), key=str)


def made(rng, n, langs):
    return [(i, f"s{i % 3}", rng.choice(langs), rng.randrange(99), rng.choice(["Ab c", "xyz", "ÄBC d", "Q"]) * rng.randrange(3)) for i in rng.sample(range(4 * n), n)]


@pytest.mark.parametrize(("n", "langs"), [(1, ["a"]), (9, ["a", None]), (70, ["a"]), (150, ["a", "b", None, "é", "Z"]), (90, [f"l{k}" for k in range(70)])])
def test_equals_a_plain_tree(spark, n, langs):
    rows = made(random.Random(n), n, langs)
    assert got(spark, rows) == brute(rows)


def test_odd_and_repeated_rows(spark):
    odd = [(None, None, None, None, None), (None, None, None, None, None), (3, "", "", 0, ""), (3, "", "", 0, ""), (3, "", None, 0, "B"), (6, "s", "a", 7, "Z" * 300_000), (None, "s", "a", 1, "Q"), (-5, "s", "a", 1, "Q"), (7, "ü", "ß", 1, None)]
    rows = odd + [(11, "s", "a", 1, "X")] * 120 + made(random.Random(2), 30, ["a", "ß"])
    want = brute(rows)
    assert got(spark, rows) == want
    assert {r[-1] for r in want} == {True, False}
    assert got(spark, []) == []


def test_query_equals_sql_and_tells_tampered_rows(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(merkle.SQL).df()[list(FIELDS)]
    have = merkle.query(spark, SF).toPandas()[list(FIELDS)]
    assert sorted(map(tuple, want.values.tolist())) == sorted(map(tuple, have.values.tolist()))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for i, ok in zip(have.doc_id, have.verified, strict=True):
        assert ok == (zlib.crc32(str(i).encode()) % 3 != 0 or not any("A" <= c <= "Z" for c in texts[i] or ""))
