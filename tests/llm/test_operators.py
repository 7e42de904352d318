"""The remaining operators against brute force on small fixtures, and their defined cases."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bagminhash, bwt_dedup, context_mixing, decontaminate, syncmers, toxicity, warc_derive

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, n_chars string, akey long, key string"
ODD = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "a b c d e f g h i j k l"), (4, "a b c d e f g h i j k l"), (5, "z " * 60_000)]


def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 7, "clash") for i, t in ODD], KIND)


# --- fingerprints ---------------------------------------------------------------------------------------------------


def test_closed_syncmers_by_definition():
    rng = random.Random(1)
    raw = bytes(rng.choice(b"abc ") for _ in range(400))
    data = np.frombuffer(raw, np.uint8)
    at, _ = syncmers.anchors(data)

    def order(i):
        h = int.from_bytes(raw[i : i + 8], "little") * 0x9E3779B97F4A7C15 % 2**64
        return (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64

    n = syncmers.K - syncmers.S + 1
    want = [i for i in range(len(raw) - syncmers.K + 1) if min(inner := [order(i + j) for j in range(n)]) in (inner[0], inner[-1])]
    assert at.tolist() == want


def test_fingerprints_equal_the_plain_ones(spark):
    rows = {r.doc_id: r for r in syncmers.query(spark, SF).collect()}
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert len(rows) == len(docs)
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (syncmers.fingerprint(t), syncmers.fingerprint(edited))
    far = [r.near_next for r in rows.values()]
    near = [r.near_edited for r in rows.values() if r.n_chars > 200]
    assert np.mean(near) > 0.5 > 0.1 > np.median(far)


def test_fingerprints_of_equal_ids_do_not_depend_on_the_deal(spark):
    rows = [(5, t) for t in ("b" * 90, "a" * 80 + "x" * 90, None, "c d " * 40)] + [(6, "z" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda d: sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in syncmers.fingerprints(d).collect())
    assert key(df.repartition(1)) == key(df.repartition(4)) == key(df.orderBy(F.desc("text")))


def test_likeness_equals_a_plain_count():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(80) for _ in range(rng.randint(0, 70))] for _ in range(2))
        if rng.random() < 0.5:
            b = [x for x in a if rng.random() < 0.8] + b[:9]
        a, b = (list(dict.fromkeys(x))[: syncmers.SKETCH] for x in (a, b))
        union = sorted({*a, *b})[: syncmers.SKETCH]
        where = {x: i for i, x in enumerate(b)}
        places = [where[x] for x in a if x in where and x in union]
        best = [0] * len(places)
        for i, p in enumerate(places):
            best[i] = 1 + max((best[j] for j in range(i) if places[j] < p), default=0)
        want = float(len(a) == len(b)) if not a or not b else 1.0 if a == b else max(best, default=0) / len(union)
        assert syncmers.likeness(np.array(a, np.uint32), np.array(b, np.uint32)) == pytest.approx(want)


def test_fingerprints_of_odd_rows(spark):
    got = syncmers.fingerprints(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert {r.fingerprint for r in by[1] + by[2]} == {""} and by[1][0].near_edited == 1.0
    assert by[3][0].fingerprint == by[4][0].fingerprint and by[3][0].near_next == 1.0
    assert syncmers.fingerprints(odd(spark).limit(0)).count() == 0
    assert syncmers.fingerprints(odd(spark).where("doc_id = 3")).first().near_next == 1.0


# --- decontamination ------------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    w, hit, own = words(text), set(), set()
    for name, item in items:
        x = words(item)
        n = min(len(x), decontaminate.WINDOW)
        for k in range(len(x) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[k : k + n]:
                    hit |= set(range(i, i + n))
                    own.add(str(name))
    return len(w), len(hit), sorted(own)


@pytest.mark.parametrize("short", [False, True])
def test_decontamination_equals_brute_force(spark, short):
    rng = random.Random(5)
    item = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(k, item(rng.randint(10, 25))) for k in range(6)] + ([(10, "A"), (11, "b, a"), (12, ""), (13, None)] if short else [])
    docs = [(i, "x " + item(rng.randint(0, 40)) + "! Q " + (items[0][1] if i % 3 == 0 else "")) for i in range(20)] + ODD
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    found = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in got)
    want = collections.Counter()
    for i, t in docs:
        n, h, own = brute_hits(t, items)
        want[(i, n, h, hashlib.sha256(",".join(own).encode()).hexdigest())] += 1
    assert found == want
    few = spark.createDataFrame(docs[:3], "doc_id long, text string")
    assert decontaminate.report(few.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(few, spark.createDataFrame([], "item_id long, text string")).collect())


def test_clean_cuts_until_nothing_is_left(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    first, last = passage.split()[:6], passage.split()[6:]
    docs = spark.createDataFrame([(1, f"before {passage} after " + "more " * 40, 5), (2, passage, 5), (3, "clean", 5), (4, " ".join(first) + f" {passage} " + " ".join(last) + " tail" * 60, 5), (5, None, 5)], "doc_id long, text string, n_chars long")
    out = decontaminate.clean(docs, items)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 3, 4, 5}
    assert not [r for r in decontaminate.report(out, items).collect() if r.contaminated]
    assert {r.doc_id: r.text for r in out.collect()}[3] == "clean"
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.doc_id in (1, 4))


def test_shards_agree_with_one_automaton(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(decontaminate.report(docs, items))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 800)
    assert len(decontaminate.automata(items)) > 8 and key(decontaminate.report(docs, items)) == want


def test_clean_over_shards_equals_one_automaton(spark, monkeypatch):
    rng = random.Random(12)
    some = [" ".join(f"s{k}w{i}" for i in range(24)) for k in range(12)]
    items = spark.createDataFrame(list(enumerate(some)), "item_id long, text string")
    docs = []
    for i in range(60):
        a, b = rng.sample(some, 2)
        x, y = a.split(), b.split()
        tail = [f"tail{j}" for j in range(rng.choice([20, 40, 100]))]
        docs.append((i, " ".join([["pre", *x[:12], *y, *x[12:], *tail], ["pre", *x, "mid", *y, *tail]][i % 2]), 1))
    docs = spark.createDataFrame([*docs, (100, None, 0), (101, "", 0)], "doc_id long, text string, n_chars long")
    key = lambda df: sorted((r.doc_id, r.text or "", r.n_chars) for r in df.collect())
    want = key(decontaminate.clean(docs, items))
    assert 2 < len(want) < 62
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 400)
    assert len(decontaminate.automata(items)) > 2
    out = decontaminate.clean(docs, items)
    assert out.columns == docs.columns and key(out) == want
    assert not [r for r in decontaminate.report(out, items).collect() if r.contaminated]


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_finds_held_out_documents(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choice(["tion", "er", "an", "the", "ou", "ble", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, marks = [], []
    for i in range(700):
        w = [rng.choice(plain) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["qwixzard", "vrodnik", "zzkuhm"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad), None))
    docs = spark.createDataFrame([*rows, *ODD], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (700, None, None)], "doc_id long, toxic int, quality int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id > 5]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95
    wide = docs.withColumns({c: F.lit(1) for c in ("score", "row", "text_", "toxic")})
    kept = toxicity.keep_clean(wide, labels)
    assert kept.columns == wide.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.keep_clean(wide.limit(0), labels).count() == toxicity.classify(docs.limit(0), labels).count() == 0


def test_toxicity_counts_words_that_ordinary_text_also_has():
    rng = random.Random(6)
    plain = ["".join(rng.choice(["tion", "er", "an", "the", "ou", "ble", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(800):
        w = [rng.choice(plain) for _ in range(300)]
        for _ in range(5 if i % 5 == 0 else int(i % 3 == 1)):
            w[rng.randrange(300)] = "achlund"
        rows.append((" ".join(w), int(i % 5 == 0)))
    model = toxicity.fit(rows[:600])
    judge = toxicity.Judge(model)
    got = [judge.score(np.frombuffer(t.encode(), np.uint8)) >= 0.5 for t, _ in rows[600:]]
    assert np.mean([g == bool(y) for g, (_, y) in zip(got, rows[600:], strict=True)]) > 0.95


def test_margins_are_differences_of_compressed_lengths(monkeypatch):
    """Held against direct calls of the library, window by window, and over blocks."""
    import zstandard

    rng = random.Random(7)
    rows = [(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(90)) for _ in range(80)) + (" nastiword" * 3 if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    model = toxicity.fit(rows)
    text = np.frombuffer((rows[0][0] + " tail é").encode() * 9, np.uint8)
    low = bytes(toxicity.lowered(text))
    grams = [low[i : i + toxicity.GRAM] for i in range(len(low) - toxicity.GRAM + 1)]
    mask = 2**64 - 1

    def mixed(x):
        for a, b in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = ((x ^ (x >> a)) * b) & mask
        return x

    raw = [b"".join(mixed((mixed(int.from_bytes(g, "big") * 0x9E3779B97F4A7C15 & mask) + k) & mask).to_bytes(8, "little") for k in range(toxicity.WIDE)) for g in grams]
    sizes = []
    for content in (model["ordinary"], model["ordinary"] + model["toxic"]):
        own = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, min_match=7, hash_log=17, chain_log=16, search_log=1, window_log=18, target_length=1, write_content_size=False, write_checksum=False, write_dict_id=False))
        sizes.append([len(own.compress(b"".join(raw[i : i + toxicity.WINDOW]))) for i in range(0, len(raw), toxicity.WINDOW)])
    want = [a - b for a, b in zip(*sizes, strict=True)]
    judge = toxicity.Judge(model)
    assert judge.margins(toxicity.lowered(text)).tolist() == want and max(want) > 10
    monkeypatch.setattr(toxicity, "BLOCK", 4 * toxicity.WINDOW)
    assert judge.margins(toxicity.lowered(text)).tolist() == want


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(odd(spark), none).collect()} == {0.0}


# --- suffix deduplication -------------------------------------------------------------------------------------------


def brute_removed(texts):
    raw = [(t or "").encode() for t in texts]
    n = bwt_dedup.WINDOW
    seen = collections.Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "sample"), [(8192, 4000), (2, 4000), (8192, 2000), (2, 1)])
def test_repeated_bytes_equal_brute_force(spark, hot, sample, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "HOT", hot)
    monkeypatch.setattr(bwt_dedup, "SAMPLE", sample)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    base = [text(700) for _ in range(4)]
    texts = [base[0], base[0], base[1] + text(100), text(50) + base[1][100:500] + text(300), base[2][:199], base[2][:200], base[2], "ab" * 400, text(300), None, "", base[3][:450] + text(20) + base[3][:450]]
    texts += [text(rng.randint(0, 200)) + base[3][50:320] + text(rng.randint(0, 200)) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in bwt_dedup.report(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts)


def test_repeated_bytes_of_odd_rows(spark):
    got = bwt_dedup.report(odd(spark)).collect()
    assert len(got) == len(ODD) and {r.n_removed for r in got if r.doc_id != 5} == {0}
    assert next(r.n_removed for r in got if r.doc_id == 5) == 120_000
    assert bwt_dedup.report(odd(spark).limit(0)).count() == 0


def test_repeated_rows_count_as_often_as_they_come(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    a, b = text(500), text(500)
    rows = [(1, a)] * 3 + [(2, b), (3, a[:260]), (None, b), (None, b), (4, text(400)), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_removed([t for _, t in rows])
    got = sorted(map(str, bwt_dedup.report(df).collect()))
    assert len(got) == len(rows)
    assert sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True)) == sorted((str(r.doc_id), *tuple(r)[1:]) for r in bwt_dedup.report(df).collect())


def test_many_equal_rows_cost_about_as_much_as_one(spark):
    rng = random.Random(12)
    row = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    df = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(row).alias("text")).repartition(8)
    began = time.perf_counter()
    got = bwt_dedup.report(df).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert [tuple(r) for r in got] == [(4000, 4000, 1, 10_000)]
    assert time.perf_counter() - began < 120


# --- near-duplicates ------------------------------------------------------------------------------------------------


def test_signatures_estimate_the_weighted_similarity():
    a = np.arange(1, 101, dtype=np.uint64) * np.uint64(7919)
    b = np.concatenate([a[:80], a[:30], a[:30], np.arange(1000, 1020, dtype=np.uint64)])
    seen = []
    for k in range(150):
        x, y = (np.sort(bagminhash.mix(v + np.uint64(k * 10**6))) for v in (a, b))
        s = bagminhash.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        seen.append((s[0] == s[1]).mean())
    true = bagminhash.multiset_jaccard(bagminhash.distinct_items(x), bagminhash.distinct_items(y))
    assert true == pytest.approx(80 / (100 + 160 - 80)) and abs(np.mean(seen) - true) < 0.015


def brute_classes(docs):
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a is None or b is None:
                near = a is None and b is None and (docs[i][1] or "") == (docs[j][1] or "")
            else:
                both = sum((a & b).values())
                near = both >= 0.8 * (sum(a.values()) + sum(b.values()) - both)
            if near:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {frozenset(k for k in range(len(docs)) if find(k) == r) for r in {find(i) for i in range(len(docs))}}


@pytest.mark.parametrize("tile", [512, 4])
def test_near_duplicates_equal_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(bagminhash, "TILE", tile)
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    docs, base = [], text(120)
    for i in range(60):
        w = list(base) if i < 40 else text(rng.randint(3, 80))
        for _ in range(rng.randint(0, 5) if i < 40 else 0):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
        docs.append((i, " ".join(w)))
    docs += [(100, docs[3][1].upper()), (101, "one two"), (102, "One, two!"), (103, None), (104, ""), (105, "!!"), (106, "a " * 300), (107, "a " * 290)]
    got = collections.defaultdict(set)
    place = {i: k for k, (i, _) in enumerate(docs)}
    for r in bagminhash.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect():
        got[r.class_id].add(place[r.doc_id])
    assert {frozenset(v) for v in got.values()} == brute_classes(docs)


def test_near_duplicates_lose_few_links():
    """Of random pairs at a similarity of 0.8, hardly any share no band."""
    rng = np.random.default_rng(2)
    lost = 0
    for _ in range(400):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (240, 30, 30))
        x, y = np.sort(np.concatenate([both, a])), np.sort(np.concatenate([both, b]))
        s = bagminhash.bands(bagminhash.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])))
        lost += not (s[0] == s[1]).any()
    assert lost <= 4


def test_components_equal_a_plain_union(spark):
    from tessera.llm.components import components

    rng = random.Random(15)
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(0, 60)] + [("n500", f"n{i}") for i in range(510, 600)] + [(f"n{rng.randrange(100, 300)}", f"n{rng.randrange(100, 300)}") for _ in range(120)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark, spark.createDataFrame([], "a string, b string")).count() == 0


def test_keep_one(spark):
    df = odd(spark)
    kept = bagminhash.keep_one(df)
    assert kept.columns == df.columns
    named = bagminhash.keep_one(df.withColumnsRenamed({"akey": "kept_", "key": "digest"}).withColumn("id", F.lit(1)).withColumn("row", F.lit(2)))
    assert sorted(named.columns) == ["digest", "doc_id", "id", "kept_", "n_chars", "row", "text"] and named.count() == kept.count()
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 5]
    assert bagminhash.classes(df.limit(0)).count() == 0


def test_keep_one_tells_rows_of_equal_or_no_id_apart(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(30))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (None, text(2)), (None, text(3) + " more"), (5, text(3)), (7, text(4)), (7, text(5)), (7, text(5)), (8, text(4)), (9, None), (9, "")]
    kept = bagminhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, text(0)), (None, text(1)), (None, text(2)), (5, text(3)), (7, text(4)), (7, text(5)), (9, "")]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(key, kept)) == sorted(map(key, want))


# --- language model -------------------------------------------------------------------------------------------------


def test_base_score_and_probabilities(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "FREQUENT", 50)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(9001, None), (9002, "Ünknown\tA  b"), (9002, "Ünknown\tA  b")]
    got = context_mixing.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    toks = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in rows if not out(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append((out(i), len(toks(t)), sum(w in c for w in toks(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t))))
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4]) and r.score < 0
    assert len({r.score for r in got if r.doc_id == 9002}) == 1


def random_model():
    rng = np.random.default_rng(0)
    cells = [np.zeros((1 << bits, 256), np.int32) for _, bits in context_mixing.ORDERS]
    for c in cells:
        c.reshape(-1)[rng.integers(0, c.size, 5000)] = rng.integers(1, 50, 5000)
    code = context_mixing.Code(cells[0].sum(0))
    tables = []
    for c in cells:
        table = np.zeros(c.shape, np.int8)
        for i in range(0, len(c), 4096):
            table[i : i + 4096, :255] = np.clip(np.rint(context_mixing.log_odds(*code.node_counts(c[i : i + 4096])) * context_mixing.STEPS), -127, 127)
        tables.append(table)
    model = context_mixing.Model(code, tables, cells[-1].sum(1))
    text = np.frombuffer(b"some text to fit the gates on \n", np.uint8)
    assert model.fit(text, np.array([0, len(text)])) > 50
    return model


def test_bits_are_a_code():
    """Over all one-byte continuations of a fresh model the probabilities add up to one."""
    model = random_model()
    total = sum(2.0 ** -model.bits(np.array([b], np.uint8), np.array([0, 1]))[0] for b in range(256))
    assert total == pytest.approx(1.0, abs=1e-4)


def plain_bits(model, text):
    """Bits of each byte of one text, a bit at a time."""
    m, out = context_mixing, []
    slots = m.contexts(text, np.array([0, len(text)]))
    weights = model.weights.astype(float)
    for start in range(0, len(text), m.BLOCK):
        step = np.zeros_like(weights)
        for i in range(start, min(start + m.BLOCK, len(text))):
            a = model.code.start[text[i]]
            bits = 0.0
            for j in range(a, a + model.code.length[text[i]]):
                node, bit = int(model.code.node[j]), int(model.code.bit[j])
                x = [int(t.reshape(-1, 256)[s[i], node]) / m.STEPS for t, s in zip(model.tables, slots, strict=True)]
                gate = min(int(model.code.depth[j]), m.DEPTHS - 1) * m.SURE + int(model.sure[slots[-1][i]])
                p = 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights[gate], x, strict=True))))
                bits -= math.log2(p if bit else 1 - p)
                for k, v in enumerate(x):
                    step[gate, k] += m.RATE * (bit - p) * v
            out.append(bits)
        weights += step
    return out


def test_bits_equal_a_plain_mixer():
    model = random_model()
    texts = [np.frombuffer(t, np.uint8) for t in (b"some text to fit the gates on, and more " * 9, b"\n", "é few wörds \n".encode(), b"x" * 64, b"y" * 65)]
    got = model.bits(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert got.tolist() == pytest.approx([v for t in texts for v in plain_bits(model, t)], rel=1e-3, abs=1e-3)


def test_scores_equal_a_plain_mixture(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "FREQUENT", 50)
    monkeypatch.setattr(context_mixing, "FIT_SHARE", 4)
    rng = random.Random(21)
    word = lambda: rng.choice(["the", "of", "Énd", "ab" * rng.randint(1, 3), f"w{rng.randrange(200)}"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(70, None), (71, "long " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted = context_mixing.written(spark, context_mixing.counts(docs))
    model = context_mixing.train(docs, counted)
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    toks = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = collections.Counter(w for i, t in rows if not out(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in context_mixing.report(docs).collect()}
    for i, t in rows:
        parts = [b"\n" if w is None else (w + " ").encode() for w in toks(t)]
        each = iter(plain_bits(model, np.frombuffer(b"".join(parts), np.uint8)))
        total, odds = 0.0, 0.0
        for w, part in zip(toks(t), parts, strict=True):
            own, by = math.log2((c[w] + 0.1) / (n + 0.1 * (v + 1))), -sum(next(each) for _ in part)
            gate = 1 / (1 + math.exp(-max(-4.0, min(4.0, odds / context_mixing.MIX_STEP + context_mixing.MIX_START))))
            total += math.log10(gate * 2**own + (1 - gate) * 2**by)
            if c[w] * 50 > n:
                odds += max(-6.0, min(6.0, own - by))
        assert got[i].score == pytest.approx(total, rel=2e-3, abs=1e-2)
    assert sum(r.score > r.base_score for r in got.values()) > 30


def test_language_model_of_odd_rows(spark):
    got = context_mixing.report(odd(spark)).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) for r in got) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert context_mixing.report(odd(spark).limit(0)).count() == 0


def test_no_training_rows(spark):
    got = context_mixing.report(spark.createDataFrame([(i, "a") for i in range(30) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")).first()
    assert got.train_tokens == 0 and got.n_known == 0 and math.isfinite(got.score)


# --- WARC -----------------------------------------------------------------------------------------------------------


def test_warc_derivatives(spark):
    html = "<html lang='en'><head><title> A &amp; B </title><style>x{}</style></head><body><!-- c --><p>One<br>two &lt;3</p><script>no()</script><a href='/x'>l</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a/", html, 0), (2, None, None, 0), (1, "http://a/", html, 0)], "page_id long, url string, html string, kind int")
    rows = warc_derive.derive(warc_derive.responses(pages)).collect()
    assert len(rows) == 6
    text = next(r for r in rows if r.kind == "conversion" and r.page_id == 1)
    meta = next(r for r in rows if r.kind == "metadata" and r.page_id == 1)
    assert text.block == "One\ntwo <3\nl" and text.content_length == len(text.block)
    assert meta.block == "title: A & B\r\nlanguage: en\r\noutlinks: 1\r\n"
    assert text.refers_to == meta.refers_to != text.record_id != meta.record_id and text.payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert next(r.block for r in rows if r.kind == "conversion" and r.page_id == 2) == ""
    assert "WARC-Refers-To: <urn:uuid:" in warc_derive.as_text(warc_derive.derive(warc_derive.responses(pages))).first().record
    assert warc_derive.derive(warc_derive.responses(pages.limit(0))).count() == 0
    same = spark.createDataFrame([(None, "1", "x"), (1, None, "x")], "page_id long, url string, html string")
    assert len({r.record_id for r in warc_derive.responses(same).collect()}) == 2


def test_warc_record_as_it_stands_in_a_file(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>hi</p>")], "page_id long, url string, html string")
    rec = next(r.record for r in warc_derive.as_text(warc_derive.derive(warc_derive.responses(pages))).collect() if r.kind == "conversion")
    head, block = rec.split("\r\n\r\n", 1)
    lines = head.split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:] if not x.startswith("WARC-Source-HTTP"))
    assert lines[0] == "WARC/1.1" and block == "hi\r\n\r\n" and fields["Content-Length"] == "2" and fields["WARC-Type"] == "conversion"
    assert fields["WARC-Refers-To-Target-URI"] == fields["WARC-Target-URI"] == "http://a/" and fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(b"hi").hexdigest()
    assert [x for x in lines if x.startswith("WARC-Source-HTTP")] == [f"WARC-Source-HTTP-Header: {h}" for h in ("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: 9")]
