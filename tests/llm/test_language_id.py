"""Language identification: grams and margins against plain Python, codes by their distances, accuracy on held-out rows, odd rows."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id

SF = "/root/testdata/sf0.01"
KIND = "doc_id long, text string, lang string, grams string, margins string, held_out string"


def grams(text):
    """Slots of a text, by definition."""
    line = bytearray()
    for x in language_id.LETTER[np.frombuffer(text.encode(), np.uint8)].tolist():
        if x != 32 or not line or line[-1] != 32:
            line.append(x)
    out = collections.Counter()
    for g in language_id.GRAMS:
        for i in range(len(line) - g + 1):
            h = (int.from_bytes(line[i : i + g], "little") + g) * 0x9E3779B97F4A7C15 % 2**64
            out[h >> 64 - 17] += 1
    return out


@pytest.mark.parametrize("part", [1 << 19, 64, 7])
def test_grams_by_definition(monkeypatch, part):
    monkeypatch.setattr(language_id, "PART", part)
    rng = random.Random(part)
    texts = ["", None, " a ", "  ", " bb 12 c  ", " é-ß ", *(" " + "".join(rng.choice("abc é,  9") for _ in range(rng.randrange(200))) for _ in range(30))]
    data, offsets = language_id.utf8(pa.array(texts))
    have = [collections.Counter() for _ in texts]
    for out, start, rows in language_id.slots(data, offsets):
        ends = np.append(start[1:], out.shape[1])
        for r, a, b in zip(rows, start, ends, strict=True):
            have[r].update(x for x in out[:, a:b].ravel().tolist() if x != language_id.SLOTS)
    assert have == [grams(t or "") for t in texts]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6, 7, 20, 150])
def test_codewords(k):
    code = language_id.codewords(k)
    assert len(code) == k and (k == 1 or (np.abs(code.sum(0, dtype=int)) < k).all())
    apart = [int((a != b).sum()) for a, b in itertools.combinations(code, 2)]
    if k > 1:
        assert min(apart) == language_id.distance(code) >= (2 ** (k - 2) if k <= language_id.EXHAUSTIVE else 4)
        if k <= language_id.EXHAUSTIVE:  # no two columns tell the same languages apart
            assert len({tuple(c * c[0]) for c in code.T}) == code.shape[1]


def made(rng, n, stocks, first=0):
    return [(first + i, " ".join(rng.choice(stocks[lang]) for _ in range(rng.randint(1, 30))), lang) for i in range(n) for lang in [rng.choice(sorted(stocks))]]


def got(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], KIND).repartition(3)
    return {(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9), r.runner_up, r.ambiguous) for r in language_id.identify(df).collect()}


def plain(rows):
    """The whole model in plain Python."""
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    has = lambda t: t is not None and any(c.isalpha() for c in t)
    text = lambda t: grams(f" {t.lower()} ")
    counts = collections.defaultdict(collections.Counter)
    for i, t, lang in rows:
        if not out_of(i) and lang is not None and has(t):
            counts[lang].update(text(t))
    langs = sorted(counts)
    code, size = language_id.codewords(len(langs)), {x: sum(counts[x].values()) for x in langs}
    every = collections.Counter()
    for c in counts.values():
        every.update(c)
    share = lambda x, g: (counts[x][g] + language_id.PRIOR * every[g] / sum(size.values())) / (size[x] + language_id.PRIOR)

    def margins(t):
        own = text(t)
        out = []
        for b in range(code.shape[1]):
            total = 0.0
            for g, n in own.items():
                if every[g]:
                    one, other = ([share(x, g) for k, x in enumerate(langs) if code[k, b] == s] for s in (1, -1))
                    total += n * (math.log(sum(one) / len(one)) - math.log(sum(other) / len(other)))
            out.append(total / math.sqrt(sum(own.values())))
        return out

    trust = np.ones(code.shape)
    for k, x in enumerate(langs):
        seen = [margins(t) for i, t, lang in rows if lang == x and not out_of(i) and has(t)]
        trust[k] = [(sum((m[b] > 0) == (code[k, b] > 0) for m in seen) + 1) / (len(seen) + 2) for b in range(code.shape[1])]
    trust = trust / trust.mean(1, keepdims=True)
    out = {}
    for i, t, _ in rows:
        if not has(t):
            out[i] = ("und", 0.0)
            continue
        m = margins(t)
        loss = [sum(trust[k, b] * math.log1p(math.exp(-code[k, b] * m[b])) for b in range(len(m))) for k in range(len(langs))]
        near = min(range(len(langs)), key=lambda k: (round(loss[k], 9), k))
        out[i] = (langs[near], 1 / sum(math.exp(loss[near] - x) for x in loss))
    return out


def test_equals_a_plain_model(spark):
    rng = random.Random(5)
    stocks = {"aa": ["bado", "lumi", "Tra"], "bb": ["lumo", "grét", "tra"], "cc": ["bad", "óxi", "lum"], "dd": ["zed", "tra"], "": ["qi", "bado"]}
    rows = made(rng, 160, stocks) + [(900, None, "aa"), (901, "", "bb"), (902, "12 ?", "cc"), (903, "A", None), (904, "zed zed", None), (906, "bado", "aa")]
    want = plain(rows)
    have = got(spark, rows)
    assert len(have) == len(rows)
    for i, held, pred, score, _, _ in have:
        assert (pred, held) == (want[i][0], zlib.crc32(str(i).encode()) % 4 == 2)
        assert score == pytest.approx(want[i][1], abs=1e-4)


def test_odd_rows(spark):
    stocks = {"aa": ["bado", "lumi"], "bb": ["grét", "tra"]}
    rows = made(random.Random(1), 40, stocks)
    odd = [(None, "bado lumi", "aa"), (None, None, None), (500, "tra " * 300_000, "bb"), (500, "tra " * 300_000, "bb"), (501, "ß", None), (502, "—…", None), (503, "日本", None)]
    have = got(spark, rows + odd)
    by = {r[0]: r for r in have}
    assert (None, False, "und", 0.0, "und", True) in have and by[502][2] == "und" and by[500][2] == "bb" and by[503][2] != "und"
    assert sum(r[0] == 500 for r in have) == 1
    assert got(spark, []) == set()
    assert {r[2] for r in got(spark, [(1, "abc", None), (2, "abc", None)])} == {"und"}
    one = got(spark, [(i, "abc", "xx") for i in range(9)])
    assert {(r[2], r[3]) for r in one} == {("xx", 1.0)}


def test_many_languages(spark):
    rng = random.Random(2)
    stocks = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(12)] for k in range(70)}
    rows = made(rng, 1500, stocks)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got(spark, rows) if r[1]]
    assert np.mean([truth[r[0]] == r[2] for r in held]) > 0.97


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = language_id.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n, flagged = both.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("ambiguous").cast("int"))).first()
    assert n > 200 and right / n > 0.99 and flagged / n < 0.05


def test_training_does_not_see_held_out_rows(spark):
    rows = made(random.Random(3), 60, {"aa": ["bado", "lumi"], "bb": ["grét", "tra"]})
    other = [(i, t, "zz") if zlib.crc32(str(i).encode()) % 4 == 2 else (i, t, lang) for i, t, lang in rows]
    assert got(spark, rows) == got(spark, other)
