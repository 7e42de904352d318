"""Language identification with error-correcting output codes.

Every language of the training rows has a codeword; every bit of the code has a binary classifier over hashed byte n-grams of 2 to 4 bytes, that tells the languages whose bit is
1 from the others. A classifier's weights are log ratios of the two groups' mean gram frequencies, each language's smoothed towards the frequencies of all;
the counts cover all training rows and are added up by Spark, and the weights are made from them in tasks, a block of slots each. A text's margin for a bit is the
sum of its grams' weights over the root of their number.

Decoding is loss-weighted: the loss of a language is the sum over bits of log(1 + exp(-sign * margin)), weighed by how often that classifier is right on that
language's training rows; the nearest codeword is that of least loss, of equals the first language by name. ``score`` is the share of exp(-loss) that it has among all. A row
is ``ambiguous`` if that is under ``SURE``, or if more bits disagree with its codeword than the code can correct.

Up to ``EXHAUSTIVE`` languages take the exhaustive code; more take the best of some random codes of 10 log2 K bits, so the model grows with the logarithm of the languages.
What is collected: the languages, and for each bit its weights (``SLOTS`` floats) and its accuracies (one a language).

Defined cases: a null text, an empty one, and one without letters are ``und`` with score 0; so is every text if no row can be learned from. With one language in training
all others are that with score 1. A null doc_id is not held out. A text of any length is taken in parts. Repeated rows count each, and get the same answer. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, discard, documents, pieces, utf8, written

SLOTS = 1 << 17
#: Slots whose weights are made in one group.
BLOCK = 1 << 13
#: Lengths of grams in bytes.
GRAMS = (2, 3, 4)
#: Strength of smoothing, in grams.
PRIOR = 4096.0
#: Largest number of languages that get the exhaustive code, and random codes that are tried for more.
EXHAUSTIVE, DRAWS = 6, 32
#: Bytes of text that are taken at a time, and languages whose counts a task holds before it hands them on.
PART, HELD = 1 << 19, 64
#: Share of the winner under which a row is ambiguous.
SURE = 0.8
UND = "und"

#: Letters as they are, all else as blanks; A-Z were lowered before, and bytes over 127 are parts of letters.
LETTER = np.full(256, 32, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def texts(docs: DataFrame) -> DataFrame:
    """Lowered text between blanks, null where there is no letter."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.when(~held_out(), F.col("lang").cast("string")).alias("lang"), F.when(text.rlike(r"\p{L}"), F.concat(F.lit(" "), F.lower(text), F.lit(" "))).alias("text"))


def codewords(k: int) -> np.ndarray:
    """Codewords of k languages as rows of -1 and 1; no column is constant."""
    if k < 2:
        return np.zeros((k, 0), np.int8)
    if k <= EXHAUSTIVE:
        bits = np.arange(1, 2 ** (k - 1))
        return np.array([[1] * len(bits)] + [np.where(bits >> (k - 2 - i) & 1, -1, 1) for i in range(k - 1)], np.int8)
    best, far = None, -1
    for draw in range(DRAWS):
        rng = np.random.default_rng([k, draw])
        columns = np.where(rng.random((k, int(np.ceil(10 * np.log2(k))))) < 0.5, -1, 1).astype(np.int8)
        for j in np.flatnonzero(np.abs(columns.sum(0, dtype=np.int64)) == k):
            columns[j % k, j] *= -1
        least = distance(columns)
        if least > far:
            best, far = columns, least
    return best


def distance(code: np.ndarray) -> int:
    """Least Hamming distance of two codewords."""
    least, wide = code.shape[1], code.astype(np.float32)
    for a in range(0, len(code), 512):
        agree = wide[a : a + 512] @ wide.T
        agree[np.arange(len(agree)), a + np.arange(len(agree))] = -code.shape[1]
        least = min(least, int((code.shape[1] - agree.max()) / 2)) if len(code) > 1 else least
    return least


def slots(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed grams of a run of texts, by part: (slots by length of gram, starts of the rows that are in it, those rows). Runs of blanks are one blank; slot ``SLOTS`` stands for no gram."""
    for a, b in pieces(offsets, PART):
        lo, hi = int(offsets[a]), int(offsets[b])
        carry, blank_before = np.zeros(0, np.uint8), False
        for at in range(lo, hi, PART):
            # Only a text longer than a part is in several: each begins with the last bytes of the one before, whose grams are not taken again.
            low = LETTER[data[at : min(hi, at + PART)]]
            blank = low == 32
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            keep[0] |= not blank_before
            first = offsets[a:b][(offsets[a:b] >= at) & (offsets[a:b] < at + len(low)) & (offsets[a + 1 : b + 1] > offsets[a:b])] - at
            keep[first] = True
            blank_before = bool(blank[-1])
            kept = np.concatenate([[0], np.cumsum(keep)])
            line = np.concatenate([carry, low[keep]])
            if hi - lo <= PART:
                rows, start = np.flatnonzero(offsets[a + 1 : b + 1] > offsets[a:b]) + a, kept[first]
            else:
                rows, start = np.array([a]), np.zeros(1, np.int64)
            if len(line):
                yield hashed(line, start, np.append(start[1:], len(line)), len(carry)), start, rows
            carry = line[-(GRAMS[-1] - 1) :]


def hashed(line: np.ndarray, start: np.ndarray, end: np.ndarray, known: int) -> np.ndarray:
    """The slot of each gram; none for what would go beyond its row, or lies within the first bytes, which are known."""
    n = len(line)
    line = np.concatenate([line, np.zeros(4, np.uint8)]).astype(np.uint32)
    out = np.empty((len(GRAMS), n), np.int32)
    word, wide = line[:n], 1
    for i, g in enumerate(GRAMS):
        while wide < g:
            word = word | line[wide : n + wide] << np.uint32(8 * wide)
            wide += 1
        slot = ((word.astype(np.uint64) + U64(g)) * U64(0x9E3779B97F4A7C15) >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int32)
        for back in range(1, g):
            over = end - back
            slot[over[over >= start]] = SLOTS
        slot[: max(0, known - g + 1)] = SLOTS
        out[i] = slot
    return out


def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams by language and slot, added up within a task as long as it holds few languages."""
    held: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(at), np.int32))), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "slot", "n"])
        held.clear()

    for batch in batches:
        names, code = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
        order = np.argsort(code, kind="stable")
        data, offsets = utf8(batch.column("text").take(pa.array(order)))
        code = code[order]
        for out, start, rows in slots(data, offsets):
            langs = code[rows]
            cut = np.flatnonzero(np.concatenate([[True], langs[1:] != langs[:-1]])) if len(langs) else np.zeros(0, np.int64)
            for i, c in enumerate(cut):
                lo, hi = start[c], start[cut[i + 1]] if i + 1 < len(cut) else out.shape[1]
                name = names[langs[c]]
                if name not in held and len(held) >= HELD:
                    yield from told()
                n = np.bincount(out[:, lo:hi].ravel(), minlength=SLOTS + 1)[:SLOTS]
                held[name] = held[name] + n if name in held else n
    yield from told()


class Model:
    """Languages, codewords, the bits' weights (slot by bit), and how much a bit counts for a language."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray):
        self.langs, self.code, self.weights = langs, code, weights
        self.trust = np.full(code.shape, 1.0)

    def margins(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A margin for each row and bit, and the number of grams of each row."""
        data, offsets = utf8(column)
        rows_n = len(offsets) - 1
        total, n = np.zeros((rows_n, self.code.shape[1])), np.zeros(rows_n, np.int64)
        for out, start, rows in slots(data, offsets):
            if not len(rows):
                continue
            for slot in out:
                total[rows] += np.add.reduceat(self.weights[slot], start, axis=0, dtype=np.float64)
                n[rows] += np.add.reduceat((slot != SLOTS).astype(np.int64), start)
        return total / np.sqrt(np.maximum(n, 1))[:, None], n

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nearest language, its share, the next one (or itself), and whether it is ambiguous."""
        k, bits = self.code.shape
        if k == 1:
            zero = np.zeros(len(margins), np.int64)
            return zero, np.ones(len(margins)), zero, np.zeros(len(margins), bool)
        plus, minus = np.logaddexp(0, -margins), np.logaddexp(0, margins)  # losses if the bit is 1, or -1
        one = self.code > 0
        loss = plus @ np.where(one, self.trust, 0).T + minus @ np.where(one, 0, self.trust).T
        order = np.argsort(loss, axis=1, kind="stable")[:, :2]
        near, after = order[:, 0], order[:, 1]
        least = np.take_along_axis(loss, order[:, :1], 1)
        score = 1 / np.exp(least - loss).sum(1)
        wrong = ((margins > 0) != one[near]).sum(1)
        return near, score, after, (score < SURE) | (wrong > (distance(self.code) - 1) // 2)


def weights_of(code: np.ndarray, index: dict[str, int], total: np.ndarray):
    """Map: the bits' weights of a block of slots, from the counts of its grams by language."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        base = int(key[0]) * BLOCK
        n = np.zeros((len(total), BLOCK))
        np.add.at(n, (rows["lang"].map(index).to_numpy(), rows["slot"].to_numpy() - base), rows["n"].to_numpy())
        every = n.sum(0) / total.sum()
        share = (n + PRIOR * every) / (total + PRIOR)[:, None]
        seen = every > 0
        out = np.zeros((BLOCK, code.shape[1]), np.float32)
        for b in range(code.shape[1]):
            one = code[:, b] > 0
            out[seen, b] = np.log(share[one].mean(0)[seen]) - np.log(share[~one].mean(0)[seen])
        return pd.DataFrame({"block": [int(key[0])], "weights": [out.tobytes()]})

    return run


def train(rows: DataFrame) -> Model | None:
    """Codewords and weights from the rows that have a language; None if there are none."""
    spark = rows.sparkSession
    parts = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(counting, "lang string, slot int, n long")
    counts = written(spark, parts.groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        discard(counts)
        return None
    code = codewords(len(langs))
    weights = np.zeros((SLOTS + 1, code.shape[1]), np.float32)
    if code.shape[1]:
        index, total = {name: i for i, name in enumerate(langs)}, np.array([totals[name] for name in langs], float)
        blocks = counts.groupBy(F.expr(f"slot div {BLOCK}").alias("block")).applyInPandas(weights_of(code, index, total), "block long, weights binary")
        for r in blocks.collect():  # SLOTS floats a bit
            weights[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.weights, np.float32).reshape(BLOCK, -1)
    discard(counts)
    return Model(langs, code, weights)


def right(model) -> object:
    """Map: for each language and bit, rows on whose side of 0 the margin is right, and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        index = {name: i for i, name in enumerate(m.langs)}
        good, n = np.zeros(m.code.shape, np.int64), np.zeros(len(m.langs), np.int64)
        for batch in batches:
            own = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            margins = batch.column("margins").flatten().to_numpy().reshape(len(own), -1)
            np.add.at(good, own, (margins > 0) == (m.code[own] > 0))
            np.add.at(n, own, 1)
        at = np.flatnonzero(n)
        bits = m.code.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, bits), pa.int32()), pa.array(np.tile(np.arange(bits), len(at)), pa.int32()), pa.array(good[at].ravel()), pa.array(np.repeat(n[at], bits))], ["lang", "bit", "good", "n"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """A language and a score for each document."""
    spark = docs.sparkSession
    rows = texts(docs)
    model = train(rows)
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(UND).alias("runner_up"), F.lit(True).alias("ambiguous"))
    sent = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            margins, n = m.margins(batch.column("text"))
            at = pa.array(np.arange(len(margins) + 1) * margins.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("lang"), pa.array(n), pa.ListArray.from_arrays(at, pa.array(margins.ravel()))], ["doc_id", "held_out", "lang", "grams", "margins"])

    measured = written(spark, rows.mapInArrow(measure, "doc_id long, held_out boolean, lang string, grams long, margins array<double>"))
    known = measured.where("lang IS NOT NULL AND grams > 0")
    trust = np.full(model.code.shape, 0.5)
    for r in known.select("lang", "margins").mapInArrow(right(sent), "lang int, bit int, good long, n long").groupBy("lang", "bit").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect():
        trust[r.lang, r.bit] = (r.good + 1) / (r.n + 2)
    if trust.size:
        # A row adds to the number of bits, so that languages' losses are of one size.
        model.trust = trust / trust.mean(1, keepdims=True)
    decoder = Model(model.langs, model.code, np.zeros((0, 0), np.float32))
    decoder.trust = model.trust

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("grams").to_numpy()
            near, score, after, doubt = decoder.decode(batch.column("margins").flatten().to_numpy().reshape(len(n), decoder.code.shape[1]))
            names = np.array([*decoder.langs, UND], object)
            none = n == 0
            near, after = np.where(none, len(decoder.langs), near), np.where(none, len(decoder.langs), after)
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(names[near], pa.string()), pa.array(np.where(none, 0.0, np.clip(score, 0, 1))), pa.array(names[after], pa.string()), pa.array(doubt | none)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score", "runner_up", "ambiguous"])

    return measured.select("doc_id", "held_out", "grams", "margins").mapInArrow(decode, "doc_id long, held_out boolean, lang_pred string, score double, runner_up string, ambiguous boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
