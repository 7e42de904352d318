"""Toxicity by compression distance.

Two zstandard dictionaries come from labelled text, both made by zstandard's own trainer: one from pieces of ordinary texts, one from the passages of toxic
texts whose grams are typical of them by likelihood ratio. (Trained on whole toxic texts, the second would hold what all texts share.) Each text is
lower-cased, white space and punctuation become blanks, and every ``GRAM``-byte gram becomes one symbol of ``WIDE`` 8-byte words (hashes), so a match in a
dictionary is a whole shared gram and literals do not compress. Windows of ``WINDOW`` symbols are compressed twice: with the ordinary dictionary, and with
the toxic one laid after it, as a toxic text is ordinary text and more. The margin of a window is how many bytes the second saves over
the first, so what both explain, a licence line say, cancels. A logistic model over the sum of a document's margins, that sum for each window and
its two largest margins, calibrated on labelled rows that gave nothing to the dictionaries, gives the score; a
feature that would speak for the ordinary class is left out, so more margin never lowers a score.

Bounds of the fit: at most ``MAX_TOXIC`` and ``MAX_ORDINARY`` labelled rows, those of least hash of doc_id, of at most ``MAX_CLASS_BYTES`` bytes
in all for each class, no text over ``MAX_TEXT``. Scoring takes every whole text, a window at a time.

Defined cases: null text counts as empty; an empty text has one empty window with margin 0 and so the score of a
text without toxic passages. Rows without a label or with a null label do not train; of several labels the largest
counts; rows of equal id and text train once. Without labels of both kinds every score is the share of toxic labels (0 without any). Repeated documents each
get a row; a null doc_id counts as held in. Other columns are ignored by ``classify`` and kept by ``keep_clean``, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle as pickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import ALNUM, U64, documents, mix, utf8

#: Bytes of a gram, symbols of a window, 8-byte words of a symbol: one shared gram must save more than the gain zstd asks of a block.
GRAM, WINDOW, WIDE = 5, 32, 3
MAX_TOXIC, MAX_ORDINARY, MAX_CLASS_BYTES, MAX_TEXT = 2000, 4000, 12 << 20, 1 << 20
#: Of a gram: least number of toxic documents, least ratio of its rates in toxic and ordinary text, least log-likelihood statistic; most occurrences counted in one document.
LEAST, RATIO, SURE, REPEATS = 4, 6.0, 40.0, 4
#: Most bytes of the toxic and the ordinary dictionary, and of a segment that the trainer lays into one.
TOXIC_BYTES, ORDINARY_BYTES, SEGMENT = 48 << 10, 16 << 10, 240
#: Ordinary texts that its dictionary is trained on, and their pieces.
ORDINARY_TEXTS, ORDINARY_PIECES = 1000, 20_000
#: Bytes that a window's margin must reach to count.
MARGIN = 3
SLOTS = 22
#: Symbols that are compressed at once, a multiple of WINDOW.
BLOCK = 1 << 18


def lowered(data: np.ndarray) -> np.ndarray:
    """A byte run in lower case, bounded by blanks."""
    low = np.full(len(data) + 2, 32, np.uint8)
    low[1:-1] = ALNUM[data]
    return low


def symbols(low: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each gram."""
    n = len(low) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = (h << U64(8)) | low[i : i + n]
    return mix(h * U64(0x9E3779B97F4A7C15))


def wide(sym: np.ndarray) -> np.ndarray:
    return np.stack([mix(sym + U64(k)) for k in range(WIDE)], 1).reshape(-1)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, min_match=7, hash_log=17, chain_log=16, search_log=1, window_log=18, target_length=1, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def cut(sym: np.ndarray) -> list[memoryview]:
    """The windows of some symbols, as the bytes that are compressed."""
    raw, step = memoryview(wide(sym)).cast("B"), 8 * WIDE * WINDOW
    return [raw[a : a + step] for a in range(0, max(len(raw), 1), step)]


class Judge:
    """Scores by a fitted model, with its two compressors."""

    def __init__(self, model: dict):
        self.constant = model.get("constant")
        if self.constant is None:
            self.plain = compressor(model["ordinary"])
            self.toxic = compressor(model["ordinary"] + model["toxic"])
            self.weights = model.get("weights")

    def margins(self, low: np.ndarray) -> np.ndarray:
        """Of each window of a lowered text, which is taken a block at a time."""
        one, two, out = self.plain.compress, self.toxic.compress, [np.zeros(0, np.int64)]
        for a in range(0, len(low) - GRAM + 1, BLOCK):
            runs = cut(symbols(low[a : a + BLOCK + GRAM - 1]))
            out.append(np.fromiter((len(one(r)) - len(two(r)) for r in runs), np.int64, len(runs)))
        return np.concatenate(out) if len(out) > 1 else np.zeros(1, np.int64)

    def score(self, data: np.ndarray) -> float:
        """Of the UTF-8 bytes of a text."""
        if self.constant is not None:
            return self.constant
        z = float(np.dot(self.weights, [1.0, *features(self.margins(lowered(data)))]))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def features(m: np.ndarray) -> list[float]:
    top = np.sort(m)[-2:]
    total = float(m[m >= MARGIN].sum())
    return [float(np.log1p(total)), float(np.log((total + 1) / (len(m) + 20))), max(0.0, float(top[-1])), max(0.0, float(top[0])) if len(m) > 1 else 0.0]


def occurrences(docs: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each slot the number of documents and of occurrences (REPEATS of a document at most), and the number of all grams."""
    df, out, total = np.zeros(1 << SLOTS, np.int32), np.zeros(1 << SLOTS, np.int32), 0
    for h in docs:
        slot, n = np.unique((h >> U64(64 - SLOTS)).astype(np.int64), return_counts=True)
        df[slot] += 1
        out[slot] += np.minimum(n, REPEATS).astype(np.int32)
        total += len(h)
    return df, out, total


def typical(docs: Iterable[np.ndarray], ordinary: Iterable[np.ndarray]) -> np.ndarray:
    """The slots whose grams are more frequent in toxic text, by likelihood ratio."""
    df, toxic, n = occurrences(docs)
    _, plain, m = occurrences(ordinary)
    at = np.flatnonzero(df >= LEAST)
    a, b = toxic[at].astype(float), plain[at].astype(float)
    share = n / max(1, n + m)
    g = 2 * (a * np.log(a / ((a + b) * share)) + b * np.log(np.maximum(b, 1e-9) / np.maximum((a + b) * (1 - share), 1e-9)))
    good = np.zeros(1 << SLOTS, bool)
    good[at[((a + 0.5) * max(1, m) > RATIO * (b + 0.5) * n) & (g > SURE)]] = True
    return good


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary by zstandard's trainer; of too little text, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=8, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def toxic_dictionary(docs: list[np.ndarray], ordinary: Iterable[np.ndarray]) -> bytes:
    """From the runs of typical grams in toxic texts, each occurrence a sample."""
    good = typical(docs, ordinary)
    samples = []
    for sym in docs:
        ok = np.concatenate([[False], good[(sym >> U64(64 - SLOTS)).astype(np.int64)], [False]]).astype(np.int8)
        edge = np.flatnonzero(np.diff(ok))
        samples += [wide(sym[a:b]).tobytes() for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return trained(samples, TOXIC_BYTES)


def ordinary_dictionary(docs: list[np.ndarray]) -> bytes:
    return trained([wide(s).tobytes() for d in docs for s in np.array_split(d, max(1, len(d) // 128)) if len(s)][:ORDINARY_PIECES], ORDINARY_BYTES)


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights (intercept first) that are not negative: the most negative feature is left out until none is."""
    keep = list(range(x.shape[1]))
    while True:
        a = np.column_stack([np.ones(len(x)), x[:, keep]])
        mean, spread = a[:, 1:].mean(0), a[:, 1:].std(0) + 1e-9
        a[:, 1:] = (a[:, 1:] - mean) / spread
        w, ridge = np.zeros(a.shape[1]), 1e-2 * np.eye(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if len(keep) == 1 or w[1:].min() >= 0:
            break
        keep.pop(int(w[1:].argmin()))
    out = np.zeros(x.shape[1] + 1)
    out[1 + np.array(keep)] = w[1:] / spread
    out[0] = w[0] - (w[1:] / spread) @ mean
    return out


def fit(rows: list[tuple[str, int]]) -> dict:
    """rows: text and label. The dictionaries come from two thirds of them, the weights from the rest."""
    rows = list(dict.fromkeys(rows))
    low = lambda i: lowered(np.frombuffer(rows[i][0].encode(), np.uint8))
    of = lambda i: symbols(low(i))
    y = np.array([v for _, v in rows], float)
    if not len(rows) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(rows) else 0.0}
    rank = np.zeros(len(rows), int)
    for v in (0.0, 1.0):
        rank[y == v] = np.arange(int((y == v).sum()))
    learn = rank % 3 != 2
    plain = np.flatnonzero(learn & (y == 0)).tolist()
    model = {"toxic": toxic_dictionary([of(i) for i in np.flatnonzero(learn & (y == 1)).tolist()], map(of, plain)), "ordinary": ordinary_dictionary([of(i) for i in plain[:ORDINARY_TEXTS]])}
    held = ~learn if len({*y[~learn]}) == 2 else learn | True
    judge = Judge(model)
    x = np.array([features(judge.margins(low(i))) for i in np.flatnonzero(held).tolist()])
    return model | {"weights": calibrated(x, y[held])}


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from a bounded sample of the labelled rows."""
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    kept = kept.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    some = lambda df, of: df.orderBy(order, *of).where("toxic = 1").limit(MAX_TOXIC).union(df.orderBy(order, *of).where("toxic = 0").limit(MAX_ORDINARY))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= MAX_TEXT)
    rows = some(text.join(F.broadcast(some(kept, [])), "doc_id").dropDuplicates(["doc_id", "text"]), ["text"])
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(order, "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= MAX_CLASS_BYTES).orderBy(order, "text").select("text", "toxic").toArrow()
    return fit(list(zip(rows["text"].to_pylist(), rows["toxic"].to_pylist(), strict=True)))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """row, all columns of a document as one, and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(pickle.loads(shared.value))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = [judge.score(data[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(docs, train(docs, labels)).select("row.doc_id", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, columns unchanged, that are not predicted toxic."""
    return scored(docs, train(docs, labels)).where("score < 0.5").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
