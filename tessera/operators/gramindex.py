"""Which of many keys each of many texts contains: an inverted index of grams.

A gram is a run of 1 to 16 bytes as a number of 64 bits. Every key is filed under one of its grams of the longest size in ``SIZES`` that it has: the one that the texts hold least
often. Texts are reduced to the distinct grams that keys are filed under, an equi-join finds the keys to try, and ``contains`` decides. Nothing depends on the
number of keys: they are told to the tasks as a bitmap of their grams, of a size that is bounded (``BITS``), and what a full bitmap lets through only makes the
join longer. A very common gram is a skewed join, which Spark splits.

The texts are read twice as bytes: to count the keys' grams in them, and to find those that keys were filed under.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import discard, written

#: Sizes of grams in bytes. Up to eight they are their bytes, longer ones are hashed from their first and last eight.
SIZES = (1, 2, 3, 4, 6, 8, 11, 16)
#: Bits of the bitmap at least and at most (32 MB), and bits for each gram in it. A bucket of Spark's bitmap functions has 32768 bits.
BITS, PER_KEY, BUCKET = (1 << 20, 1 << 28), 128, 1 << 15
#: Counters of grams in texts; a gram counts for as frequent as all keys' grams that share its counter.
COUNTERS = 1 << 18
#: Bytes of text that are looked at in one go.
PART = 1 << 20


def _hash(gram: np.ndarray, size: int) -> np.ndarray:
    h = (gram ^ np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def slot(gram: np.ndarray, size: int, slots: int) -> np.ndarray:
    """A gram's place among ``slots``, a power of two."""
    return (_hash(gram, size) >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The gram that begins at each byte, as many as there are."""
    n = max(0, len(data) - size + 1)
    if size >= 8 and n:
        eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (data.strides[0], data.strides[0])).copy().view("<u8").ravel()
        return eight if size == 8 else _hash(eight[:n], size) + eight[size - 8 :] * np.uint64(0x9FB21C651E98DF25)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out |= data[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return out


def size_of(length: np.ndarray) -> np.ndarray:
    """The longest size of gram that so many bytes have; 0 for none."""
    return np.array((0, *SIZES))[np.searchsorted(SIZES, length, "right")]


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column end to end, and where its rows begin and end; null counts as empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _parts(data: np.ndarray, lo: int, hi: int, size: int) -> Iterator[np.ndarray]:
    """Grams of one row, a part at a time; parts overlap so that each gram is in one."""
    for a in range(lo, max(lo, hi - size + 1), PART):
        yield grams(data[a : min(hi, a + PART + size - 1)], size)


def _rows(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, gram) of many rows at once: those that fit a part together, or a part of a longer one."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART, "right")) - 1)
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo > PART:
            for g in _parts(data, lo, hi, size):
                yield np.full(len(g), a), g
        else:
            g = grams(data[lo:hi], size)
            row = np.repeat(np.arange(a, b), np.diff(offsets[a : b + 1]))
            # A gram that would go on in the next row is none.
            own = row[: len(g)] == row[size - 1 :]
            yield row[: len(g)][own], g[own]
        a = b


def _sizes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and bounds of keys, and the size of their grams."""
    data, offsets = _raw(column)
    return data, offsets, size_of(np.diff(offsets))


def placing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map: the places of all grams of the keys."""
    for batch in batches:
        data, offsets, own = _sizes(batch.column("raw"))
        for size in np.unique(own).tolist():
            for row, gram in _rows(data, offsets, size):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(slot(gram[own[row] == size], size, BITS[1])))], ["place"])


def filing(sent):
    """Map: (key, size, gram, place) with the gram that each key is filed under, the one of least count, of equals the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            data, offsets, sizes = _sizes(batch.column("raw"))
            out, place = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.int64)
            best = np.full(len(sizes), np.iinfo(np.int64).max)
            for size in np.unique(sizes).tolist():
                for row, gram in _rows(data, offsets, size):
                    own = sizes[row] == size
                    row, gram = row[own], gram[own]
                    n = counts[slot(gram, size, COUNTERS)]
                    order = np.lexsort((gram, n, row))
                    row, gram, n = row[order], gram[order], n[order]
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    row, gram, n = row[first], gram[first], n[first]
                    less = (n < best[row]) | ((n == best[row]) & (gram < out[row]))
                    out[row[less]], best[row[less]] = gram[less], n[less]
                place[sizes == size] = slot(out[sizes == size], size, BITS[1])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes.astype(np.int32)), pa.array(out.view(np.int64)), pa.array(place)], ["key", "size", "gram", "place"])

    return run


class Filter:
    """A bitmap of grams, and the sizes that they have."""

    def __init__(self, bits: int, raw: dict[int, bytes], sizes: list[int]):
        self.bits, self.sizes = bits, sizes
        self.map = np.zeros(bits // 8, np.uint8)
        for bucket, part in raw.items():
            at = (bucket - 1) * (BUCKET // 8)  # buckets are numbered from 1
            self.map[at : at + len(part)] = np.frombuffer(part, np.uint8)[: len(self.map) - at]

    def holds(self, gram: np.ndarray, size: int) -> np.ndarray:
        s = slot(gram, size, self.bits)
        return (self.map[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def filter_of(places: DataFrame, n: int, sizes: list[int]) -> Filter:
    """The bitmap of about n places, brought together by Spark in buckets of 4 KB."""
    bits = min(BITS[1], max(BITS[0], 1 << max(0, PER_KEY * n - 1).bit_length()))
    at = F.shiftright("place", BITS[1].bit_length() - bits.bit_length())
    rows = places.select(at.alias("at")).groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("part"))
    return Filter(bits, {r.bucket: bytes(r.part) for r in rows.collect()}, sizes)


def counting(sent):
    """Map: the grams of a task's texts that the filter lets through, by counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, n = sent.value, np.zeros(COUNTERS, np.int64)
        for batch in batches:
            data, offsets = _raw(batch.column("raw"))
            for size in f.sizes:
                for _, gram in _rows(data, offsets, size):
                    n += np.bincount(slot(gram[f.holds(gram, size)], size, COUNTERS), minlength=COUNTERS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["counter", "n"])

    return run


def meeting(sent):
    """Map: the distinct grams of each text that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for batch in batches:
            data, offsets = _raw(batch.column("raw"))
            for size in f.sizes:
                for row, gram in _rows(data, offsets, size):
                    hit = f.holds(gram, size)
                    row, gram = row[hit], gram[hit]
                    order = np.lexsort((gram, row))
                    row, gram = row[order], gram[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
                    row, gram = row[new], gram[new]
                    yield pa.RecordBatch.from_arrays([batch.column("uid").take(pa.array(row)), pa.array(np.full(len(row), size, np.int32)), pa.array(gram.view(np.int64))], ["uid", "size", "gram"])

    return run


def candidates(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """texts: (uid, text), uid telling rows apart and stable if read again; keys: (key) and what goes with it, read several times. Rows (uid, key, ...): all keys that a text holds, and
    some more that it has but a gram of; some more than once."""
    spark: SparkSession = texts.sparkSession
    own = written(keys.select("key").where("key <> ''").distinct().withColumn("raw", F.encode("key", "utf-8")))
    long = F.octet_length("raw")
    size = F.lit(0)
    for x in SIZES:
        size = F.when(long >= x, x).otherwise(size)
    per = own.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.sum(long - size + 1).alias("grams")).collect()  # a row a size
    sizes = sorted(r["size"] for r in per)
    raw = texts.select("uid", F.encode("text", "utf-8").alias("raw"))
    sent = spark.sparkContext.broadcast(filter_of(own.mapInArrow(placing, "place long"), sum(r["grams"] for r in per), sizes))
    counts = np.zeros(COUNTERS, np.int64)
    for r in raw.mapInArrow(counting(sent), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[r.column("counter").to_numpy()] = r.column("n").to_numpy()
    sent.destroy()
    sent = spark.sparkContext.broadcast(counts)
    filed = written(own.mapInArrow(filing(sent), "key string, size int, gram long, place long"))
    sent.destroy()
    discard(own)
    sent = spark.sparkContext.broadcast(filter_of(filed.select("place"), sum(r["n"] for r in per), sizes))
    full = keys.join(filed.select("key", "size", "gram"), "key")
    return raw.mapInArrow(meeting(sent), "uid long, size int, gram long").join(full, ["size", "gram"]).select("uid", *keys.columns)


def holding(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """As ``candidates``, decided and with the text: a row (uid, text, key, ...) for each text and distinct row of ``keys`` whose key is in it. Empty and null keys are in none."""
    found = candidates(texts, keys).repartition("uid").distinct()
    return texts.select("uid", "text").join(found, "uid").where(F.contains("text", "key"))
